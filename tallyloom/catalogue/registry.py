"""Named queries over the shared tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.partitions import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table over all cores, for queries that compute a lot per row."""
        return spread(getattr(self, name))


def query(sql: str | None = None, name: str | None = None):
    """Register a function of `Tables` under its own name."""

    def register(function: Callable[[Tables], DataFrame]):
        key = name or function.__name__
        QUERIES[key] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded for comparison, with minus zero as zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def null_where(column: str, value) -> Column:
    """The column with one of its values turned into null: the tables hold no nulls of their own."""
    return F.nullif(F.col(column), F.lit(value))
