"""Imputation, scaling, category coding and exact splits.

Fitted values are one number per column. Everything data-sized stays in
DataFrames, category vocabularies included.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.local import local_table
from tallyloom.operators.ordering import OrderedCounts, order_counts, value_counts, without_nan
from tallyloom.operators.profile import by_counting_type


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return df.agg(*[F.avg(without_nan(df, c)).alias(c) for c in columns]).first().asDict()


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, the lowest on ties, counted with a hash aggregation."""
    modes: dict[str, object] = dict.fromkeys(columns)
    for kind, names in by_counting_type(df, columns):
        best = F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")
        found = value_counts(df, names, kind).groupBy("column_name").agg(best)
        modes.update({row.column_name: row.mode for row in found.collect()})
    return modes


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Missing (null or NaN) cells of the named columns replaced by a fitted value; a projection."""
    filled = {c: F.coalesce(without_nan(df, c), F.lit(v)) for c, v in values.items() if v is not None}
    return df.withColumns(filled)


def column_scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column scales by 1."""
    measured = [f(without_nan(df, c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*measured).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, code, width): codes number the distinct values of a text column in order from 0."""
    counts = value_counts(df, columns).withColumn("n", F.lit(1).cast("long"))
    ordered = order_counts(counts)
    starts = [(c, b.block, b.below, ordered.distinct(c)) for c, blocks in ordered.blocks.items() for b in blocks]
    offsets = local_table(df.sparkSession, starts, "column_name string, block int, below long, width long")
    place = F.row_number().over(W.partitionBy("column_name", "block").orderBy("value"))
    return ordered.values.join(F.broadcast(offsets), ["column_name", "block"]).select(
        "column_name", "value", (F.col("below") + place - 1).alias("code"), "width"
    )


def one_hot(df: DataFrame, id_column: str, columns: list[str], codes: DataFrame) -> DataFrame:
    """Sparse one-hot rows (id, column_name, hot): the position of the 1, null where the value is unknown (all zeros)."""
    long = df.select(id_column, *columns).unpivot([id_column], columns, "column_name", "value")
    return long.join(codes, ["column_name", "value"], "left").select(id_column, "column_name", F.col("code").alias("hot"))


def split_hash(key, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _hex(share: float) -> str:
    """The share of the hash range as a hash text to compare with."""
    return f"{min(max(int(share * 2**64), 0), 2**64 - 1):016x}".ljust(32, "0")


def mark_test_rows(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `is_test`, true for exactly ceil(share * n) rows of a unique key, repeatable for a seed.

    The rows with the lowest key hashes are the test set. Hashes are uniform,
    so the cut lies in a known narrow band; only rows of that band are put in
    order, the rest is counted. Should the cut fall outside, all are ordered. A null
    key raises.
    """
    refused = F.raise_error(F.lit(f"{key} is null")).cast(df.schema[key].dataType)
    df = df.withColumn(key, F.coalesce(F.col(key), refused))
    hashed = df.withColumn("__hash", split_hash(F.col(key), seed))
    n = df.count()
    k = ceil(test_share * n)
    if k <= 0 or k >= n:
        return df.withColumn("is_test", F.lit(k > 0))
    margin = 6 * sqrt(test_share * (1 - test_share) / n)
    low, high = _hex(test_share - margin), _hex(test_share + margin)
    hashes = hashed.select("__hash")
    below = hashes.where(F.col("__hash") < low).count()
    band = _ordered_hashes(hashes.where((F.col("__hash") >= low) & (F.col("__hash") < high)))
    if not below < k <= below + band.total("__hash"):
        below, band = 0, _ordered_hashes(hashes)
    cut = band.at_ranks({"__hash": [k - 1 - below]}).first()["value"]
    return hashed.withColumn("is_test", F.col("__hash") <= cut).drop("__hash")


def _ordered_hashes(hashes: DataFrame) -> OrderedCounts:
    return order_counts(value_counts(hashes, ["__hash"]))
