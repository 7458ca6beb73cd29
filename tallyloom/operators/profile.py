"""Dataset profile: shape, types, missing, distinct and numeric summaries."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.local import local_table
from tallyloom.operators.ordering import WHOLE, value_counts, values_at_ranks, without_nan

QUARTILES = [0.25, 0.5, 0.75]


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f)]


def by_counting_type(df: DataFrame, columns: list[str]) -> list[tuple[T.DataType, list[str]]]:
    """Columns grouped by the type their values can be compared in without loss."""
    groups: dict[str, tuple[T.DataType, list[str]]] = {}
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, WHOLE):
            kind = T.LongType()
        elif isinstance(kind, T.FloatType):
            kind = T.DoubleType()
        groups.setdefault(kind.simpleString(), (kind, []))[1].append(name)
    return list(groups.values())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def per_column(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """One global aggregation over all columns, laid out as one row per column.

    `measures` maps an output name to a function of the (NaN-free) column.
    Every task ships one partial row, whatever the table size.
    """
    cells = []
    for name in columns:
        column = without_nan(df, name)
        made = [make(column).alias(alias) for alias, make in measures.items()]
        cells.append(F.struct(F.lit(name).alias("column_name"), *made))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def pandas_type(kind: T.DataType, has_missing: bool = False) -> str:
    """Type name in pandas terms; whole numbers and booleans lose their type when values are missing."""
    if isinstance(kind, WHOLE):
        return "float64" if has_missing else "int64"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(kind, T.BooleanType):
        return "object" if has_missing else "bool"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    return "object"


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return per_column(df, columns or df.columns, {"n_missing": lambda c: F.count_if(c.isNull())})


def reported_types(df: DataFrame) -> DataFrame:
    """Spark type and pandas type per column; the latter depends on whether values are missing."""
    names = [
        (f.name, f.dataType.simpleString(), pandas_type(f.dataType), pandas_type(f.dataType, has_missing=True))
        for f in df.schema.fields
    ]
    types = local_table(df.sparkSession, names, "column_name string, spark_type string, whole string, with_gaps string")
    shown = F.when(F.col("n_missing") > 0, F.col("with_gaps")).otherwise(F.col("whole"))
    return missing_counts(df).join(F.broadcast(types), "column_name").select(
        "column_name", "spark_type", shown.alias("pandas_type")
    )


def missing_mask(df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns as they are, every other column as a missing flag."""
    return df.select(*keep, *[without_nan(df, c).isNull().alias(c) for c in df.columns if c not in keep])


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct count per column, missing values excluded.

    Two hash aggregations with map-side combining; nothing is held per column.
    """
    columns = columns or df.columns
    counted = union_all([value_counts(df, names, kind).select("column_name") for kind, names in by_counting_type(df, columns)])
    return all_columns(counted.groupBy("column_name").agg(F.count("*").alias("n_unique")), columns, {"n_unique": 0})


def all_columns(measured: DataFrame, columns: list[str], defaults: dict) -> DataFrame:
    """Add rows for columns that have no value at all."""
    names = local_table(measured.sparkSession, [(c,) for c in columns], "column_name string")
    return F.broadcast(names).join(measured, "column_name", "left").fillna(defaults)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max and missing per numeric column.

    One aggregation for the moments, then exact quartiles between bracketed ranks:
    no column is shuffled. The driver holds a few numbers per column.
    """
    columns = columns or numeric_columns(df)
    numbers = {c: without_nan(df, c).cast("double") for c in columns}
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(F.count("*").alias("rows"), *[f(v).alias(f"{m}_{i}") for i, v in enumerate(numbers.values()) for m, f in measures.items()]).first()
    facts = {c: {m: row[f"{m}_{i}"] for m in measures} for i, c in enumerate(columns)}
    totals = {c: facts[c]["count"] for c in columns}
    spots = {c: [p * (totals[c] - 1) for p in QUARTILES] for c in columns if totals[c]}
    found = values_at_ranks(df, numbers, {c: [r for spot in own for r in (floor(spot), ceil(spot))] for c, own in spots.items()}, totals)

    def quartile(c: str, k: int) -> float | None:
        if c not in spots:
            return None
        low, high = found[c, floor(spots[c][k])], found[c, ceil(spots[c][k])]
        return low + (high - low) * (spots[c][k] - floor(spots[c][k]))

    lines = [
        (c, totals[c], *(facts[c][m] for m in ("mean", "std", "min")), *(quartile(c, k) for k in range(len(QUARTILES))), facts[c]["max"], row["rows"] - totals[c])
        for c in columns
    ]
    at = ", ".join(f"p{int(p * 100)} double" for p in QUARTILES)
    return local_table(df.sparkSession, lines, f"column_name string, count long, mean double, std double, min double, {at}, max double, n_missing long")


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value of each column as text, lowest value on ties, with its frequency."""
    parts = []
    for kind, names in by_counting_type(df, columns):
        best = value_counts(df, names, kind).groupBy("column_name").agg(
            F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("best"),
            F.count("*").alias("unique"),
            F.sum("n").alias("count"),
        )
        parts.append(
            best.select("column_name", "count", "unique", F.col("best.value").cast("string").alias("top"), F.col("best.n").alias("freq"))
        )
    return union_all(parts)


def describe_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Summary over every column: frequency figures for non-numeric, moments and quartiles for numeric."""
    columns = columns or df.columns
    numeric = [c for c in columns if is_numeric(df.schema[c])]
    other = [c for c in columns if c not in numeric]
    parts = []
    if other:
        empty = [F.lit(None).cast("double").alias(a) for a in ("mean", "std", "min", "p25", "p50", "p75", "max")]
        found = all_columns(top_values(df, other), other, {"count": 0, "unique": 0})
        parts.append(found.select("column_name", "count", "unique", "top", "freq", *empty))
    if numeric:
        parts.append(
            describe(df, numeric).select(
                "column_name",
                "count",
                F.lit(None).cast("long").alias("unique"),
                F.lit(None).cast("string").alias("top"),
                F.lit(None).cast("long").alias("freq"),
                "mean", "std", "min", "p25", "p50", "p75", "max",
            )
        )
    return union_all(parts)


def head(df: DataFrame, order_by: list, n: int = 5) -> DataFrame:
    """First rows in a stated order; planned as a per-task top-n."""
    return df.orderBy(*order_by).limit(n)
