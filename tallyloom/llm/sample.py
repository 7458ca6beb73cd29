"""Bounded samples to fit on, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drawn(df: DataFrame, most: int, *keys: str | Column) -> DataFrame:
    """At most `most` rows, those whose hashed keys lie lowest. Each task sends its share of them, not `most` rows of its own."""
    share = min(1.0, most / max(1, df.count()))
    place = F.xxhash64(*keys).cast("double") / float(1 << 64) + 0.5
    few = df.withColumn("place_", place)
    few = few if share == 1.0 else few.where(F.col("place_") < share)
    return few.orderBy("place_", *keys).limit(most).drop("place_")
