"""Latest rows, bounded top-n per key and the top-decile mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.text import python_float
from tallyloom.operators.ordering import values_at_ranks


def top_n(df: DataFrame, order_by: list[Column], n: int) -> DataFrame:
    """First n rows of the whole table; each task keeps n rows."""
    return df.orderBy(*order_by).limit(n)


def top_n_per_key(df: DataFrame, keys: list[str], order_by: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key.

    The rank filter is pushed below the shuffle (window group limit), so a key
    that holds a third of the table ships n rows per task. Name every column
    that breaks ties in `order_by`.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def latest(df: DataFrame, by: Column, ties: list[Column]) -> DataFrame:
    """The row with the greatest `by`, the first in `ties` order when several share it."""
    return top_n(df, [by.desc(), *ties], 1)


def latest_per_key(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    return top_n_per_key(df, keys, by, 1)


def top_decile_mean(df: DataFrame, score: Column) -> DataFrame:
    """Mean of the highest tenth of the scores (at least one); 0.0 when there is none.

    The cut is an exact order statistic between bracketed ranks. Scores above it are
    summed in a scan and the cut fills what is left of the tenth, so the scores are
    neither sorted nor shuffled.
    """
    value = score.cast("double")
    scores = df.select(F.when(~F.isnan(value), value).alias("score")).where(F.col("score").isNotNull())
    total = scores.count()
    if not total:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("top_decile_mean"), F.lit(0).cast("long").alias("n_scores"))
    k = max(1, total // 10)
    cut = values_at_ranks(scores, {"score": F.col("score")}, {"score": [total - k]}, {"score": total})["score", total - k]
    above = F.col("score") > cut
    filled = F.coalesce(F.sum(F.when(above, F.col("score"))), F.lit(0.0)) + (F.lit(k) - F.count(F.when(above, 1))) * F.lit(cut)
    return scores.agg((filled / F.lit(k)).alias("top_decile_mean"), F.lit(total).cast("long").alias("n_scores"))


def text_scores(df: DataFrame, score: str) -> DataFrame:
    """Rows whose score text is a number, with the number."""
    return df.withColumn(score, python_float(F.col(score))).where(F.col(score).isNotNull())
