"""Classification measures from (truth, prediction) pairs; every job shuffles class counts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.local import local_table


def accuracy(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.col(truth).eqNullSafe(F.col(prediction)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, truth: str, prediction: str, classes: list) -> DataFrame:
    """One row and one column predicted_<class> per class, zero where nothing fell. Values that are no class raise."""

    def known(c: str) -> Column:
        other = F.raise_error(F.concat(F.lit(f"{c} is no class: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
        return F.when(F.coalesce(F.col(c).isin(classes), F.lit(False)), F.col(c)).otherwise(other.cast(df.schema[c].dataType)).alias(c)

    counted = df.select(known(truth), known(prediction)).groupBy(truth).pivot(prediction, classes).agg(F.count(F.lit(1)))
    listed = local_table(df.sparkSession, [(c,) for c in classes], T.StructType([T.StructField(truth, df.schema[truth].dataType)]))
    return listed.join(counted, truth, "left").select(
        truth, *[F.coalesce(F.col(f"`{c}`"), F.lit(0).cast("long")).alias(f"predicted_{c}") for c in classes]
    )


def class_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(label, precision, recall, f1, support) per class, then accuracy, macro and weighted averages."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")

    def side(label: str, support, predicted, hits):
        return F.struct(F.col(label).cast("string").alias("label"), support.alias("s"), predicted.alias("q"), hits.cast("long").alias("h"))

    sides = pairs.select(F.inline(F.array(side("t", F.col("n"), zero, hit), side("p", zero, F.col("n"), zero))))
    classes = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    hits, support = F.col("hits"), F.col("support")
    measured = classes.select(
        "label", "support", "hits", ratio(hits, F.col("predicted")).alias("precision"), ratio(hits, support).alias("recall")
    ).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    rolled = measured.rollup("label").agg(
        F.grouping("label").alias("is_total"),
        F.sum("support").alias("support"),
        F.sum("hits").alias("hits"),
        *[F.avg(m).alias(m) for m in names],
        *[ratio(F.sum(F.col(m) * support), F.sum(support)).alias(f"weighted_{m}") for m in names],
    )
    share = ratio(F.col("hits"), support)

    def line(label, values):
        return F.struct(label.alias("label"), *[v.alias(m) for v, m in zip(values, names)], F.col("support"))

    totals = F.array(
        line(F.lit("accuracy"), [share] * 3),
        line(F.lit("macro avg"), [F.col(m) for m in names]),
        line(F.lit("weighted avg"), [F.col(f"weighted_{m}") for m in names]),
    )
    own = F.array(line(F.col("label"), [F.col(m) for m in names]))
    return rolled.select(F.inline(F.when(F.col("is_total") == 1, totals).otherwise(own)))
