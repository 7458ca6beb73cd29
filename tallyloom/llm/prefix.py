"""Running sums and row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.scratch import materialize


def numbered(df: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """`df` with `number` (from 0 in this order) and `before` (sum of `value` over the rows ahead).

    Rows are laid out in ranges once and stored; only each range's count and sum
    go through the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.withColumn("value_", value).repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), "ranges")
    of_part = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    heads = laid.groupBy("part_").agg(F.count("*").alias("rows_"), F.sum("value_").alias("sum_"))
    heads = heads.select("part_", F.coalesce(F.sum("rows_").over(of_part), F.lit(0)).alias("rows_"), F.coalesce(F.sum("sum_").over(of_part), F.lit(0)).alias("sum_"))
    inside = Window.partitionBy("part_").orderBy(*order)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    found = laid.join(F.broadcast(heads), "part_")
    found = found.withColumn("number", F.col("rows_") + F.row_number().over(inside) - 1)
    found = found.withColumn("before", F.col("sum_") + F.coalesce(F.sum("value_").over(ahead), F.lit(0)))
    return found.drop("part_", "rows_", "sum_", "value_")


def numbered_in_groups(df: DataFrame, group: str, bucket: Column, order: list[Column], value: Column) -> DataFrame:
    """`df` with `number`, `before` and `bucket` per group, for groups of any size.

    `bucket` must not decrease in `order`; a bucket of a group is what one task
    sorts, and a group's buckets are what one task sums up.
    """
    df = df.withColumn("bucket", bucket).withColumn("value_", value)
    ahead = Window.partitionBy("g_").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy(F.col(group).alias("g_"), F.col("bucket").alias("b_")).agg(F.count("*").alias("rows_"), F.sum("value_").alias("sum_"))
    heads = heads.select("g_", "b_", F.coalesce(F.sum("rows_").over(ahead), F.lit(0)).alias("rows_"), F.coalesce(F.sum("sum_").over(ahead), F.lit(0)).alias("sum_"))
    inside = Window.partitionBy(group, "bucket").orderBy(*order)
    found = df.join(heads, (F.col(group) == F.col("g_")) & (F.col("bucket") == F.col("b_")))
    found = found.withColumn("number", F.col("rows_") + F.row_number().over(inside) - 1)
    found = found.withColumn("before", F.col("sum_") + F.coalesce(F.sum("value_").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return found.drop("g_", "b_", "rows_", "sum_", "value_")
