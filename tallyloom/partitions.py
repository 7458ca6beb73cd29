"""Partition counts of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan that yields fewer partitions than there are cores, dealt out over all of them.

    For work that costs more than moving its rows. A scan with enough
    partitions, as any large table has, is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
