from tallyloom.partitions import spread


def test_only_small_scans_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    small, large = spark.range(100, numPartitions=1), spark.range(100, numPartitions=cores)
    assert spread(small).rdd.getNumPartitions() == cores
    assert spread(large) is large
    assert sorted(r.id for r in spread(small).collect()) == list(range(100))
