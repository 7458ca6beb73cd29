"""Stateful operators over streams, as idempotent micro-batch folds.

Each micro-batch is reduced with the batch operator (which combines map-side, so
a hot key is no problem) and merged with the state the previous batch wrote.
State of batch N lives in its own folder, so a batch that is retried after a
failure overwrites its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tallyloom.operators.memory import MAX_ITEMS, strongest
from tallyloom.operators.ranking import latest_per_key
from tallyloom.scratch import finished_batches


def _state(spark: SparkSession, path: str, batch: int, schema: T.StructType) -> DataFrame:
    if batch < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch}")


def memory_stream(
    items: DataFrame, owner: str, importance: str, seq: str, path: str, checkpoint: str, n: int = MAX_ITEMS, trigger: dict | None = None
) -> StreamingQuery:
    """Keep each owner's n strongest items of an unbounded stream; the state is n rows per owner."""
    schema = items.schema

    def fold(batch: DataFrame, batch_id: int) -> None:
        known = _state(batch.sparkSession, path, batch_id - 1, schema)
        merged = strongest(known.unionByName(batch), owner, importance, seq, n).select(*schema.fieldNames())
        merged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return items.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upsert_stream(changes: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each batch's winning change per key; `current` resolves the table. Cost follows the changes, not the table."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: str) -> DataFrame:
    """The upserted table: the newest change per key over all batches."""
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return latest_per_key(changes, keys, [F.desc(order)])


def memory_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """State after the newest batch that was written whole; empty before the first."""
    return _state(spark, path, max(finished_batches(spark, path), default=-1), schema)
