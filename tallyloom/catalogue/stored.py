"""Queries over a log stored in buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalogue.logs import _CHANGES, _SET, CKPT, SHOWN, checkpoints, order_changes
from tallyloom.catalogue.registry import Tables, query
from tallyloom.operators import keyed_log as k
from tallyloom.operators.stored_log import StoredLog
from tallyloom.scratch import new_path


def stored_checkpoints(t: Tables) -> StoredLog:
    return StoredLog.create(
        checkpoints(t), new_path(t.spark, "checkpoints"), k.CHECKPOINT, k.THREAD, buckets=32, bloom=("checkpoint_id",), parsed=("metadata",)
    )


def stored_orders(t: Tables) -> StoredLog:
    base = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return StoredLog.create(base, new_path(t.spark, "orders"), ["o_orderkey"], ["o_orderkey"], buckets=32)


@query("SELECT doc_id, lang, source, text FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def stored_point_lookup(t: Tables):
    log = StoredLog.create(t.documents.select("doc_id", "lang", "source", "text"), new_path(t.spark, "documents"), ["doc_id"], ["doc_id"], buckets=32)
    return log.find(doc_id=t.documents.agg(F.max("doc_id")).first()[0])


@query(f"SELECT thread_id, checkpoint_id, type, checkpoint FROM {CKPT} WHERE thread_id = (SELECT max(user_id) FROM events) ORDER BY checkpoint_id DESC LIMIT 1")
def stored_checkpoint_latest(t: Tables):
    thread = t.events.agg(F.max("user_id")).first()[0]
    return stored_checkpoints(t).find([F.desc("checkpoint_id")], thread_id=thread, checkpoint_ns="").select(*SHOWN)


@query(
    f"WITH c AS (SELECT *, min(checkpoint_id) OVER (PARTITION BY thread_id) AS oldest FROM {CKPT}) "
    "SELECT thread_id, checkpoint_id, type, checkpoint FROM c WHERE checkpoint_id = oldest AND thread_id % 3 = 0"
)
def stored_checkpoints_by_id(t: Tables):
    wanted = checkpoints(t).where("thread_id % 3 = 0").groupBy(*k.THREAD).agg(F.min("checkpoint_id").alias("checkpoint_id"))
    return stored_checkpoints(t).find_all(wanted).select(*SHOWN)


@query(f"SELECT thread_id, checkpoint_id, type, checkpoint FROM {CKPT} WHERE json_extract_string(metadata, '$.k') = '24'")
def stored_metadata_filter(t: Tables):
    return stored_checkpoints(t).list(metadata={"k": 24}).select(*SHOWN)


@query(
    f"WITH {_CHANGES} SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM win) "
    "UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM win"
)
def stored_upsert(t: Tables):
    changes = order_changes(t).withColumn("o_orderdate", F.lit(None).cast(t.orders.schema["o_orderdate"].dataType))
    return stored_orders(t).upsert(changes, [F.desc("ver")]).rows().select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(_SET.format(join="FULL"))
def stored_update_fields(t: Tables):
    log = stored_orders(t).set_fields(order_changes(t), ["o_totalprice"], [F.desc("ver")], insert=True)
    return log.rows().withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "WITH w AS (SELECT l_orderkey AS checkpoint_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS task_id, 0 AS idx, l_returnflag AS channel, l_quantity AS value FROM lineitem), "
    "ch AS (SELECT l_orderkey AS checkpoint_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS task_id, 0 AS idx, 'quantity' AS channel, l_quantity + 1 AS value FROM lineitem WHERE l_orderkey % 7 = 0 "
    "UNION ALL SELECT l_orderkey, l_partkey || '-' || l_suppkey || '-' || l_linenumber, 1, 'price', l_extendedprice FROM lineitem WHERE l_orderkey % 7 = 0) "
    "SELECT w.* FROM w WHERE checkpoint_id % 7 <> 0 UNION ALL SELECT * FROM ch"
)
def stored_bulk_upsert(t: Tables):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("thread_id"), F.lit("").alias("checkpoint_ns"), F.col("l_orderkey").alias("checkpoint_id"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]).alias("task_id"), "l_returnflag", "l_quantity", "l_extendedprice",
    )
    base = lines.select(*k.CHECKPOINT, "task_id", F.lit(0).alias("idx"), F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("value"))
    log = StoredLog.create(base, new_path(t.spark, "writes"), k.WRITE, k.THREAD, buckets=32)
    pairs = F.array(
        F.struct(F.lit("quantity").alias("channel"), (F.col("l_quantity") + 1).alias("value")),
        F.struct(F.lit("price").alias("channel"), F.col("l_extendedprice").alias("value")),
    )
    batches = lines.where("checkpoint_id % 7 = 0").select(*k.CHECKPOINT, "task_id", pairs.alias("writes"))
    return log.bulk_upsert(batches, [F.desc("value")]).rows().select("checkpoint_id", "task_id", "idx", "channel", "value")
