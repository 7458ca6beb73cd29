"""Keyed tables: lookup, listing, pending writes and upserts.

Checkpoints are keyed by (thread_id, checkpoint_ns, checkpoint_id); writes add
(task_id, idx).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.urls import with_slash
from tallyloom.local import local_table
from tallyloom.operators.ranking import latest_per_key, top_n, top_n_per_key
from tallyloom.scratch import materialize

THREAD = ["thread_id", "checkpoint_ns"]
CHECKPOINT = [*THREAD, "checkpoint_id"]
WRITE = [*CHECKPOINT, "task_id", "idx"]

HEAVY_SHARE = 256


def join_unique(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table that has one row per key, for use below a window or aggregation on the same keys.

    There the optimizer cannot split a hot key of a shuffled join without
    another shuffle. Keys with more than 1/256 of the rows (at most 256 keys, so
    they can be broadcast) are therefore joined where their rows are, and only
    the others are shuffled.
    """
    limit = rows.count() // HEAVY_SHARE
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    heavy = counted.where(F.col("__n") > limit).select(*keys)
    found = [tuple(row) for row in heavy.collect()]
    if not found:
        return rows.join(per_key, keys)
    heavy_keys = F.broadcast(local_table(rows.sparkSession, found, heavy.schema))
    in_place = rows.join(F.broadcast(per_key.join(heavy_keys, keys, "left_semi")), keys)
    others = rows.join(heavy_keys, keys, "left_anti").join(per_key, keys)
    return in_place.unionByName(others)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def find_one(df: DataFrame, order_by: list[Column] | None = None, **equals) -> DataFrame:
    """At most one row matching all equalities; the filters reach the scan."""
    found = df.where(_all([F.col(k) == v for k, v in equals.items()]))
    return top_n(found, order_by, 1) if order_by else found.limit(1)


def checkpoint(checkpoints: DataFrame, thread_id, checkpoint_ns="", checkpoint_id=None) -> DataFrame:
    """The named checkpoint of a thread, or its newest one."""
    keys = {"thread_id": thread_id, "checkpoint_ns": checkpoint_ns}
    if checkpoint_id not in (None, ""):
        keys["checkpoint_id"] = checkpoint_id
    return find_one(checkpoints, [F.desc("checkpoint_id")], **keys)


def newest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return latest_per_key(checkpoints, THREAD, [F.desc("checkpoint_id")])


def checkpoints_for(checkpoints: DataFrame, configs: DataFrame) -> DataFrame:
    """One checkpoint per config row: the one named by checkpoint_id, or the thread's newest where that is null.

    The newest checkpoints are found before the configs are matched: that keeps
    one row per thread and task, where matching first would bring a hot
    thread's rows together.
    """
    named = checkpoints.join(configs.where(F.col("checkpoint_id").isNotNull()).select(*CHECKPOINT), CHECKPOINT, "left_semi")
    open_ended = configs.where(F.col("checkpoint_id").isNull()).select(*THREAD)
    return named.unionByName(newest_checkpoints(checkpoints).join(open_ended, THREAD, "left_semi"))


def _json_equals(parsed: Column, path: str, value: object) -> Column:
    """Whether the value at a path of a parsed JSON text is this one, its type included; 1 and 1.0 are one number."""
    found = F.try_variant_get(parsed, path, "variant")
    kind = F.schema_of_variant(found)
    if value is None:
        return found.isNull() | F.is_variant_null(found)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(parsed, path, "boolean") == value)
    if isinstance(value, (int, float)):
        return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(parsed, path, "double") == float(value))
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(parsed, path, "string") == value)
    return F.to_json(found) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def metadata_equals(metadata: Column, wanted: dict[str, object], parsed: bool = False) -> Column:
    """Every named field of a JSON text, or of a variant if `parsed`, equals the given value; a dotted name reaches into nested objects."""
    parsed = metadata if parsed else F.try_parse_json(metadata)
    return _all([F.coalesce(_json_equals(parsed, f"$.{key}", value), F.lit(False)) for key, value in wanted.items()])


def list_checkpoints(
    checkpoints: DataFrame,
    thread_id=None,
    checkpoint_ns="",
    *,
    metadata: dict[str, object] | None = None,
    before=None,
    limit: int | None = None,
) -> DataFrame:
    """Checkpoints newest first; every condition is optional and pushed to the scan where it can be."""
    conditions = []
    if thread_id is not None:
        conditions += [F.col("thread_id") == thread_id, F.col("checkpoint_ns") == checkpoint_ns]
    if metadata:
        conditions.append(metadata_equals(F.col("metadata"), metadata))
    if before is not None:
        conditions.append(F.col("checkpoint_id") < before)
    ordered = checkpoints.where(_all(conditions)).orderBy(F.desc("checkpoint_id"))
    return ordered if limit is None else ordered.limit(limit)


def list_checkpoints_for(checkpoints: DataFrame, before: DataFrame, limit: int) -> DataFrame:
    """Per thread, the `limit` newest checkpoints below `before` (one row per thread: key, before_id); adds `position`."""
    matched = join_unique(checkpoints, before, THREAD)
    older = matched.where(F.col("checkpoint_id") < F.col("before_id")).drop("before_id")
    return top_n_per_key(older, THREAD, [F.desc("checkpoint_id")], limit, rank="position")


def parent_config(parent_id: str = "parent_checkpoint_id") -> Column:
    """Key of the parent checkpoint, null when there is none."""
    has_parent = F.coalesce(F.col(parent_id).cast("string"), F.lit("")) != ""
    return F.when(has_parent, F.struct(*THREAD, F.col(parent_id).alias("checkpoint_id")))


def with_parent(checkpoints: DataFrame, fields: list[str]) -> DataFrame:
    """Adds fields of the parent row as parent_<field>; null for a first checkpoint."""
    parents = checkpoints.select(
        *THREAD, F.col("checkpoint_id").alias("parent_checkpoint_id"), *[F.col(f).alias(f"parent_{f}") for f in fields]
    )
    return checkpoints.join(parents, [*THREAD, "parent_checkpoint_id"], "left")


def with_pending_writes(checkpoints: DataFrame, writes: DataFrame) -> DataFrame:
    """Left lookup of a checkpoint's writes, one row per write.

    Written as inner join plus the checkpoints without writes: in that form a
    checkpoint that holds a third of all writes can be split over tasks, which
    a left join cannot do on its right side.
    """
    columns = [c for c in writes.columns if c not in CHECKPOINT]
    matched = checkpoints.join(writes, CHECKPOINT)
    without = checkpoints.join(writes.select(*CHECKPOINT).distinct(), CHECKPOINT, "left_anti")
    empty = without.select("*", *[F.lit(None).cast(writes.schema[c].dataType).alias(c) for c in columns])
    return matched.unionByName(empty)


def pack_writes(rows: DataFrame, limit_per_checkpoint: int) -> DataFrame:
    """Writes of each checkpoint as one array ordered by task and idx.

    For checkpoints known to hold at most `limit_per_checkpoint` writes; a
    larger one raises: no more than one write beyond the bound is gathered.
    """
    few = top_n_per_key(rows, CHECKPOINT, [F.asc("task_id"), F.asc("idx")], limit_per_checkpoint + 1, rank="__rank")
    entry = F.struct("task_id", "idx", "channel", "value")
    packed = few.groupBy(*CHECKPOINT).agg(F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), entry))).alias("pending_writes"))
    over = F.raise_error(F.lit("a checkpoint holds more writes than the stated bound; use the row form"))
    fits = F.size("pending_writes") <= limit_per_checkpoint
    return packed.withColumn("pending_writes", F.when(fits, F.col("pending_writes")).otherwise(over.cast(packed.schema["pending_writes"].dataType)))


def _same_key(base: DataFrame, other: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """`other` with its keys renamed, and the condition that all keys agree; null agrees with null."""
    renamed = other.withColumnsRenamed({c: f"__key_{c}" for c in keys})
    return renamed, _all([F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """`base` with changed rows replaced and new ones added; `order_by` puts the winning change of a key first.

    Changes are reduced to one row per key and written down before they meet the
    base table: they are read twice, and only a written table has a size the
    optimizer can trust. While it is small, its keys are broadcast and the base
    is not shuffled.
    """
    winners = materialize(latest_per_key(changes, keys, order_by).select(*base.columns), "changes")
    kept = base.join(*_same_key(base, winners.select(*keys), keys), "left_anti")
    return kept.select(*base.columns).unionByName(winners)


def set_fields(
    base: DataFrame, changes: DataFrame, keys: list[str], fields: list[str], order_by: list[Column], insert: bool = False
) -> DataFrame:
    """Overwrite only `fields` of matching rows; with `insert`, unmatched changes become new rows.

    Without `insert` the base is not shuffled while the written changes are
    small enough to broadcast.
    """
    winners = latest_per_key(changes, keys, order_by)
    marked = materialize(winners.select(*keys, F.struct(*fields).alias("__set")), "changes")
    merged = base.join(*_same_key(base, marked, keys), "left")
    columns = [
        F.when(F.col("__set").isNotNull(), F.col(f"__set.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in base.columns
    ]
    changed = merged.select(*columns)
    if not insert:
        return changed
    new = marked.join(*_same_key(marked, base.select(*keys), keys), "left_anti")
    blank = [F.col(c) if c in keys else F.col(f"__set.{c}") if c in fields else F.lit(None).cast(base.schema[c].dataType) for c in base.columns]
    return changed.unionByName(new.select(*[value.alias(c) for c, value in zip(base.columns, blank)]))


def explode_writes(batches: DataFrame) -> DataFrame:
    """One row per (channel, value) pair of each batch; idx is its place in the batch."""
    others = [c for c in batches.columns if c != "writes"]
    return batches.select(*others, F.posexplode("writes").alias("idx", "write")).select(*others, "idx", "write.*")


def bulk_upsert(writes: DataFrame, batches: DataFrame, order_by: list[Column]) -> DataFrame:
    """Upsert every pair of every batch on the five-part key; `order_by` puts the winning batch first."""
    return upsert(writes, explode_writes(batches), WRITE, order_by)


def cached_results(cache: DataFrame, requests: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a result cache keyed by URL with a closing slash."""
    asked = requests.withColumn(url, with_slash(F.col(url))).dropDuplicates([url])
    return cache.join(asked.select(url), url, "left_semi"), asked.join(cache.select(url), url, "left_anti")


def nest_fields(df: DataFrame, name: str, fields: dict[str, str]) -> DataFrame:
    """Replace columns by one struct column of (new name -> old column) fields."""
    kept = [c for c in df.columns if c not in fields.values()]
    return df.select(*kept, F.struct(*[F.col(old).alias(new) for new, old in fields.items()]).alias(name))
