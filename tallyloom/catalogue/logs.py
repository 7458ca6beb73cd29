"""Keyed-log, memory, history and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalogue.registry import Tables, query
from tallyloom.functions import slices, templates
from tallyloom.functions.urls import with_slash
from tallyloom.operators import history as h
from tallyloom.operators import keyed_log as k
from tallyloom.operators import memory as m
from tallyloom.scratch import new_path
from tallyloom.streaming import folds


def checkpoints(t: Tables):
    """Events as checkpoints: a user is a thread, the event id orders its checkpoints."""
    return t.events.select(
        F.col("user_id").alias("thread_id"),
        F.lit("").alias("checkpoint_ns"),
        F.col("event_id").alias("checkpoint_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") - 1).alias("parent_checkpoint_id"),
        F.col("event_type").alias("type"),
        F.col("value").alias("checkpoint"),
        F.col("props").alias("metadata"),
    )


SHOWN = ["thread_id", "checkpoint_id", "type", "checkpoint"]
CKPT = (
    "(SELECT user_id AS thread_id, event_id AS checkpoint_id, "
    "CASE WHEN event_id % 5 <> 0 THEN event_id - 1 END AS parent_checkpoint_id, "
    "event_type AS type, value AS checkpoint, props AS metadata FROM events)"
)


@query("SELECT * FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def point_lookup(t: Tables):
    return k.find_one(t.documents, doc_id=t.documents.agg(F.max("doc_id")).first()[0])


@query(f"SELECT thread_id, checkpoint_id, type, checkpoint FROM {CKPT} QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY checkpoint_id DESC) = 1")
def checkpoint_latest(t: Tables):
    return k.newest_checkpoints(checkpoints(t)).select(*SHOWN)


@query(
    f"WITH c AS (SELECT *, max(checkpoint_id) OVER w AS newest, min(checkpoint_id) OVER w AS oldest FROM {CKPT} WINDOW w AS (PARTITION BY thread_id)) "
    "SELECT thread_id, checkpoint_id, type, checkpoint FROM c WHERE checkpoint_id = CASE WHEN thread_id % 2 = 1 THEN oldest ELSE newest END"
)
def checkpoint_by_id(t: Tables):
    """Odd threads ask for a named checkpoint, even ones for their newest."""
    rows = checkpoints(t)
    named = F.when(F.col("thread_id") % 2 == 1, F.col("oldest")).alias("checkpoint_id")
    configs = rows.groupBy(*k.THREAD).agg(F.min("checkpoint_id").alias("oldest")).select(*k.THREAD, named)
    return k.checkpoints_for(rows, configs).select(*SHOWN)


@query(
    f"WITH c AS (SELECT *, max(checkpoint_id) OVER (PARTITION BY thread_id) AS newest FROM {CKPT}) "
    "SELECT thread_id, checkpoint_id, type, checkpoint, row_number() OVER (PARTITION BY thread_id ORDER BY checkpoint_id DESC)::INTEGER AS position "
    "FROM c WHERE checkpoint_id < newest QUALIFY position <= 3"
)
def checkpoint_list_before(t: Tables):
    rows = checkpoints(t)
    before = rows.groupBy(*k.THREAD).agg(F.max("checkpoint_id").alias("before_id"))
    return k.list_checkpoints_for(rows, before, 3).select(*SHOWN, "position")


@query(f"SELECT thread_id, checkpoint_id, type, checkpoint FROM {CKPT} WHERE json_extract_string(metadata, '$.k') = '24'")
def checkpoint_metadata_filter(t: Tables):
    return k.list_checkpoints(checkpoints(t), metadata={"k": 24}).select(*SHOWN)


@query(
    f"SELECT thread_id, checkpoint_id, type, checkpoint FROM {CKPT} WHERE checkpoint_id < (SELECT max(event_id) FROM events) "
    "ORDER BY checkpoint_id DESC LIMIT 10"
)
def checkpoint_list_limit(t: Tables):
    rows = checkpoints(t)
    newest = rows.agg(F.max("checkpoint_id")).first()[0]
    return k.list_checkpoints(rows, before=newest, limit=10).select(*SHOWN)


@query(
    f"WITH c AS (SELECT * REPLACE (checkpoint_id // 100 AS thread_id) FROM {CKPT}) SELECT c.thread_id, c.checkpoint_id, c.type, p.type AS parent_type, "
    "CASE WHEN c.parent_checkpoint_id IS NOT NULL THEN c.thread_id || '/' || c.parent_checkpoint_id END AS parent "
    "FROM c LEFT JOIN c p ON p.thread_id = c.thread_id AND p.checkpoint_id = c.parent_checkpoint_id"
)
def checkpoint_parent(t: Tables):
    rows = checkpoints(t).withColumn("thread_id", F.floor(F.col("checkpoint_id") / 100))
    parent = F.concat_ws("/", F.col("parent.thread_id").cast("string"), F.col("parent.checkpoint_id").cast("string"))
    return (
        k.with_parent(rows, ["type"])
        .withColumn("parent", k.parent_config())
        .select("thread_id", "checkpoint_id", "type", "parent_type", F.when(F.col("parent").isNotNull(), parent).alias("parent"))
    )


def order_checkpoints(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("thread_id"), F.lit("").alias("checkpoint_ns"), F.col("o_orderkey").alias("checkpoint_id"),
        F.col("o_totalprice").alias("checkpoint"),
    )


def line_writes(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("thread_id"), F.lit("").alias("checkpoint_ns"), F.col("l_orderkey").alias("checkpoint_id"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("task_id"),
        F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("channel"), F.col("l_extendedprice").alias("value"),
    )


LINES = (
    "(SELECT l_orderkey AS thread_id, l_partkey || '-' || l_suppkey AS task_id, l_linenumber AS idx, "
    "l_returnflag AS channel, l_extendedprice AS value FROM lineitem)"
)


@query(
    f"SELECT o_orderkey AS checkpoint_id, o_totalprice AS checkpoint, task_id, idx, channel, value FROM orders LEFT JOIN {LINES} ON thread_id = o_orderkey"
)
def checkpoint_pending_writes(t: Tables):
    rows = k.with_pending_writes(order_checkpoints(t), line_writes(t))
    return rows.select("checkpoint_id", "checkpoint", "task_id", "idx", "channel", "value")


@query(
    "SELECT o_orderkey AS checkpoint_id, coalesce(string_agg(task_id || ':' || idx || ':' || channel, ' ' ORDER BY task_id, idx, channel), '') AS writes "
    f"FROM orders LEFT JOIN {LINES} ON thread_id = o_orderkey GROUP BY o_orderkey"
)
def checkpoint_packed_writes(t: Tables):
    rows = k.pack_writes(k.with_pending_writes(order_checkpoints(t), line_writes(t)), limit_per_checkpoint=1000)
    text = F.transform("pending_writes", lambda w: F.concat_ws(":", w["task_id"], w["idx"].cast("string"), w["channel"]))
    return rows.select("checkpoint_id", F.array_join(text, " ").alias("writes"))


_CHANGES = """
ch AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice + ver AS o_totalprice, ver FROM orders, (VALUES (1), (2)) v(ver) WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT o_orderkey + 1000000000, 'X', o_totalprice, 1 FROM orders WHERE o_orderpriority = '5-LOW'
), win AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY ver DESC) = 1)
"""


def order_changes(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").withColumn("ver", F.explode(F.array(F.lit(1), F.lit(2))))
    new = orders.where(F.col("o_orderpriority") == "5-LOW").withColumns(
        {"o_orderkey": F.col("o_orderkey") + 1000000000, "o_orderstatus": F.lit("X"), "ver": F.lit(1)}
    )
    bumped = urgent.withColumn("o_totalprice", F.col("o_totalprice") + F.col("ver"))
    return bumped.unionByName(new).drop("o_orderpriority")


@query(
    f"WITH {_CHANGES} SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM win) "
    "UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM win"
)
def upsert(t: Tables):
    base = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    merged = k.upsert(base, order_changes(t), ["o_orderkey"], [F.desc("ver")])
    return merged.withColumn("o_totalprice", F.round("o_totalprice", 2))


_SET = (
    f"WITH {_CHANGES} SELECT coalesce(o.o_orderkey, w.o_orderkey) AS o_orderkey, o.o_orderdate, "
    "round(CASE WHEN w.o_orderkey IS NOT NULL THEN w.o_totalprice ELSE o.o_totalprice END, 2) AS o_totalprice, o.o_orderstatus FROM orders o {join} JOIN win w ON w.o_orderkey = o.o_orderkey"
)


def _set_price(t: Tables, insert: bool):
    base = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    merged = k.set_fields(base, order_changes(t), ["o_orderkey"], ["o_totalprice"], [F.desc("ver")], insert=insert)
    return merged.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(_SET.format(join="LEFT"))
def update_fields(t: Tables):
    return _set_price(t, insert=False)


@query(_SET.format(join="FULL"))
def update_or_insert_fields(t: Tables):
    return _set_price(t, insert=True)


@query(
    "WITH l AS (SELECT l_orderkey AS checkpoint_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS task_id, l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem), "
    "ch AS (SELECT checkpoint_id, task_id, 0 AS idx, 'quantity' AS channel, l_quantity + 1 AS value FROM l WHERE l_linestatus = 'O' "
    "UNION ALL SELECT checkpoint_id, task_id, 1, 'price', l_extendedprice FROM l WHERE l_linestatus = 'O') "
    "SELECT checkpoint_id, task_id, 0 AS idx, l_returnflag AS channel, l_quantity AS value FROM l "
    "WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.checkpoint_id = l.checkpoint_id AND ch.task_id = l.task_id AND ch.idx = 0) "
    "UNION ALL SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY checkpoint_id, task_id, idx ORDER BY value DESC) = 1"
)
def bulk_upsert(t: Tables):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("thread_id"), F.lit("").alias("checkpoint_ns"), F.col("l_orderkey").alias("checkpoint_id"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]).alias("task_id"),
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
    )
    base = lines.select(*k.CHECKPOINT, "task_id", F.lit(0).alias("idx"), F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("value"))
    pairs = F.array(
        F.struct(F.lit("quantity").alias("channel"), (F.col("l_quantity") + 1).alias("value")),
        F.struct(F.lit("price").alias("channel"), F.col("l_extendedprice").alias("value")),
    )
    batches = lines.where(F.col("l_linestatus") == "O").select(*k.CHECKPOINT, "task_id", pairs.alias("writes"))
    return k.bulk_upsert(base, batches, [F.desc("value")]).select("checkpoint_id", "task_id", "idx", "channel", "value")


_SLASHED = "CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END"


@query(
    f"SELECT DISTINCT {_SLASHED} AS url, {_SLASHED} IN (SELECT {_SLASHED} FROM pages WHERE url LIKE 'http://%') AS cached FROM pages"
)
def cached_results(t: Tables):
    cache = t.pages.where(F.startswith("url", F.lit("http://"))).select(with_slash(F.col("url")).alias("url")).distinct()
    hits, misses = k.cached_results(cache, t.pages.select("url"), "url")
    return hits.withColumn("cached", F.lit(True)).unionByName(misses.withColumn("cached", F.lit(False)))


@query(
    "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS place FROM events QUALIFY place <= 5"
)
def weighted_memory(t: Tables):
    return m.strongest(t.events, "user_id", "value", "event_id").select("user_id", "event_id", "value", "place")


@query(
    "WITH r AS (SELECT user_id, event_type || ' ' || event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 5) "
    "SELECT user_id, string_agg(item, chr(10) ORDER BY place) AS memories FROM r GROUP BY user_id"
)
def memory_text(t: Tables):
    items = t.events.withColumn("item", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    return m.memory_text(items, "user_id", "value", "event_id", "item")


_SUMMARY = "('Task: ' || event_type || chr(10) || 'Result Summary: ' || event_id)"


@query(
    f"WITH r AS (SELECT user_id, {_SUMMARY} AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 5), "
    "m AS (SELECT user_id, string_agg(item, chr(10) ORDER BY place) AS memories FROM r GROUP BY user_id) "
    "SELECT user_id, 'Context: ' || memories || chr(10) || chr(10) || 'Question: what next?' AS question, 'Q: what next?' || chr(10) || 'A: ' || length(memories) AS remembered FROM m"
)
def memory_questions(t: Tables):
    """A question per user with its memories as context, and what is remembered of the answer."""
    item = templates.task_summary(F.col("event_type"), F.col("event_id"))
    texts = m.memory_text(t.events.withColumn("item", item), "user_id", "value", "event_id", "item")
    asked = F.lit("what next?")
    return texts.select(
        "user_id",
        templates.question_with_memory(F.col("memories"), asked).alias("question"),
        templates.answered_question(asked, F.length("memories")).alias("remembered"),
    )


def _event_stream(t: Tables):
    """The table as a stream, be it one file or a folder of files; a glob accepts both."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5")
def streaming_memory(t: Tables):
    path = new_path(t.spark, "memory")
    items = _event_stream(t).select("user_id", "event_id", "value")
    done = folds.memory_stream(items, "user_id", "value", "event_id", f"{path}/state", f"{path}/progress")
    done.awaitTermination()
    return folds.memory_state(t.spark, f"{path}/state", items.schema)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def streaming_upsert(t: Tables):
    path = new_path(t.spark, "upserts")
    changes = _event_stream(t).select("user_id", "event_id", "event_type")
    folds.upsert_stream(changes, ["user_id"], "event_id", f"{path}/state", f"{path}/progress").awaitTermination()
    return folds.current(t.spark, f"{path}/state", changes.schema, ["user_id"], "event_id")


def run_log(t: Tables):
    return t.conversations.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("task"),
        F.col("text").alias("code"), F.concat("text", F.lit(" "), "text").alias("result"),
    )


def run_plans(t: Tables):
    """Plan rows with the index each run has reached."""
    return run_log(t).withColumn("index", F.col("run_id") % 4 - 1)


LOG = "(SELECT conv_id AS run_id, turn AS seq, role AS task, text AS code, text || ' ' || text AS result, conv_id % 4 - 1 AS idx FROM conversations)"
_CELL = "(chr(10) || '# %% ' || chr(10) || chr(10) || '#############################' || chr(10) || chr(10) || code)"
_CUT = "CASE WHEN length({0}) > 300 THEN {0}[1:300] || '...' ELSE {0} END"
_BLOCK = f"('<Task>' || task || '</Task>' || chr(10) || '<Code>' || code || '</Code>' || chr(10) || 'Result:' || chr(10) || {_CUT.format('result')} || chr(10))"


@query(f"SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC)::INTEGER AS age FROM {LOG} QUALIFY age <= 2")
def history_last_n(t: Tables):
    return h.last_entries(run_log(t), 2).select("run_id", "seq", "age")


@query(f"SELECT run_id, seq, {_CELL} AS cell FROM {LOG} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 2")
def executed_codes(t: Tables):
    return h.executed_codes(run_log(t), 3)


@query(f"SELECT run_id, seq, {_CELL} AS cell FROM {LOG} WHERE seq > 0")
def executed_codes_all_but_oldest(t: Tables):
    return h.executed_codes(run_log(t))


@query(
    f"WITH r AS (SELECT run_id, {_BLOCK} AS block, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM {LOG} QUALIFY age <= 2) "
    "SELECT run_id, string_agg(block, chr(10) ORDER BY age) AS previous_result FROM r GROUP BY run_id"
)
def previous_result(t: Tables):
    return h.previous_results(run_log(t))


@query(
    f"WITH r AS (SELECT * FROM {LOG} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 2) "
    "SELECT run_id, seq * 3 AS position, 'human' AS role, '<Task>' || chr(10) || task || chr(10) || '</Task>' AS text FROM r "
    "UNION ALL SELECT run_id, seq * 3 + 1, 'ai', '<CODE>' || chr(10) || code || chr(10) || '</CODE>' FROM r "
    "UNION ALL SELECT run_id, seq * 3 + 2, 'human', 'Result is :' || chr(10) || chr(10) || result FROM r"
)
def history_messages(t: Tables):
    return h.history(run_log(t), 2)


@query(f"SELECT run_id, seq, '- ' || seq || '. ' || task || chr(10) AS line FROM {LOG} WHERE seq > idx")
def future_tasks(t: Tables):
    return h.future_tasks(run_plans(t))


@query(f"SELECT run_id, seq, '- ' || (seq + 1) || '. ' || task || chr(10) AS line FROM {LOG} WHERE seq <= idx")
def executed_tasks(t: Tables):
    return h.executed_tasks(run_plans(t))


@query(
    f"SELECT run_id, seq, task FROM {LOG} UNION ALL SELECT run_id, max(seq) + 1, 'wrap-up' FROM {LOG} GROUP BY run_id "
    "UNION ALL SELECT -1 - conv_id, 0, 'first' FROM conversations WHERE turn = 0"
)
def append_to_log(t: Tables):
    """One more entry for every run, and a first entry for as many new runs."""
    log = run_log(t).select("run_id", "seq", "task")
    more = log.where("seq = 0").select("run_id", F.lit("wrap-up").alias("task"))
    new = log.where("seq = 0").select((-1 - F.col("run_id")).alias("run_id"), F.lit("first").alias("task"))
    return h.append_entries(log, more.unionByName(new))


def plan_records(t: Tables):
    """Run records with in-row arrays: the lines of a document are its plan."""
    lines = F.split("text", "\n", -1)
    entries = F.transform(lines, lambda x: F.struct(F.col("lang").alias("task"), x.alias("code"), x.alias("result")))
    return t.documents.select("doc_id", lines.alias("plan"), (F.col("doc_id") % 5 - 1).cast("int").alias("index"), entries.alias("entries"))


DOCS = "(SELECT doc_id, lang, string_split(text, chr(10)) AS p, doc_id % 5 - 1 AS idx FROM documents)"


@query(f"SELECT doc_id, coalesce(array_to_string(list_transform(p[idx + 2:], lambda x, i: '- ' || (idx + i) || '. ' || x || chr(10)), ''), '') AS tasks FROM {DOCS}")
def record_future_tasks(t: Tables):
    return plan_records(t).select("doc_id", slices.future_tasks(F.col("plan"), F.col("index")).alias("tasks"))


@query(
    "SELECT doc_id, CASE WHEN idx < 0 THEN 'NO Task Executed' ELSE '** Number of executed tasks: ** ' || chr(10) || ' ' || "
    f"array_to_string(list_transform(p[1:idx + 1], lambda x, i: '- ' || i || '. ' || x || chr(10)), '') END AS tasks FROM {DOCS}"
)
def record_executed_tasks(t: Tables):
    return plan_records(t).select("doc_id", slices.executed_tasks(F.col("plan"), F.col("index")).alias("tasks"))


@query(f"SELECT doc_id, CASE WHEN idx >= 0 THEN p[idx + 1] END AS task FROM {DOCS}")
def record_current_task(t: Tables):
    plan = plan_records(t)
    at = F.when(F.col("index") >= 0, F.col("index"))
    return plan.select("doc_id", slices.current_task(F.col("plan"), at).alias("task"))


@query(
    "SELECT doc_id, coalesce(array_to_string(list_transform(list_reverse(p)[1:len(p) - 1], lambda code: chr(10) || '# %% ' || chr(10) || chr(10) || "
    f"'#############################' || chr(10) || chr(10) || code), ''), '') AS codes FROM {DOCS}"
)
def record_executed_codes(t: Tables):
    return plan_records(t).select("doc_id", slices.executed_codes(F.col("plan")).alias("codes"))


@query(
    "SELECT doc_id, array_to_string(list_transform(list_reverse(p)[1:3], lambda x: '<Task>' || lang || '</Task>' || chr(10) || '<Code>' || x || '</Code>' || chr(10) || 'Result:' || chr(10) || "
    f"{_CUT.format('x')} || chr(10)), chr(10)) AS previous_result FROM {DOCS}"
)
def record_previous_result(t: Tables):
    return plan_records(t).select("doc_id", slices.previous_results(F.col("entries"), 3).alias("previous_result"))


@query(
    "SELECT doc_id, array_to_string(list_transform(list_reverse(list_reverse(p)[1:2]), lambda x: 'human|<Task>' || chr(10) || lang || chr(10) || '</Task>ai|<CODE>' || chr(10) || x || chr(10) || '</CODE>"
    f"human|Result is :' || chr(10) || chr(10) || x), '') AS messages FROM {DOCS}"
)
def record_history(t: Tables):
    messages = F.transform(slices.history(F.col("entries"), 2), lambda x: F.concat_ws("|", x["role"], x["text"]))
    return plan_records(t).select("doc_id", F.array_join(messages, "").alias("messages"))


@query(f"SELECT doc_id, list_sum(list_transform(p, lambda x: length(x)))::BIGINT AS total, array_to_string(list_transform(p, lambda x: x[1:1]), '') AS initials FROM {DOCS}")
def rolling_summary(t: Tables):
    """An ordered fold over the entries of each record."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit("").alias("initials"))

    def merge(summary, entry):
        return F.struct(
            (summary["total"] + F.length(entry["result"])).alias("total"),
            F.concat(summary["initials"], F.left(entry["result"], F.lit(1))).alias("initials"),
        )

    return plan_records(t).select("doc_id", slices.fold_summary(F.col("entries"), start, merge).alias("s")).select("doc_id", "s.*")


@query(f"SELECT doc_id, len(p) + 1 AS n_entries, CASE WHEN idx = 0 THEN p[1] ELSE 'No result available' END AS result FROM {DOCS}")
def record_append_and_lookup(t: Tables):
    entry = F.struct(F.lit("t").alias("task"), F.lit("c").alias("code"), F.lit("r").alias("result"))
    results = F.create_map(F.concat(F.lit("task "), F.col("index").cast("string")), F.get(F.col("plan"), F.lit(0)))
    return plan_records(t).select(
        "doc_id",
        F.size(slices.append_entry(F.col("entries"), entry)).cast("long").alias("n_entries"),
        slices.result_of(results, F.lit("task 0")).alias("result"),
    )
