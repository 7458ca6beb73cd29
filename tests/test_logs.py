"""Keyed logs, history, memory and streams on small hand-made tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import history, keyed_log, memory
from tallyloom.streaming import folds

LOG = "thread_id string, checkpoint_ns string, checkpoint_id string, parent_checkpoint_id string, metadata string"


@pytest.fixture(scope="module")
def checkpoints(spark):
    rows = [
        ("t", "", f"{i:03d}", f"{i - 1:03d}" if i else None, json.dumps({"step": i % 3, "source": "loop"})) for i in range(10)
    ] + [("t", "sub", "100", "", "{}"), ("u", "", "005", None, "{}")]
    return spark.createDataFrame(rows, LOG).repartition(4)


def ids(df):
    return [r.checkpoint_id for r in df.collect()]


def test_checkpoint_by_id_or_newest(checkpoints):
    assert ids(keyed_log.checkpoint(checkpoints, "t")) == ["009"]
    assert ids(keyed_log.checkpoint(checkpoints, "t", checkpoint_id="004")) == ["004"]
    assert ids(keyed_log.checkpoint(checkpoints, "t", "sub")) == ["100"]
    assert ids(keyed_log.checkpoint(checkpoints, "nobody")) == []


def test_listing(checkpoints):
    listed = keyed_log.list_checkpoints
    assert ids(listed(checkpoints, "t", before="003")) == ["002", "001", "000"]
    assert ids(listed(checkpoints, "t", limit=2)) == ["009", "008"]
    assert ids(listed(checkpoints, "t", metadata={"step": 1, "source": "loop"})) == ["007", "004", "001"]
    assert len(ids(listed(checkpoints))) == 12


def test_metadata_values(spark):
    texts = ['{"a": true, "b": {"c": "x"}, "n": 1.5}', '{"a": false, "b": {"c": "y"}}', '{"b": null}']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, m string")
    cases = [({"a": True}, [0]), ({"a": False}, [1]), ({"b.c": "y"}, [1]), ({"n": 1.5}, [0]), ({"n": None}, [1, 2]), ({"a": True, "b.c": "y"}, [])]
    for wanted, expected in cases:
        assert [r.i for r in df.where(keyed_log.metadata_equals(F.col("m"), wanted)).collect()] == expected


def test_parents(checkpoints):
    rows = {(r.thread_id, r.checkpoint_ns, r.checkpoint_id): r.parent for r in checkpoints.withColumn("parent", keyed_log.parent_config()).collect()}
    assert rows["t", "", "003"].checkpoint_id == "002"
    assert rows["t", "", "000"] is None and rows["t", "sub", "100"] is None


def test_pending_writes_keep_checkpoints_without_any(spark, checkpoints):
    writes = spark.createDataFrame(
        [("t", "", "003", "b", 0, "c1", "v"), ("t", "", "003", "a", 1, "c2", "w"), ("t", "", "003", "a", 0, "c1", "x")],
        "thread_id string, checkpoint_ns string, checkpoint_id string, task_id string, idx int, channel string, value string",
    )
    rows = keyed_log.with_pending_writes(checkpoints, writes)
    assert rows.count() == 14
    packed = {r.checkpoint_id: r.pending_writes for r in keyed_log.pack_writes(rows, 3).where("thread_id = 't'").collect()}
    assert [(w.task_id, w.idx) for w in packed["003"]] == [("a", 0), ("a", 1), ("b", 0)]
    assert packed["004"] == []
    with pytest.raises(Exception, match="more writes than the stated bound"):
        keyed_log.pack_writes(rows, 2).collect()


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_list_before_with_a_hot_thread(spark, hot):
    random.seed(int(hot * 10))
    rows = [(0 if random.random() < hot else random.randint(1, 700), "", i) for i in range(3000)]
    before = {k: random.randint(0, 3000) for k in range(0, 701, 2)}
    table = spark.createDataFrame(rows, "thread_id int, checkpoint_ns string, checkpoint_id int").repartition(6)
    wanted = spark.createDataFrame([(k, "", v) for k, v in before.items()], "thread_id int, checkpoint_ns string, before_id int")
    found = keyed_log.list_checkpoints_for(table, wanted, 2).collect()
    expected = {
        (k, i) for k, limit in before.items() for i in sorted((i for t, _, i in rows if t == k and i < limit), reverse=True)[:2]
    }
    assert len(found) == len(expected) and {(r.thread_id, r.checkpoint_id) for r in found} == expected


def test_set_fields_leaves_other_fields(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    changes = spark.createDataFrame([(1, "old", 1), (1, None, 2), (3, "new", 1)], "k int, p string, v int")
    kept = {r.k: (r.p, r.q) for r in keyed_log.set_fields(base, changes, ["k"], ["p"], [F.desc("v")]).collect()}
    assert kept == {1: (None, "x"), 2: ("b", "y")}
    more = {r.k: (r.p, r.q) for r in keyed_log.set_fields(base, changes, ["k"], ["p"], [F.desc("v")], insert=True).collect()}
    assert more == {**kept, 3: ("new", None)}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, p string, v int")
    once = keyed_log.upsert(base, changes, ["k"], [F.desc("v")])
    twice = keyed_log.upsert(once, changes, ["k"], [F.desc("v")])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_small_changes_do_not_shuffle_the_base(spark, tmp_path):
    spark.range(50000).select(F.col("id").alias("k"), F.lit("a").alias("p")).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    changes = spark.range(10).select(F.col("id").alias("k"), F.lit("b").alias("p"), F.lit(1).alias("v"))
    for merged in (keyed_log.upsert(base, changes, ["k"], [F.desc("v")]), keyed_log.set_fields(base, changes, ["k"], ["p"], [F.desc("v")])):
        assert "Exchange hashpartitioning" not in merged._jdf.queryExecution().executedPlan().toString()
        assert merged.where("p = 'b'").count() == 10 and merged.count() == 50000


def insert_one_by_one(items, n=5):
    """Add, sort stably by importance, cut."""
    kept = []
    for seq, importance in items:
        kept = sorted([*kept, (seq, importance)], key=lambda x: -x[1])[:n]
    return [seq for seq, _ in kept]


def test_memory_equals_adding_one_by_one(spark):
    random.seed(1)
    rows = [(random.choice("aaab"), i, float(random.randint(0, 6))) for i in range(400)]
    found = memory.strongest(spark.createDataFrame(rows, "owner string, seq int, w double"), "owner", "w", "seq").collect()
    for owner in "ab":
        mine = [r.seq for r in sorted((r for r in found if r.owner == owner), key=lambda r: r.place)]
        assert mine == insert_one_by_one([(s, w) for o, s, w in rows if o == owner])


def test_streams_give_the_batch_result_over_restarts(spark, tmp_path):
    random.seed(2)
    schema = "owner string, seq int, w double"
    rows = [(random.choice("aaaab"), i, float(random.randint(0, 50))) for i in range(300)]
    source = str(tmp_path / "in")
    for start in range(0, 300, 100):
        part = spark.createDataFrame(rows[start : start + 100], schema)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        folds.memory_stream(stream, "owner", "w", "seq", str(tmp_path / "m"), str(tmp_path / "mc")).awaitTermination()
        stream = spark.readStream.schema(schema).parquet(source)
        folds.upsert_stream(stream, ["owner"], "seq", str(tmp_path / "u"), str(tmp_path / "uc")).awaitTermination()
    table = spark.createDataFrame(rows, schema)
    kept = folds.memory_state(spark, str(tmp_path / "m"), table.schema)
    assert sorted(kept.collect()) == sorted(memory.strongest(table, "owner", "w", "seq").select("owner", "seq", "w").collect())
    newest = {r.owner: r.seq for r in folds.current(spark, str(tmp_path / "u"), table.schema, ["owner"], "seq").collect()}
    assert newest == {o: max(s for k, s, _ in rows if k == o) for o in "ab"}


def test_history_views(spark):
    rows = [("r", i, f"t{i}", f"c{i}", "z" * (301 if i == 3 else 2)) for i in range(4)] + [("s", 0, "t", "c", "r")]
    log = spark.createDataFrame(rows, "run_id string, seq int, task string, code string, result string")
    texts = {r.run_id: r.previous_result for r in history.previous_results(log).collect()}
    assert texts["r"].startswith("<Task>t3</Task>\n<Code>c3</Code>\nResult:\n" + "z" * 300 + "...\n\n<Task>t2")
    assert texts["s"] == "<Task>t</Task>\n<Code>c</Code>\nResult:\nr\n"
    messages = sorted((r.position, r.role) for r in history.history(log, 2).where("run_id = 'r'").collect())
    assert messages == [(6, "human"), (7, "ai"), (8, "human"), (9, "human"), (10, "ai"), (11, "human")]
    assert history.executed_codes(log, 1).count() == 0
