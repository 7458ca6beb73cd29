"""A log in buckets: what is read, what is rewritten, and what a failed write leaves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import keyed_log
from tallyloom.operators.stored_log import StoredLog

SCHEMA = "thread_id string, checkpoint_ns string, checkpoint_id int, metadata string, value double"
KEYS = ["thread_id", "checkpoint_ns", "checkpoint_id"]


def made(n=400, hot=0.3):
    pick = random.Random(4)
    rows = {}
    for i in range(n):
        thread = "hot" if pick.random() < hot else pick.choice([None, *"abcdefghij"])
        rows[thread, pick.choice(["", "sub"]), i] = (json.dumps({"k": i % 5, "s": str(i % 3), "deep": {"x": i % 2 == 0}}) if i % 11 else None, float(i))
    return [(*key, *rest) for key, rest in rows.items()]


@pytest.fixture
def log(spark, tmp_path):
    rows = spark.createDataFrame(made(), SCHEMA)
    return StoredLog.create(rows, str(tmp_path / "log"), KEYS, KEYS[:2], buckets=16, slice_rows=40, bloom=("checkpoint_id",), parsed=("metadata",))


def all_rows(frame):
    return sorted((tuple(r) for r in frame.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()), key=repr)


def test_all_rows_are_there(spark, log):
    assert all_rows(log.rows()) == sorted(made(), key=repr)
    assert all_rows(StoredLog.open(spark, log.folder).rows()) == sorted(made(), key=repr)
    assert log.heavy, "the hot thread is to be cut"


def test_lookup_reads_one_bucket(log):
    for thread in ["hot", "a", None]:
        expected = sorted((r for r in made() if r[:2] == (thread, "sub")), key=lambda r: -r[2])
        found = log.find([F.desc("checkpoint_id")], thread_id=thread, checkpoint_ns="sub")
        assert [tuple(r) for r in found.collect()] == expected[:1]
        named = log.within(thread_id=thread, checkpoint_ns="sub", checkpoint_id=expected[-1][2])
        assert all_rows(named) == [expected[-1]]
        places = {f.rpartition("/")[0] for f in named.inputFiles()}
        assert len(places) == 1, "a whole key is in one slice"
        buckets = {f.split("bucket_=")[1].split("/")[0] for f in log.within(thread_id=thread, checkpoint_ns="sub").inputFiles()}
        assert len(buckets) == 1
    assert log.find(thread_id="nobody", checkpoint_ns="").collect() == []
    plan = log.within(thread_id="a", checkpoint_ns="", checkpoint_id=3)._jdf.queryExecution().toString()
    assert "EqualNullSafe(checkpoint_id,3)" in plan.partition("PushedFilters")[2]


def test_find_all(spark, log):
    keys = [r[:3] for r in made()[::7]] + [("a", "", 99999)]
    wanted = spark.createDataFrame(keys, "thread_id string, checkpoint_ns string, checkpoint_id int")
    assert all_rows(log.find_all(wanted)) == sorted(made()[::7], key=repr)


def test_upsert_touches_its_slices_only(spark, log):
    changes = spark.createDataFrame([("a", "", 1000, "{}", 1.0, 1), ("a", "", 1000, "{}", 2.0, 2), ("hot", "sub", 5000, None, 3.0, 1)], SCHEMA + ", v int")
    before = {f for f in log.rows().inputFiles()}
    new = log.upsert(changes, [F.desc("v")])
    after = {f for f in new.rows().inputFiles()}
    assert 0 < len(after - before) <= 2 and len(before & after) >= len(before) - 2
    expected = [r for r in made()] + [("a", "", 1000, "{}", 2.0), ("hot", "sub", 5000, None, 3.0)]
    assert all_rows(new.rows()) == sorted(expected, key=repr)
    assert all_rows(log.rows()) == sorted(made(), key=repr), "the version before is as it was"
    assert all_rows(new.upsert(changes, [F.desc("v")]).rows()) == sorted(expected, key=repr)


def test_random_upserts_as_the_plain_operator(spark, log):
    pick = random.Random(8)
    rows = [(*pick.choice(made())[:3], None, float(i), i) for i in range(60)] + [(pick.choice([None, "new", "hot"]), "", 10000 + i, "{}", 0.0, i) for i in range(20)]
    changes = spark.createDataFrame(rows, SCHEMA + ", v int")
    plain = keyed_log.upsert(spark.createDataFrame(made(), SCHEMA), changes, KEYS, [F.desc("v")])
    assert all_rows(log.upsert(changes, [F.desc("v")]).rows()) == all_rows(plain)
    for insert in (False, True):
        plain = keyed_log.set_fields(spark.createDataFrame(made(), SCHEMA), changes, KEYS, ["value"], [F.desc("v")], insert)
        assert all_rows(log_at(log, changes, insert)) == all_rows(plain)


def log_at(log, changes, insert):
    """Set fields in a copy of the first version."""
    copy = StoredLog.create(log.rows().select(*log.schema.names), f"{log.folder}-{insert}", KEYS, KEYS[:2], buckets=4, slice_rows=50)
    return copy.set_fields(changes, ["value"], [F.desc("v")], insert).rows()


def test_failed_and_competing_writes(spark, log):
    change = spark.createDataFrame([("a", "", 1, "{}", 9.0, 1)], SCHEMA + ", v int")

    def broken(rows, new):
        return rows.unionByName(new.withColumn("value", F.raise_error(F.lit("lost")).cast("double")))

    with pytest.raises(Exception, match="lost"):
        log.rewrite(change.drop("v"), broken)
    assert StoredLog.open(spark, log.folder).version == 0
    assert all_rows(StoredLog.open(spark, log.folder).rows()) == sorted(made(), key=repr)
    first = log.upsert(change, [F.desc("v")])
    assert first.version == 1, "what the failed write left is no hindrance"
    with pytest.raises(RuntimeError, match="another writer"):
        log.upsert(change, [F.desc("v")])


def test_vacuum_keeps_the_newest(spark, log):
    change = spark.createDataFrame([("a", "", 1, "{}", 9.0, 1)], SCHEMA + ", v int")
    newest = log.upsert(change, [F.desc("v")]).upsert(change, [F.desc("v")])
    rows = all_rows(newest.rows())
    newest.vacuum()
    assert all_rows(StoredLog.open(spark, log.folder).rows()) == rows


@pytest.mark.parametrize("wanted", [{"k": 3}, {"s": "1"}, {"s": 1}, {"deep.x": True}, {"k": 1, "deep.x": False}, {"none": None}])
def test_metadata_without_parsing(spark, log, wanted):
    found = log.list(metadata=wanted)
    plain = spark.createDataFrame(made(), SCHEMA).where(keyed_log.metadata_equals(F.col("metadata"), wanted))
    assert all_rows(found) == all_rows(plain)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan.lower() and "parsejson" not in plan.lower()


def test_metadata_filter_reaches_the_scan(log):
    plan = log.list(metadata={"k": 3}).select("value")._jdf.queryExecution().executedPlan().toString()
    assert "metadata_parsed:struct<" in plan.partition("ReadSchema")[2], "only the wanted fields are read"


def test_names_of_the_layout(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2)], "k int, bucket_ int")
    with pytest.raises(ValueError, match="taken by the layout"):
        StoredLog.create(rows, str(tmp_path / "x"), ["k"], ["k"])
    empty = StoredLog.create(spark.createDataFrame([], "k int, v int"), str(tmp_path / "empty"), ["k"], ["k"])
    assert empty.rows().collect() == [] and empty.find(k=1).collect() == []
    assert [tuple(r) for r in empty.upsert(spark.createDataFrame([(1, 2)], "k int, v int"), [F.desc("v")]).rows().collect()] == [(1, 2)]
