"""Readers, writers, settings and the run loop."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import session
from tallyloom.functions.text import python_float
from tallyloom.operators import cells, ranking
from tallyloom.plans import dataset_report, run_loop
from tallyloom.sources import documents, tables

CSV = """id,flag,gap_flag,n,gap_n,x,s,empty
a1,True,True,1,1,1.5,hello,
a2,False,NA,2,,nan,"with, comma",
a3,True,False,-3,null,1e3,N/A,
a4,False,,4,7,.5,"quote "" in",
a5,True,True,5,<NA>,inf,None,
"""


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types_and_missing_match_pandas(spark, csv_path):
    df, frame = tables.read_table(spark, csv_path), pd.read_csv(csv_path)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {"id": "string", "flag": "boolean", "gap_flag": "boolean", "n": "bigint", "gap_n": "bigint", "x": "double", "s": "string", "empty": "double"}
    rows = df.toPandas()
    for c in frame.columns:
        assert rows[c].isnull().tolist() == frame[c].isnull().tolist(), c
        assert rows[c].dropna().tolist() == frame[c].dropna().tolist(), c


def test_reported_types_match_pandas(spark, csv_path):
    from tallyloom.operators.profile import reported_types

    found = {r.column_name: r.pandas_type for r in reported_types(tables.read_table(spark, csv_path)).collect()}
    assert found == {c: str(t) for c, t in pd.read_csv(csv_path).dtypes.items()}


def test_schema_can_be_pinned(spark, csv_path):
    schema = T.StructType.fromDDL("n double, s string")
    assert [tuple(r) for r in tables.read_table(spark, csv_path, schema).limit(1).collect()] == [(1.0, "hello")]
    train, test = tables.read_train_and_test(spark, csv_path, csv_path)
    assert train.schema == test.schema


def test_quoted_line_feeds(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"one\ntwo",1\nthree,2\n')
    rows = tables.read_table(spark, str(tmp_path / "t.csv"), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("one\ntwo", 1), ("three", 2)]


def test_leaderboards(spark, tmp_path):
    boards = {
        "many.json": {"submissions": [{"score": str(i)} for i in range(25)] + [{"score": None}, {"score": "n/a"}, {}]},
        "empty.json": {"submissions": []},
        "none.json": {},
    }
    for name, board in boards.items():
        (tmp_path / name).write_text(json.dumps(board, indent=2))
    for name, mean in (("many.json", 23.5), ("empty.json", 0.0), ("none.json", 0.0)):
        scores = documents.read_scores(spark, str(tmp_path / name))
        assert ranking.top_decile_mean(scores, python_float(F.col("score"))).first()[0] == mean


def test_plan_and_field_files(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps(["first\ntask", "second"], indent=2))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "doc.json").write_text(json.dumps({"a": "1", "b": "two\nlines"}))
    assert [tuple(r) for r in documents.read_plan(spark, str(tmp_path / "plan.json")).collect()] == [(0, "first\ntask"), (1, "second")]
    assert documents.read_plan(spark, str(tmp_path / "bad.json")).collect() == []
    assert {tuple(r) for r in documents.read_fields(spark, str(tmp_path / "doc.json")).collect()} == {("a", "1"), ("b", "two\nlines")}
    assert documents.read_lines(spark, str(tmp_path / "plan.json")).count() == 4
    written = str(tmp_path / "out")
    df = spark.createDataFrame([(["x", "y"],)], "plan array<string>")
    documents.write_json(df, F.col("plan"), written)
    assert json.loads("".join(r.value for r in spark.read.text(written, wholetext=True).collect())) == ["x", "y"]


def test_frame_text(spark):
    frame = pd.DataFrame({"a": [1, 2], "b": ["x", None]})
    df = spark.createDataFrame([(frame.to_json(),)], "j string")
    schema = T.StructType.fromDDL("a long, b string")
    rows = df.select(F.inline(documents.frame_rows(F.col("j"), schema))).collect()
    assert [tuple(r) for r in rows] == [("0", 1, "x"), ("1", 2, None)]


def test_notebook_file(spark, tmp_path):
    stream = {"output_type": "stream", "name": "stdout", "text": ["one\n", "two"]}
    error = {"output_type": "error", "ename": "E", "evalue": "v", "traceback": ["t1", "t2"]}
    result = {"output_type": "execute_result", "data": {"text/plain": "3"}, "metadata": {}, "execution_count": 1}
    book = {"cells": [
        {"cell_type": "markdown", "source": ["# t\n", "x"], "metadata": {}},
        {"cell_type": "code", "source": ["a = 1\n", "a"], "outputs": [stream, result], "metadata": {}},
        {"cell_type": "code", "source": ["b"], "outputs": [error], "metadata": {}},
    ], "nbformat": 4}
    path = tmp_path / "book.ipynb"
    path.write_text(json.dumps(book))
    read = documents.read_notebook(spark, str(path))
    rows = read.withColumn("first", cells.first_output(F.col("outputs"))).withColumn("texts", cells.output_texts(F.col("outputs"))).orderBy("seq").collect()
    assert [r.code for r in rows] == ["# t\nx", "a = 1\na", "b"]
    assert [r["first"] for r in rows] == [None, "one\ntwo", "Error: E\nv"]
    assert rows[1].texts == ["Text Output:\none\ntwo", "3"] and rows[2].texts == ["Error: E\nv\n['t1', 't2']"]


def test_settings(spark):
    spark.conf.set("tallyloom.test.n", "7")
    assert session.int_setting(spark, "tallyloom.test.n", 1) == 7
    assert session.int_setting(spark, "tallyloom.test.none", 1) == 1
    assert session.float_setting(spark, "tallyloom.test.n", 0.0) == 7.0
    assert session.bool_setting(spark, "tallyloom.test.none", True) is True
    assert session.setting(spark, "tallyloom.test.none") is None
    with pytest.raises(ValueError):
        session.bool_setting(spark, "tallyloom.test.n", True)


def test_results_come_through_the_cache(spark):
    cache = spark.createDataFrame([("http://a/", "cached")], "url string, info string")
    asked = spark.createDataFrame([("http://a",), ("http://b",), ("http://b/",)], "url string")
    everything, new = dataset_report.through_cache(cache, asked, "url", lambda df: df.withColumn("info", F.lit("made")))
    assert sorted(map(tuple, everything.collect())) == [("http://a/", "cached"), ("http://b/", "made")]
    assert [tuple(r) for r in new.collect()] == [("http://b/", "made")]


def test_runs_that_do_not_stop_are_returned(spark):
    runs = spark.createDataFrame([(1, 0), (2, 5), (3, None)], "run_id int, index int")
    route = F.when(F.col("index") > 6, "__end__").when(F.col("index").isNotNull(), "on")
    found = run_loop.repeat(runs, lambda df: df.withColumn("index", F.col("index") + 1), route, ["__end__"], cap=3)
    assert sorted((r.run_id, r.route) for r in found.collect()) == [(1, "step_cap"), (2, "__end__"), (3, "step_cap")]


def test_runs_stop_independently(spark):
    runs = spark.createDataFrame([(i, 0, i) for i in range(4)], "run_id int, index int, goal int")
    route = F.when(F.col("index") > F.col("goal"), "end").otherwise("on")
    done = run_loop.repeat(runs, lambda df: df.withColumn("index", F.col("index") + 1), route, ["end"])
    assert sorted((r.run_id, r["index"]) for r in done.collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]
