"""Inputs at the edge of a rule: nulls, empty lists, unlisted values, both forms of a format."""

import json
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import markup, slices
from tallyloom.operators import evaluation, features, history, keyed_log, records, retrieval
from tallyloom.plans import dataset_report, run_loop
from tallyloom.sources import documents

ROOT = Path(__file__).resolve().parent.parent


def test_all_documents_are_listed(spark):
    store = spark.range(2500).select(F.col("id").cast("string").alias("id"), F.create_map(F.lit("doc_type"), F.lit("a")).alias("metadata"))
    assert retrieval.list_documents(store).count() == 2500 and retrieval.list_documents(store, limit=7).count() == 7


def test_plans_end(spark):
    df = spark.createDataFrame([(0, []), (0, ["a"]), (0, ["a", "b"]), (5, ["a"]), (0, None)], "i int, p array<string>")
    assert [r[0] for r in df.select(run_loop.plan_route(F.col("i"), F.col("p"))).collect()] == ["__end__", "__end__", "enhancer", "__end__", "__end__"]


def test_attempts_without_an_error_flag_stay(spark):
    runs = spark.createDataFrame([(1, None, 3), (2, "yes", 9)], "run_id int, error string, iterations int")
    same = lambda df: df
    assert {r.run_id: r.outcome for r in run_loop.solve_task(runs, same, same, same).collect()} == {1: "__end__", 2: "fail"}


def test_measures(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "y int, p int")
    assert sorted(map(tuple, evaluation.confusion_matrix(pairs, "y", "p", [0, 1]).collect())) == [(0, 1, 2), (1, 0, 0)]
    with pytest.raises(Exception, match="is no class: 2"):
        evaluation.confusion_matrix(pairs.union(spark.createDataFrame([(0, 2)], "y int, p int")), "y", "p", [0, 1]).collect()
    assert evaluation.accuracy(spark.createDataFrame([(1, 1), (1, None)], "y int, p int"), "y", "p").first()[0] == 0.5


@pytest.mark.parametrize(
    "wanted, ids",
    [({"a": True}, [1]), ({"a": "true"}, [2]), ({"a": 1}, [3, 4]), ({"a": 1.0}, [3, 4]), ({"a": "1"}, [5]), ({"a": {"b": [1, "x"]}}, [6]), ({"a.b": "deep"}, [7]), ({"a": None}, [8, 9, 10])],
)
def test_metadata_has_types(spark, wanted, ids):
    texts = ['{"a": true}', '{"a": "true"}', '{"a": 1}', '{"a": 1.0}', '{"a": "1"}', '{"a": {"b": [1, "x"]}}', '{"a": {"b": "deep"}}', '{"a": null}', "{}", "no json"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id int, m string")
    assert [r.id for r in df.where(keyed_log.metadata_equals(F.col("m"), wanted)).orderBy("id").collect()] == ids


def test_null_keys_are_keys(spark):
    base = spark.createDataFrame([(None, "old", 1), (1, "one", 2)], "k int, v string, w int")
    changes = spark.createDataFrame([(None, "new", 7, 1), (2, "two", 8, 1)], "k int, v string, w int, ver int")
    found = keyed_log.upsert(base, changes, ["k"], [F.desc("ver")])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "one", 2), (2, "two", 8), (None, "new", 7)]
    found = keyed_log.set_fields(base, changes, ["k"], ["v"], [F.desc("ver")], insert=True)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "one", 2), (2, "two", None), (None, "new", 1)]


def test_split_refuses_null_keys(spark):
    with pytest.raises(Exception, match="k is null"):
        features.mark_test_rows(spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "k int"), "k").collect()


def test_no_codes_asked_for_means_all_but_the_oldest(spark):
    log = spark.createDataFrame([("r", i, f"c{i}") for i in range(3)], "run_id string, seq int, code string")
    assert sorted(r.seq for r in history.executed_codes(log, 0).collect()) == [1, 2]
    df = spark.createDataFrame([(["a", "b", "c"],)], "a array<string>")
    zero, default = df.select(slices.executed_codes(F.col("a"), 0), slices.executed_codes(F.col("a"))).first()
    assert zero == default


def test_notebook_texts_in_both_forms(spark):
    book = {"cells": [
        {"cell_type": "code", "source": "x = 1", "outputs": [{"output_type": "display_data", "data": {"text/plain": ["a\n", "b"], "application/json": {"k": 1}}}, {"output_type": "stream", "name": "stdout", "text": "said"}]},
        {"cell_type": "markdown", "source": ["[1,\n", "2]"]},
        {"cell_type": "markdown", "source": "[1, 2]"},
    ]}
    rows = documents.notebook_cells(spark.createDataFrame([(json.dumps(book),)], "book string"), "book").orderBy("seq").collect()
    assert [r.code for r in rows] == ["x = 1", "[1,\n2]", "[1, 2]"]
    assert rows[0].outputs[0].data == {"text/plain": "a\nb", "application/json": '{"k":1}'} and rows[0].outputs[1].text == "said"


def test_fields_of_many_lines_keep_their_rows(spark, tmp_path):
    rows = [(1, "l1\nl2", None), (2, "", "x\x1ey")]
    path = str(tmp_path / "fields")
    documents.write_fields(spark.createDataFrame(rows, "id int, a string, b string"), ["a", "b"], path, keys=["id"])
    for i, field in enumerate("ab", 1):
        found = documents.read_field(spark, path, field, "id int, value string")
        assert sorted(map(tuple, found.collect())) == [(r[0], r[i]) for r in rows]


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; names = e.queries(); print(len(names), any(n.startswith('op') and n[2].isdigit() for n in names), 'pipeline' in names)"
    out = subprocess.run([sys.executable, "-c", code], cwd=bare, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split()[1:] == ["False", "False"], out.stderr[-600:]


def test_elements_by_class(spark):
    page = '<div class="x"><div class="a c b">hit</div></div><div class="a">miss</div>'
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(markup.inner_html(F.col("h"), "div.a.b"), markup.inner_html(F.col("h"), "div.x > .c"), markup.inner_html(F.col("h"), "div.z")).first()[:] == ("hit", "hit", None)


def test_markdown_of_lists_tables_and_open_heads(spark):
    page = "<head><title>t</title><p>seen</p><ol start=3><li>c<li>d</ol><table><caption>a | b</caption><tr><td>1<td>2<tr><td>3<td>4</table>"
    found = spark.createDataFrame([(page,)], "h string").select(markup.html_to_markdown("h")).first()[0]
    assert found.startswith("seen") and "3. c" in found and "4. d" in found and found.count("---") == 2


def test_long_lists_take_time_in_proportion():
    def seconds(n):
        start = time.perf_counter()
        writer = markup._MarkdownWriter()
        writer.feed("<ol>" + "<li>item</li>" * n + "</ol>")
        writer.close()
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.005)


def test_log_views_name_what_is_missing(spark):
    whole = spark.range(1).select(F.lit("r").alias("run_id"), *[F.lit(c).alias(c) for c in sorted({c for step in records.LOGGED.values() for c in step})])
    for step, fields in records.LOGGED.items():
        assert records.log_view(whole, step).columns == ["run_id", *fields]
    with pytest.raises(Exception, match="best_score"):
        records.log_view(whole.drop("best_score"), "enhancer")


def test_indented_records_read_like_plain_json(spark):
    record = {"a": "x : y", "b \" c": 1, "d": None}
    df = spark.createDataFrame([("x : y", 1, None)], "a string, `b \" c` int, d string")
    assert df.select(documents.pretty_json(F.struct("*"))).first()[0] == json.dumps(record, indent=2)


def test_cells_of_a_report_stay_in_their_rows(spark):
    df = spark.createDataFrame([("a|b\nc", None)], "s string, n int")
    assert dataset_report.head_markdown(df, ["s"]).split("\n")[2:] == ["| 0 | a\\|b<br>c | nan |"]


def test_frames_whose_columns_differ_in_order(spark):
    text = json.dumps({"a": {"0": 1, "1": 2}, "b": {"1": "y", "0": "x"}})
    schema = T.StructType.fromDDL("a int, b string, missing string")
    rows = spark.createDataFrame([(text,)], "j string").select(F.inline(documents.frame_rows(F.col("j"), schema))).collect()
    assert [tuple(r) for r in rows] == [("0", 1, "x", None), ("1", 2, "y", None)]


def test_dropped_tables_are_gone(spark):
    from tallyloom import scratch

    table = scratch.materialize(spark.range(10), "gone")
    folder = table.inputFiles()[0].rpartition("/")[0]
    scratch.drop(table)
    scratch.release(spark)
    assert folder.rpartition("/")[2] not in scratch.subfolders(spark, folder.rpartition("/")[0])


def test_new_memories_of_one_owner_are_numbered_by_a_stated_order(spark):
    from tallyloom.plans.assistant import remember

    items = spark.createDataFrame([("a", 1.0, 4, "old")], "owner string, importance double, seq long, text string")
    new = spark.createDataFrame([("a", 1.0, "z"), ("a", 1.0, "b"), ("a", 2.0, "m"), ("c", 1.0, "x")], "owner string, importance double, text string")
    for parts in (1, 3):
        found = sorted((r.owner, r.seq, r.text) for r in remember(items, new.repartition(parts), 3).collect())
        assert found == [("a", 4, "old"), ("a", 5, "m"), ("a", 6, "b"), ("c", 0, "x")]


def test_indented_records_are_split_at_their_own_end(spark, tmp_path):
    from tallyloom.sources.documents import read_indented, write_json

    texts = ["", "}\n", "a\n}\nb", '{"x": 1}', None, "\u00e9" * 50]
    rows = spark.createDataFrame([(i, t, (t,), [t, "}"]) for i, t in enumerate(texts)], "id long, t string, s struct<u: string>, l array<string>").coalesce(1)
    write_json(rows, F.struct("*"), f"{tmp_path}/out")
    back = read_indented(spark, f"{tmp_path}/out", "id long, t string, s struct<u: string>, l array<string>")
    assert sorted(back.collect()) == sorted(rows.collect())
    write_json(rows.limit(0), F.struct("*"), f"{tmp_path}/none")
    assert read_indented(spark, f"{tmp_path}/none", "id long").count() == 0


def test_missing_texts_have_no_summary(spark):
    from tallyloom.plans.dataset_report import summarize_problems

    problems = spark.createDataFrame([(1, ("d", None, "x")), (2, None)], "id int, scraped_data struct<description: string, evaluation: string, data_details: string>")
    judge = lambda c: F.struct(F.upper(c).alias("description"), F.lit("m").alias("metric"))
    found = {r.id: r.summarized for r in summarize_problems(problems, F.upper, judge, F.upper).collect()}
    assert tuple(found[1]) == ("D", None, "X") and tuple(found[2]) == (None, None, None)
