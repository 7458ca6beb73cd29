"""Vectors in clusters: the rows of a full scan, from a part of the files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.stored_vectors import VectorIndex

SCHEMA = "id long, embedding array<float>, kind int, distance_to string"


def made(n=600, dim=6):
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(12, dim)) * 5
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + pick.normal(size=dim)], i % 5, "clash") for i in range(n)]
    # A third at one place, and what is no hit.
    rows += [(n + i, rows[0][1], i % 5, None) for i in range(n // 3)]
    rows += [(9001, None, 1, None), (9002, [], 1, None), (9003, [1.0], 1, None), (9004, [math.nan] * dim, 1, None), (9005, [None] * dim, 1, None), (9006, [0.0] * dim, 1, None)]
    return rows


def brute(rows, query, k, metric, kind=None):
    found = []
    for id_, v, own, _ in rows:
        if v is None or len(v) != len(query) or any(x is None or not math.isfinite(x) for x in v) or kind not in (None, own):
            continue
        v, q = np.array(v), np.array(query)
        if metric == "cosine" and not v.any():
            continue
        found.append((float(((v - q) ** 2).sum()) if metric == "l2" else float(1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q)), id_))
    return sorted((round(d, 9), i) for d, i in found)[:k]


def listed(frame):
    return sorted((round(r.distance, 9) + 0.0, r.id) for r in frame.collect())


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    rows = spark.createDataFrame(made(), SCHEMA)
    return {m: VectorIndex.create(rows, str(tmp_path_factory.mktemp("v") / m), metric=m, clusters=12, ring_rows=30) for m in ("l2", "cosine")}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_same_rows_as_a_full_scan(indexes, metric):
    pick = random.Random(2)
    for k, kind in [(5, None), (250, None), (7, 3), (10_000, None)]:
        query = [x + pick.gauss(0, 0.5) for x in made()[pick.randrange(500)][1]]
        found = indexes[metric].nearest(query, k, None if kind is None else F.col("kind") == kind)
        assert listed(found) == brute(made(), query, k, metric, kind)
        assert found.columns == [*SCHEMA.replace(",", "").split()[::2], "distance"]
    with pytest.raises(ValueError, match="components"):
        indexes[metric].nearest([1.0], 1)


def test_reads_few_files(indexes):
    index = indexes["l2"]
    every = {f for v in index.versions for f in index.spark.read.parquet(f"{index.folder}/data/version={v}").inputFiles()}
    found = index.nearest(made()[7][1], 5)
    assert len(found.inputFiles()) < len(every) / 3
    assert "GreaterThanOrEqual(from_centre_" in found._jdf.queryExecution().executedPlan().toString()
    assert any("/ring_=1/" in f for f in every), "large clusters are cut into rings"


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_many_queries(spark, indexes, metric):
    asked = [(i, v) for i, v, _, _ in made() if i % 25 == 0 or i > 9000] + [(-1, [90.0] * 6)]
    found = indexes[metric].nearest_to_each(spark.createDataFrame(asked, "query_id long, embedding array<double>"), 4)
    got = sorted((r.query_id, r["rank"], round(r.distance, 9) + 0.0, r.id) for r in found.collect())
    usable = [(i, v) for i, v in asked if v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and (any(v) or metric == "l2")]
    want = sorted((i, n, *hit) for i, v in usable for n, hit in enumerate(brute(made(), v, 4, metric), 1))
    assert [(q, n, i) for q, n, _, i in got] == [(q, n, i) for q, n, _, i in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-8)


def test_queries_are_not_sent_everywhere(spark, indexes):
    asked = spark.createDataFrame([(i, v) for i, v, _, _ in made()[:60]], "query_id long, embedding array<double>")
    found = indexes["l2"].nearest_to_each(asked, 3)
    assert "CartesianProduct" not in (text := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in text
    assert found.count() == 180


def test_many_queries_are_compared_in_blocks(spark, tmp_path):
    """Not pair by pair; with copies, text ids, a common mean and more rows than a block holds."""
    pick = np.random.default_rng(5)
    rows = [(f"é{i}" if i % 3 else f"z{i}", [float(np.float32(x)) for x in 1000 + pick.normal(size=4)]) for i in range(2500)]
    rows += [(f"c{i}", rows[0][1]) for i in range(2500)]
    index = VectorIndex.create(spark.createDataFrame(rows, "id string, embedding array<float>"), str(tmp_path / "b"), clusters=2)
    asked = rows[:1400:7] + rows[2600:2610]
    found = index.nearest_to_each(spark.createDataFrame(asked, "query_id string, embedding array<float>"), 5)
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r["rank"], r.id, r.distance) for r in found.collect())
    vectors = np.array([v for _, v in rows])
    want = []
    for id_, v in asked:
        distance = sum((vectors[:, j] - v[j]) ** 2 for j in range(4)).tolist()
        best = sorted(zip(distance, (i for i, _ in rows)))[:5]
        want += [(id_, n, i, d) for n, (d, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_append_keeps_files_and_hides_what_is_not_complete(spark, tmp_path):
    rows = made()
    first = VectorIndex.create(spark.createDataFrame(rows[:300], SCHEMA), str(tmp_path / "x"), clusters=6)
    before = {f for f in spark.read.parquet(f"{first.folder}/data/version=0").inputFiles()}
    second = first.append(spark.createDataFrame(rows[300:], SCHEMA))
    assert listed(VectorIndex.open(spark, first.folder).nearest(rows[450][1], 9)) == brute(rows, rows[450][1], 9, "l2")
    assert listed(first.nearest(rows[450][1], 9)) == brute(rows[:300], rows[450][1], 9, "l2")
    assert before == {f for f in spark.read.parquet(f"{first.folder}/data/version=0").inputFiles()}
    with pytest.raises(RuntimeError, match="another writer"):
        first.append(spark.createDataFrame(rows[:1], SCHEMA))
    broken = spark.createDataFrame(rows[:3], SCHEMA).withColumn("kind", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        second.append(broken)
    assert VectorIndex.open(spark, first.folder).versions == [0, 1]


def test_empty_and_clashing(spark, tmp_path):
    empty = VectorIndex.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert empty.nearest([], 3).collect() == []
    assert empty.nearest_to_each(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3).collect() == []
    with pytest.raises(ValueError, match="layout"):
        VectorIndex.create(spark.createDataFrame([(1, [1.0], 2)], "id long, embedding array<float>, ring_ int"), str(tmp_path / "c"))
