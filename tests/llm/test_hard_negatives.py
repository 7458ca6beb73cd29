"""Hard negatives against all inner products, as whole numbers of Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_all_pairs(rows, every):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        if sum(x * x for x in v) < 1 << 62:
            kept.append((i, label, v))
    wide = max((len(v) for _, _, v in kept), default=0)
    kept = sorted((i, label, [float(x) for x in v], v + [0] * (wide - len(v))) for i, label, v in kept)
    kept = [(i, label, v) for i, label, _, v in kept]
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b) for b, (_, _, w) in enumerate(kept) if b != a)
        near = [(-s, b) for s, b in scored if kept[b][1] == label][:5]
        for score, b in near:
            far = [(-s, c) for s, c in scored if kept[c][1] != label and 50 * score <= -100 * s <= 95 * score][:3]
            out += [(i, kept[b][0], rank, kept[c][0], score, s) for rank, (s, c) in enumerate(far, 1)]
    return sorted(out)


def found(spark, rows, every, schema=SCHEMA):
    frame = hn.hard_negatives(spark.createDataFrame(rows, schema), F.col("id") % every == 0)
    return sorted(tuple(r) for r in frame.collect())


def clustered(seed, n, dim=6, spread=0.3):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [x + pick.gauss(0, spread) for x in pick.choice(centres)], pick.randrange(3)) for i in range(n)]


def odd():
    rows = clustered(2, 90, 4)
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [math.nan] * 4, 1), (203, [math.inf] * 4, 0), (204, [0.5] * 4, None), (None, [0.5] * 4, 1), (205, [1e300] * 4, 1)]
    rows += [(206, [1.0, 2.0], 1), (207, [], 2), (208, [0.0] * 4, 0)]
    # Repeated rows and ids, and ties.
    return rows + rows[:12] + [(5, [0.25] * 4, 1), (5, [0.25] * 4, 2)] + [(300 + i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(20)]


@pytest.mark.parametrize("rows, every", [([], 1), ([(0, [1.0], 1)], 1), (clustered(1, 300), 10), (odd(), 3), ([(i, [1e6 * (i % 7), 3e6, 2e6 * (i % 5)], i % 2) for i in range(40)], 4)])
def test_as_by_all_pairs(spark, monkeypatch, rows, every):
    monkeypatch.setattr(hn, "CELL_ROWS", 4)
    monkeypatch.setattr(hn, "FIRST_CELLS", 2)
    monkeypatch.setattr(hn, "CHUNK", 8)
    monkeypatch.setattr(hn, "ANCHORS", 5)
    assert found(spark, rows, every) == by_all_pairs(rows, every)


def test_extra_columns_with_names_of_its_own(spark):
    rows = [(i, [float(i % 3), 1.0], i % 2, "x", i) for i in range(20)]
    assert found(spark, rows, 5, SCHEMA + ", cell string, row int") == by_all_pairs([r[:3] for r in rows], 5)


def test_walk_falls_and_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(0)
    points = rng.normal(size=(400, 8))
    books = hn._codebook(points[:, :4], 6), hn._codebook(points[:, 4:], 7)
    (i, far_i), (j, far_j) = hn._nearest(points[:, :4], books[0]), hn._nearest(points[:, 4:], books[1])
    radii = np.zeros(6), np.zeros(7)
    np.maximum.at(radii[0], i, far_i)
    np.maximum.at(radii[1], j, far_j)
    used = np.zeros(42, bool)
    used[i * 7 + j] = True
    walked = list(hn.Cells(books, radii, used).walk(points[0]))
    assert sorted(c for _, _, c in walked) == np.flatnonzero(used).tolist()
    assert all(a[0] >= b[0] for a, b in zip(walked, walked[1:]))
    scores = points @ points[0]
    for most, least, cell in walked:
        inside = scores[i * 7 + j == cell]
        assert inside.max() <= most and inside.min() >= least


def test_anchors_and_chunks_are_not_broadcast(spark):
    asked = spark.createDataFrame([(1, a) for a in range(5)] + [(2, 0)], "part long, anchor long")
    asked = asked.selectExpr("part", "X'00' AS cells", "anchor", "0L AS label", "X'00' AS v", "array(0L) AS low", "array(9L) AS high")
    chunks = spark.createDataFrame([(1,), (1,), (2,), (3,)], "part long").selectExpr("part", *(f"X'00' AS {c}" for c in ("cells", "rows", "ids", "labels", "vs")))
    met = hn._met(asked, chunks, 1)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(len(r.asks) for r in met.collect()) == [1, 5, 5]


def test_an_anchor_is_sent_once_to_each_part(spark, monkeypatch):
    monkeypatch.setattr(hn, "CELL_ROWS", 4)
    monkeypatch.setattr(hn, "CHUNK", 16)
    monkeypatch.setattr(hn, "PART_ROWS", 64)
    rows, asked, met = clustered(3, 400), [], hn._met
    monkeypatch.setattr(hn, "_met", lambda table, *others: asked.append(table) or met(table, *others))
    assert found(spark, rows, 20) == by_all_pairs(rows, 20)
    for table in asked:
        assert table.count() == table.select("anchor", "part").distinct().count()
    # More than twice as many cells are asked as rows sent.
    assert sum(len(r.cells) // 8 for table in asked for r in table.collect()) > 2 * sum(table.count() for table in asked)
