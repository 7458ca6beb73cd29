import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.alignment import characters, edit_distance, runs_allow, similar
from tallyloom.llm.components import components, linked_groups
from tallyloom.llm.prefix import numbered, numbered_in_groups
from tallyloom.llm.sieve import Sieve
from tallyloom.llm.words import Texts, slices, windows

TEXTS = ["", None, " ", "one", "One two\tthree\n\x0bfour ", "é über x 　y", "a" * 1000, "\n\n", "end"]


def test_words_of_texts():
    t = Texts(pa.array(TEXTS))
    t.words()
    for i, text in enumerate(TEXTS):
        own = [t.data[a:b].tobytes().decode() for a, b in zip(t.start[t.word_at[i] : t.word_at[i + 1]], t.end[t.word_at[i] : t.word_at[i + 1]])]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_hashes_follow_the_text_alone():
    a, b = Texts(pa.array(["x", "same words HERE", None])), Texts(pa.array(["longer before", "Same words here"]))
    a.words(), b.words()
    ha, hb = a.hashes(a.start, a.end), b.hashes(b.start, b.end)
    assert ha[1:4].tolist() == hb[2:5].tolist()
    assert a.hashes(a.start, a.end, fold=False)[1] != b.hashes(b.start, b.end, fold=False)[2]
    key, first = windows(ha, a.word_at, 3)
    assert first.tolist() == [1] and len(key) == 1


def test_slices_cover_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 300_000, None, "b", "c" * 300_000, ""] * 3})
    assert pa.Table.from_batches(list(slices(batch, "text"))).column("text").to_pylist() == batch.column("text").to_pylist()
    assert list(slices(batch.slice(0, 0), "text")) == []


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_banded_distance_is_the_edit_distance():
    random = np.random.default_rng(1)
    for _ in range(400):
        a = random.integers(0, 4, random.integers(0, 14))
        b = random.integers(0, 4, random.integers(0, 14)) if random.random() < 0.5 else np.delete(a, slice(2, 4))
        expected = plain_distance(a.tolist(), b.tolist())
        for most in (0, 1, 3, 8, 20):
            assert edit_distance(a, b, most) == (expected if expected <= most else None)
    assert similar(np.arange(10), np.r_[np.arange(8), 77, 78], 0.8) and not similar(np.arange(10), np.r_[np.arange(7), 77, 78, 79], 0.8)


def test_components_against_union_find(spark):
    random = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in random.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]
    above = {}

    def root(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        above.setdefault(a, root(a)), above.setdefault(b, root(b))
        above[high] = low
    nodes = {x for link in links if link[0] != link[1] for x in link}
    found = components(spark.createDataFrame(links + [(None, 1), (5, None)], "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_are_found_without_pairs(spark):
    # One bucket with a large group, two strangers that are linked to each other, and a chain that only a non-pivot joins.
    rows = [(1, n, 1) for n in (10, 11, 12, 13, 50, 51, 70)] + [(2, 13, 5), (2, 70, 1), (2, 71, 1)]
    truth = {(10, 11), (10, 12), (10, 13), (50, 51), (70, 71), (12, 70)} | {(11, 13), (12, 13), (11, 12)}
    asked = []

    def verify(pairs):
        found = [tuple(r) for r in pairs.collect()]
        asked.extend(found)
        return spark.createDataFrame([p for p in found if p in truth], "a long, b long")

    groups = {r.node: r.root for r in linked_groups(spark.createDataFrame(rows, "bucket long, node long, weight long"), verify).collect()}
    assert groups == {10: 10, 11: 10, 12: 10, 13: 10, 70: 10, 71: 10, 50: 50, 51: 50}
    assert len(asked) == len(set(asked))


def test_larger_buckets_are_grouped_too(spark, monkeypatch):
    from tallyloom.llm import components as module

    monkeypatch.setattr(module, "FEW", 4)
    verify = lambda pairs: pairs.where("pmod(a, 7) = pmod(b, 7)")
    sides = lambda x, y: (x("n") - y("n")) == 0
    members = spark.range(90).select(F.expr("id div 30").alias("bucket"), F.col("id").alias("node"), F.lit(1).alias("weight"))
    members = members.union(spark.range(100, 103).select(F.lit(9), F.col("id"), F.lit(1)))
    of_nodes = members.select("node", F.expr("node div 45").alias("n"))
    for conditions in ((), (sides, sides, of_nodes)):
        groups = {r.node: r.root for r in linked_groups(members, verify, *conditions).collect()}
        for bucket in range(3):
            for node in range(30 * bucket, 30 * bucket + 30):
                alike = [n for n in range(30 * bucket, 30 * bucket + 30) if n % 7 == node % 7 and (not conditions or n // 45 == node // 45)]
                assert groups.get(node, node) == min(alike)
        assert not set(groups) & {100, 101, 102}


def test_spent_tables_are_deleted_and_no_group_is_lost(spark):
    from tallyloom.scratch import materialize

    def verify(pairs):
        stored = materialize(pairs, "pairs-of-a-test")
        verify.spent.append(stored)
        made.append(stored.inputFiles())
        return stored.where("pmod(a, 3) = pmod(b, 3)")

    verify.spent, made = [], []
    rows = [(b, n, 1) for b, n in [(1, 1), (1, 4), (1, 5), (1, 8), (2, 8), (2, 11), (3, 1)]]
    members = materialize(spark.createDataFrame(rows, "bucket long, node long, weight long"))
    files = members.inputFiles()
    groups = {r.node: r.root for r in linked_groups(members, verify, spend=True).collect()}
    assert groups == {1: 1, 4: 1, 5: 5, 8: 5, 11: 5}
    there = lambda paths: [p for p in paths if Path(p.removeprefix("file://")).exists()]
    assert files and any(made) and not there(files) and not any(there(paths) for paths in made)


def test_running_sums(spark):
    rows = [(i % 3, i, (i * 7) % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    found = sorted((r.k, r.number, r.before) for r in numbered(df, [F.col("k")], F.col("v")).collect())
    assert found == [(k, k, sum(v for _, j, v in rows if j < k)) for _, k, _ in sorted(rows, key=lambda r: r[1])]
    found = {r.k: (r.number, r.before) for r in numbered_in_groups(df, "g", F.expr("k div 10"), [F.col("k")], F.col("v")).collect()}
    assert found == {k: (sum(1 for a, b, _ in rows if a == g and b < k), sum(v for a, b, v in rows if a == g and b < k)) for g, k, _ in rows}


def test_sieve_loses_nothing(spark):
    rows = spark.range(5000)
    keys = rows.where("id % 7 = 0").select(F.xxhash64("id").alias("k"))
    some, none = Sieve(keys, F.col("k")).split(rows, F.xxhash64("id"))
    kept, left = {r.id for r in some.collect()}, {r.id for r in none.collect()}
    assert kept >= set(range(0, 5000, 7)) and not kept & left and len(kept) + len(left) == 5000
    pairs = rows.select("id", F.array(F.xxhash64("id"), F.xxhash64(F.col("id") + 1)).alias("both"))
    found = {r.id for r in Sieve(keys, F.col("k")).with_any(pairs, F.col("both")).collect()}
    assert found >= {i for i in range(5000) if i % 7 == 0 or (i + 1) % 7 == 0 and i < 4999} and len(found) < 1600
    some, none = Sieve(keys.limit(0), F.col("k")).split(rows, F.xxhash64("id"))
    assert some.count() == 0 and none.count() == 5000


@pytest.mark.parametrize("width", [1, 5])
def test_windows_stay_inside_rows(width):
    at = np.array([0, 0, 3, 9, 10])
    _, first = windows(np.arange(10, dtype=np.uint64), at, width)
    assert first.tolist() == [i for a, b in zip(at, at[1:]) for i in range(a, b - width + 1)]


def test_runs_in_common_keep_every_similar_pair():
    rng = np.random.default_rng(12)
    pairs = []
    for _ in range(300):
        a = rng.integers(97, 102, rng.integers(0, 120)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, 16)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.choice([97, 0xF6, 0x1F600], int(rng.integers(0, 2))).tolist()
        pairs.append(["".join(map(chr, x)) for x in (a, b)])
    pairs += [["", ""], ["", "a"], ["a" * 40, "b" * 40]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pairs))), *(pa.array(x, pa.string()) for x in zip(*pairs))], names=["n", "text_a", "text_b"])
    left = {n for part in runs_allow(0.9)([batch]) for n in part.column("n").to_pylist()}
    linked = {n for n, pair in enumerate(pairs) if similar(*characters(pa.array(pair, pa.string())), 0.9)}
    assert len(linked) > 50 and linked <= left and len(left) < len(pairs)
