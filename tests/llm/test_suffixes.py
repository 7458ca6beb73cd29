"""Removed repeats against a set of all strings seen so far."""

import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import suffixes

WIDTH = suffixes.WIDTH


def by_strings(rows):
    seen, out = set(), []
    for _, raw, doc_id in sorted(((i is not None, i or 0), (t or "").encode(), i) for i, t in rows):
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - WIDTH + 1):
            if raw[p : p + WIDTH] in seen:
                covered[p : p + WIDTH] = True
            seen.add(raw[p : p + WIDTH])
        kept = bytes(b for b, gone in zip(raw, covered) if not gone)
        spans = sum(1 for p in range(len(raw)) if covered[p] and not (p and covered[p - 1]))
        out.append((doc_id, len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, schema="doc_id long, text string"):
    kept = suffixes.without_repeats(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in kept), key=repr)


def mixed(seed=1, n=120):
    pick = random.Random(seed)
    words = lambda k: " ".join("".join(pick.choices("abcdefgh", k=pick.randint(2, 9))) for _ in range(k))
    shared = [words(pick.randint(5, 150)) for _ in range(25)]
    rows = []
    for i in range(n):
        text = " ".join(pick.choice(shared) if pick.random() < 0.5 else words(pick.randint(1, 60)) for _ in range(pick.randint(1, 5)))
        rows.append((i, text[pick.randint(0, len(text) // 2) :]))
    return rows


ODD = [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "x" * 101), (205, "x" * 700), (206, "ab" * 300), (207, "\0" * 300), (None, "y" * 150), (208, "é" * 150), (209, "é" * 150), (209, "é" * 150), (-3, "ab" * 90)]


@pytest.mark.parametrize("rows", [[], [(1, None)], ODD, mixed() + ODD])
def test_as_by_strings(spark, monkeypatch, rows):
    monkeypatch.setattr(suffixes, "BUCKET", 3000)
    assert found(spark, rows) == by_strings(rows)


def test_documents_of_many_pieces_and_blocks(spark, monkeypatch):
    for name, value in (("BUCKET", 3000), ("PIECE", 700), ("BLOCK", 3000), ("BLOCK_ROWS", 7)):
        monkeypatch.setattr(suffixes, name, value)
    rows = mixed(2, 60) + ODD
    assert found(spark, rows) == by_strings(rows)


def test_extra_columns_with_names_of_its_own(spark):
    rows = [(i, "z" * 60 + str(i % 2) * 60, "x", i) for i in range(4)]
    assert found(spark, rows, "doc_id long, text string, block string, size int") == by_strings([r[:2] for r in rows])


def test_packed_numbers():
    for values in ([], [0], [7, 7, 9], [5, 3], [2**63, 1], list(range(1000)), [2**64 - 1]):
        values = np.array(values, np.uint64)
        assert suffixes._unpack(suffixes._pack(values)).tolist() == values.tolist()
    parts = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint64), np.array([9], np.uint64)]
    assert [p.tolist() for p in suffixes._unpack_all(suffixes._pack_all(*parts))] == [p.tolist() for p in parts]


def test_merged_order_is_that_of_the_suffixes():
    """Ranks of the sample taken from a plain sort give the plain order of all positions."""
    pick = random.Random(5)
    text = bytes(pick.choices(b"ab", k=400))
    layout = suffixes.Layout(np.array([400 - WIDTH + 1]))
    letters = layout.letters(text[:400])
    order = {p: i + 1 for i, p in enumerate(sorted(range(400), key=lambda p: text[p:]))}
    ranks = np.array([order.get(p, 0) if layout.members[1][p] else 0 for p in range(layout.n)], np.uint64)
    at = np.flatnonzero(layout.ranked[0])
    ahead, step = suffixes._ahead, suffixes.STEPS[0]
    key = np.stack([letters[at], ahead(letters, step)[at], ranks[at], ahead(ranks, step)[at], ahead(ranks, 2 * step)[at]])
    merged = at[suffixes._merged(layout.place[at] // step % 3, key)]
    assert merged.tolist() == sorted(range(400 - WIDTH + 1), key=lambda p: text[p:])
