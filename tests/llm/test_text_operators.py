"""Rules, lines, near copies and mixing on small tables, against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import alignment, lines, mixture, near_duplicates, quality
from tallyloom.llm.words import Texts

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int = 60) -> str:
    return " ".join(f"{WORDS[(seed * 31 + i * (seed + 7)) % 24]}{(seed * 17 + i * i) % 97}" for i in range(n)) + "."


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rule_statistics(spark, documents):
    odd = [(None, None), (1, ""), (1, ""), (2, " \n\t"), (3, "a b c d e f g h " * 3), (4, "x\nx\n\n\nx \n"), (5, "é|é $ <b> "), (6, "word " * 40_000)]
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + odd
    found = quality.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in found), key=str) == sorted(((i, *counts(t)) for i, t in rows), key=str)


def test_rules_keep_good_and_reject_junk(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.judge(docs, marks).join(marks, "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert all(good) and sum(bad) <= 0.05 * len(bad)
    passed = quality.keep_good(docs, marks)
    assert passed.schema == docs.schema
    assert {r.doc_id for r in passed.select("doc_id").collect()} == {r.doc_id for r in quality.judge(docs, marks).where("kept").collect()}


def test_rules_on_poor_tables(spark, labels):
    none = spark.createDataFrame([], DOCS)
    assert quality.judge(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    docs = spark.createDataFrame([(1, prose(1), "clash", 5), (None, None, "x", 1), (1, prose(1), "clash", 5)], "doc_id long, text string, kept string, n_words int")
    no_labels = spark.createDataFrame([(None, 1), (7, None)], "doc_id long, quality int")
    judged = quality.judge(docs, no_labels).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in judged) == [("1", False, True), ("1", False, True), ("None", True, False)]
    assert quality.keep_good(docs, no_labels).columns == docs.columns


def brute_groups(rows, least=0.8):
    shingles = {}
    for i, text in rows:
        w = (text or "").lower().split()
        if w:
            shingles[i] = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)}
    holders = defaultdict(set)
    for i, s in shingles.items():
        for x in s:
            holders[x].add(i)
    return {(a, b) for h in holders.values() for a in h for b in h if a < b and len(shingles[a] & shingles[b]) >= least * len(shingles[a] | shingles[b])}


def test_near_copies_of_the_test_table(spark, documents):
    found = {r.doc_id: r for r in near_duplicates.near_duplicates(documents).collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert set(found) == {i for i, _ in rows}
    for a, b in brute_groups(rows):
        assert found[a].group_id == found[b].group_id
    shingled = {i: set(zip(*((t or "").lower().split()[k:] for k in range(5)))) for i, t in rows}
    for i, r in found.items():
        assert r.kept == (r.group_id == i)
        if not r.kept and shingled[i]:
            assert any(shingled[i] & shingled[j] for j in found if j != i and found[j].group_id == r.group_id)
    kept = near_duplicates.drop_near_duplicates(documents)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if r.kept) and kept.columns == documents.columns


def test_near_copies_of_odd_rows(spark):
    long = prose(3, 3000)
    changed = long.replace("alpha", "omega", 1)
    rows = [(5, long), (9, changed), (7, long), (7, long), (None, long), (None, prose(8)), (1, None), (2, ""), (3, " \n"), (11, "two words"), (12, "two words"), (13, "Two  WORDS"), (14, "other words"), (20, prose(20)), (21, prose(21))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kept int, group_id string")
    found = near_duplicates.near_duplicates(docs)
    group = {r.doc_id: r.group_id for r in found.where("doc_id IS NOT NULL").collect()}
    assert group[5] == group[9] == group[7] and group[11] == group[12] == group[13] == 11
    assert all(group[i] == i for i in (1, 2, 3, 14, 20, 21))
    assert found.where("doc_id IS NULL").count() == 2
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 2
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 11, 14, 20, 21]
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0 and near_duplicates.drop_near_duplicates(docs.limit(0)).count() == 0


def test_scattered_edits_meet_in_a_sketch(spark):
    import random

    r = random.Random(2)
    pairs = []
    for k in range(200):
        a = [f"w{r.randrange(5000)}" for _ in range(r.choice([50, 200, 600]))]
        b = list(a)
        for i in r.sample(range(len(a)), len(a) // 5):
            b[i] = f"x{r.randrange(5000)}"
        pairs.append((" ".join(a), " ".join(b)))
    assert all(alignment.similar(*alignment.words_of(pa.array(p)), 0.8) for p in pairs)
    found = near_duplicates.sketches(Texts(pa.array([t for p in pairs for t in p])))
    assert sum(bool((found[2 * i] == found[2 * i + 1]).any()) for i in range(200)) >= 0.9 * 200
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs[:60]) for j, t in enumerate(p)], "doc_id long, text string")
    group = {r.doc_id: r.group_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert sum(group[2 * i] == group[2 * i + 1] for i in range(60)) >= 0.9 * 60
    assert len(set(group.values())) >= 60


def test_hot_group_of_near_copies(spark):
    base = prose(4, 200).split()
    rows = [(i, " ".join(base[: i % 190] + [f"new{i}"] + base[i % 190 + 1 :])) for i in range(300)] + [(1000 + i, prose(50 + i, 200)) for i in range(20)]
    found = {r.doc_id: r.group_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(300)} == {0} and all(found[1000 + i] == 1000 + i for i in range(20))


def test_repeated_lines(spark):
    a, b, near = prose(1, 30), prose(2, 30), prose(1, 30).replace("theta", "thetb", 1)
    rows = [(2, f"{a}\nkeep two\n\n"), (1, f"{b}\n{a}\n{b}"), (3, f"{near}\nkeep three"), (4, None), (5, ""), (6, a), (6, a), (7, "...\n...\n--"), (None, f"{b}\nnull one")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, lines_dropped int")
    found = lines.drop_repeated_lines(docs)
    assert found.columns == [*docs.columns, "lines_dropped_"]
    got = sorted(((r.doc_id, r.text, r.lines_dropped_) for r in found.collect()), key=str)
    expected = [(2, "keep two\n\n", 1), (1, a, 2), (3, "keep three", 1), (4, None, 0), (5, "", 0), (6, "", 1), (6, "", 1), (7, "...\n...\n--", 0), (None, f"{b}\nnull one", 0)]
    assert near != a and got == sorted(expected, key=str)
    left = lines.drop_repeated_lines(docs, keep_emptied=False).collect()
    assert 6 not in {r.doc_id for r in left} and {4, 5, 7} <= {r.doc_id for r in left}
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


def test_exact_lines_stay_once_in_the_test_table(spark, documents):
    found = {r.doc_id: r.text for r in lines.drop_repeated_lines(documents).collect()}
    before, after = Counter(), Counter()
    for r in documents.collect():
        before.update(filter(None, (lines.normal(x.encode()) for x in r.text.split("\n"))))
        after.update(filter(None, (lines.normal(x.encode()) for x in found[r.doc_id].split("\n"))))
        assert all(line in r.text.split("\n") for line in found[r.doc_id].split("\n") if line)
    assert all(n == 1 for n in after.values())
    # A line is gone only where another like it is left: most lines that occur once stay.
    once = [line for line, n in before.items() if n == 1]
    assert sum(line in after for line in once) >= 0.9 * len(once)


def water_level(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, stopped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in stopped]
        share = {s: (left - sum(2 * sizes[x] for x in stopped)) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in stopped else share[s] for s in order}
        stopped |= above


@pytest.mark.parametrize("slots", [mixture.SLOTS, 500])
def test_mix(spark, documents, monkeypatch, slots):
    monkeypatch.setattr(mixture, "SLOTS", slots)
    extra = [(90_001, prose(1), "en", None, 1), (90_002, None, "en", None, 1), (90_003, "", "en", "zz", 1), (None, prose(2), "en", "src1", 1), (90_004, prose(3), "en", "src1", 1), (90_004, prose(3), "en", "src1", 1)]
    docs = documents.union(spark.createDataFrame(extra, DOCS))
    found = mixture.mix(docs).collect()
    assert len(found) == docs.count()
    size = defaultdict(int)
    for r in docs.collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    expected = water_level({s: n for s, n in size.items()})
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == size[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    block = max(1, int(1.5 * sum(size.values()) // slots))
    assert all(abs(taken[s] - expected[s]) <= 6 * block for s in size)
    again = mixture.mix(docs.repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


@pytest.mark.parametrize("slots", [mixture.SLOTS, 500, 7, 1])
def test_each_source_gets_its_target(spark, documents, monkeypatch, slots):
    monkeypatch.setattr(mixture, "SLOTS", slots)
    docs = documents.union(spark.createDataFrame([(90_000 + i, f"tiny {i}", "en", f"t{i}", 1) for i in range(9)], DOCS))
    taken, target = defaultdict(int), {}
    for r in mixture.mix(docs).collect():
        assert (r.uses > 0) == (r.taken > 0)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert taken == {s: round(t) or 1 for s, t in target.items()}
    assert {f"t{i}" for i in range(9)} <= {r.source for r in mixture.mixed_documents(docs).select("source").collect()}


def test_schedule_keeps_shares_in_every_stretch(spark):
    shares = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 20.0), (3, 0.0)], "number long, target double")
    rows = sorted(mixture.schedule(shares, 1000).collect())
    assert [r.slot for r in rows] == list(range(1000))
    for start in range(0, 1000, 100):
        part = Counter(r.number for r in rows[start : start + 100])
        assert abs(part[0] - 50) <= 3 and abs(part[1] - 30) <= 3 and abs(part[2] - 20) <= 3 and part[3] == 0
    for n in range(3):
        assert [r.block for r in rows if r.number == n] == list(range(sum(r.number == n for r in rows)))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixture.mix(docs).count() == 0 and mixture.mixed_documents(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOCS)
    assert [(r.taken, r.target) for r in mixture.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]
    assert mixture.mixed_documents(blank).count() == 0


def test_mixed_documents_repeat_by_pass(spark, documents):
    uses = {r.doc_id: r.uses for r in mixture.mix(documents).collect()}
    mixed = mixture.mixed_documents(documents)
    assert mixed.columns == documents.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in uses.items() if n})


def changed_lines(kind, n, seed):
    """Pairs of lines at about the least similarity: words replaced, one word added, or letters changed here and there."""
    import random

    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinsrhldcumfpgwyb") for _ in range(r.randint(3, 8)))
    pairs = []
    while len(pairs) < n:
        if kind == "short":
            a = " ".join(word() for _ in range(r.randint(2, 8)))
        else:
            a = " ".join(word() for _ in range({"words": 20, "many words": 50, "added": 10, "letters": 20, "few letters": 20}[kind]))
        b = a.split() if "words" in kind or kind == "added" else list(a)
        if "words" in kind:
            for i in r.sample(range(len(b)), len(b) // 10):
                b[i] = word()
        elif kind == "added":
            b.insert(r.randint(0, 10), word())
        else:
            for i in r.sample([i for i, c in enumerate(b) if c != " "], {"short": 1, "letters": len(a) // 10, "few letters": len(a) // 20}[kind]):
                b[i] = "z"
        b = (" " if "words" in kind or kind == "added" else "").join(b)
        x, y = alignment.characters(pa.array([a, b]))
        if a != b and alignment.similar(x, y, 0.9):
            pairs.append((a, b))
    return pairs


@pytest.mark.parametrize("kind", ["words", "many words", "added", "short", "letters", "few letters"])
def test_similar_lines_meet_in_a_bucket(kind):
    pairs = changed_lines(kind, 400, 3)
    rows = lines._line_rows(Texts(pa.array([line for pair in pairs for line in pair])))
    keys = [set() for _ in range(2 * len(pairs))]
    for line, key in zip(*(x.tolist() for x in lines.keys_of(rows[-1], rows[2]))):
        keys[line].add(key)
    met = sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs)))
    assert met >= 0.9 * len(pairs), met


def test_unrelated_lines_of_few_syllables_share_few_buckets():
    import random

    r = random.Random(21)
    syllables = "the and ing ion th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar".split()
    line = lambda: " ".join(r.choice(("the", *("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(4)))) for _ in range(r.randint(8, 25)))
    rows = lines._line_rows(Texts(pa.array([line() for _ in range(3000)])))
    _, found = lines.keys_of(rows[-1], rows[2])
    shared = Counter(Counter(found.tolist()).values())
    assert sum(n * (n - 1) // 2 * times for n, times in shared.items()) < 12000


def test_short_lines_and_single_letters_are_linked(spark):
    shown = ["Home | Contact | Imprint", "Home | Contact | Imprimt", "Copyright 2023 by the authors", "Copyright 2024 by the authors", "Open from Monday", "Shut on Tuesdays", "größere Straße, später", "größere Strasse, später"]
    pairs = changed_lines("words", 12, 5) + changed_lines("added", 6, 7) + changed_lines("short", 12, 9)
    rows = [(i, line) for i, line in enumerate(shown)] + [(100 + i, line) for i, line in enumerate(x for pair in pairs for x in pair)]
    found = {r.doc_id: r.lines_dropped_ for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(8)] == [0, 1, 0, 1, 0, 0, 0, 1]
    assert sum(found[100 + 2 * i + 1] for i in range(len(pairs))) >= 0.9 * len(pairs) and not any(found[100 + 2 * i] for i in range(len(pairs)))


def test_ids_of_any_sign_and_rows_that_share_id_and_text(spark):
    text, near = prose(60, 60), prose(60, 60) + " end"
    rows = [(-5, text, "a"), (-5, text, "b"), (-5, text, "b"), (3, near, "c"), (None, prose(61, 60), "d"), (-9, prose(62, 60), "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    group = {r.doc_id: r.group_id for r in near_duplicates.near_duplicates(docs).where("doc_id IS NOT NULL").collect()}
    assert group == {-5: -5, 3: -5, -9: -9}
    kept = sorted(((r.doc_id, r.lang) for r in near_duplicates.drop_near_duplicates(docs).collect()), key=repr)
    assert kept == sorted([(-5, "a"), (-5, "b"), (None, "d"), (-9, "e")], key=repr)


def test_bounds_never_exceed_the_edits():
    import random

    pick = random.Random(11)
    for _ in range(60):
        a = [f"w{pick.randrange(80)}" for _ in range(pick.randint(1, 150))]
        b = list(a)
        for _ in range(pick.randint(0, 30)):
            i = pick.randrange(len(b) + 1)
            b[i : i + pick.randint(0, 1)] = [f"w{pick.randrange(80)}"] * pick.randint(0, 1)
        t = Texts(pa.array([" ".join(a), " ".join(b)]))
        t.words()
        x, y = (np.unpackbits(row.view(np.uint8)).astype(bool) for row in near_duplicates.bounds(t))
        edits = alignment.edit_distance(*alignment.words_of(pa.array([" ".join(a), " ".join(b)])), 1000)
        assert (x & ~y).sum() <= edits and (y & ~x).sum() <= edits


def test_groups_against_alignment_of_all_pairs(spark, documents):
    """No two documents are in one group unless links of sufficient similarity join them, and few links are missed."""
    rows = {r.doc_id: r.text or "" for r in documents.collect()}
    words = dict(zip(rows, alignment.words_of(pa.array(list(rows.values())))))
    parent = {i: i for i in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, ids = [], sorted(i for i in rows if len(words[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if min(len(words[a]), len(words[b])) >= 0.8 * max(len(words[a]), len(words[b])) - 1 and alignment.similar(words[a], words[b], 0.8):
                links.append((a, b))
                parent[max(top(a), top(b))] = min(top(a), top(b))
    group = {r.doc_id: r.group_id for r in near_duplicates.near_duplicates(documents).collect()}
    assert links and sum(group[a] == group[b] for a, b in links) >= 0.95 * len(links)
    assert all(top(i) == top(g) for i, g in group.items() if len(words[i]))
