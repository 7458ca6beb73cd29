"""Quality rules judged by an isolation forest.

Every document gets rule statistics. Random trees are grown over the statistics
of labelled rows: a document that few random splits set apart has a short path
and counts as anomalous. The cut between normal and anomalous is calibrated on
all labelled rows.

Defined cases: a null text is an empty one (no words, so the base rules reject
it); a null or repeated doc_id is judged row by row; labels are used by doc_id,
the worst label of a doc_id counts, null labels are left out. Without both kinds
of labels there is no verdict beyond the base rules. Extra columns are ignored
by `statistics` and passed on by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.sample import drawn
from tallyloom.llm.words import CONTINUES, SPACE, Texts, slices, windows
from tallyloom.scratch import materialize

WINDOW = 8
#: Labelled rows that the trees are grown from, at most; each tree draws TREE_ROWS of them.
FIT_ROWS = 20_000
TREES, TREE_ROWS = 200, 256
#: Share of well labelled rows that the calibrated cut may reject.
GOOD_LOST = 0.001
BUCKETS = 4096

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the trees split on: by how much a share goes beyond what ordinary prose shows, so
#: that the spread within ordinary prose sets no document apart. Shares don't depend on length.
RULES = ["symbol_excess", "mark_excess", "upper_excess", "same_word_excess", "odd_end_excess"]
#: Symbols, and `!` or `?`, in a word; capitals among A-Z and a-z; words equal to the one before; words that end in no letter, digit or usual mark.
ALLOWED = {"symbol_excess": 0.1, "mark_excess": 0.1, "upper_excess": 0.3, "same_word_excess": 0.2, "odd_end_excess": 0.2}



def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOL, _MARK = _table("#*$%&|<>"), _table("!?")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
#: How a word of prose may end: with a letter, a digit, a byte of a longer character, or one of these marks.
_PLAIN_END = _table(".,;:'\")") | _UPPER | _LOWER | _table("0123456789")
_PLAIN_END[0x80:] = True


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    worded = [line for line in lines if line.strip()]
    return len(worded) - len(set(worded))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and RULES of each text, from whole texts."""
    t = Texts(column)
    t.words()
    n = np.diff(t.word_at)
    hashes = t.hashes(t.start, t.end, fold=False)
    rows = np.repeat(np.arange(len(t)), n)

    key, first = windows(hashes, t.word_at, WINDOW)
    order = np.lexsort((rows[first], key))
    k, r = key[order], rows[first][order]
    equal = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    cover = np.zeros(len(hashes) + 1, np.int64)
    starts = first[order[twice]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    per_word = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[t.word_at])
    repeated = per_word(np.cumsum(cover[:-1]) > 0)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    plain = _PLAIN_END[t.data[t.end - 1]] if len(t.end) else np.zeros(0, bool)

    letters = t.count(_UPPER[t.data] | _LOWER[t.data])
    dup = np.array([_dup_lines(t.bytes_of(i)) for i in range(len(t))], np.int64)
    out = {
        "n_words": n,
        "word_chars": t.count(~SPACE[t.data] & ~CONTINUES[t.data]),
        "n_symbols": t.count(_SYMBOL[t.data]),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
    }
    parts = {
        "symbol_excess": (out["n_symbols"], n),
        "mark_excess": (t.count(_MARK[t.data]), n),
        "upper_excess": (t.count(_UPPER[t.data]), letters),
        "same_word_excess": (per_word(same), n),
        "odd_end_excess": (per_word(~plain), n),
    }
    return out | {c: np.clip(a / np.maximum(b, 1) - ALLOWED[c], 0, 1) for c, (a, b) in parts.items()}


def statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, COUNTS and RULES."""
    kind = docs.schema[id_column].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(found[c], pa.int64()) for c in COUNTS), *(pa.array(found[c], pa.float64()) for c in RULES)],
                    names=["id", *COUNTS, *RULES],
                )

    schema = ", ".join([f"id {kind}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RULES)])
    found = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(compute, schema)
    return found.withColumnRenamed("id", id_column)


def base_failed() -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth at which random splits set one of n points apart."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: the split's feature (-1: leaf), its value, the left child (the right one is next to it), the leaf's path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    rows: int
    cut: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher where random splits set a row apart sooner."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, value, left, path in zip(self.feature, self.value, self.left, self.path):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                f = np.where(inner, feature[node], 0)
                node = np.where(inner, left[node] + (x[every, f] >= value[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(_usual_path(self.rows)), 1e-9))


def grow(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """Random trees, each over its own draw of rows."""
    random = np.random.default_rng(seed)
    rows = min(tree_rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    grown = []
    for _ in range(trees):
        feature, value, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, x[random.choice(len(x), rows, replace=False)], 0)]
        while todo:
            node, part, level = todo.pop()
            low, high = part.min(0), part.max(0)
            able = np.flatnonzero(high > low)
            if level >= depth or not len(able):
                path[node] = level + float(_usual_path(len(part)))
                continue
            f = random.choice(able)
            v = random.uniform(low[f], high[f])
            if v <= low[f]:
                v = high[f]
            feature[node], value[node], left[node] = f, v, len(feature)
            for side in (part[part[:, f] < v], part[part[:, f] >= v]):
                todo.append((len(feature), side, level + 1))
                feature.append(-1), value.append(0.0), left.append(0), path.append(0.0)
        grown.append((feature, value, left, path))
    size = max(len(t[0]) for t in grown)
    padded = [np.array([list(t[i]) + [(-1, 0.0, 0, 0.0)[i]] * (size - len(t[i])) for t in grown]) for i in range(4)]
    return Forest(padded[0].astype(int), padded[1], padded[2].astype(int), padded[3], rows)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """The statistics with a column `anomaly`."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in RULES])
            yield batch.append_column("anomaly", pa.array(forest.scores(x), pa.float64()))

    return stats.mapInArrow(compute, stats.select("*", F.lit(0.0).alias("anomaly")).schema)


def calibrated(good: np.ndarray, bad: np.ndarray, lost: float = GOOD_LOST) -> float:
    """The cut that rejects most bad rows while at most `lost` of the good rows go: from counts by score bucket, the middle of the widest gap."""
    above = lambda counts: np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # noqa: E731  rows in bucket i or higher
    g, b = above(good), above(bad)
    allowed = np.flatnonzero(g <= lost * g[0])
    best = allowed[b[allowed] == b[allowed].max()]
    run = best[: np.argmax(np.diff(np.append(best, best[-1] + 2)) > 1) + 1]
    return float((run[0] + run[-1]) / 2) / len(good)


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> Forest | None:
    """Trees from at most `fit_rows` labelled rows, the cut from all of them. `stats` is read several times: give a stored table.

    None where labels of both kinds are missing.
    """
    worst = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("label_id")).agg(F.min(label).alias("label"))
    # Rows that the base rules reject anyway tell nothing about the others.
    known = stats.where(~base_failed()).join(worst, F.col(id_column) == F.col("label_id")).select("label", id_column, *RULES)
    picked = drawn(known, fit_rows, id_column, *RULES).select(*RULES).toPandas()
    if picked.empty:
        return None
    forest = grow(picked.to_numpy(float))
    bucket = F.least(F.floor(F.col("anomaly") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    rows = score(known, forest).groupBy((F.col("label") > 0).alias("good"), bucket.alias("bucket")).count().collect()
    counts = {True: np.zeros(BUCKETS), False: np.zeros(BUCKETS)}
    for row in rows:
        counts[row.good][row.bucket] += row["count"]
    if not counts[True].sum() or not counts[False].sum():
        return None
    forest.cut = calibrated(counts[True], counts[False])
    return forest


def verdicts(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """The statistics with `anomaly`, `base_failed` and `kept`."""
    scored = score(stats, forest) if forest else stats.withColumn("anomaly", F.lit(0.0))
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < (forest.cut if forest else 1.0)))


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: its id, COUNTS, RULES, `anomaly`, `base_failed`, `kept`. Texts are read once."""
    stats = materialize(statistics(docs, id_column, text), "quality")
    return verdicts(stats, fit(stats, labels, id_column, label))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns. Texts are read twice, and never shuffled."""
    stats = materialize(statistics(docs, id_column, text), "quality")
    forest = fit(stats, labels, id_column, label)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in slices(named, f"c{place}"):
                found = measure(part.column(place))
                good = (found["n_words"] >= 20) & (100 * found["n_repeat_words"] <= 30 * found["n_words"])
                if forest:
                    good &= forest.scores(np.column_stack([found[c] for c in RULES])) < forest.cut
                yield part.filter(pa.array(good)).rename_columns(batch.schema.names)

    return docs.mapInArrow(keep, docs.schema)
