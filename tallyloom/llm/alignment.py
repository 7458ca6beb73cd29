"""Edit distance of two sequences, confined to the diagonals that a bound allows."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import Texts, slices, windows

#: Items of the runs that similar texts have in common; pairs that are counted at once, and characters of them.
RUN, RUN_ROWS, RUN_CHARACTERS = 5, 64, 1 << 15


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Insertions, deletions and replacements that turn a into b, or None if more than `most`.

    For each number of edits the furthest point on every diagonal within the band
    is kept; between two edits a diagonal is followed to its next mismatch. The
    work grows with the length times the distance, not with the square of the length.
    """
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(apart[0]) if len(apart) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    longer = max(len(a), len(b))
    if not most or longer - shared(a, b) > most:
        return None
    # An edit takes part in as many runs as a run is long, so d edits leave all others of the longer sequence in the other one.
    width = min(RUN, longer // (2 * most))
    if width > 1 and longer - width + 1 - shared(*(windows(x.astype(np.uint64), np.array([0, len(x)]), width)[0] for x in (a, b))) > width * most:
        return None
    mismatches: dict[int, array] = {}

    def follow(k: int, i: int) -> int:
        """From row i on diagonal k (column i + k) to the next mismatch or the end."""
        end = min(len(a), len(b) - k)
        if k not in mismatches:
            low = max(0, -k)
            mismatches[k] = array("i", (np.flatnonzero(a[low:end] != b[low + k : end + k]) + low).astype(np.int32).tobytes())
        found = mismatches[k]
        at = bisect_left(found, i)
        return found[at] if at < len(found) else end

    target = len(b) - len(a)
    reached = {0: follow(0, 0)}
    edits = 0
    while reached.get(target, -1) < len(a):
        edits += 1
        if edits > most:
            return None
        further = {}
        for k in range(-edits, edits + 1):
            # From the end of diagonal k, |target - k| more edits are needed at least.
            if k < -len(a) or k > len(b) or edits + abs(target - k) > most:
                continue
            i = max(reached.get(k, -2) + 1, reached.get(k - 1, -1), reached.get(k + 1, -2) + 1)
            if i >= max(0, -k):
                i = min(i, len(a), len(b) - k)
                further[k] = follow(k, i)
        reached = further
    return edits


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Items in common, repeats counted; the longer length minus this is a lower bound of the distance."""
    both = np.concatenate([a, b])
    _, inverse = np.unique(both, return_inverse=True)
    size = int(inverse.max()) + 1 if len(both) else 0
    return int(np.minimum(np.bincount(inverse[: len(a)], minlength=size), np.bincount(inverse[len(a) :], minlength=size)).sum())


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - distance / longer length is at least `least`."""
    longer = max(len(a), len(b))
    return edit_distance(a, b, int((1 - least) * longer + 1e-9)) is not None


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """The words of each text as hashes."""
    t = Texts(texts)
    t.words()
    hashes = t.hashes(t.start, t.end)
    return [hashes[t.word_at[i] : t.word_at[i + 1]] for i in range(len(t))]


def characters(texts: pa.Array) -> list[np.ndarray]:
    """The code points of each text."""
    return [np.frombuffer((text or "").encode("utf-32-le"), np.uint32) for text in texts.to_pylist()]


def aligned(least: float, items: Callable[[pa.Array], list[np.ndarray]]):
    """For `mapInArrow`: the pairs (a, b) whose text_a and text_b have at least this edit similarity, counted in items."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                linked = [similar(x, y, least) for x, y in zip(items(part.column("text_a")), items(part.column("text_b")))]
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return align


def runs_shared(texts_a: pa.Array, texts_b: pa.Array, bits: int, width: int = RUN) -> np.ndarray:
    """For each pair how many runs of `width` characters it has in common at most, repeats counted; runs are told apart by a class of so many bits.

    Runs that reach into the next text are counted too, which can only add to what is in common.
    """
    rows, counts = len(texts_a), []
    for texts in (texts_a, texts_b):
        whole = texts.to_pylist()
        points = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
        n = max(0, len(points) - width + 1)
        key = np.zeros(n, np.uint32)
        for i in range(width):
            key *= np.uint32(0x9E3779B1)
            key += points[i : i + n]
        key *= np.uint32(0x85EBCA6B)
        key >>= np.uint32(32 - bits)
        of = np.repeat(np.arange(rows) << bits, [len(t) for t in whole])[:n]
        counts.append(np.bincount(of + key, minlength=rows << bits))
    return np.minimum(*counts).reshape(rows, 1 << bits).sum(1)


def runs_allow(least: float):
    """For `mapInArrow`: the rows whose text_a and text_b have enough runs of characters in common to have this edit similarity in characters.

    An edit takes part in RUN runs at most, so d edits leave all but RUN * d runs of the longer text in the other. No similar pair is lost.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longer = np.maximum(*(pc.utf8_length(batch.column(c)).to_numpy() for c in ("text_a", "text_b"))).astype(np.int64)
            # Texts of like length are counted together, with four classes a run or more.
            order, at, keep = np.argsort(longer, kind="stable"), 0, np.zeros(len(longer), bool)
            while at < len(order):
                own = order[at : at + RUN_ROWS]
                own = own[: max(1, int(np.searchsorted(np.cumsum(longer[own]), RUN_CHARACTERS, "right")))]
                texts = [batch.column(c).take(pa.array(own)) for c in ("text_a", "text_b")]
                edits = ((1 - least) * longer[own] + 1e-9).astype(np.int64)
                keep[own] = runs_shared(*texts, min(24, 2 + int(longer[own[-1]]).bit_length())) >= longer[own] - RUN + 1 - RUN * edits
                at += len(own)
            yield batch.filter(pa.array(keep))

    return sift


def verifier(texts: DataFrame, least: float, items: Callable[[pa.Array], list[np.ndarray]] = words_of) -> Callable[[DataFrame], DataFrame]:
    """Keeps the pairs (a, b) whose texts in a stored table (node, text) have at least this edit similarity, counted in words or other items."""

    def verify(pairs: DataFrame) -> DataFrame:
        of = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(aligned(least, items), pairs.schema)

    return verify
