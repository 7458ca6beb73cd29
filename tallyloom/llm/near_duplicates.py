"""Near-duplicate documents by order MinHash.

A document is the sequence of its runs of three words, each labelled with its
occurrence number. A sketch takes the two labelled runs with the smallest hashes
and keeps them in text order, so it agrees for documents that share runs in the
same order: it follows edit similarity, where plain MinHash follows sets. Documents
that agree on any sketch are candidates; a banded alignment of their words decides:
similarity is 1 less the edits in words over the longer length.

Defined cases: words are compared with A-Z as a-z. Texts of fewer than three words
are one run. Documents without a word (null, empty, blank) are linked to none. Exact
copies are one class and are compared once. Rows that share a doc_id are one
document. A null doc_id stands for a document known by its text alone, which comes before all numbers; its class and group
are then a hash of the text. Extra columns are ignored by `near_duplicates` and passed on by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.alignment import verifier
from tallyloom.llm.components import linked_groups
from tallyloom.llm.words import Texts, mix, slices, windows
from tallyloom.scratch import materialize

RUN_WORDS = 3
#: Sketches of a document and labelled runs in each; candidates agree on one. With every fifth word replaced here and there (similarity 0.8),
#: half of the runs stay, a sketch agrees with probability 0.12 and one of 32 with 0.98.
SKETCHES, RUNS = 32, 2
LEAST = 0.8
#: Classes of words, and numbers of words of a class that are told apart, by the bound on edits.
CLASSES, STEPS = 256, (1, 2, 3, 5)
BOUNDS = [f"b{i}" for i in range(CLASSES * len(STEPS) // 64)]


def _labelled(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words, with their occurrence number inside the text; and where each row's runs begin."""
    t.words()
    hashes = t.hashes(t.start, t.end)
    key, first = windows(hashes, t.word_at, RUN_WORDS)
    row = np.searchsorted(t.word_at, first, "right") - 1
    short = np.flatnonzero((np.diff(t.word_at) > 0) & (np.diff(t.word_at) < RUN_WORDS))
    for i in short:
        whole = hashes[t.word_at[i] : t.word_at[i + 1]]
        key = np.append(key, mix((whole * np.arange(3, 3 + len(whole), dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True)))
        row = np.append(row, i)
    if len(short):
        order = np.argsort(row, kind="stable")
        key, row = key[order], row[order]
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    place = np.arange(len(k))
    label = np.empty(len(k), np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(key + label * np.uint64(0x9FB21C651E98DF25)), np.searchsorted(row, np.arange(len(t) + 1))


def sketches(t: Texts) -> list[np.ndarray]:
    """SKETCHES numbers for each text; none for a text without words."""
    labelled, at = _labelled(t)
    seeds = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    factor = np.uint64(0xE7037ED1A0B428DB)
    out = []
    for i in range(len(t)):
        own = labelled[at[i] : at[i + 1]]
        if not len(own):
            out.append(np.zeros(0, np.int64))
            continue
        ranks = (own ^ seeds[:, None]) * factor
        ranks ^= ranks >> np.uint64(32)
        ranks *= factor
        if len(own) > RUNS:
            chosen = np.sort(np.argpartition(ranks, RUNS - 1, axis=1)[:, :RUNS], axis=1)
        else:
            chosen = np.broadcast_to(np.arange(len(own)), (SKETCHES, len(own)))
        total = seeds.copy()
        for j in range(chosen.shape[1]):
            total = mix(total * np.uint64(0xD1342543DE82EF95) + own[chosen[:, j]])
        out.append(total.view(np.int64))
    return out


def bounds(t: Texts) -> np.ndarray:
    """Bits for each text: whether it has at least so many words of each class. An edit of a word clears at most one bit, so the bits of one
    text that another lacks are a lower bound of the edits between them."""
    n = len(t)
    row = np.repeat(np.arange(n), np.diff(t.word_at))
    class_ = (mix(t.hashes(t.start, t.end)) & np.uint64(CLASSES - 1)).astype(np.int64)
    counts = np.bincount(row * CLASSES + class_, minlength=n * CLASSES).reshape(n, CLASSES)
    return np.packbits((counts[:, :, None] >= np.array(STEPS)).reshape(n, CLASSES * len(STEPS)), axis=1).view(np.int64)


def _node(id_column: str, text: str) -> Column:
    """What stands for a document: its number, or for one without a number its text. Numbers come last."""
    id_ = F.col(id_column).cast("long")
    return F.struct(id_.isNotNull().alias("known"), F.coalesce(id_, F.xxhash64(text)).alias("id"))


NODE = "struct<known:boolean,id:bigint>"


def _sketched(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = Texts(part.column("text"))
                found = sketches(t)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("node", "h1", "h2")] + [pa.array(np.diff(t.word_at), pa.int64()), pa.array(found, pa.list_(pa.int64()))] + [pa.array(b) for b in bounds(t).T.copy()],
                    names=["node", "h1", "h2", "n", "sketches", *BOUNDS],
                )

    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column), text.alias("text")).select(_node(id_column, "text").alias("node"), *_prints("text"), "text")
    schema = f"node {NODE}, h1 long, h2 long, n long, sketches array<long>, " + ", ".join(f"{b} long" for b in BOUNDS)
    return rows.mapInArrow(compute, schema)


def _prints(text: str) -> list[Column]:
    """Two hashes that stand for a whole text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id (exact copies), group_id (copies and near copies, the smallest id of the group), kept, h1, h2.

    Only sketches are shuffled; texts only of the documents that share a sketch with another text.
    """
    rows = materialize(_sketched(docs, id_column, text), "sketches")
    classes = rows.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ["n", "sketches", *BOUNDS]))
    classes = materialize(classes, "classes")
    buckets = classes.select("node", F.col("copies").alias("weight"), F.posexplode("sketches").alias("i", "sketch"))
    buckets = buckets.select(F.xxhash64("i", "sketch").alias("bucket"), "node", "weight")
    busy = buckets.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1").select("bucket")
    members = materialize(buckets.join(busy, "bucket").select("bucket", "node", "weight"), "members")

    needed = classes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("node").alias("rep"))
    whole = docs.select(_node(id_column, text).alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = whole.select("node", "text", *_prints("text"))
    texts = whole.join(needed, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("node") == F.col("rep")), "left_semi")
    texts = materialize(texts.dropDuplicates(["h1", "h2"]).select("node", "text"), "texts")

    def candidates(x, y) -> Column:
        """Holds for every pair that is similar."""
        longer = F.greatest(x("n"), y("n"))
        edits = F.floor((1 - least) * longer + 1e-9)
        more = lambda p, q: sum((F.bit_count(p(c).bitwiseAND(F.bitwise_not(q(c)))) for c in BOUNDS[1:]), F.bit_count(p("b0").bitwiseAND(F.bitwise_not(q("b0")))))
        return (longer - F.least(x("n"), y("n")) <= edits) & (more(x, y) <= edits) & (more(y, x) <= edits)

    groups = linked_groups(members, verifier(texts, least), candidates, candidates, classes.select("node", "n", *BOUNDS), spend=True).select(F.col("node").alias("class_node"), "root")
    of_class = classes.select("h1", "h2", F.col("node").alias("class_id"), "n")
    of_class = of_class.join(groups, F.col("class_id") == F.col("class_node"), "left").select("h1", "h2", "class_id", "n", F.coalesce("root", "class_id").alias("group_id"))
    # Documents without a word share a class of texts and are still linked to none.
    alone = F.col("n") == 0
    found = rows.select("node", "h1", "h2").join(of_class, ["h1", "h2"])
    class_id, group_id = (F.when(alone, F.col("node")).otherwise(F.col(c)) for c in ("class_id", "group_id"))
    return found.select(
        F.when(F.col("node.known"), F.col("node.id")).alias(id_column),
        class_id["id"].alias("class_id"), group_id["id"].alias("group_id"), (F.col("node") == group_id).alias("kept"), "h1", "h2",
    ).distinct()


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of `docs` that are the kept document of their group, with all columns; rows that agree in all columns stay once."""
    kept = near_duplicates(docs, id_column, text, least).where("kept").select(F.col(id_column).alias("k_id"), F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = [F.col(id_column).cast("long").eqNullSafe(F.col("k_id")), F.xxhash64(plain) == F.col("k1"), F.xxhash64(F.lit("second"), plain) == F.col("k2")]
    return docs.join(kept, keys[0] & keys[1] & keys[2], "left_semi").dropDuplicates()
