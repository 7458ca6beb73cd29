"""Hard negatives by an inverted multi-index over halves of vectors.

Vectors become whole numbers, and their halves are coded by two codebooks fitted on a
bounded sample. A pair of codes is a cell; every vector is in one. How far the
members of a code lie from it at most is taken over all vectors, so that for an
anchor a the inner product with any member of cell (i, j) is at most
a1.c1[i] + |a1| r1[i] + a2.c2[j] + |a2| r2[j], and at least the same with minus signs.
A heap walks the cells of an anchor in falling order of that bound (multi-sequence), and
stops once every window of scores it is asked for holds k rows none of which
a later cell could displace. The result is exact whatever the codebooks are.

A search is a few rounds. In each, anchors that are not done ask for their next cells,
four times as many as before; what is asked is joined with the stored cells, which lie in chunks of
bounded size. Cells that follow each other make a part, and an anchor's vector is sent once to each part it asks a cell of.
Anchors meet a chunk in blocks of bounded size too, so a cell or an
anchor set of any size is dealt over tasks. The driver holds codebooks, radii and the parts of the cells in
use (at most MOST_CODES^2 numbers).

Defined cases: rows with a null id, label or vector, or a null or non-finite component, and rows
whose squared length does not fit in 62 bits, take no part. Shorter vectors count as followed by
zeros. Rows that repeat an id are rows of their own, ordered by id, label and vector; only the anchor's row
itself is no partner of it. Ids and labels are whole numbers. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.prefix import numbered
from tallyloom.llm.sample import drawn
from tallyloom.scratch import materialize

SCALE = 256
#: Rows that a cell is made for, codes of a codebook at most, rows of a chunk, anchors that meet a chunk at once.
CELL_ROWS, MOST_CODES, CHUNK, ANCHORS = 64, 256, 1024, 256
#: Rows after which a part takes no further cell.
PART_ROWS = 4096
#: Bytes of vectors that codebooks are fitted on at most.
FIT_BYTES = 16 << 20
#: Cells of the first round.
FIRST_CELLS = 16
NONE = np.iinfo(np.int64).min


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows, followed by zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    size = np.diff(at)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _codebook(points: np.ndarray, codes: int) -> np.ndarray:
    """k-means from evenly taken points."""
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)].copy()
    for _ in range(8):
        near = _nearest(points, centres)[0]
        for i in range(len(centres)):
            if (near == i).any():
                centres[i] = points[near == i].mean(0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and the distance to it."""
    near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(1))


class Cells:
    """Codebooks, radii and cells in use. What an anchor's walk needs."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], used: np.ndarray):
        self.books, self.radii, self.used, self.half = books, radii, used, books[0].shape[1]

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Greatest and smallest half scores of each code of either half, beyond what rounding may take."""
        high, low = [], []
        for part, book, radius in zip((v[: self.half], v[self.half :]), self.books, self.radii):
            at, reach = book @ part, np.sqrt((part**2).sum()) * radius
            slack = 1e-9 * (np.abs(at) + reach) + 1e-6
            high.append(at + reach + slack)
            low.append(at - reach - slack)
        return high[0], high[1], low[0], low[1]

    def walk(self, v: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(greatest score, smallest score, cell) of the cells in use, greatest first."""
        a, b, low_a, low_b = self.bounds(v)
        order_a, order_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b, wide = a[order_a].tolist(), b[order_b].tolist(), len(order_b)
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            # (i, j) follows (i, j - 1) in its row, and (i - 1, 0) if it opens a row.
            if j + 1 < wide:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(order_a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            cell = order_a[i] * wide + order_b[j]
            if self.used[cell]:
                yield -bound, low_a[order_a[i]] + low_b[order_b[j]], cell


class MultiIndex:
    """All rows in cells. `rows` has (row, id, label, v): v holds dim 64-bit numbers."""

    def __init__(self, rows: DataFrame, dim: int, exact: bool):
        self.spark, self.dim, self.exact = rows.sparkSession, dim, exact
        half, n = dim // 2, rows.count()
        codes = int(np.clip(round((n / CELL_ROWS) ** 0.5), 1, MOST_CODES))
        fit = drawn(rows.select("row", "v"), max(1, FIT_BYTES // max(8, 8 * dim)), "row").toArrow()
        points = _matrix(fit.column("v").combine_chunks(), dim).astype(np.float64) if n else np.zeros((1, dim))
        books = (_codebook(points[:, :half], codes), _codebook(points[:, half:], codes))
        wide = len(books[1])

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("v"), dim).astype(np.float64)
                (i, far_i), (j, far_j) = _nearest(v[:, :half], books[0]), _nearest(v[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i * wide + j, pa.int64()), pa.array(far_i), pa.array(far_j)], [*batch.schema.names, "cell", "far_a", "far_b"])

        placed = materialize(rows.mapInArrow(coded, "row long, id long, label long, v binary, cell long, far_a double, far_b double"), "coded")
        # At most MOST_CODES^2 rows.
        found = placed.groupBy("cell").agg(F.max("far_a").alias("far_a"), F.max("far_b").alias("far_b"), F.count("*").alias("n")).sort("cell").toArrow()
        cell, radii, used = found.column("cell").to_numpy(), (np.zeros(len(books[0])), np.zeros(wide)), np.zeros(len(books[0]) * wide, bool)
        np.maximum.at(radii[0], cell // wide, found.column("far_a").to_numpy())
        np.maximum.at(radii[1], cell % wide, found.column("far_b").to_numpy())
        used[cell] = True
        self.cells = Cells(books, radii, used)
        size = found.column("n").to_numpy()
        part = np.zeros(len(used), np.int64)
        part[cell] = (np.cumsum(size) - size) // PART_ROWS
        self.part = part

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, v = batch.column("cell").to_numpy(), batch.column("v").to_pylist()
                long = {name: batch.column(name).to_numpy() for name in ("cell", "row", "id", "label")}
                edges = np.flatnonzero(np.diff(part[cell])) + 1
                starts = [0, *edges.tolist(), len(cell)]
                cuts = [x for a, b in zip(starts, starts[1:]) for x in range(a, b, CHUNK)] + [len(cell)]
                spans = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cell[cuts[:-1]]])] + [pa.array([long[name][a:b].tobytes() for a, b in spans], pa.binary()) for name in long] + [pa.array([b"".join(v[a:b]) for a, b in spans], pa.binary())],
                    ["part", "cells", "rows", "ids", "labels", "vs"],
                )

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        laid = placed.select("cell", "row", "id", "label", "v").repartitionByRange(parts, "cell", "row").sortWithinPartitions("cell", "row")
        self.chunks = materialize(laid.mapInArrow(packed, "part long, cells binary, rows binary, ids binary, labels binary, vs binary"), "cells")

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, w, score, row, id): for each anchor and window w the first k rows of its label (`same`) or of other labels
        whose score lies in the window, greater scores first, then smaller rows.

        `anchors` has (row, label, v, low, high); low and high are arrays with the ends of its windows, inclusive.
        """
        cells, dim, exact = self.spark.sparkContext.broadcast((self.cells, self.part)), self.dim, self.exact
        blocks = max(1, -(-anchors.count() // ANCHORS))
        state = anchors.withColumn("kth", F.expr("transform(low, x -> cast(null AS bigint))"))
        found, seen, step = None, 0, FIRST_CELLS
        while True:
            # Walks are long and anchors few bytes, so they are dealt by number.
            dealt = state.repartition(max(blocks, self.spark.sparkContext.defaultParallelism), "row")
            asked = materialize(dealt.mapInArrow(_asking(cells, seen, step), "part long, cells binary, anchor long, label long, v binary, low array<long>, high array<long>"), "asked")
            if asked.isEmpty():
                break
            more = _met(asked, self.chunks, blocks).mapInArrow(_scoring(dim, k, same, exact), "anchor long, w int, score long, row long, id long")
            found = materialize(_first(more if found is None else found.union(more), k), "found")
            kth = found.groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
            kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("by_w"))
            state = anchors.join(kth, F.col("row") == F.col("anchor"), "left").withColumn("kth", F.expr("transform(low, (x, i) -> by_w[i])")).select(*state.columns)
            seen, step = seen + step, step * 4
        if found is None:
            return self.spark.createDataFrame([], "anchor long, w int, score long, row long, id long")
        return found


def _met(asked: DataFrame, chunks: DataFrame, blocks: int) -> DataFrame:
    """Blocks of anchors with each chunk of the part they ask cells of.

    Stored vectors are sized by their compressed files, in which an anchor's many rows hold its vector once, so Spark must not
    choose to send either side to the driver.
    """
    asks = F.collect_list(F.struct("cells", "anchor", "label", "v", "low", "high"))
    blocked = asked.groupBy("part", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block")).agg(asks.alias("asks"))
    return blocked.join(chunks.hint("merge"), "part").select("asks", "cells", "rows", "ids", "labels", "vs")


def _first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "row")
    return scored.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= k).drop("rank_")


def _asking(shared, seen: int, step: int):
    """The cells number seen to seen + step of each anchor that has an open window, by parts, with the scores that still matter."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, part = shared.value
        kind = pa.schema([("part", pa.int64()), ("cells", pa.binary()), ("anchor", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for a in batch.to_pylist():
                # A row must reach this to matter in a window; a row as good as the k-th may come before it.
                floor = [max(low, NONE if kth is None else kth) for low, kth in zip(a["low"], a["kth"])]
                open_ = [w for w in range(len(floor)) if floor[w] <= a["high"][w]]
                asked = []
                for number, (most, least, cell) in enumerate(cells.walk(np.frombuffer(a["v"], np.int64).astype(np.float64))):
                    if number >= seen + step:
                        break
                    if number == seen:
                        open_ = [w for w in open_ if most >= floor[w]]
                    if number >= seen:
                        if not any(most >= floor[w] for w in open_):
                            break
                        if any(most >= floor[w] and least <= a["high"][w] for w in open_):
                            asked.append(cell)
                of_part = np.sort(np.array(asked, np.int64))
                high = [h if w in open_ else NONE for w, h in enumerate(a["high"])]
                for own in np.split(of_part, np.flatnonzero(np.diff(part[of_part])) + 1) if asked else []:
                    out.append({"part": int(part[own[0]]), "cells": own.tobytes(), "anchor": a["row"], "label": a["label"], "v": a["v"], "low": floor, "high": high})
                if len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    return ask


def _wanted(asked: pa.Array, cells: np.ndarray) -> np.ndarray:
    """Whether each anchor asks for the cell of each row of a chunk."""
    lists = [np.frombuffer(x, np.int64) for x in asked.to_pylist()]
    own, of = np.unique(cells, return_inverse=True)
    who, flat = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    at = np.searchsorted(own, flat)
    here = at < len(own)
    here[here] = own[at[here]] == flat[here]
    wanted = np.zeros((len(lists), len(own)), bool)
    wanted[who[here], at[here]] = True
    return wanted[:, of]


def _scoring(dim: int, k: int, same: bool, exact: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.float64 if exact else np.int64
        for batch in batches:
            for i in range(batch.num_rows):
                asks = batch.column("asks")[i].values
                cells, rows, ids, labels = (np.frombuffer(batch.column(n)[i].as_py(), np.int64) for n in ("cells", "rows", "ids", "labels"))
                wanted = _wanted(asks.field("cells"), cells)
                some, of = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
                if not len(some):
                    continue
                asks, wanted, rows, ids, labels = asks.take(pa.array(some)), wanted[np.ix_(some, of)], rows[of], ids[of], labels[of]
                v = np.frombuffer(batch.column("vs")[i].as_py(), np.int64).reshape(len(cells), dim)[of]
                a = _matrix(asks.field("v"), dim)
                anchor, label = asks.field("anchor").to_numpy(), asks.field("label").to_numpy()
                scores = (a.astype(number) @ v.astype(number).T).astype(np.int64)
                partner = (label[:, None] == labels) == same
                partner &= wanted & (anchor[:, None] != rows)
                low, high = (np.array(asks.field(n).to_pylist(), np.int64).reshape(len(anchor), -1) for n in ("low", "high"))
                for w in range(low.shape[1]):
                    inside = partner & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
                    if inside.shape[1] > k:
                        here = np.where(inside, scores, NONE)
                        inside &= here >= np.partition(here, -k, axis=1)[:, -k, None]
                    x, y = np.nonzero(inside)
                    order = np.lexsort((rows[y], -scores[x, y], x))
                    x, y = x[order], y[order]
                    first = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1]) if len(x) else np.zeros(0, int)
                    rank = np.arange(len(x)) - np.repeat(first, np.diff([*first, len(x)]))
                    x, y = x[rank < k], y[rank < k]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[x]), pa.array(np.full(len(x), w, np.int32)), pa.array(scores[x, y]), pa.array(rows[y]), pa.array(ids[y])], ["anchor", "w", "score", "row", "id"])

    return score


def whole_vectors(df: DataFrame, id_: str, label: str, vector: str) -> tuple[DataFrame, int, bool]:
    """(row, id, label, v) of the rows that take part, the dimension, and whether floating point holds their scores exactly."""
    ids = df.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ids = ids.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", sound))
    ids = ids.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    ids = ids.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).where(F.col("square") < float(1 << 62))
    placed = numbered(ids, [F.col("id"), F.col("label"), F.col("v")], F.lit(0)).withColumnRenamed("number", "row").drop("before")
    size = placed.agg(F.max(F.size("v")).alias("dim"), F.max("square").alias("square")).first()
    dim = size["dim"] or 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _dense(batch.column("v"), dim).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), _lists(v)], ["row", "id", "label", "v"])

    rows = placed.select("row", "id", "label", "v").mapInArrow(packed, "row long, id long, label long, v binary")
    return materialize(rows, "vectors"), dim, (size["square"] or 0) < float(1 << 52)


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors are floor(256 x), scores their inner products. An anchor's positives are its first rows of the same
    label. For each, the first rows of other labels whose score is `percent` of the positive's
    (both ends included) are its negatives. Greater scores come first, then smaller ids. `is_anchor` reads the column `id`.
    """
    rows, dim, exact = whole_vectors(df, id_, label, vector)
    index = MultiIndex(rows, dim, exact)
    all_scores = lambda x: F.array(F.lit(int(x)).cast("long"))
    anchors = materialize(rows.where(is_anchor).select("row", "label", "v", all_scores(NONE).alias("low"), all_scores(-(NONE + 1)).alias("high")), "anchors")
    near = index.search(anchors, positives, True)
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "row")
    near = materialize(near.withColumn("w", F.row_number().over(order) - 1).select("anchor", "w", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 low >= percent[0] positive and 100 high <= percent[1] positive, in whole numbers.
    tenths = lambda p: F.col("positive_score").cast("decimal(38,0)") * p / 100
    ends = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("w", F.ceil(tenths(percent[0])).cast("long").alias("low"), F.floor(tenths(percent[1])).cast("long").alias("high")))).alias("ends"))
    windows = anchors.join(ends, F.col("row") == F.col("anchor")).select("row", "label", "v", F.col("ends.low").alias("low"), F.col("ends.high").alias("high"))
    far = index.search(materialize(windows, "windows"), negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "row"))
    far = far.withColumn("rank", rank).select("anchor", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = far.join(near, ["anchor", "w"]).join(rows.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
