"""Removal of repeated byte strings by a distributed difference-cover suffix array.

A byte goes if it lies in a string of WIDTH bytes that also starts earlier: in an earlier document, or
earlier in the same one. The steps:

1. Documents are put in order, cut into pieces with an overlap, and packed into blocks,
   which are stored in buckets so that answers meet their text without moving it.
2. Sieves leave out what needs no sorting, and lose nothing. Every string of WIDTH bytes has an
   anchor, the GRAM bytes in it with the smallest hash. Strings whose anchor stands nowhere else
   have no copy. Of the rest, stretches of strings with one anchor that are equal as a whole
   are looked at once, where they first stand; in their later copies all strings start earlier. What is left
   passes the first sieve again.
3. What is left is sorted by the difference cover of 3. Letters are 4 bytes long and start at every
   byte. Positions whose letter number isn't divisible by 3 are the sample; their triples of letters
   are sorted and named. Names are the letters of the next level, with steps three times as wide.
   At the third level names stand for 108 bytes, which is beyond WIDTH, and the recursion ends.
4. On the way up, each level's positions are put in order: two of them are compared by their letters up to where
   the sample holds both, and there by the sample's order.
5. In the order of all strings, neighbours with equal first WIDTH bytes (compared by 64-bit
   fingerprints, which only neighbours could confuse) form runs; all but the first string of the text order go.

Each sort is one exchange: blocks send what they have to buckets bounded by splitters, which
are taken from a sample as a range partitioning does, and get ranks back. Equal triples of a block
are sent once. The driver sees splitters and a count for each bucket.

Defined cases: a null text is empty. Documents come in the order of doc_id (null first), then of
their text's hash; rows that repeat both are documents of their own, and all but one of them go if they have
WIDTH bytes. Texts are whole, pieces don't show in the result. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.kept import kept
from tallyloom.scratch import drop, materialize, new_path, release

WIDTH, GRAM = 100, 64
#: Bytes of a piece that are its own, bytes and pieces of a block.
PIECE, BLOCK, BLOCK_ROWS = 1 << 20, 1 << 20, 1 << 14
#: Bytes of a letter, and of the step from letter to letter at each level.
LETTER, STEPS = 4, (4, 12, 36)
#: Zero bytes that end each sorted stretch: what a triple of the last level may reach over.
PAD = 72
#: Blocks that splitters are taken from.
SAMPLED = 64
#: Items of a bucket.
BUCKET = 1 << 20


def _plain(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, each in as few as the greatest needs; rising ones by their differences."""
    values = values.astype(np.uint64)
    rising = len(values) > 1 and bool((values[1:] >= values[:-1]).all())
    if rising:
        values = np.diff(values, prepend=np.uint64(0))
    kind = np.min_scalar_type(values.max()) if len(values) else np.dtype(np.uint8)
    # Bytes of like weight stand together.
    return np.array([len(values), kind.itemsize, rising], np.int64).tobytes() + values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def _pack_all(*arrays: np.ndarray) -> bytes:
    body = b"".join(map(_plain, arrays))
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _unpack_all(raw: bytes) -> list[np.ndarray]:
    body, at, out = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), 0, []
    while at < len(body):
        n, size, rising = np.frombuffer(body, np.int64, 3, at).tolist()
        planes = np.frombuffer(body, np.uint8, n * size, at + 24)
        values = np.ascontiguousarray(planes.reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.uint64)
        out.append(np.cumsum(values, dtype=np.uint64) if rising else values)
        at += 24 + n * size
    return out


def _pack(values: np.ndarray) -> bytes:
    return _pack_all(values)


def _unpack(raw: bytes) -> np.ndarray:
    return _unpack_all(raw)[0]


SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number, and of its inverse, modulo 2^64."""
    def made(size: int) -> tuple[np.ndarray, np.ndarray]:
        both = (seed | 1, pow(seed | 1, -1, 1 << 64))
        return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in both)

    most = max(BLOCK, PIECE + WIDTH) + 1
    return kept(("suffix powers", seed, most), lambda: made(most)) if n <= most else made(n)


class Rolling:
    """Two 64-bit hashes of any ranges of some bytes."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, {}

    def _sums(self, which: int) -> np.ndarray:
        if which not in self.sums:
            seed, n = SEEDS[which], len(self.data)
            codes = _mix(np.arange(256, dtype=np.uint64) * np.uint64(seed) + np.uint64(seed >> 7))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes[self.data] * _powers(seed, n + 1)[0][:n], out=sums[1:])
            self.sums[which] = sums
        return self.sums[which]

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self._sums(which)
        return _mix((sums[end] - sums[start]) * _powers(SEEDS[which], len(sums))[1][start] + (end - start).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """Hashes of all ranges of a width, by start."""
        sums = self._sums(0)
        n = len(sums) - width
        return _mix((sums[width:] - sums[:n]) * _powers(SEEDS[0], len(sums))[1][:n] + np.uint64(width))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def exchange(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]], label: str) -> DataFrame:
    """Blocks send parts of what they have to buckets and get an answer for each part back.

    (block, bucket, raw) of what is sent becomes (block, bucket, raw) with the answers; `answer` gets a bucket's parts in the order of blocks.
    """
    kind = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("raw", pa.binary())])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        raw = answer(table.column("raw").to_pylist())
        return pa.Table.from_arrays([table.column("block"), table.column("bucket"), pa.array(raw, pa.binary())], schema=kind)

    return materialize(sent.groupBy("bucket").applyInArrow(one, "block long, bucket int, raw binary"), label)


def by_block(answers: DataFrame) -> DataFrame:
    return answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "raw"))).alias("answers"))


def _cut(at: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of equal numbers of a rising array."""
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(at[a]), a, b


def blocks_of(n: int) -> int:
    return max(1, -(-n // BUCKET))


# -- documents in blocks


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pieces in text order. A block's number holds its task's number."""
    first, documents = TaskContext.get().partitionId() << 32, 0
    number, rows, held = first, [], 0
    kind = pa.schema([("block", pa.int64()), ("doc", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("whole", pa.list_(pa.bool_())), ("piece", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("data", pa.binary())])

    def block():
        columns = [[number], *([[r[i] for r in rows]] for i in range(6)), [b"".join(r[6] for r in rows)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for i, doc_id in enumerate(ids):
            raw = texts[i].as_buffer()
            size = 0 if raw is None else raw.size
            for piece, at in enumerate(range(0, max(size, 1), PIECE)):
                part = b"" if raw is None else raw.slice(at, min(PIECE + WIDTH - 1, size - at)).to_pybytes()
                if rows and (held + len(part) > BLOCK or len(rows) == BLOCK_ROWS):
                    yield block()
                    number, rows, held = number + 1, [], 0
                rows.append((first + documents, doc_id, size <= PIECE, piece, min(PIECE, size - at), len(part), part))
                held += len(part)
            documents += 1
    if rows:
        yield block()


def stored_blocks(documents: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of the documents, in buckets by block, and the number of their bytes."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    laid = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = laid.mapInArrow(_packing, "block long, doc array<long>, doc_id array<long>, whole array<boolean>, piece array<long>, own array<long>, size array<long>, data binary")
    name = f"blocks_{uuid.uuid4().hex}"
    writer = blocks.repartition(parts, "block").write.bucketBy(parts, "block").option("path", new_path(spark, "blocks"))
    writer.saveAsTable(name)
    stored = spark.table(name)
    return stored, stored.agg(F.sum(F.expr("aggregate(size, 0L, (s, x) -> s + x)"))).first()[0] or 0


class Stretches:
    """Strings of a block in stretches with one anchor."""

    def __init__(self, size: list[int], own: list[int], data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.hashes = Rolling(self.data)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        n = len(self.data) - WIDTH + 1
        if n <= 0:
            self.first = self.last = self.anchor = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        grams = len(self.data) - GRAM + 1
        gram = self.hashes.grams(GRAM)
        # The smallest hash of WIDTH - GRAM + 1 grams, the first of equals; the place is kept in the low bits.
        low = np.uint64((1 << max(1, grams.bit_length())) - 1)
        least, width, wanted = (gram & ~low) | np.arange(grams, dtype=np.uint64), 1, WIDTH - GRAM + 1
        while width < wanted:
            shift = min(width, wanted - width)
            least = np.minimum(least[:-shift], least[shift:])
            width += shift
        anchor = (least & low).astype(np.int64)
        # Strings that lie in a piece and start in its own part.
        sound = np.zeros(len(self.data) + 1, np.int64)
        start, count = at[:-1], np.clip(np.minimum(own, np.array(size, np.int64) - WIDTH + 1), 0, None).astype(np.int64)
        np.add.at(sound, start[count > 0], 1)
        np.add.at(sound, (start + count)[count > 0], -1)
        sound = np.cumsum(sound)[:n] > 0
        edge = np.zeros(n + 1, bool)
        edge[1:n] = (anchor[1:] != anchor[:-1]) | (sound[1:] != sound[:-1])
        edge[start[start < n]] = True
        edge[[0, n]] = True
        edges = np.flatnonzero(edge)
        kept = sound[edges[:-1]]
        self.first, self.last = edges[:-1][kept], edges[1:][kept] - 1
        self.anchor = anchor[self.first]
        self.gram = gram[self.anchor]

    def content(self, chosen: np.ndarray) -> list[np.ndarray]:
        return [self.hashes.of(self.first[chosen], self.last[chosen] + WIDTH, which) for which in (0, 1)]


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _flags(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def _unflag(answers: list[dict]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(a["raw"][8:], np.uint8), count=int.from_bytes(a["raw"][:8], "little")) for a in answers]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def map_rows(df: DataFrame, each: Callable[[dict], Iterator[tuple]], schema: str = "block long, bucket int, raw binary") -> DataFrame:
    """`each` of every row, as a table of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(each(batch.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return df.mapInArrow(run, schema)


def repeated(sent: DataFrame, label: str) -> DataFrame:
    """Answers that say for each distinct hash of a block whether it stands elsewhere too."""

    def answer(parts: list[bytes]) -> list[bytes]:
        each = [np.frombuffer(p, np.uint32) for p in parts]
        all_ = np.concatenate(each)
        _, place, count = np.unique(all_ >> 1, return_inverse=True, return_counts=True)
        again = (count > 1)[place] | (all_ & 1).astype(bool)
        return [_flags(x) for x in np.split(again, np.cumsum([len(x) for x in each])[:-1])]

    return exchange(sent, answer, label)


def hashes_to_send(block: int, grams: np.ndarray, buckets: int) -> Iterator[tuple]:
    """The distinct hashes of a block. Within a bucket the high bits are settled; the low bit says that the block has it twice."""
    gram, count = np.unique(grams, return_counts=True)
    short = (_mix(gram) >> np.uint64(33)) << np.uint64(1) | (count > 1).astype(np.uint64)
    for bucket, a, b in _cut(_bucket_of(gram, buckets), len(gram)):
        yield block, bucket, short[a:b].astype(np.uint32).tobytes()


def answered(grams: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    return _unflag(answers or [])[np.searchsorted(np.unique(grams), grams)] if len(grams) else np.zeros(0, bool)


def _suspects(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, first, last, gram, one, two): stretches whose anchor stands elsewhere too, with their anchor and content as hashes."""

    def anchors(row: dict) -> Iterator[tuple]:
        s = Stretches(row["size"], row["own"], row["data"])
        # Stretches may share an anchor.
        yield from hashes_to_send(row["block"], s.gram[np.unique(s.anchor, return_index=True)[1]], buckets)

    def each(row: dict) -> Iterator[tuple]:
        s = Stretches(row["size"], row["own"], row["data"])
        again = answered(s.gram, row["answers"])
        if again.any():
            one, two = s.content(again)
            yield row["block"], _pack(s.first[again]), _pack(s.last[again] - s.first[again]), s.gram[again].tobytes(), one.tobytes(), two.tobytes()

    texts = blocks.select("block", "size", "own", "data")
    answers = by_block(repeated(map_rows(texts, anchors), "anchors"))
    kind = "block long, first binary, length binary, gram binary, one binary, two binary"
    return materialize(map_rows(texts.join(answers, "block"), each, kind), "suspects")


def _first_of_equals(suspects: DataFrame, buckets: int) -> DataFrame:
    """Answers that say for each distinct content of a block's suspect stretches whether an earlier block has it."""

    def send(row: dict) -> Iterator[tuple]:
        one, first = np.unique(np.frombuffer(row["one"], np.uint64), return_index=True)
        two = np.frombuffer(row["two"], np.uint64)[first]
        for bucket, a, b in _cut(_bucket_of(one, buckets), len(one)):
            yield row["block"], bucket, one[a:b].tobytes() + two[a:b].tobytes()

    def answer(parts: list[bytes]) -> list[bytes]:
        # Parts come in the order of blocks, so the first of equals is the earliest.
        each = [np.frombuffer(p, np.uint64).reshape(2, -1) for p in parts]
        one, two = np.concatenate(each, axis=1)
        order = np.lexsort((two, one))
        later = np.zeros(len(one), bool)
        later[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        return [_flags(x) for x in np.split(later, np.cumsum([x.shape[1] for x in each])[:-1])]

    return exchange(map_rows(suspects.select("block", "one", "two"), send), answer, "contents")


def _later(row: dict) -> np.ndarray:
    """Which suspect stretches of a block are later copies of equal ones."""
    one = np.frombuffer(row["one"], np.uint64)
    _, first, place = np.unique(one, return_index=True, return_inverse=True)
    here = np.ones(len(one), bool)
    here[first] = False
    return _unflag(row["contents"] or [])[place] | here


def _to_sort(blocks: DataFrame, suspects: DataFrame, buckets: int) -> DataFrame:
    """(block, at, size, data, later): the stretches to sort as runs of bytes, and where later copies start and end.

    Copies of whole stretches are out of the way now, and many a stretch had no other partner: only those go on whose
    anchor stands in another stretch that is left.
    """
    contents = by_block(_first_of_equals(suspects, buckets)).withColumnRenamed("answers", "contents")
    suspects = suspects.drop("two").join(contents, "block")

    def anchors(row: dict) -> Iterator[tuple]:
        yield from hashes_to_send(row["block"], np.frombuffer(row["gram"], np.uint64)[~_later(row)], buckets)

    answers = by_block(repeated(map_rows(suspects.select("block", "one", "gram", "contents"), anchors), "anchors"))

    def chosen(row: dict) -> Iterator[tuple]:
        first, later = _unpack(row["first"]).astype(np.int64), _later(row)
        end, sort = first + _unpack(row["length"]).astype(np.int64) + 1, ~later
        sort[sort] = answered(np.frombuffer(row["gram"], np.uint64)[~later], row["answers"])
        yield row["block"], _pack_all(*_runs(first[sort], end[sort]).T), _pack_all(*_runs(first[later], end[later]).T)

    ranges = materialize(map_rows(suspects.join(answers, "block", "left"), chosen, "block long, sort binary, later binary"), "ranges")

    def each(row: dict) -> Iterator[tuple]:
        start, end = (x.astype(np.int64) for x in _unpack_all(row["sort"]))
        data = b"".join(row["data"][a : b + WIDTH - 1] for a, b in zip(start.tolist(), end.tolist()))
        yield row["block"], _pack_all(start), _pack_all(end - start), int((end - start).sum()), data, row["later"]

    return materialize(map_rows(blocks.select("block", "data").join(ranges, "block"), each, "block long, at binary, size binary, strings long, data binary, later binary"), "to_sort")


def _runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges, sorted by start, joined where they touch."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return np.stack([start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]], axis=1)


# -- the suffix array


def _letter_class(place: np.ndarray, step: int) -> np.ndarray:
    """Letter numbers modulo 3."""
    letter = place // np.int32(step)
    return letter - letter // np.int32(3) * np.int32(3)


class Layout:
    """Positions of a block's runs of bytes, each run followed by PAD that belongs to none."""

    def __init__(self, sizes: np.ndarray):
        """`sizes`: how many strings start in each run."""
        sizes = sizes.astype(np.int32)
        length = sizes + np.int32(WIDTH - 1)
        start = np.concatenate([[0], np.cumsum(length + PAD, dtype=np.int64)])
        self.n = int(start[-1])
        place = np.arange(self.n, dtype=np.int32) - np.repeat(start[:-1].astype(np.int32), length + PAD)
        size = np.repeat(sizes, length + PAD)
        inside = place < size + np.int32(WIDTH - 1)
        self.begin, self.length, self.place = start[:-1], length, place
        # members[k + 1] is the sample of level k, which is named; ranked[k] is what level k puts in order: the strings, and
        # of each sample what the order of the level before looks ahead to.
        self.members, self.ranked, reach = [inside], [place < size], 0
        for step in STEPS:
            self.members.append(self.members[-1] & (_letter_class(place, step) != 0))
            reach += 2 * step
            self.ranked.append(self.members[-1] & (place < size + np.int32(reach)))
        self.ranked[-1] = self.members[-1]

    def letters(self, data: bytes) -> np.ndarray:
        out, at = np.zeros(self.n + LETTER, np.uint64), 0
        for b, n in zip(self.begin.tolist(), self.length.tolist()):
            out[b : b + n] = np.frombuffer(data, np.uint8, n, at)
            at += n
        return out[:-4] << np.uint64(24) | out[1:-3] << np.uint64(16) | out[2:-2] << np.uint64(8) | out[3:-1]

    def spread(self, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Values at their positions, 0 elsewhere."""
        out = np.zeros(self.n, np.uint64)
        out[wanted] = values
        return out


def _ahead(x: np.ndarray, step: int) -> np.ndarray:
    return np.concatenate([x[step:], np.zeros(min(step, len(x)), x.dtype)])


def _triples(letters: np.ndarray, layout: Layout, level: int) -> np.ndarray:
    sample, step = np.flatnonzero(layout.members[level + 1]), STEPS[level]
    return np.stack([_ahead(letters, step * i)[sample] for i in range(3)])


def _named(triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct triples in order, and where each stands among them."""
    n = triples.shape[1]
    keys = triples
    if n and int(triples.max()) < 1 << 32:
        # Two letters fit in one number.
        keys = np.stack([triples[0] << np.uint64(32) | triples[1], triples[2]])
    order = np.lexsort(keys[::-1])
    laid = keys[:, order]
    new = np.ones(n, bool)
    new[1:] = (laid[:, 1:] != laid[:, :-1]).any(0)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return triples[:, order[new]], place


def _rank_among(splitters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many splitters each key is at or beyond; both have a column for each item, and are compared row by row."""
    n = splitters.shape[1]
    if not n:
        return np.zeros(keys.shape[1], np.int64)
    both = np.concatenate([splitters, keys], axis=1)
    is_key = np.arange(both.shape[1]) >= n
    order = np.lexsort((is_key, *both[::-1]))
    out = np.empty(both.shape[1], np.int64)
    out[order] = np.cumsum(~is_key[order])
    return out[n:]


def _splitters(state: DataFrame, sample: Callable[[dict, int], np.ndarray], items: int) -> np.ndarray:
    """Bounds of buckets from an even sample of columns; about 64 a bucket come to the driver."""
    buckets = blocks_of(items)
    blocks = state.count()
    # SAMPLED blocks are enough to know how content is spread, if they have 64 items a bucket.
    every = max(1, min(blocks // SAMPLED, items // (64 * buckets)))
    share = max(1, items // (64 * buckets * every))
    state = state.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0)

    def some(row: dict) -> Iterator[tuple]:
        found = sample(row, share)
        if found.shape[1]:
            yield (_pack_all(*found),)

    rows = [_unpack_all(r["raw"]) for r in map_rows(state, some, "raw binary").collect()]
    if not rows or buckets == 1:
        return np.zeros((3, 0), np.uint64)
    found = np.concatenate([np.stack(r) for r in rows], axis=1)
    found = found[:, np.lexsort(found[::-1])]
    at = np.unique((np.arange(1, buckets) * found.shape[1]) // buckets)
    return found[:, at]


def _evenly(n: int, share: int, block: int) -> np.ndarray:
    """About every share-th of n items, starting where the block's number says."""
    return np.arange(int(_mix(np.array([block], np.uint64))[0] % np.uint64(share)), n, share)


def _names(state: DataFrame, level: int, letters: Callable[[dict, Layout], np.ndarray], items: int) -> tuple[DataFrame, list[int]]:
    """Answers with the places of a block's distinct triples in their buckets, and how many names the buckets before hold."""

    def sample(row: dict, share: int) -> np.ndarray:
        layout = Layout(_unpack_all(row["size"])[0])
        triples = _triples(letters(row, layout), layout, level)
        return triples[:, _evenly(triples.shape[1], share, row["block"])]

    splitters = _splitters(state, sample, items)

    def send(row: dict) -> Iterator[tuple]:
        layout = Layout(_unpack_all(row["size"])[0])
        distinct, _ = _named(_triples(letters(row, layout), layout, level))
        for bucket, a, b in _cut(_rank_among(splitters, distinct), distinct.shape[1]):
            yield row["block"], bucket, _pack_all(*distinct[:, a:b])

    def answer(parts: list[bytes]) -> list[bytes]:
        each = [np.stack(_unpack_all(p)) for p in parts]
        distinct, place = _named(np.concatenate(each, axis=1))
        return [_pack_all(np.array([distinct.shape[1]]), x) for x in np.split(place, np.cumsum([x.shape[1] for x in each])[:-1])]

    answers = exchange(map_rows(state, send), answer, f"names{level}")
    sizes = {r["bucket"]: int(_unpack_all(r["raw"])[0][0]) for r in answers.groupBy("bucket").agg(F.first("raw").alias("raw")).collect()}
    counts = [sizes.get(b, 0) for b in range(splitters.shape[1] + 1)]
    return answers, np.concatenate([[1], 1 + np.cumsum(counts)]).astype(np.uint64).tolist()


def _with_names(state: DataFrame, level: int, letters: Callable[[dict, Layout], np.ndarray], answers: DataFrame, before: list[int]) -> DataFrame:
    """(block, size, names): names of the level's sample; 0 is left for what lies beyond a run."""

    def each(row: dict) -> Iterator[tuple]:
        layout = Layout(_unpack_all(row["size"])[0])
        _, place = _named(_triples(letters(row, layout), layout, level))
        parts = [_unpack_all(a["raw"])[1] + np.uint64(before[a["bucket"]]) for a in row["answers"] or []]
        names = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield row["block"], row["size"], _pack_all(names[place])

    joined = state.join(by_block(answers), "block", "left")
    return materialize(map_rows(joined, each, "block long, size binary, names binary"), f"named{level}")


def _order(state: DataFrame, level: int, letters: Callable[[dict, Layout], np.ndarray], ranks: Callable[[dict, Layout], np.ndarray], items: int, answer_with: Callable, extra=None):
    """Answers of buckets of positions in order.

    A position's class is its letter number modulo 3. Classes 1 and 2 are in the sample and in its order. A position of class 0
    is held against class 1 by its letter and the rank one step on, against class 2 by two letters and the rank two steps on.
    Splitters are of class 1, so that every position can be held against them.
    """
    step = STEPS[level]

    def keys(row: dict) -> tuple:
        layout = Layout(_unpack_all(row["size"])[0])
        x, r = letters(row, layout), ranks(row, layout)
        at = np.flatnonzero(layout.ranked[level])
        return layout, at, _letter_class(layout.place[at], step), np.stack([x[at], _ahead(x, step)[at], r[at], _ahead(r, step)[at], _ahead(r, 2 * step)[at]])

    def sample(row: dict, share: int) -> np.ndarray:
        _, _, kind, key = keys(row)
        key = key[:, kind == 1]
        return key[[2, 0, 3]][:, _evenly(key.shape[1], share, row["block"])]

    splitters = _splitters(state, sample, items)

    def bucket_of(kind: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.searchsorted(splitters[0], key[2], "right")
        zero = kind == 0
        out[zero] = _rank_among(splitters[1:], key[[0, 3]][:, zero])
        return out

    def send(row: dict) -> Iterator[tuple]:
        layout, at, kind, key = keys(row)
        more = extra(row, layout, at) if extra else np.zeros((0, len(at)), np.uint64)
        bucket = bucket_of(kind, key)
        order = np.argsort(bucket, kind="stable")
        for number, a, b in _cut(bucket[order], len(at)):
            own = order[a:b]
            k, z = kind[own], key[:, own]
            # Only what a class is compared by.
            parts = [k, z[0], z[1][k != 1], z[2][k != 0], z[3][k != 2], z[4][k != 1]]
            yield row["block"], number, _pack_all(*parts, *more[:, own])

    def answer(parts: list[bytes]) -> list[bytes]:
        kinds, rows, more = [], [], []
        for p in parts:
            k, x, x1, r, r1, r2, *rest = _unpack_all(p)
            z = np.zeros((5, len(k)), np.uint64)
            z[0], z[1, k != 1], z[2, k != 0], z[3, k != 2], z[4, k != 1] = x, x1, r, r1, r2
            kinds.append(k)
            rows.append(z)
            more.append(np.stack(rest) if rest else np.zeros((0, len(k)), np.uint64))
        sizes = [len(k) for k in kinds]
        order = _merged(np.concatenate(kinds), np.concatenate(rows, axis=1))
        return answer_with(sizes, order, np.concatenate(more, axis=1))

    answers = exchange(map_rows(state, send), answer, f"order{level}")
    return answers, keys, bucket_of


def _merged(kind: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Indices of the positions in order."""
    one, two, zero = (np.flatnonzero(kind == k) for k in (1, 2, 0))
    sample = np.concatenate([one, two])
    sample = sample[np.argsort(key[2, sample], kind="stable")]
    zero = zero[np.lexsort((key[3, zero], key[0, zero]))]
    ones, twos = sample[kind[sample] == 1], sample[kind[sample] == 2]
    # How many of the sample come before each position of class 0.
    ahead = _rank_among(key[[0, 3]][:, ones], key[[0, 3]][:, zero]) + _rank_among(key[[0, 1, 4]][:, twos], key[[0, 1, 4]][:, zero])
    both = np.concatenate([sample, zero])
    at = np.concatenate([np.arange(len(sample)) * 2 + 1, ahead * 2])
    return both[np.argsort(at, kind="stable")]


def _rank_answers(sizes: list[int], order: np.ndarray, more: np.ndarray) -> list[bytes]:
    place = np.empty(len(order), np.uint64)
    place[order] = np.arange(len(order), dtype=np.uint64)
    return [_pack_all(np.array([len(order)]), x) for x in np.split(place, np.cumsum(sizes)[:-1])]


def _ranked(state: DataFrame, level: int, answers: DataFrame, keys, bucket_of) -> DataFrame:
    """(block, ranks): ranks of what the level puts in order."""
    # One row for each bucket.
    sizes = {r["bucket"]: int(_unpack_all(r["raw"])[0][0]) for r in answers.groupBy("bucket").agg(F.first("raw").alias("raw")).collect()}
    before, total = {}, 1
    for bucket in sorted(sizes):
        before[bucket], total = total, total + sizes[bucket]

    def each(row: dict) -> Iterator[tuple]:
        _, at, kind, key = keys(row)
        out = np.zeros(len(at), np.uint64)
        order = np.argsort(bucket_of(kind, key), kind="stable")
        parts = [_unpack_all(a["raw"])[1] + np.uint64(before[a["bucket"]]) for a in row["answers"] or []]
        if parts:
            out[order] = np.concatenate(parts)
        yield row["block"], _pack_all(out)

    joined = state.join(by_block(answers), "block", "left")
    return materialize(map_rows(joined, each, "block long, ranks binary"), f"ranks{level}")


def _run_answers(sizes: list[int], order: np.ndarray, more: np.ndarray) -> list[bytes]:
    """For each string whether a neighbour with equal first bytes is earlier; runs at a bucket's ends are left to be settled, with fingerprints.

    Positions come block by block in text order, so the smaller index is the earlier string.
    """
    prints = more[0, order]
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = prints[1:] != prints[:-1]
    run = np.cumsum(new) - 1
    first = np.full(run[-1] + 1, n, np.int64)
    np.minimum.at(first, run, order)
    state = np.zeros(n, np.uint64)
    state[order] = order != first[run]
    open_ = (run == 0) | (run == run[-1])
    state[order[open_]] += 2
    out, at = [], 0
    for size in sizes:
        own = state[at : at + size]
        left = own >= 2
        out.append(_pack_all(own, more[0, at : at + size][left]))
        at += size
    return out


def _later_strings(state: DataFrame, answers: DataFrame, keys, bucket_of) -> DataFrame:
    """(block, strings): places in the layout of strings that start earlier too."""

    def ends(row: dict) -> Iterator[tuple]:
        own, prints = _unpack_all(row["raw"])
        distinct, first = np.unique(prints, return_index=True)
        for own_print, place in zip(distinct.view(np.int64).tolist(), np.flatnonzero(own >= 2)[first].tolist()):
            yield row["block"], row["bucket"], place, own_print

    # Two runs of each bucket at most, and of each one row for a block that has it.
    left = materialize(map_rows(answers, ends, "block long, bucket int, first long, print long"), "ends")
    # The earliest string of a run: a block's buckets keep text order inside only, so places are compared by block first.
    joined = state.join(by_block(answers), "block", "left").join(
        left.groupBy("block").agg(F.collect_list(F.struct("bucket", "first", "print")).alias("ends")), "block", "left"
    )

    def places(row: dict) -> Iterator[tuple]:
        """Where the earliest string of each open run stands in its block."""
        order, cuts = _order_of(row)
        for end in row["ends"] or []:
            yield end["print"], row["block"], int(order[cuts[end["bucket"]] + end["first"]])

    def _order_of(row: dict):
        _, at, kind, key = keys(row)
        bucket = bucket_of(kind, key)
        order = np.argsort(bucket, kind="stable")
        return at[order], {b: a for b, a, _ in _cut(bucket[order], len(at))}

    stand = materialize(map_rows(joined.where("ends IS NOT NULL"), places, "print long, block long, place long"), "stand")
    earliest = stand.groupBy("print").agg(F.min(F.struct("block", "place")).alias("earliest"))
    mine = stand.join(earliest, "print").select("print", "block", F.when(F.col("earliest.block") == F.col("block"), F.col("earliest.place")).alias("earliest"))
    mine = mine.distinct().groupBy("block").agg(F.collect_list(F.struct("print", "earliest")).alias("earliest"))

    def each(row: dict) -> Iterator[tuple]:
        order, _ = _order_of(row)
        known = {e["print"]: e["earliest"] for e in row["earliest"] or []}
        gone, at = [], 0
        for a in row["answers"] or []:
            own, prints = _unpack_all(a["raw"])
            here = order[at : at + len(own)]
            at += len(own)
            gone.append(here[own == 1])
            left = here[own >= 2]
            distinct, place = np.unique(prints, return_inverse=True)
            stays = [known[p] for p in distinct.view(np.int64).tolist()]
            if len(left):
                gone.append(left[left != np.array([-1 if s is None else s for s in stays])[place]])
        found = np.sort(np.concatenate(gone)) if gone else np.zeros(0, np.int64)
        yield row["block"], _pack_all(found)

    return materialize(map_rows(joined.drop("ends").join(mine, "block", "left"), each, "block long, strings binary"), "strings")


def later_strings(to_sort: DataFrame) -> DataFrame:
    """(block, strings) of `to_sort`: places in each block's layout of strings of WIDTH bytes that start earlier too."""
    whole = to_sort.agg(F.sum(F.octet_length("data")), F.sum("strings")).first()
    total, strings = whole[0] or 0, max(1, whole[1] or 0)
    sizes = [max(1, int(total * (2 / 3) ** k)) for k in range(4)]
    text = to_sort.select("block", "size", "data")
    of_text = lambda row, layout: layout.letters(row["data"])
    of_names = lambda level: lambda row, layout: layout.spread(_unpack_all(row["names"])[0], layout.members[level])
    of_ranks = lambda level: lambda row, layout: layout.spread(_unpack_all(row["ranks"])[0], layout.ranked[level])

    # Down: names of samples.
    states = [text]
    for level, letters in enumerate((of_text, of_names(1), of_names(2))):
        answers, before = _names(states[-1], level, letters, sizes[level + 1])
        states.append(_with_names(states[-1], level, letters, answers, before))
        drop(answers)
        release(text.sparkSession)
    _, first, second, third = states
    # Up: names of the last level stand for more than WIDTH bytes, so they are ranks.
    ranks = third.select("block", F.col("names").alias("ranks"))
    for level, state in ((2, second), (1, first)):
        state = state.join(ranks, "block")
        found = _order(state, level, of_names(level), of_ranks(level + 1), strings, _rank_answers)
        ranks = _ranked(state, level, *found)
        drop(found[0])
        release(text.sparkSession)

    def prints(row: dict, layout: Layout, at: np.ndarray) -> np.ndarray:
        raw = np.zeros(layout.n, np.uint8)
        done = 0
        for b, n in zip(layout.begin.tolist(), layout.length.tolist()):
            raw[b : b + n] = np.frombuffer(row["data"], np.uint8, n, done)
            done += n
        rolling = Rolling(raw)
        return rolling.of(at, at + WIDTH)[None]

    state = text.join(ranks, "block")
    found = _later_strings(state, *_order(state, 0, of_text, of_ranks(1), strings, _run_answers, prints))
    drop(first, second, third)
    release(text.sparkSession)
    return found


# -- what is left of the documents


def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document; kept is the rest of its bytes."""
    blocks, n_bytes = stored_blocks(documents)
    # An anchor stands in every 19 bytes or so.
    buckets = blocks_of(n_bytes // 16)
    release(documents.sparkSession)
    suspects = _suspects(blocks, buckets)
    release(documents.sparkSession)
    to_sort = _to_sort(blocks, suspects, buckets)
    drop(suspects)
    release(documents.sparkSession)
    strings = later_strings(to_sort.where("octet_length(data) > 0"))
    gone = to_sort.select("block", "at", F.col("size").alias("strings_in_run"), "later").join(strings, "block", "left")

    def each(row: dict) -> Iterator[tuple]:
        data = np.frombuffer(row["data"], np.uint8)
        n = len(data)
        covered = np.zeros(n + 1, np.int64)
        if row["later"] is not None:
            start, end = (x.astype(np.int64) for x in _unpack_all(row["later"]))
            np.add.at(covered, start, 1)
            np.add.at(covered, end + WIDTH - 1, -1)
            if row["strings"] is not None:
                at, size = (_unpack_all(row[name])[0].astype(np.int64) for name in ("at", "strings_in_run"))
                layout, found = Layout(size), _unpack_all(row["strings"])[0].astype(np.int64)
                run = np.searchsorted(layout.begin, found, "right") - 1
                found = at[run] + found - layout.begin[run]
                np.add.at(covered, found, 1)
                np.add.at(covered, found + WIDTH, -1)
        covered = np.cumsum(covered)[:n] > 0
        place = 0
        for doc, doc_id, whole, piece, own, size in zip(row["doc"], row["doc_id"], row["whole"], row["piece"], row["own"], row["size"]):
            mine, part = covered[place : place + size], data[place : place + size]
            place += size
            if whole:
                yield doc, doc_id, True, piece, size, int(mine.sum()), _spans(mine), None, part[~mine].tobytes()
            else:
                yield doc, doc_id, False, piece, own, 0, 0, np.packbits(mine).tobytes(), part.tobytes()

    kind = "doc long, doc_id long, whole boolean, piece long, own long, n_removed long, n_spans long, covered binary, kept binary"
    found = materialize(map_rows(blocks.join(gone, "block", "left"), each, kind), "pieces")
    done = found.where("whole").select("doc_id", F.col("own").alias("n_bytes"), "n_removed", "n_spans", "kept")

    def joined(table: pa.Table) -> pa.Table:
        """A document that was cut: what a piece says about its overlap holds for the next piece too."""
        rows = table.sort_by("piece").to_pylist()
        n = sum(r["own"] for r in rows)
        data, covered, at = np.zeros(n, np.uint8), np.zeros(n, bool), 0
        for r in rows:
            part = np.frombuffer(r["kept"], np.uint8)
            data[at : at + r["own"]] = part[: r["own"]]
            covered[at : at + len(part)] |= np.unpackbits(np.frombuffer(r["covered"], np.uint8), count=len(part)).astype(bool)
            at += r["own"]
        return pa.Table.from_pylist([{"doc_id": rows[0]["doc_id"], "n_bytes": n, "n_removed": int(covered.sum()), "n_spans": _spans(covered), "kept": data[~covered].tobytes()}], pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    return done.union(found.where("NOT whole").groupBy("doc").applyInArrow(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def _spans(covered: np.ndarray) -> int:
    return int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
