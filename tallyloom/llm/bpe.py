"""BPE encoding and decoding of whole texts with a public tokenizer file.

A long text is a tree: it is halved until its pieces are short, the pieces are
encoded on their own, wherever they were cut, as rows that Spark deals out, and
neighbours are joined level by level. Around a join a window of the text is encoded
anew; it grows until, on either side of the cut, a stretch of its tokens is the same
as the piece's own, in number and place. There the three are spliced. A sequence in
which every two neighbouring tokens are what the encoder makes of their text is the
encoding of the whole, so the result is exact; tests hold it against the library.

Between white space the encoder works on its own, so the encodings of such chunks
are kept by each worker and joined; only chunks not seen yet go to the library.

Defined cases: a null text is an empty one and has no tokens. Repeated rows and
repeated or null ids are encoded row by row. Extra columns are passed on unless they
have the names of the results, which replace them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.kept import kept
from tallyloom.llm.words import Texts, slices
from tallyloom.scratch import materialize

#: Code points of a piece; longer texts are halved.
PIECE = 32_768
#: Code points on each side of a join that are encoded anew first; doubled until both sides agree on AGREE tokens.
WINDOW, AGREE = 32, 4
#: Chunks, and cores of chunks, whose encodings a worker keeps, the first it meets; later ones are encoded again each time.
KEPT = 400_000
#: Chunks that are kept by their hash.
WORDS_KEPT = 800_000
#: Cores that go to the library in one call.
CALL = 2048


class _Table(dict):
    """A bounded dictionary with a place for what doesn't fit, which lasts for one call."""

    def __init__(self, most: int):
        self.passing, self.most = {}, most

    def __missing__(self, key):
        return self.passing[key]

    def add(self, key, value):
        (self if len(self) < self.most else self.passing)[key] = value


class Encoder:
    """A tokenizer of one worker, with the chunks it has encoded."""

    def __init__(self, path: str, decoded: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([name.endswith("</w>") for name in self.names])
        most = KEPT // 2 if decoded else KEPT
        self.cores, self.ids_of, self.text_of = _Table(most), _Table(most), _Table(most)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def placed(self, text: str) -> np.ndarray:
        """Rows (id, first, last code point) of a text's tokens."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.column_stack([np.array(found.ids, np.int64), np.array(found.offsets, np.int64).reshape(-1, 2)]) if found.ids else np.zeros((0, 3), np.int64)

    def decode(self, ids) -> str:
        return self.tokenizer.decode([int(i) for i in ids], skip_special_tokens=False)

    def _learn_cores(self, new: list[str]) -> None:
        """Words of letters only are one unit each for the encoder: they go to it in one text and come apart again where units end."""
        words = [w for w in new if w.isalpha()]
        others = [w for w in new if not w.isalpha()]
        for at in range(0, len(words), CALL):
            part = words[at : at + CALL]
            ids = np.array(self.ids([" ".join(part)])[0], np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                others += part
                continue
            packed, last = ids.astype("<u4").tobytes(), 0
            for word, end in zip(part, ends.tolist()):
                self.cores.add(word, packed[4 * last : 4 * end])
                last = end
        for at in range(0, len(others), CALL):
            part = others[at : at + CALL]
            for word, ids in zip(part, self.ids(part)):
                self.cores.add(word, np.array(ids, "<u4").tobytes())

    def _learn(self, new: set[bytes], decoded: bool) -> None:
        """A chunk is a core and the dots or commas after its last letter, where the encoder parts them too. Plain A-Z may be small at once, but in special tokens."""
        split = {}
        for chunk in new:
            core = (chunk.lower() if chunk.isascii() and b"<" not in chunk else chunk).decode()
            tail = ""
            if core[-1] in ".,":
                short = core.rstrip(".,")
                # A letter that is one in lower case as well, and not a letter with a mark.
                if short and short[-1].lower()[-1].isalpha():
                    core, tail = short, core[len(short) :]
            split[chunk] = (core, tail)
        cores = self.cores
        self._learn_cores(list({part for parts in split.values() for part in parts if part and part not in cores}))
        for chunk, (core, tail) in split.items():
            ids = cores[core] + cores[tail] if tail else cores[core]
            self.ids_of.add(chunk, ids)
            if decoded:
                self.text_of.add(chunk, " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()]))
        cores.passing.clear()

    def chunked(self, texts: list[bytes], decoded: bool) -> list[tuple[bytes, str | None]]:
        """For each text its ids as little-endian 32-bit numbers, and the decoded text."""
        split = [text.split() for text in texts]
        self._learn({c for c in set().union(*split) if c not in self.ids_of}, decoded)
        ids, text = self.ids_of.__getitem__, self.text_of.__getitem__
        out = [(b"".join(map(ids, chunks)), " ".join(filter(None, map(text, chunks))) if decoded else None) for chunks in split]
        self.ids_of.passing.clear(), self.text_of.passing.clear()
        return out


class WordIds:
    """Ids of chunks by their 64-bit hash, in flat arrays: a batch looks each distinct chunk up once, and its ids are gathered without a Python step for each word."""

    def __init__(self, coder: Encoder):
        self.coder = coder
        # Chunks are kept here instead, and few cores.
        coder.ids_of.most, coder.cores.most = 0, KEPT // 4
        none = np.zeros(0, np.int64)
        # Sorted tables of (hash, place in flat, number of ids): a large one, and a small one of what came last.
        self.tables = [(np.zeros(0, np.uint64), none, none)] * 2
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for own, own_at, own_n in self.tables:
            if len(own):
                place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                found = own[place] == keys
                at[found], n[found] = own_at[place[found]], own_n[place[found]]
        return at, n

    def _keep(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        def merged(table, more):
            both = [np.concatenate(c) for c in zip(table, more)]
            order = np.argsort(both[0])
            return tuple(c[order] for c in both)

        large, small = self.tables
        small = merged(small, (keys, at, n))
        if len(small[0]) > max(1 << 15, len(large[0]) // 8):
            large, small = merged(large, small), tuple(c[:0] for c in small)
        self.tables = [large, small]

    def rows(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids as little-endian 32-bit numbers."""
        t = Texts(texts)
        t.words()
        keys, first, place = np.unique(t.hashes(t.start, t.end, fold=False), return_index=True, return_inverse=True)
        at, n = self._find(keys)
        new = np.flatnonzero(n < 0)
        if len(new):
            raw = t.data.tobytes()
            words = [raw[a:b] for a, b in zip(t.start[first[new]].tolist(), t.end[first[new]].tolist())]
            self.coder._learn(set(words), False)
            found = [self.coder.ids_of[w] for w in words]
            self.coder.ids_of.passing.clear()
            ids = np.frombuffer(b"".join(found), "<u4")
            n[new] = np.array([len(f) // 4 for f in found])
            at[new] = self.used + np.cumsum(n[new]) - n[new]
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + len(ids), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            # Beyond the bound chunks are encoded again each time, and their ids overwritten.
            if sum(len(table[0]) for table in self.tables) < WORDS_KEPT:
                self.used += len(ids)
                self._keep(keys[new], at[new], n[new])
        n_of = n[place]
        total = np.concatenate([[0], np.cumsum(n_of)])
        ids = self.flat[np.repeat(at[place] - total[:-1], n_of) + np.arange(total[-1])].astype("<u4")
        edges = total[t.word_at].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]


def encoder(path: str, decoded: bool = True) -> Encoder:
    return kept(("encoder", path, decoded), lambda: Encoder(path, decoded))


def join(coder: Encoder, text: str, left: np.ndarray, cut: int, right: np.ndarray) -> np.ndarray:
    """Tokens (id, first, last) of `text` from those of `text[:cut]` and of `text[cut:]`, all placed in `text`."""
    reach = WINDOW
    while True:
        low, high = max(0, cut - reach), min(len(text), cut + reach)
        middle = coder.placed(text[low:high])
        middle[:, 1:] += low
        # A side that the window covers whole needs no agreement.
        start = (0, 0) if low == 0 else _agreed(left, middle, low, cut, False)
        end = (len(right), len(middle)) if high == len(text) else _agreed(right, middle, cut, high, True)
        if start and end and start[1] <= end[1]:
            return np.concatenate([left[: start[0]], middle[start[1] : end[1]], right[end[0] :]])
        reach *= 2


def _agreed(side: np.ndarray, middle: np.ndarray, low: int, high: int, after: bool) -> tuple[int, int] | None:
    """Where to leave one sequence for the other: the positions in `side` and `middle` in the midst of AGREE tokens that are the same in both.

    Of several such stretches the one furthest from the cut; a token that starts
    within a code point it shares with another is no place to change over.
    """
    mine = side[(side[:, 1] >= low) & (side[:, 2] <= high)]
    first = int(np.searchsorted(side[:, 1], low)) if len(mine) else 0
    place = {tuple(t): i for i, t in enumerate(middle.tolist())}
    tokens = mine.tolist()
    first = next((i for i in range(first, len(side)) if tuple(side[i]) == tuple(tokens[0])), first) if tokens else first
    span = range(len(tokens) - AGREE, -1, -1) if after else range(len(tokens) - AGREE + 1)
    for i in span:
        at = place.get(tuple(tokens[i]))
        if at is None or at + AGREE > len(middle):
            continue
        run = tokens[i : i + AGREE]
        if [list(t) for t in middle[at : at + AGREE].tolist()] == run and all(a[2] <= b[1] for a, b in zip(run, run[1:])):
            return first + i + AGREE // 2, at + AGREE // 2
    return None


def concatenated(coder: Encoder, pieces: list[str], tokens: list[np.ndarray]) -> np.ndarray:
    """Tokens of the joined pieces: neighbours are joined until one is left."""
    while len(pieces) > 1:
        texts, joined = [], []
        for i in range(0, len(pieces) - 1, 2):
            cut = len(pieces[i])
            right = tokens[i + 1].copy()
            right[:, 1:] += cut
            texts.append(pieces[i] + pieces[i + 1])
            joined.append(join(coder, texts[-1], tokens[i], cut, right))
        if len(pieces) % 2:
            texts.append(pieces[-1])
            joined.append(tokens[-1])
        pieces, tokens = texts, joined
    return tokens[0]


def halves(text: str, most: int) -> list[str]:
    """The leaves of the tree: a power of two of nearly equal pieces, none longer than `most`."""
    parts = 1
    while -(-len(text) // parts) > most:
        parts *= 2
    at = [len(text) * i // parts for i in range(parts + 1)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def packed(placed: np.ndarray) -> bytes:
    """Placed tokens in little space: each column as steps from one row to the next, compressed."""
    return zlib.compress(np.diff(placed.T, axis=1, prepend=0).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4").reshape(3, -1), axis=1, dtype=np.int64).T


def _pieces_of(long: DataFrame, path: str, piece: int) -> DataFrame:
    """(row, part, text, tokens): the encoded leaves of each long text, dealt out over all cores."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, parts, texts = [], [], []
                for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist()):
                    leaves = halves(text, piece)
                    rows += [row] * len(leaves)
                    parts += range(len(leaves))
                    texts += leaves
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(parts, pa.int32()), pa.array(texts, pa.string())], names=["row", "part", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [packed(coder.placed(text)) for text in part.column("text").to_pylist()]
                yield part.append_column("tokens", pa.array(found, pa.binary()))

    leaves = long.mapInArrow(cut, "row long, part int, text string").repartition(F.col("row"), F.col("part"))
    return leaves.mapInArrow(encode, "row long, part int, text string, tokens binary")


def encode(docs: DataFrame, path: str, text: str = "text", piece: int = PIECE, decode: bool = True) -> DataFrame:
    """`docs` without the text, with `ids` (binary: little-endian 32-bit numbers) and `decoded` (null unless `decode`)."""
    others = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    carried = [f"c{i}" for i in range(len(others))]
    results = plain.select(*carried, F.lit(b"").cast("binary").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, decode)
        for batch in batches:
            for part in slices(batch, "text"):
                found = coder.chunked([t.encode() for t in part.column("text").to_pylist()], decode)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in carried] + [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())],
                    names=[*carried, "ids", "decoded"],
                )

    def rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, decode)
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in (*carried, "leaves")}
                leaves = sorted(row["leaves"], key=lambda leaf: leaf["part"])
                ids = concatenated(coder, [leaf["text"] for leaf in leaves], [unpacked(leaf["tokens"]) for leaf in leaves])[:, 0]
                columns = [pa.array([row[c]], batch.schema.field(c).type) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([ids.astype("<u4").tobytes()], pa.binary()), pa.array([coder.decode(ids) if decode else None], pa.string())],
                    names=[*carried, "ids", "decoded"],
                )

    size = F.length("text")
    short = plain.where(size <= piece).mapInArrow(whole, results)
    # Stored, as the numbers are read twice: a frame that is computed again may come in another order.
    numbered = materialize(plain.where(size > piece).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    leaf = F.struct("part", "text", "tokens")
    trees = _pieces_of(numbered.select("row", "text"), path, piece).groupBy(F.col("row").alias("of")).agg(F.collect_list(leaf).alias("leaves"))
    # A tree holds one text, which is one row of the input as well.
    long = numbered.drop("text").join(trees, F.col("row") == F.col("of")).select(*carried, "leaves").mapInArrow(rejoin, results)
    return short.union(long).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), "ids", "decoded")


def encode_in_place(rows: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`rows` with `ids` in place of the text, in the same partitions and order; texts of any length are encoded where they stand."""
    others = [c for c in rows.columns if c not in (text, "ids")]
    plain = rows.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("word ids", path), lambda: WordIds(Encoder(path, False)))
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(words.rows(part.column(text)), pa.binary())], names=[*others, "ids"])

    return plain.mapInArrow(whole, rows.select(*others, F.lit(b"").cast("binary").alias("ids")).schema)


def tokens(ids) -> np.ndarray:
    """The numbers in one value of `ids`."""
    return np.frombuffer(ids, "<u4")
