"""Splitting text into chunks.

`separator_chunks` packs pieces; `nested_chunks` tries ever finer separators and
keeps an overlap. A fold over an array would copy what it has gathered at every
piece, so both run as Arrow-batched functions over whole texts, in linear time.
As columns they hold the chunks of a whole batch; `chunk_rows` makes rows of them
and holds a few hundred.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes, overlap and separators, coarse to fine.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
PARAGRAPH = "\n\n"
SEPARATORS = ["\n\n", "\n", " ", ""]
#: Characters of chunks, and bytes of what stands beside them, that are handed on at once.
HELD = 1 << 20


def pack_pieces(text: str, separator: str, size: int) -> Iterator[str]:
    """Pieces between separators, put together again as long as they fit."""
    held: list[str] = []
    length = 0
    for piece in filter(None, text.split(separator)):
        if held and length + len(separator) + len(piece) > size:
            yield separator.join(held)
            held, length = [], 0
        length += len(piece) + (len(separator) if held else 0)
        held.append(piece)
    if held:
        yield separator.join(held)


def paragraph_chunks(text: str, separator: str = PARAGRAPH, size: int = CHUNK_SIZE) -> Iterator[str]:
    """Trimmed chunks of packed pieces, without empty ones."""
    return (c for c in (part.strip() for part in pack_pieces(text, separator, size)) if c)


def separator_chunks(text: Column, separator: str = PARAGRAPH, size: int = CHUNK_SIZE) -> Column:
    """Pack pieces between separators greedily into chunks of at most `size` characters.

    A piece longer than `size` stays whole. Chunks are trimmed, empty ones dropped.
    """

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> list[str] | None:
            if value is None:
                return None
            return list(paragraph_chunks(value, separator, size))

        return texts.map(one)

    return chunks(text)


def _pieces(text: str, separators: list[str]) -> tuple[list[str], list[str]]:
    """Split at the first separator that occurs, keeping it at the head of the piece it introduces."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if not separator:
        return list(text), finer
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p], finer


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbours up to `size`; each chunk starts with at most `overlap` characters of the one before."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def split_nested(text: str, size: int, overlap: int, separators: list[str]) -> Iterator[str]:
    pieces, finer = _pieces(text, separators)
    small: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _pack(small, size, overlap)
        small = []
        if finer:
            yield from split_nested(piece, size, overlap, finer)
        else:
            yield piece
    yield from _pack(small, size, overlap)


def overlapping_chunks(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> Iterator[str]:
    """Trimmed chunks of nested separators, without empty ones."""
    return (c for c in (part.strip() for part in split_nested(text, size, overlap, separators or SEPARATORS)) if c)


def nested_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> Column:
    """Chunks of at most `size` characters split at the coarsest separator that works, with an overlap."""
    levels = separators or SEPARATORS

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> list[str] | None:
            if value is None:
                return None
            return list(overlapping_chunks(value, size, overlap, levels))

        return texts.map(one)

    return chunks(text)


def _handed_on(batch: pa.RecordBatch, text: str, chunks_of: Callable[[str], Iterable[str]]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, once for every chunk of their text, in batches of some HELD characters."""
    beside = batch.drop_columns([text])
    wide = beside.nbytes // max(1, batch.num_rows)
    rows, numbers, found, held = [], [], [], 0

    def made() -> pa.RecordBatch:
        index = pa.array(rows, pa.int32())
        columns = [c.take(index) for c in beside.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(found, pa.string())], names=[*beside.schema.names, "chunk_no", "chunk"])

    texts = batch.column(text)
    for i in range(batch.num_rows):
        value = texts[i].as_py()
        for number, chunk in enumerate(chunks_of(value) if value is not None else ()):
            rows.append(i)
            numbers.append(number)
            found.append(chunk)
            held += len(chunk) + wide
            if held >= HELD:
                yield made()
                rows, numbers, found, held = [], [], [], 0
    if rows:
        yield made()


def chunk_rows(documents: DataFrame, text: str, chunks_of: Callable[[str], Iterable[str]]) -> DataFrame:
    """One row per chunk with its position, `chunk_no` and `chunk`, in place of the text. A worker holds one input batch and HELD characters of chunks."""
    kept = [c for c in documents.columns if c != text]
    schema = T.StructType([*[documents.schema[c] for c in kept], T.StructField("chunk_no", T.IntegerType(), False), T.StructField("chunk", T.StringType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _handed_on(batch, text, chunks_of)

    return documents.select(*kept, text).mapInArrow(compute, schema)
