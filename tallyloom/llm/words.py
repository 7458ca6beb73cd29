"""Words of a column of texts as flat numpy arrays.

Everything works on the UTF-8 bytes of a slice of rows, so there is no Python
loop over words. Words are runs of bytes other than `[\\x20\\x09-\\x0D]`; these
bytes never occur inside a longer UTF-8 sequence. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyloom.llm.kept import kept

#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _byte_values(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(0x5851F42D4C957F2D))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    def make(size):
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out
    if n <= SLICE_BYTES + 1:
        return kept("powers", lambda: make(SLICE_BYTES + 1))
    return make(n)


class Texts:
    """Texts of one slice: `data` holds all bytes, row i is `data[at[i]:at[i + 1]]`."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        self.data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]

    def __len__(self) -> int:
        return len(self.at) - 1

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.at[row] : self.at[row + 1]].tobytes()

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[self.at])

    def runs(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of wanted bytes; no run crosses a row."""
        first, last = wanted.copy(), wanted.copy()
        first[1:] &= ~wanted[:-1]
        last[:-1] &= ~wanted[1:]
        edge = self.at[1:-1]
        edge = edge[(edge > 0) & (edge < len(wanted))]
        first[edge] = wanted[edge]
        last[edge - 1] = wanted[edge - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> None:
        """Set `start`, `end` of every word, and `word_at`: row i has words `word_at[i]:word_at[i + 1]`."""
        self.start, self.end = self.runs(~SPACE[self.data])
        self.word_at = np.searchsorted(self.start, self.at)

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
        """64-bit hashes of byte ranges, A-Z as a-z if `fold`."""
        power, inverse = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(kept(("byte values", fold), lambda: _byte_values(fold))[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` items inside one row, and the index of their first item."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[i : i + n]
    row_end = np.repeat(at[1:], np.diff(at))[:n]
    inside = np.flatnonzero(np.arange(n) + width <= row_end)
    return mix(total[inside]), inside


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most SLICE_BYTES of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(size), 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + SLICE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last
