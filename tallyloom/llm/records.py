"""Token ids in files of length-delimited records, with an offset index beside each file.

A record is framed as: length (8 bytes), masked checksum of the length (4), the
serialized sequence, its masked checksum (4); all little-endian. A sequence is a flag
(1 if it has a number), the document's number (8), the bytes of an id (2 or 4), and the ids.
The index has for each record its offset and the ids before it in the file (8 bytes
each), so records can be read in any order. Checksums are zlib's CRC-32.

Each task writes files of its own name and returns a row about them; only rows that
Spark commits count, so a task that is lost or run twice leaves nothing behind that
is read. The folder must be one that all executors reach (a local path shared by
all, or a store that pyarrow knows, such as hdfs or s3).

Defined cases: documents stand in ascending id, null first, then by a hash of the text;
repeated rows are written each. A null text has no ids besides the end id. No rows: no
files and no records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.scratch import materialize, new_path

#: Records that one reading task takes from a file.
READ_RECORDS = 8192

# Fixed values of the masking rule.
_MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(number: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    body = struct.pack("<BqB", number is not None, number or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked(length)) + body + struct.pack("<I", masked(body))


def unframe(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """Number and ids of the record at an offset, and the offset of the next."""
    length = data[at : at + 8]
    (size,) = struct.unpack("<Q", length)
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(length):
        raise ValueError(f"damaged length at {at}")
    body = data[at + 12 : at + 12 + size]
    if len(body) < size or struct.unpack("<I", data[at + 12 + size : at + 16 + size])[0] != masked(body):
        raise ValueError(f"damaged record at {at}")
    some, number, width = struct.unpack("<BqB", body[:10])
    return (number if some else None), np.frombuffer(body, f"<u{width}", offset=10), at + 16 + size


def in_order(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text), range-partitioned and sorted by id. An id with many rows may span partitions."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("print")]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("print")


def write_sequences(rows: DataFrame, folder: str, end_id: int | None = None) -> DataFrame:
    """Write (id, ids) as they are laid out; returns the stored list of files: part, file, records, ids, start (ids in all files before)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        records = total = offset = 0
        data = index = None
        end = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            if batch.num_rows and data is None:
                store.create_dir(place, recursive=True)
                data, index = store.open_output_stream(f"{place}/{name}.bin"), store.open_output_stream(f"{place}/{name}.idx")
            for number, ids in zip(batch.column("id").to_pylist(), batch.column("ids")):
                sequence = np.concatenate([np.frombuffer(ids.as_buffer() or b"", "<u4"), end])
                framed = frame(number, sequence)
                index.write(struct.pack("<QQ", offset, total))
                data.write(framed)
                offset, total, records = offset + len(framed), total + len(sequence), records + 1
        if data is not None:
            data.close(), index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{name}"], "records": pa.array([records], pa.int64()), "ids": pa.array([total], pa.int64())})

    # One row for each file.
    files = materialize(rows.mapInArrow(write, "part int, file string, records long, ids long"), "files")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(ahead), F.lit(0)))


def read_sequences(files: DataFrame, folder: str) -> DataFrame:
    """(id, start, ids): every record of the files, and how many ids stand before it in all of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{place}/{row['file']}.idx") as index:
                    entries = np.frombuffer(index.read_at((min(READ_RECORDS, row["records"] - row["first"]) + 1) * 16, row["first"] * 16), "<u8").reshape(-1, 2)
                taken = entries[: READ_RECORDS]
                with store.open_input_file(f"{place}/{row['file']}.bin") as data:
                    for some in range(0, len(taken), 512):
                        own = taken[some : some + 512]
                        after = entries[some + 512][0] if some + 512 < len(entries) else data.size()
                        base = int(own[0][0])
                        block = data.read_at(int(after) - base, base)
                        found = [unframe(block, int(offset) - base)[:2] for offset, _ in own]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f[0] for f in found], pa.int64()), pa.array([row["start"] + int(before) for _, before in own], pa.int64()), pa.array([f[1].astype("<u4").tobytes() for f in found], pa.binary())],
                            names=["id", "start", "ids"],
                        )

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(READ_RECORDS).cast("long"))
    runs = files.withColumn("first", F.explode(step)).repartition(parts, "file", "first")
    return runs.select("file", "records", "start", "first").mapInArrow(read, "id long, start long, ids binary")


def new_folder(spark, label: str = "records") -> str:
    """A fresh folder that all executors share, as a URI or absolute path."""
    return new_path(spark, label)
