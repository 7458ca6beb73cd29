"""A keyed log that is stored in hash buckets, so that lookups and upserts touch only some of its files.

Layout of a folder:

- `about`: one row with the keys, the number of buckets and the schema.
- `data/version=V/bucket_=B/slice_=S`: Parquet files, sorted by the keys, with Bloom filters on columns of choice.
- `versions/batch=V`: the manifest of version V, a row for each bucket and slice with the version whose files hold it.

A row's bucket is the hash of the columns that lookups always name. A bucket that is much larger than others when the log is
made is cut into slices by the hash of the whole key, so a hot thread is rewritten and read in parts.
A write makes new files for the slices it touches and then a new manifest. The manifest is the switch: it counts only with the mark
of a completed write, so a write that fails leaves the version before it as it was, and readers of that version keep their files.
Of two writers that start from one version the second one fails.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.local import local_table
from tallyloom.operators import keyed_log
from tallyloom.operators.ranking import latest_per_key
from tallyloom.scratch import finished_batches, materialize, remove, subfolders

PLACE = ["bucket_", "slice_"]
MANIFEST = "bucket_ int, slice_ int, version long"
#: Suffix of the variant beside a JSON text.
PARSED = "_parsed"


class StoredLog:
    """A log opened at its newest version. Writes return the log at the version they made."""

    def __init__(self, spark: SparkSession, folder: str, about: dict, version: int):
        self.spark, self.folder, self.about, self.version = spark, folder, about, version
        self.schema = T.StructType.fromJson(about["schema"])
        self.keys, self.bucket_by, self.buckets = about["keys"], about["bucket_by"], about["buckets"]
        self.heavy = {int(b): n for b, n in about["heavy"].items()}

    @classmethod
    def create(
        cls, rows: DataFrame, folder: str, keys: list[str], bucket_by: list[str], buckets: int = 64, slice_rows: int = 1 << 20, bloom: tuple[str, ...] = (), parsed: tuple[str, ...] = ()
    ) -> StoredLog:
        """Store `rows`, which have each key once. Columns in `parsed` hold JSON texts and are stored as shredded variants too."""
        clash = {*PLACE, *[c + PARSED for c in parsed]} & set(rows.columns)
        if clash:
            raise ValueError(f"columns {sorted(clash)} are taken by the layout")
        if not set(bucket_by) <= set(keys):
            raise ValueError("buckets are made of key columns")
        about = {"keys": keys, "bucket_by": bucket_by, "buckets": buckets, "heavy": {}, "bloom": list(bloom), "parsed": list(parsed), "schema": rows.schema.jsonValue()}
        log = cls(rows.sparkSession, folder, about, 0)
        # A row for each bucket at most.
        sizes = rows.groupBy(log._bucket().alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > slice_rows).collect()
        log.heavy = about["heavy"] = {r["b"]: -(-r["n"] // slice_rows) for r in sizes}
        local_table(log.spark, [(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{folder}/about")
        log._write(rows, 0)
        return log._commit(0, log._written(0))

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: int | None = None) -> StoredLog:
        """The log at a version, or at the newest one whose write was completed."""
        versions = finished_batches(spark, f"{folder}/versions")
        if not versions or version is not None and version not in versions:
            raise FileNotFoundError(f"{folder} holds no such version")
        about = json.loads(spark.read.parquet(f"{folder}/about").first()["about"])
        return cls(spark, folder, about, max(versions) if version is None else version)

    # -- places

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*[F.col(c) for c in self.bucket_by]), F.lit(self.buckets))

    def _slice(self) -> Column:
        slices = F.lit(1)
        if self.heavy:
            slices = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in self.heavy.items() for x in pair]), F.col("bucket_")), F.lit(1))
        return F.pmod(F.hash(F.lit("slice"), *[F.col(c) for c in self.keys]), slices)

    def placed(self, rows: DataFrame) -> DataFrame:
        """`rows` with the bucket and slice each belongs to."""
        return rows.withColumn("bucket_", self._bucket()).withColumn("slice_", self._slice())

    def _place_of(self, values: dict[str, object]) -> tuple[int | None, int | None]:
        """Bucket and slice of the rows with these key values, as far as the values settle them."""
        if not set(self.bucket_by) <= set(values):
            return None, None
        named = [c for c in self.keys if c in values]
        row = local_table(self.spark, [tuple(values[c] for c in named)], T.StructType([self.schema[c] for c in named]))
        row = row.withColumn("bucket_", self._bucket())
        row = row.withColumn("slice_", self._slice() if named == self.keys else F.lit(None).cast("int")).first()
        return row["bucket_"], row["slice_"]

    # -- files

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/versions/batch={self.version}")

    def _files(self, entries: list[tuple[int, int, int]]) -> DataFrame:
        """Rows of these (bucket, slice, version), with the variants."""
        full = T.StructType([*self.schema, *[T.StructField(c + PARSED, T.VariantType()) for c in self.about["parsed"]]])
        if not entries:
            return local_table(self.spark, [], self.schema).withColumns({c + PARSED: F.try_parse_json(F.col(c)) for c in self.about["parsed"]})
        return self.spark.read.schema(full).parquet(*[f"{self.folder}/data/version={v}/bucket_={b}/slice_={s}" for b, s, v in entries])

    def _entries(self, where: Column | None = None) -> list[tuple[int, int, int]]:
        found = self.manifest() if where is None else self.manifest().where(where)
        return sorted(tuple(r) for r in found.select(*PLACE, "version").collect())

    def rows(self) -> DataFrame:
        """All rows of this version."""
        return self._files(self._entries())

    def within(self, **equals) -> DataFrame:
        """Rows that agree with these values. Only the bucket of the key columns among them is read, and only one slice if all keys are named."""
        bucket, part = self._place_of(equals)
        where = None if bucket is None else (F.col("bucket_") == bucket) if part is None else (F.col("bucket_") == bucket) & (F.col("slice_") == part)
        found = self._files(self._entries(where))
        for column, value in equals.items():
            found = found.where(F.col(column).eqNullSafe(F.lit(value).cast(self.schema[column].dataType)))
        return found

    def find(self, order_by: list[Column] | None = None, **equals) -> DataFrame:
        """At most one row that agrees with all values, the first in order."""
        return keyed_log.find_one(self.within(**equals), order_by).select(*self.schema.names)

    def find_all(self, wanted: DataFrame) -> DataFrame:
        """Rows whose keys are in `wanted`, which has all key columns; only slices that may hold one are read."""
        asked = materialize(self.placed(wanted.select(*self.keys).distinct()), "wanted")
        rows = self._files(self._touched(asked))
        return rows.join(*keyed_log._same_key(rows, asked.select(*self.keys), self.keys), "left_semi").select(*self.schema.names)

    def list(self, metadata: dict[str, object] | None = None, column: str = "metadata", **equals) -> DataFrame:
        """Rows that agree with the values and whose metadata hold the wanted fields; shredded variants are read, no text is parsed."""
        found = self.within(**equals)
        if metadata:
            stored = column in self.about["parsed"]
            found = found.where(keyed_log.metadata_equals(F.col(column + PARSED if stored else column), metadata, stored))
        return found.select(*self.schema.names)

    # -- writes

    def _touched(self, placed: DataFrame) -> list[tuple[int, int, int]]:
        """Manifest entries of the slices that these rows belong to."""
        return sorted(tuple(r) for r in self.manifest().join(placed.select(*PLACE).distinct(), PLACE).select(*PLACE, "version").collect())

    def _write(self, rows: DataFrame, version: int) -> None:
        full = rows.select(*self.schema.names).withColumns({c + PARSED: F.try_parse_json(F.col(c)) for c in self.about["parsed"]})
        laid = self.placed(full).repartition(*PLACE).sortWithinPartitions(*PLACE, *self.keys)
        writer = laid.write.partitionBy(*PLACE)
        for column in self.about["bloom"]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        conf = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"} if self.about["parsed"] else {}
        before = {name: self.spark.conf.get(name, None) for name in conf}
        for name, value in conf.items():
            self.spark.conf.set(name, value)
        try:
            writer.parquet(f"{self.folder}/data/version={version}")
        finally:
            for name, value in before.items():
                self.spark.conf.unset(name) if value is None else self.spark.conf.set(name, value)

    def _written(self, version: int) -> list[tuple[int, int, int]]:
        """What a write left: slices without rows have no folder."""
        folder, number = f"{self.folder}/data/version={version}", lambda name: int(name.partition("=")[2])
        buckets = [number(n) for n in subfolders(self.spark, folder) if n.startswith("bucket_=")]
        slices = {b: [0] if b not in self.heavy else [number(n) for n in subfolders(self.spark, f"{folder}/bucket_={b}")] for b in buckets}
        return [(b, s, version) for b in buckets for s in slices[b]]

    def _commit(self, version: int, entries: list[tuple[int, int, int]]) -> StoredLog:
        local_table(self.spark, entries, MANIFEST).coalesce(1).write.parquet(f"{self.folder}/versions/batch={version}")
        return StoredLog(self.spark, self.folder, self.about, version)

    def rewrite(self, changes: DataFrame, merge) -> StoredLog:
        """A new version, in which `merge(rows, changes)` stands for the rows of all slices that `changes` belong to. Other slices keep their files."""
        changes = materialize(changes, "changes")
        touched, version = self._touched(self.placed(changes)), self.version + 1
        if version in finished_batches(self.spark, f"{self.folder}/versions"):
            raise RuntimeError(f"version {version} was written by another writer")
        remove(self.spark, f"{self.folder}/data/version={version}")
        self._write(merge(self._files(touched).select(*self.schema.names), changes), version)
        gone = {(b, s) for b, s, _ in touched}
        kept = [e for e in self._entries() if e[:2] not in gone]
        return self._commit(version, sorted(kept + self._written(version)))

    def upsert(self, changes: DataFrame, order_by: list[Column]) -> StoredLog:
        """Changed rows replaced and new ones added; `order_by` puts the winning change of a key first."""
        winners = latest_per_key(changes, self.keys, order_by).select(*self.schema.names)
        return self.rewrite(winners, lambda rows, new: rows.join(*keyed_log._same_key(rows, new.select(*self.keys), self.keys), "left_anti").unionByName(new))

    def set_fields(self, changes: DataFrame, fields: list[str], order_by: list[Column], insert: bool = False) -> StoredLog:
        """Only `fields` of matching rows overwritten; with `insert`, other changes become new rows."""
        winners = latest_per_key(changes, self.keys, order_by).select(*self.keys, *fields)
        return self.rewrite(winners, lambda rows, new: keyed_log.set_fields(rows, new, self.keys, fields, [F.lit(0)], insert))

    def bulk_upsert(self, batches: DataFrame, order_by: list[Column]) -> StoredLog:
        """Every (channel, value) pair of every batch; the log's keys are those of a write."""
        return self.upsert(keyed_log.explode_writes(batches), order_by)

    def vacuum(self) -> None:
        """Delete files that the newest version doesn't hold. Frames of older versions become unusable."""
        newest = max(finished_batches(self.spark, f"{self.folder}/versions"))
        held = {v for _, _, v in StoredLog(self.spark, self.folder, self.about, newest)._entries()}
        for name in subfolders(self.spark, f"{self.folder}/data"):
            version = int(name.partition("=")[2])
            if version <= newest and version not in held:
                remove(self.spark, f"{self.folder}/data/{name}")
        for version in finished_batches(self.spark, f"{self.folder}/versions"):
            if version < newest:
                remove(self.spark, f"{self.folder}/versions/batch={version}")
