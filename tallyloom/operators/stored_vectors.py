"""Exact nearest neighbours over vectors stored in clusters, of which a search reads only those that can hold a hit.

Layout of a folder:

- `about`: one row with the settings and the schema; `centres`: the centre of each cluster.
- `data/version=V/cluster_=C/ring_=R`: Parquet files, sorted by the distance of a vector to its centre.
- `entries/batch=V`: for each ring of version V its rows and its least and greatest distance to the centre.

By the triangle inequality a vector at distance r of a centre is at least |d - r| from a query at distance d of it. A search visits
rings in the order of that bound and stops when the k-th distance found is below the bound of all others, so it gives the rows of a
full scan. Centres come from k-means on at most FIT_ROWS rows; every row is stored, and any centres give the same result.
An append adds files and then its entries, which count only with the mark of a completed write.

Defined cases: a vector that is null, of another length than the centres, or holds null, NaN or infinity (with cosine also a zero
vector) is no hit and is not stored. Distances that are equal go by the lower id. Fewer than k rows: all of them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.vectors import METRICS, vector
from tallyloom.local import local_table
from tallyloom.operators.ranking import top_n, top_n_per_key
from tallyloom.scratch import finished_batches, materialize, remove

#: Rows from which centres are made, greatest number of clusters, and rows of a ring.
FIT_ROWS, MAX_CLUSTERS, RING_ROWS = 100_000, 4096, 1 << 18
#: Queries and stored vectors of a block; two blocks are compared at once.
QUERY_BLOCK, ROW_BLOCK = 1024, 2048
#: Room for rounding in bounds, as a share of the distances they are made of.
SLACK = 1e-6
_PLACE = [T.StructField("cluster_", T.IntegerType()), T.StructField("from_centre_", T.DoubleType())]
_ENTRY = ["version", "cluster_", "ring_"]


def _usable(embedding: Column, dim: int, metric: str) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    kept = (F.size(embedding) == dim) & ~bad
    return F.coalesce(kept & F.exists(embedding, lambda x: x != 0) if metric == "cosine" else kept, F.lit(False))


def _points(column: pa.ChunkedArray | pa.Array, dim: int, metric: str) -> np.ndarray:
    """Vectors of one length as rows; of length one where cosine counts."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of every row of `x` to every centre, without the loss that a difference of squares has."""
    return np.stack([np.linalg.norm(x - c, axis=1) for c in centres], axis=1)


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row a centre that is nearest, up to rounding, and the distance to that centre."""
    own = np.empty(len(x), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), 1024):
        own[at : at + 1024] = (half - x[at : at + 1024] @ centres.T).argmin(axis=1)
    return own, np.linalg.norm(x - centres[own], axis=1)


def _exact(x: np.ndarray, q: np.ndarray, row: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """The metric of pairs (x[row], q[query]), summed in the order in which `METRICS` sums."""

    def total(a: np.ndarray, b: np.ndarray, term) -> np.ndarray:
        out = np.zeros(len(a) if b is a else len(row))
        for j in range(x.shape[1]):
            out += term(a[:, j], b[:, j]) if b is a else term(a[row, j], b[query, j])
        return out

    if metric == "l2":
        return total(x, q, lambda a, b: (a - b) * (a - b))
    norm = lambda a: np.sqrt(total(a, a, np.multiply))
    return 1.0 - total(x, q, np.multiply) / (norm(x)[row] * norm(q)[query])


def _best(x: np.ndarray, q: np.ndarray, centre: np.ndarray, bound: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): for every query its k nearest rows of those within its bound, in the order of distance and row.

    A product of matrices, taken from the centre of the rows, leaves out what is too far for certain; the rest is measured one by one.
    """
    unit = (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)) if metric == "cosine" else (lambda v: v)
    xs, qs = unit(x) - centre, unit(q) - centre
    long, wide = (xs * xs).sum(axis=1), (qs * qs).sum(axis=1)
    apart = wide[:, None] + long - 2 * (qs @ xs.T)
    room = 1e-14 * (x.shape[1] + 8) * (wide + long.max() + (metric == "cosine"))
    least = bound * bound + room
    if len(x) > k:
        # What isn't a number is measured.
        full = np.flatnonzero((~(apart > least[:, None])).sum(axis=1) > k)
        if len(full):
            least[full] = np.fmin(least[full], np.partition(apart[full], k - 1, axis=1)[:, k - 1] + 2 * room[full])
    query, row = np.nonzero(~(apart > least[:, None]))
    distance = _exact(x, q, row, query, metric)
    # Rows are in the order of their ids.
    order = np.lexsort((row, distance, query))
    query, row, distance = query[order], row[order], distance[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[first], row[first], distance[first]


class VectorIndex:
    """Stored vectors opened with all versions that are complete."""

    def __init__(self, spark: SparkSession, folder: str, about: dict, centres: np.ndarray, versions: list[int]):
        self.spark, self.folder, self.about, self.centres, self.versions = spark, folder, about, centres, versions
        self.schema = T.StructType.fromJson(about["schema"])
        self.id, self.embedding, self.metric, self.dim = about["id"], about["embedding"], about["metric"], about["dim"]

    @classmethod
    def create(
        cls, rows: DataFrame, folder: str, *, id_column: str = "id", embedding: str = "embedding", metric: str = "l2", clusters: int | None = None, ring_rows: int = RING_ROWS
    ) -> VectorIndex:
        """Store `rows`. The length of the vectors is the most frequent one; `clusters` is by default the root of the number of rows."""
        if clash := {*_ENTRY, "from_centre_"} & set(rows.columns):
            raise ValueError(f"columns {sorted(clash)} are taken by the layout")
        sizes = rows.where(F.col(embedding).isNotNull()).groupBy(F.size(embedding).alias("dim")).count()
        common = top_n(sizes, [F.desc("count"), F.asc("dim")], 1).first()
        dim = common["dim"] if common else 0
        about = {"id": id_column, "embedding": embedding, "metric": metric, "dim": dim, "ring_rows": ring_rows, "schema": rows.schema.jsonValue()}
        usable = rows.where(_usable(F.col(embedding), dim, metric))
        n = common["count"] if common else 0
        wanted = min(clusters or math.isqrt(n) or 1, MAX_CLUSTERS)
        centres = cls._fitted(usable, n, wanted, about)
        local_table(rows.sparkSession, [(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{folder}/about")
        local_table(rows.sparkSession, list(enumerate(centres.tolist())), "cluster int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        return cls(rows.sparkSession, folder, about, centres, []).append(rows)

    @staticmethod
    def _fitted(usable: DataFrame, n: int, clusters: int, about: dict) -> np.ndarray:
        values = F.col(about["embedding"]).cast("array<double>")
        if about["metric"] == "cosine":
            length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))
            values = F.transform(values, lambda x: x / length)
        drawn = usable.where(F.pmod(F.xxhash64(about["id"]), F.lit(max(1, -(-n // FIT_ROWS)))) == 0)
        # Copies would draw several centres to one place.
        drawn = materialize(drawn.select(values.alias("values")).distinct().select(array_to_vector("values").alias("features")), "fitted")
        if not about["dim"] or drawn.isEmpty():
            return np.zeros((1, about["dim"]))
        model = KMeans(k=clusters, maxIter=5, initSteps=2, seed=1).fit(drawn) if clusters > 1 else None
        return np.array(model.clusterCenters()) if model else np.zeros((1, about["dim"]))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        versions = finished_batches(spark, f"{folder}/entries")
        if not versions:
            raise FileNotFoundError(f"{folder} holds no complete version")
        about = json.loads(spark.read.parquet(f"{folder}/about").first()["about"])
        centres = [r["centre"] for r in spark.read.parquet(f"{folder}/centres").orderBy("cluster").collect()]
        return cls(spark, folder, about, np.array(centres, float).reshape(len(centres), about["dim"]), sorted(versions))

    # -- writes

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Usable rows with their nearest centre and the distance to it."""
        centres, dim, metric, embedding = self.centres, self.dim, self.metric, self.embedding

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, apart = _nearest_centre(_points(batch.column(embedding), dim, metric), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(apart)], names=[*batch.schema.names, "cluster_", "from_centre_"])

        usable = rows.select(*self.schema.names).where(_usable(F.col(embedding), dim, metric))
        return usable.mapInArrow(place, T.StructType([*self.schema, *_PLACE]))

    def append(self, rows: DataFrame) -> VectorIndex:
        """The index with further rows. Files that are there stay as they are."""
        version = max(self.versions, default=-1) + 1
        if version in finished_batches(self.spark, f"{self.folder}/entries"):
            raise RuntimeError(f"version {version} was written by another writer")
        folder = f"{self.folder}/data/version={version}"
        remove(self.spark, folder)
        placed = materialize(self._placed(rows), "placed")
        # Rings hold about as many rows each; a row for each cluster, of which there are MAX_CLUSTERS at most.
        cuts = placed.groupBy("cluster_").agg(F.count("*").alias("n"), F.percentile_approx("from_centre_", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
        step = F.greatest(F.lit(1), F.lit(64) / F.greatest(F.lit(1.0), F.ceil(F.col("n") / self.about["ring_rows"]))).cast("int")
        cuts = cuts.select(F.col("cluster_").alias("c_"), F.filter("cuts", lambda _x, i: (i + 1) % step == 0).alias("cuts"))
        ringed = placed.join(F.broadcast(cuts), F.col("cluster_") == F.col("c_")).withColumn("ring_", F.size(F.filter("cuts", lambda x: x < F.col("from_centre_")))).drop("c_", "cuts")
        order = ["cluster_", "ring_", "from_centre_"]
        # By range and not by key, so that a large cluster, or a third of all rows at one place, is written by several tasks.
        ringed.repartitionByRange(*order, F.xxhash64(self.id)).sortWithinPartitions(*order).write.partitionBy("cluster_", "ring_").parquet(folder)
        entries = ringed.groupBy("cluster_", "ring_").agg(F.count("*").alias("n"), F.min("from_centre_").alias("low"), F.max("from_centre_").alias("high"))
        entries.coalesce(1).write.parquet(f"{self.folder}/entries/batch={version}")
        return VectorIndex(self.spark, self.folder, self.about, self.centres, [*self.versions, version])

    # -- searches

    def _entries(self) -> dict[str, np.ndarray]:
        """All rings: a row for some RING_ROWS vectors each."""
        found = [self.spark.read.parquet(f"{self.folder}/entries/batch={v}").withColumn("version", F.lit(v)) for v in self.versions]
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        table = whole.select(*_ENTRY, "n", "low", "high").toArrow()
        return {name: table.column(name).to_numpy() for name in table.column_names}

    def _rings(self, entries: dict[str, np.ndarray], chosen: np.ndarray) -> DataFrame:
        """Rows of some rings."""
        schema = T.StructType([*self.schema, _PLACE[1]])
        if not len(chosen):
            return local_table(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/version={v}/cluster_={c}/ring_={r}" for v, c, r in zip(*(entries[name][chosen] for name in _ENTRY))])

    def _reach(self, distance: float) -> float:
        """How far apart points are at this value of the metric, with room for rounding."""
        apart = math.sqrt(max(0.0, 2 * distance if self.metric == "cosine" else distance))
        return apart * (1 + SLACK) + SLACK

    def _scored(self, rows: DataFrame, query: list[float], where: Column | None) -> DataFrame:
        pool = rows if where is None else rows.where(where)
        return pool.withColumn("distance", METRICS[self.metric](F.col(self.embedding), vector(query)))

    def nearest(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """The k rows closest to `query` of those that meet the condition, with their `distance`. The driver sees k distances a round."""
        point = np.array(query, float)
        if len(point) != self.dim:
            raise ValueError(f"vectors have {self.dim} components")
        entries = self._entries()
        point = point / np.linalg.norm(point) if self.metric == "cosine" else point
        d = np.linalg.norm(self.centres - point, axis=1)[entries["cluster_"]]
        least = np.maximum(0, np.maximum(d - entries["high"], entries["low"] - d)) - SLACK * (d + entries["high"])
        order = np.lexsort((d, least))
        best: list[float] = []
        bound, at, size = math.inf, 0, 4
        while at < len(order) and least[order[at]] <= bound:
            part = order[at : at + size]
            scored = self._scored(self._rings(entries, part[least[part] <= bound]), query, where).select("distance", self.id)
            best = sorted(best + [r["distance"] for r in top_n(scored, [F.asc("distance"), F.asc(self.id)], k).collect()])[:k]
            bound = self._reach(best[-1]) if len(best) == k else math.inf
            at, size = at + size, size * 4
        chosen = np.flatnonzero(least <= bound)
        rows = self._rings(entries, chosen)
        if math.isfinite(bound) and len(chosen):
            rows = rows.where(F.col("from_centre_").between(float((d[chosen] - bound).min() * (1 - SLACK) - SLACK), float((d[chosen] + bound).max() * (1 + SLACK))))
        return top_n(self._scored(rows, query, where), [F.asc("distance"), F.asc(self.id)], k).select(*self.schema.names, "distance")

    def nearest_to_each(self, queries: DataFrame, k: int, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """(query id, id, rank, distance): the k rows closest to every query. Query ids are unique; a query whose vector is not usable has no hits.

        Queries that lie together make a block. A block is first compared with the rings that surely hold k rows and lie nearest to one of its
        queries, which bounds every query's k-th distance, and then with the rings that one of these bounds meets. Blocks of queries and of
        stored vectors are compared by a product of matrices, and what it leaves is measured: at most k rows of a block for a query.
        """
        entries, centres, dim, metric = self._entries(), self.centres, self.dim, self.metric
        own_id, own_embedding = self.id, self.embedding
        asked = queries.select(F.col(query_id).alias("query_"), F.col(embedding).cast("array<double>").alias("point_"))
        asked = asked.where(_usable(F.col("point_"), dim, metric))
        query_kind, id_kind = asked.schema["query_"].dataType.simpleString(), self.schema[own_id].dataType.simpleString()
        numbers = lambda raw, kind=float: np.frombuffer(raw, kind).reshape(-1, dim).astype(float)
        own_kind = np.float32 if isinstance(self.schema[own_embedding].dataType.elementType, T.FloatType) else float

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, _ = _nearest_centre(_points(batch.column("point_"), dim, metric), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=["query_", "point_", "cluster_"])

        def query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for whole in batches:
                for first in range(0, whole.num_rows, QUERY_BLOCK):
                    batch = whole.slice(first, QUERY_BLOCK)
                    x = batch.column("point_").flatten().to_numpy(zero_copy_only=False)
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("query_")), pa.array([x.tobytes()]), pa.array([[math.inf] * n])],
                        names=["block_", "queries_", "points_", "bounds_"],
                    )
                    number += 1

        def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.stack([batch.column(f"r_{c}").to_numpy() for c in _ENTRY])
                starts = np.append(np.flatnonzero(np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0))) if batch.num_rows else [], batch.num_rows)
                for begin, end in zip(starts[:-1].astype(int).tolist(), starts[1:].astype(int).tolist()):
                    for first in range(begin, end, ROW_BLOCK):
                        part = batch.slice(first, min(ROW_BLOCK, end - first))
                        # In the order of ids, as equal distances go by the lower id.
                        part = part.take(pc.sort_indices(part.column("id_"), null_placement="at_start"))
                        x = part.column("vector_").flatten().to_numpy(zero_copy_only=False).astype(own_kind)
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.array([int(at)], pa.int32()) for at in place[:, first]], pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id_")), pa.array([x.tobytes()])],
                            names=[*[f"r_{c}" for c in _ENTRY], "ids_", "vectors_"],
                        )

        def meets(batches: Iterator[pa.RecordBatch], bounded: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of queries and the rings that they are compared with."""
            for batch in batches:
                for block, points, bounds in zip(*(batch.column(c).to_pylist() for c in ("block_", "points_", "bounds_"))):
                    q, bound = numbers(points), np.array(bounds)
                    q = q / np.linalg.norm(q, axis=1, keepdims=True) if metric == "cosine" else q
                    chosen = np.zeros(len(entries["n"]), bool)
                    for at in range(0, len(q), 128):
                        d = _apart(q[at : at + 128], centres)[:, entries["cluster_"]]
                        room = SLACK * (d + entries["high"])
                        if bounded:
                            chosen |= (np.maximum(d - entries["high"], entries["low"] - d) - room <= bound[at : at + 128, None]).any(axis=0)
                        else:
                            order = np.argsort(d + entries["high"] + room, axis=1, kind="stable")
                            before = np.cumsum(entries["n"][order], axis=1) - entries["n"][order]
                            chosen[order[before < k]] = True
                    chosen = np.flatnonzero(chosen)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), block)), *[pa.array(entries[c][chosen], pa.int32()) for c in _ENTRY]], names=["m_block_", *_ENTRY])

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    of = {c: batch.column(c)[i] for c in batch.schema.names}
                    query, row, distance = _best(
                        numbers(of["vectors_"].as_py(), own_kind), numbers(of["points_"].as_py()), centres[of["r_cluster_"].as_py()], np.array(of["bounds_"].as_py()), k, metric
                    )
                    yield pa.RecordBatch.from_arrays([of["queries_"].values.take(pa.array(query)), of["ids_"].values.take(pa.array(row)), pa.array(distance)], names=["query_", "id_", "distance"])

        data = f"{self.folder}/data"
        paths = [f"{data}/version={v}" for v in self.versions]
        stored = T.StructType([self.schema[own_id], self.schema[own_embedding], *[T.StructField(c, T.IntegerType()) for c in _ENTRY]])
        rows = self.spark.read.schema(stored).option("basePath", data).parquet(*paths) if len(entries["n"]) else local_table(self.spark, [], stored)
        rows = rows.select(F.col(own_id).alias("id_"), F.col(own_embedding).alias("vector_"), *[F.col(c).alias(f"r_{c}") for c in _ENTRY])
        rows = rows.mapInArrow(row_blocks, ", ".join([*[f"r_{c} int" for c in _ENTRY], f"ids_ array<{id_kind}>", "vectors_ binary"]))

        def hits(blocks: DataFrame, bounded: bool) -> DataFrame:
            # Numbers of blocks and rings only, which is little; blocks go to it and not along with every ring.
            pairs = blocks.select("block_", "points_", "bounds_").mapInArrow(lambda batches: meets(batches, bounded), ", ".join(["m_block_ long", *[f"{c} int" for c in _ENTRY]]))
            pairs = materialize(pairs, "pairs")
            on = F.lit(True)
            for c in _ENTRY:
                on &= F.col(c) == F.col(f"r_{c}")
            met = rows.join(pairs, on).join(blocks, F.col("m_block_") == F.col("block_")).select("r_cluster_", "ids_", "vectors_", "queries_", "points_", "bounds_")
            found = met.mapInArrow(compared, f"query_ {query_kind}, id_ {id_kind}, distance double")
            return top_n_per_key(found, ["query_"], [F.asc("distance"), F.asc("id_")], k, rank="rank")

        lying = asked.mapInArrow(placed, f"query_ {query_kind}, point_ array<double>, cluster_ int").repartitionByRange("cluster_").sortWithinPartitions("cluster_")
        blocks = lying.select("query_", "point_").mapInArrow(query_blocks, f"block_ long, queries_ array<{query_kind}>, points_ binary, bounds_ array<double>")
        # Numbers of blocks hold as they are stored here once.
        blocks = materialize(blocks, "queries")
        last = hits(blocks, False).groupBy("query_").agg(F.max("distance").alias("last"), F.count("*").alias("n"))
        apart = F.sqrt(F.greatest(F.lit(0.0), F.col("last") * (2 if metric == "cosine" else 1))) * (1 + SLACK) + SLACK
        bounds = last.select(F.col("query_").alias("q_"), F.when(F.col("n") == k, apart).alias("bound_"))
        each = blocks.select(F.col("block_").alias("b_"), F.posexplode("queries_").alias("i", "query_")).join(bounds, F.col("query_").eqNullSafe(F.col("q_")), "left")
        of_block = each.groupBy("b_").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("bound_", F.lit(math.inf)).alias("bound")))).getField("bound").alias("bounds_"))
        # Read and joined once more by a plan of its own, so the bounds are stored.
        bounded = materialize(blocks.drop("bounds_").join(of_block, F.col("block_") == F.col("b_")).select(*blocks.columns), "bounds")
        found = hits(bounded, True)
        return found.select(F.col("query_").alias(query_id), F.col("id_").alias(self.id), "rank", "distance")
