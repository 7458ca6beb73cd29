"""Exact nearest-neighbour search, lookups and document listing.

A search scans the vectors once with the query as a literal; each task keeps k
rows, so nothing but k rows per task is shuffled and no pair is materialised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.chunks import chunk_rows, overlapping_chunks, paragraph_chunks
from tallyloom.functions.text import join_blocks, override
from tallyloom.functions.vectors import METRICS, vector
from tallyloom.local import local_table
from tallyloom.operators.ranking import top_n, top_n_per_key

SHOTS = 4
HITS = 5


def centroid(vectors: DataFrame, embedding: str) -> list[float]:
    """Mean vector of a table: one partial sum per dimension and task."""
    places = vectors.select(F.posexplode(embedding).alias("place", "x"))
    means = places.groupBy("place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return [row.mean for row in means.orderBy("place").collect()]


def nearest(
    vectors: DataFrame, query: list[float], k: int, *, id_column: str = "id", where: Column | None = None, metric: str = "l2"
) -> DataFrame:
    """The k rows closest to `query`, filtered before ranking; ties go to the lower id. Adds `distance`."""
    pool = vectors if where is None else vectors.where(where)
    scored = pool.withColumn("distance", METRICS[metric](F.col("embedding"), vector(query)))
    return top_n(scored, [F.asc("distance"), F.asc(id_column)], k)


def nearest_per_type(
    vectors: DataFrame, query: list[float], k: int, doc_type: str, *, id_column: str = "id", metric: str = "l2"
) -> DataFrame:
    """The filtered search for every document type in one pass; adds `rank` and `distance`."""
    scored = vectors.withColumn("distance", METRICS[metric](F.col("embedding"), vector(query)))
    return top_n_per_key(scored, [doc_type], [F.asc("distance"), F.asc(id_column)], k, rank="rank")


def ranked(hits: DataFrame) -> DataFrame:
    """A search result with its 1-based rank, fetched once: k rows, kept as a local table so the search is not run again."""
    rows = [(*row, i) for i, row in enumerate(hits.collect(), start=1)]
    return local_table(hits.sparkSession, rows, T.StructType([*hits.schema.fields, T.StructField("rank", T.IntegerType())]))


def look_up(hits: DataFrame, documents: DataFrame, on: str) -> DataFrame:
    """Rows of `documents` for ranked hits, hits without one kept. The k ids go to the scan as a filter."""
    ids = [row[on] for row in hits.select(on).collect()]
    return hits.join(documents.where(F.col(on).isin(ids)), on, "left")


def few_shots(vectors: DataFrame, query: list[float], examples: DataFrame, n: int = SHOTS, id_column: str = "id") -> DataFrame:
    """Examples behind the n nearest vectors, in rank order."""
    hits = ranked(nearest(vectors, query, n, id_column=id_column).select(id_column, "distance"))
    return look_up(hits, examples, id_column).orderBy("rank")


def load_document(store: DataFrame, doc_id) -> DataFrame:
    """Content, type and metadata of one document; no row when it is missing."""
    return store.where(F.col("id") == doc_id).limit(1).select(F.col("text").alias("content"), *_described())


def load_documents(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The same lookup for a table of ids."""
    found = store.select("id", F.col("text").alias("content"), *_described())
    return ids.select("id").distinct().join(found, "id")


def _described() -> list[Column]:
    return [F.col("metadata")["doc_type"].alias("doc_type"), F.col("metadata")]


def list_documents(store: DataFrame, doc_type: str | None = None, limit: int | None = None) -> DataFrame:
    """All documents by id, or the first `limit`, with empty text for a missing id or type."""
    pool = store if doc_type is None else store.where(F.col("metadata")["doc_type"] == doc_type)
    blank = F.lit("")
    listed = pool.orderBy("id") if limit is None else top_n(pool, [F.asc("id")], limit)
    return listed.select(
        F.coalesce(F.col("id").cast("string"), blank).alias("id"),
        F.coalesce(F.col("metadata")["doc_type"], blank).alias("doc_type"),
        "metadata",
    )


def chunk_documents(documents: DataFrame, text: str = "text", *, overlap: bool) -> DataFrame:
    """One row per chunk with its position: nested separators with an overlap, or paragraphs without."""
    return chunk_rows(documents, text, overlapping_chunks if overlap else paragraph_chunks)


def tag_document(metadata: Column, doc_type: Column) -> Column:
    """Caller metadata with the document type set; the caller's entries win."""
    return override(F.create_map(F.lit("doc_type"), doc_type), metadata)


def add_documents(documents: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Vector-table rows (id, text, embedding, metadata) for whole documents (id, text, doc_type, metadata).

    `embed` is the caller's model as a column function.
    """
    tagged = documents.withColumn("metadata", tag_document(F.col("metadata"), F.col("doc_type"))).drop("doc_type")
    chunks = chunk_documents(tagged, overlap=False)
    key = F.concat_ws("-", F.col("id").cast("string"), F.col("chunk_no").cast("string"))
    return chunks.select(key.alias("id"), F.col("chunk").alias("text"), embed(F.col("chunk")).alias("embedding"), "metadata")


def answer(
    hits: DataFrame, question: str, prompt: Callable[[Column, Column], Column], model: Callable[[Column], Column]
) -> DataFrame:
    """Context of k ranked hits joined in order, put into a prompt and given to the caller's model."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"])
    context = hits.agg(join_blocks(texts).alias("context"))
    return context.select("context", model(prompt(F.col("context"), F.lit(question))).alias("answer"))
