"""Retrieval, chunking and document-store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalogue.registry import Tables, query, rounded
from tallyloom.operators import retrieval as r
from tallyloom.operators.ranking import top_n_per_key
from tallyloom.operators.stored_vectors import VectorIndex
from tallyloom.plans import assistant
from tallyloom.scratch import new_path

_CENTROID = (
    "q AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) g(i) GROUP BY i))"
)
_L2 = "list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - q.v[i]) * (embedding[i]::DOUBLE - q.v[i])))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}::DOUBLE * {1}::DOUBLE))"
_COS = (
    f"1.0 - {_DOT.format('embedding[i]', 'q.v[i]')} / "
    f"(sqrt({_DOT.format('embedding[i]', 'embedding[i]')}) * sqrt({_DOT.format('q.v[i]', 'q.v[i]')}))"
)


def probe(t: Tables) -> list[float]:
    """The query vector: the mean of all vectors."""
    return r.centroid(t.embeddings, "embedding")


@query(f"WITH {_CENTROID} SELECT vec_id, label, round({_L2}, 6) AS distance FROM embeddings, q ORDER BY {_L2}, vec_id LIMIT 5")
def knn(t: Tables):
    hits = r.nearest(t.embeddings, probe(t), r.HITS, id_column="vec_id")
    return rounded(hits.select("vec_id", "label", "distance"), "distance")


@query(f"WITH {_CENTROID} SELECT vec_id, label, round({_COS}, 6) AS distance FROM embeddings, q ORDER BY {_COS}, vec_id LIMIT 5")
def knn_cosine(t: Tables):
    hits = r.nearest(t.embeddings, probe(t), r.HITS, id_column="vec_id", metric="cosine")
    return rounded(hits.select("vec_id", "label", "distance"), "distance")


@query(
    f"WITH {_CENTROID} SELECT vec_id, label, round({_L2}, 6) AS distance FROM embeddings, q WHERE label = (SELECT max(label) FROM embeddings) ORDER BY {_L2}, vec_id LIMIT 5"
)
def knn_filtered(t: Tables):
    label = t.embeddings.agg(F.max("label")).first()[0]
    hits = r.nearest(t.embeddings, probe(t), r.HITS, id_column="vec_id", where=F.col("label") == label)
    return rounded(hits.select("vec_id", "label", "distance"), "distance")


@query(
    f"WITH {_CENTROID} SELECT vec_id, label, round({_L2}, 6) AS distance, row_number() OVER (PARTITION BY label ORDER BY {_L2}, vec_id)::INTEGER AS rank FROM embeddings, q QUALIFY rank <= 5"
)
def knn_per_type(t: Tables):
    hits = r.nearest_per_type(t.embeddings, probe(t), r.HITS, "label", id_column="vec_id")
    return rounded(hits.select("vec_id", "label", "distance", "rank"), "distance")


@query(
    f"WITH {_CENTROID}, h AS (SELECT vec_id, row_number() OVER (ORDER BY {_L2}, vec_id)::INTEGER AS rank FROM embeddings, q QUALIFY rank <= 4) "
    "SELECT h.vec_id, h.rank, d.text, d.lang FROM h LEFT JOIN documents d ON d.doc_id = h.vec_id"
)
def few_shots(t: Tables):
    examples = t.documents.withColumnRenamed("doc_id", "vec_id")
    return r.few_shots(t.embeddings, probe(t), examples, id_column="vec_id").select("vec_id", "rank", "text", "lang")


@query(
    f"WITH {_CENTROID}, h AS (SELECT vec_id, row_number() OVER (ORDER BY {_L2}, vec_id) AS rank FROM embeddings, q QUALIFY rank <= 4), "
    "c AS (SELECT coalesce(string_agg(d.text, chr(10) || chr(10) ORDER BY h.rank), '') AS context FROM h JOIN documents d ON d.doc_id = h.vec_id) "
    "SELECT context, 'Question: what is this?' || chr(10) || 'Context: ' || context AS answer FROM c"
)
def retrieval_answer(t: Tables):
    """Context of the nearest documents put into a prompt; the model hands the prompt back."""
    examples = t.documents.withColumnRenamed("doc_id", "vec_id")
    hits = r.few_shots(t.embeddings, probe(t), examples, id_column="vec_id")
    return r.answer(
        hits, "what is this?",
        prompt=lambda context, question: F.concat(F.lit("Question: "), question, F.lit("\nContext: "), context),
        model=lambda text: text,
    )


def store(t: Tables):
    """Documents as a store: id, text, and metadata with the document type."""
    metadata = F.create_map(F.lit("doc_type"), F.col("lang"), F.lit("source"), F.col("source"))
    return t.documents.select(F.col("doc_id").alias("id"), "text", metadata.alias("metadata"))


@query("SELECT doc_id::VARCHAR AS id, lang AS doc_type, source FROM documents")
def list_documents(t: Tables):
    return r.list_documents(store(t)).select("id", "doc_type", F.col("metadata")["source"].alias("source"))


@query("SELECT doc_id::VARCHAR AS id, lang AS doc_type, source FROM documents WHERE lang = 'de'")
def list_documents_of_type(t: Tables):
    return r.list_documents(store(t), "de").select("id", "doc_type", F.col("metadata")["source"].alias("source"))


@query("SELECT doc_id AS id, text AS content, lang AS doc_type FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def load_document(t: Tables):
    newest = t.documents.agg(F.max("doc_id")).first()[0]
    return r.load_document(store(t), newest).select(F.lit(newest).cast("long").alias("id"), "content", "doc_type")


@query("SELECT doc_id AS id, text AS content, lang AS doc_type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def load_documents(t: Tables):
    return r.load_documents(store(t), t.labels.select(F.col("doc_id").alias("id"))).select("id", "content", "doc_type")


_SPACED = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"
_CHUNKS = f"""
WITH f AS (
  SELECT doc_id, list_reduce(list_transform({_SPACED}, lambda x: {{'done': '', 'cur': x}}),
    lambda a, b: CASE WHEN length(a.cur) + 2 + length(b.cur) <= 1000 THEN {{'done': a.done, 'cur': a.cur || chr(10) || chr(10) || b.cur}}
                      ELSE {{'done': a.done || a.cur || chr(30), 'cur': b.cur}} END) AS s
  FROM documents WHERE len({_SPACED}) > 0),
c AS (SELECT doc_id, list_filter(list_transform(string_split(s.done || s.cur, chr(30)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS chunks FROM f)
"""


@query(_CHUNKS + "SELECT doc_id, i - 1 AS chunk_no, chunks[i] AS chunk FROM c, LATERAL (SELECT unnest(range(1, len(chunks) + 1))::INTEGER AS i)")
def chunk_documents(t: Tables):
    """Paragraph chunks of texts whose lines are paragraphs."""
    spaced = t.spread("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return r.chunk_documents(spaced, overlap=False)


@query()
def chunk_documents_with_overlap(t: Tables):
    return r.chunk_documents(t.spread("documents").select("doc_id", "text"), overlap=True)


@query(
    _CHUNKS + "SELECT doc_id || '-' || (i - 1) AS id, chunks[i] AS text, length(chunks[i])::DOUBLE AS size, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'own' END AS doc_type "
    "FROM c JOIN documents USING (doc_id), LATERAL (SELECT unnest(range(1, len(chunks) + 1))::INTEGER AS i)"
)
def add_documents(t: Tables):
    """Chunked, tagged vector rows; the stand-in model embeds a text as its length."""
    own = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("b"))).otherwise(F.create_map(F.lit("doc_type"), F.lit("own")))
    docs = t.spread("documents").select(
        F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.col("lang").alias("doc_type"), own.alias("metadata")
    )
    rows = r.add_documents(docs, lambda text: F.array(F.length(text).cast("float")))
    return rows.select("id", "text", F.get("embedding", F.lit(0)).cast("double").alias("size"), F.col("metadata")["doc_type"].alias("doc_type"))


def memory_items(t: Tables):
    """Events as memories of their users."""
    text = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    return t.events.select(F.col("user_id").alias("owner"), F.col("value").cast("double").alias("importance"), F.col("event_id").alias("seq"), text.alias("text"))


_ITEMS = "i AS (SELECT user_id AS owner, value::DOUBLE AS importance, event_id AS seq, event_type || ' ' || event_id AS text FROM events), last AS (SELECT owner, max(seq) AS last FROM i GROUP BY owner)"
_KEPT = "SELECT owner, importance, seq, text FROM (SELECT owner, importance, seq, text FROM i UNION ALL SELECT owner, importance, seq, text FROM n) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY importance DESC, seq) <= 5"


@query(
    f"WITH {_CENTROID}, {_ITEMS}, "
    f"h AS (SELECT vec_id, row_number() OVER (ORDER BY {_L2}, vec_id) AS rank FROM embeddings, q WHERE label = (SELECT max(label) FROM embeddings) QUALIFY rank <= 5), "
    "c AS (SELECT coalesce(string_agg(d.text, chr(10) || chr(10) ORDER BY h.rank), '') AS context FROM h JOIN documents d ON d.doc_id = h.vec_id), "
    "m AS (SELECT owner, string_agg(text, chr(10) ORDER BY importance DESC, seq) AS memories FROM (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY owner ORDER BY importance DESC, seq) <= 5) GROUP BY owner), "
    "a AS (SELECT owner, length(context || 'Context: ' || memories || chr(10) || chr(10) || 'Question: what next?') AS answer FROM m, c), "
    "n AS (SELECT owner, 1.0::DOUBLE AS importance, last + 1 AS seq, 'Q: what next?' || chr(10) || 'A: ' || answer AS text FROM a JOIN last USING (owner)) " + _KEPT
)
def answered_from_memory(t: Tables):
    """Every user's question with memories and retrieved documents of one label, and the memory after the answer; the model says how long its prompt is."""
    label = t.embeddings.agg(F.max("label")).first()[0]
    documents = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    model = lambda context, question: F.length(F.concat(context, question)).cast("string")
    _, memory = assistant.ask(memory_items(t), t.embeddings, documents, probe(t), "what next?", model, where=F.col("label") == label, id_column="vec_id")
    return memory


@query(
    f"WITH {_ITEMS}, "
    "e AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS task, o_orderpriority AS code, o_orderdate::VARCHAR AS result FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1), "
    "n AS (SELECT e.owner, 2.0::DOUBLE AS importance, coalesce(last, -1) + 1 AS seq, 'Task: ' || task || chr(10) || 'Result Summary: ' || task || code AS text FROM e LEFT JOIN last USING (owner)), "
    f"k AS ({_KEPT}) "
    "SELECT 'row' AS kind, id AS owner, task || code AS text, NULL::DOUBLE AS number FROM e UNION ALL SELECT 'vector', id, task, length(task)::DOUBLE FROM e UNION ALL SELECT 'memory', owner, text, importance FROM k"
)
def added_examples(t: Tables):
    """A finished task per customer: its row, its vector under the same id, and what is remembered."""
    first = top_n_per_key(t.orders, ["o_custkey"], [F.asc("o_orderkey")], 1, rank="place")
    done = first.select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("task"),
        F.col("o_orderpriority").alias("code"), F.col("o_orderdate").cast("string").alias("result"),
    )
    rows, vectors, memory = assistant.add_examples(memory_items(t), done, lambda task, code, _: F.concat(task, code), lambda task: F.array(F.length(task).cast("float")))
    listed = rows.select(F.lit("row").alias("kind"), F.col("id").alias("owner"), F.concat("task", "code").alias("text"), F.lit(None).cast("double").alias("number"))
    listed = listed.unionByName(vectors.select(F.lit("vector").alias("kind"), F.col("id").alias("owner"), "text", F.get("embedding", F.lit(0)).cast("double").alias("number")))
    return listed.unionByName(memory.select(F.lit("memory").alias("kind"), "owner", "text", F.col("importance").alias("number")))


def vector_index(t: Tables, metric: str = "l2") -> VectorIndex:
    return VectorIndex.create(t.embeddings, new_path(t.spark, "vectors"), id_column="vec_id", metric=metric)


@query(f"WITH {_CENTROID} SELECT vec_id, label, round({_L2}, 6) AS distance FROM embeddings, q ORDER BY {_L2}, vec_id LIMIT 5")
def stored_knn(t: Tables):
    return rounded(vector_index(t).nearest(probe(t), r.HITS).select("vec_id", "label", "distance"), "distance")


@query(f"WITH {_CENTROID} SELECT vec_id, label, round({_COS}, 6) AS distance FROM embeddings, q ORDER BY {_COS}, vec_id LIMIT 5")
def stored_knn_cosine(t: Tables):
    return rounded(vector_index(t, "cosine").nearest(probe(t), r.HITS).select("vec_id", "label", "distance"), "distance")


@query(
    f"WITH {_CENTROID} SELECT vec_id, label, round({_L2}, 6) AS distance FROM embeddings, q WHERE label = (SELECT max(label) FROM embeddings) ORDER BY {_L2}, vec_id LIMIT 5"
)
def stored_knn_filtered(t: Tables):
    label = t.embeddings.agg(F.max("label")).first()[0]
    return rounded(vector_index(t).nearest(probe(t), r.HITS, F.col("label") == label).select("vec_id", "label", "distance"), "distance")


@query(
    "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance "
    "FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) "
    "SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM p QUALIFY rank <= 4"
)
def few_shots_for_each(t: Tables):
    """The examples nearest to each of many tasks: every row whose id is divisible by 50 asks, all rows answer."""
    tasks = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vector_index(t).nearest_to_each(tasks, r.SHOTS), "distance")
