"""Named queries over the shared tables: opN_<name> and pipeline, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm import quality

    judged = quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


@_query
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.near_duplicates import near_duplicates

    return near_duplicates(_table(spark, folder, "documents")).select("doc_id", "class_id", "group_id", "kept")


@_query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.lines import drop_repeated_lines

    cleaned = drop_repeated_lines(_table(spark, folder, "documents"))
    return cleaned.select("doc_id", "text", F.col("lines_dropped_").alias("lines_dropped"))


@_query
def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.mixture import mix

    return mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "uses")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.bpe import encode

    found = encode(_table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())
    return found.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op9_token_records(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm import records
    from tallyloom.llm.bpe import encode_in_place

    place = records.new_folder(spark)
    encoded = encode_in_place(records.in_order(_table(spark, folder, "documents")), tokenizer_path())
    files = records.write_sequences(encoded, place, end_id=1)
    found = records.read_sequences(files, place)
    return found.select(F.col("id").alias("doc_id"), "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm import personal_data as pd

    found = pd.personal_data(_table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(pd.BASE))
    of_rank = lambda rank: F.filter("spans", lambda s: s["rank"] == rank)
    counts = [F.size(of_rank(rank)).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(pd.BASE)]
    return found.select("doc_id", *counts, F.sha2(pd.listed(base).cast("binary"), 256).alias("base_sha256"), pd.listed(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))


@_query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.licenses import scan

    found = scan(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@_query
def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.embeddings import near_vectors

    return near_vectors(_table(spark, folder, "embeddings"))


@_query
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.html_extraction import extract

    return extract(_table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@_query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.prefix_trie import conversation_trie

    return conversation_trie(_table(spark, folder, "conversations"))


SQL["op12_prefix_trie"] = """
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, CAST(c AS VARCHAR) AS s FROM turns GROUP BY c
), crc(c, i, bit, r) AS (
  SELECT c, 1, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT c, CASE WHEN bit = 8 THEN i + 1 ELSE i END, (bit + 1) % 9,
         CASE WHEN bit = 0 THEN xor(r, CAST(ascii(substr(s, i, 1)) AS BIGINT))
              ELSE xor(r // 2, CASE WHEN r % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) END
  FROM crc JOIN ids USING (c) WHERE i <= length(s)
), heads AS (
  SELECT c, xor(max_by(r, i * 10 + bit), CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc GROUP BY c
), rebuilt AS (
  SELECT heads.c, pos, role, text FROM heads JOIN turns ON turns.c = heads.c - heads.c % 5 WHERE pos < h
  UNION ALL
  SELECT heads.c, pos + 1000000, role, text FROM heads JOIN turns ON turns.c = heads.c WHERE pos >= h
), whole AS (
  SELECT heads.c, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns
  FROM heads LEFT JOIN rebuilt USING (c) GROUP BY heads.c
), starts AS (
  SELECT c, len(turns) AS size, d AS depth, turns[1:d] AS prefix, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS n_bytes
  FROM whole, unnest(range(0, len(turns) + 1)) AS depths(d)
), nodes AS (
  SELECT depth, min(c) AS node, count(*) AS n_convs, any_value(n_bytes) AS n_bytes, prefix,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = depth), '')) AS ends_sha256
  FROM starts GROUP BY depth, prefix
), above AS (
  SELECT low.depth AS low_depth, low.node AS low_node, high.depth, high.node
  FROM nodes AS low JOIN starts ON starts.c = low.node AND starts.depth <= low.depth
  JOIN nodes AS high ON high.depth = starts.depth AND high.prefix = starts.prefix
), children AS (
  SELECT depth, node, count(*) AS n_children FROM above WHERE low_depth = depth + 1 GROUP BY depth, node
), totals AS (
  SELECT above.depth, above.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved_tokens
  FROM above JOIN nodes ON nodes.depth = low_depth AND nodes.node = low_node
  LEFT JOIN children ON children.depth = low_depth AND children.node = low_node
  GROUP BY above.depth, above.node
)
SELECT nodes.node AS conv_id, nodes.depth, parents.node AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes JOIN totals USING (depth, node) LEFT JOIN children USING (depth, node)
LEFT JOIN above AS parents ON parents.low_depth = nodes.depth AND parents.low_node = nodes.node AND parents.depth = nodes.depth - 1
"""


@_query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.hard_negatives import hard_negatives

    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings").withColumn("label", shifted), F.col("id") % 50 == 0)


SQL["op11_hard_negatives"] = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors AS a JOIN vectors AS b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives AS p JOIN scores AS n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@_query
def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.llm.suffixes import without_repeats

    found = without_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op13_suffix_dedup"] = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS d FROM documents
), strings AS (
  SELECT d, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM docs, unnest(range(0, length(h) // 2 - 99)) AS places(p)
), later AS (
  SELECT d, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, p) > 1
), opened AS (
  SELECT d, p, CASE WHEN p <= lag(p) OVER (PARTITION BY d ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM later
), spans AS (
  SELECT d, min(p) AS a, max(p) + 100 AS b FROM (SELECT d, p, sum(opens) OVER (PARTITION BY d ORDER BY p) AS span FROM opened) GROUP BY d, span
), parts AS (
  SELECT d, a, b, lag(b, 1, 0) OVER (PARTITION BY d ORDER BY a) AS before FROM spans
), kept AS (
  SELECT d, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM parts JOIN docs USING (d) GROUP BY d
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (d)
"""
