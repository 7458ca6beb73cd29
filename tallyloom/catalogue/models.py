"""Feature, evaluation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalogue.profiles import CUSTOMER, customer_with_gaps
from tallyloom.catalogue.registry import Tables, query, rounded
from tallyloom.local import local_table
from tallyloom.operators import evaluation as e
from tallyloom.operators import features as f
from tallyloom.plans import tabular_model as m
from tallyloom.scratch import materialize

_GAPS = "(SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal) FROM customer)"


def customer_with_missing_balance(t: Tables):
    """Negative balances missing, half of them as NaN."""
    odd = F.when(F.col("c_custkey") % 2 == 1, F.lit(float("nan")))
    return t.customer.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(odd))


@query(f"SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {_GAPS})), 6) AS c_acctbal FROM {_GAPS}")
def impute_mean(t: Tables):
    gaps = customer_with_missing_balance(t)
    return rounded(f.fill(gaps, f.column_means(gaps, ["c_acctbal"])).select("c_custkey", "c_acctbal"), "c_acctbal")


_MODE = "(SELECT {c} FROM {s} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "SELECT c_custkey, "
    + ", ".join(f"coalesce({c}, {_MODE.format(c=c, s=CUSTOMER)}) AS {c}" for c in ("c_mktsegment", "c_nationkey"))
    + f" FROM {CUSTOMER}"
)
def impute_mode(t: Tables):
    gaps = customer_with_gaps(t)
    columns = ["c_mktsegment", "c_nationkey"]
    filled = f.fill(gaps, f.column_modes(gaps, columns)).select("c_custkey", *columns)
    return filled.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS l_quantity, "
    "round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) + 0.0 AS l_extendedprice FROM lineitem"
)
def standardize(t: Tables):
    columns = ["l_quantity", "l_extendedprice"]
    scaled = f.standardize(t.lineitem, f.column_scales(t.lineitem, columns))
    return rounded(scaled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *columns), *columns)


_CODED = ["p_brand", "p_type"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS code, count(*) OVER () AS width FROM (SELECT DISTINCT {c} FROM part)"
        for c in _CODED
    )
)
def category_codes(t: Tables):
    return f.category_codes(t.part, _CODED).withColumns({"code": F.col("code").cast("long"), "width": F.col("width").cast("long")})


@query(
    " UNION ALL ".join(
        f"SELECT p_partkey, '{c}' AS column_name, CASE WHEN {c} IN (SELECT {c} FROM part WHERE p_size > 10) "
        f"THEN (SELECT count(DISTINCT b.{c}) FROM part b WHERE b.p_size > 10 AND b.{c} < a.{c}) END AS hot FROM part a"
        for c in _CODED
    )
)
def one_hot(t: Tables):
    """Coded by the categories of the larger parts; a category only small parts have is unknown."""
    codes = f.category_codes(t.part.where("p_size > 10"), _CODED)
    return f.one_hot(t.part, "p_partkey", _CODED, codes).withColumn("hot", F.col("hot").cast("long"))


@query(
    "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM documents"
)
def train_split(t: Tables):
    return f.mark_test_rows(t.documents, "doc_id").select("doc_id", "is_test")


_PRED = "(SELECT quality AS t, 1 - toxic AS p FROM labels)"


def predictions(t: Tables):
    return t.labels.withColumn("predicted", F.lit(1) - F.col("toxic"))


@query(f"SELECT round(avg((t = p)::INT), 6) AS accuracy FROM {_PRED}")
def accuracy(t: Tables):
    return rounded(e.accuracy(predictions(t), "quality", "predicted"), "accuracy")


@query(
    f"SELECT t AS quality, count(*) FILTER (p = 0) AS predicted_0, count(*) FILTER (p = 1) AS predicted_1 FROM {_PRED} GROUP BY 1"
)
def confusion_matrix(t: Tables):
    return e.confusion_matrix(predictions(t), "quality", "predicted", [0, 1])


@query(
    f"""
WITH k AS (SELECT DISTINCT t AS label FROM {_PRED} UNION SELECT DISTINCT p FROM {_PRED}),
c AS (SELECT label, (SELECT count(*) FROM {_PRED} WHERE t = label) AS support, (SELECT count(*) FROM {_PRED} WHERE p = label) AS q,
      (SELECT count(*) FROM {_PRED} WHERE t = label AND p = label) AS h FROM k),
m AS (SELECT label::VARCHAR AS label, coalesce(h / nullif(q, 0), 0) AS precision, coalesce(h / nullif(support, 0), 0) AS recall, support, h FROM c),
n AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m),
r AS (SELECT label, precision, recall, f1, support FROM n
  UNION ALL SELECT 'accuracy', sum(h) / sum(support), sum(h) / sum(support), sum(h) / sum(support), sum(support) FROM n
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM n
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM n)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r
"""
)
def class_report(t: Tables):
    return rounded(e.class_report(predictions(t), "quality", "predicted"), "precision", "recall", "f1")


def vectors(t: Tables):
    """Vectors with their label, split exactly."""
    rows = m.embedding_features(t.embeddings, F.col("embedding")).withColumn("label", F.col("label").cast("double"))
    marked = f.mark_test_rows(rows, "vec_id")
    return marked.where(~F.col("is_test")), marked.where("is_test")


@query()
def forest_predict(t: Tables):
    train, valid = vectors(t)
    return m.predict(m.forest("label").fit(train), valid, "vec_id", "label", "int")


@query()
def forest_report(t: Tables):
    train, valid = vectors(t)
    scored = m.forest("label").fit(train).transform(valid)
    return e.class_report(scored, "label", "prediction")


def order_rows(t: Tables):
    """Orders as a passenger-like table: gaps in a number and a category, a binary target."""
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        (F.col("o_orderstatus") == "F").cast("double").alias("label"),
    )


def ready_orders(t: Tables):
    """Training and test orders, prepared with what the training side shows, each written once."""
    marked = materialize(f.mark_test_rows(order_rows(t), "o_orderkey"), "orders")
    train, valid = marked.where(~F.col("is_test")), marked.where("is_test")
    prepare = m.Preprocessor(["price"], ["priority"]).fit(train)
    return materialize(prepare.transform(train), "train"), materialize(prepare.transform(valid), "valid")


@query()
def compare_models(t: Tables):
    """Validation accuracy of two estimators on all orders, each at its own defaults."""
    train, valid = ready_orders(t)
    found = m.compare(train, valid, "label", {"forest": m.forest("label"), "boosted": m.boosted("label")})
    return local_table(t.spark, found, "model string, accuracy double")
