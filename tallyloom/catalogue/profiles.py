"""Profile and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalogue.registry import Tables, null_where, query, rounded
from tallyloom.operators import profile as p
from tallyloom.operators import ranking as r

NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM = "(SELECT * REPLACE (nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax, nullif(l_returnflag, 'N') AS l_returnflag) FROM lineitem)"
CUSTOMER = "(SELECT * REPLACE (nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, nullif(c_nationkey, 3) AS c_nationkey) FROM customer)"
FIGURES = ["mean", "std", "p25", "p50", "p75"]


def lineitem_with_gaps(t: Tables):
    """Missing values as null in two columns and as NaN in a third."""
    nan = F.when(F.col("l_tax") == 0.0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return t.lineitem.withColumns(
        {"l_discount": null_where("l_discount", 0.0), "l_tax": nan, "l_returnflag": null_where("l_returnflag", "N")}
    )


def customer_with_gaps(t: Tables):
    return t.customer.withColumns(
        {"c_mktsegment": null_where("c_mktsegment", "BUILDING"), "c_nationkey": null_where("c_nationkey", 3)}
    )


def _each(columns: list[str], select: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {select.format(c=c)} FROM {source}" for c in columns)


_MOMENTS = (
    "count({c}) AS count, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, min({c})::DOUBLE AS min, "
    "round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, "
    "round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, max({c})::DOUBLE AS max"
)
_DESCRIBE = _each(NUMERIC, _MOMENTS + ", count(*) - count({c}) AS n_missing", LINEITEM)
_COLUMNS = [*NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT count(*) AS n_rows, 11 AS n_columns FROM {LINEITEM}")
def profile_shape(t: Tables):
    return p.shape(lineitem_with_gaps(t))


@query(
    _each(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "CASE WHEN count({c}) < count(*) THEN 'float64' ELSE 'int64' END AS pandas_type", LINEITEM)
    + " UNION ALL " + _each(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "CASE WHEN count(*) >= 0 THEN 'float64' END AS pandas_type", LINEITEM)
    + " UNION ALL " + _each(["l_returnflag", "l_linestatus"], "CASE WHEN count(*) >= 0 THEN 'object' END AS pandas_type", LINEITEM)
    + " UNION ALL " + _each(["l_shipdate"], "CASE WHEN count(*) >= 0 THEN 'datetime64[ns]' END AS pandas_type", LINEITEM)
)
def profile_types(t: Tables):
    return p.reported_types(lineitem_with_gaps(t)).select("column_name", "pandas_type")


@query(_each(_COLUMNS, "count(*) - count({c}) AS n_missing", LINEITEM))
def profile_missing(t: Tables):
    return p.missing_counts(lineitem_with_gaps(t))


@query(_each(_COLUMNS, "count(DISTINCT {c}) AS n_unique", LINEITEM))
def profile_unique(t: Tables):
    return p.distinct_counts(lineitem_with_gaps(t))


@query(_DESCRIBE)
def profile_describe(t: Tables):
    return rounded(p.describe(lineitem_with_gaps(t)), *FIGURES)


_NONE = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mean", "std", "min", "p25", "p50", "p75", "max"))


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, sum(n)::BIGINT AS count, count(*) AS \"unique\", "
        f"arg_max(v, (n, -rnk)) AS top, max(n) AS freq, {_NONE} FROM (SELECT v, n, row_number() OVER (ORDER BY v) AS rnk FROM "
        f"(SELECT {c} AS v, count(*) AS n FROM {CUSTOMER} WHERE {c} IS NOT NULL GROUP BY 1)))"
        for c in ("c_name", "c_mktsegment")
    )
    + " UNION ALL BY NAME SELECT * FROM ("
    + _each(["c_custkey", "c_nationkey", "c_acctbal"], _MOMENTS + ", CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq", CUSTOMER)
    + ")"
)
def profile_describe_all(t: Tables):
    return rounded(p.describe_all(customer_with_gaps(t)), *FIGURES)


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def profile_head(t: Tables):
    return p.head(t.orders, ["o_orderkey"])


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"{c} IS NULL AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    + f" FROM {LINEITEM}"
)
def missing_mask(t: Tables):
    return p.missing_mask(lineitem_with_gaps(t), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


_TOP = """
WITH s AS ({scores}),
r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS rn, count(*) OVER () AS n FROM s WHERE v IS NOT NULL)
SELECT round(coalesce(avg(v), 0.0), 6) AS top_decile_mean, coalesce(max(n), 0)::BIGINT AS n_scores
FROM r WHERE rn <= greatest(1, n // 10)
"""


@query(_TOP.format(scores="SELECT o_totalprice AS v FROM orders"))
def top_decile_mean(t: Tables):
    return rounded(r.top_decile_mean(t.orders, F.col("o_totalprice")), "top_decile_mean")


_SCORE_SQL = "CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN NULL ELSE ' ' || CAST(value AS VARCHAR) END"


@query(_TOP.format(scores=f"SELECT TRY_CAST(trim({_SCORE_SQL}) AS DOUBLE) AS v FROM events"))
def top_decile_mean_text_scores(t: Tables):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).when(
        F.col("event_id") % 11 != 0, F.concat(F.lit(" "), F.col("value").cast("string"))
    )
    scores = r.text_scores(t.events.withColumn("score", text), "score")
    return rounded(r.top_decile_mean(scores, F.col("score")), "top_decile_mean")


@query("SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def latest_row(t: Tables):
    return r.latest(t.orders, F.col("o_orderdate"), [F.asc("o_orderkey")])
