"""Profile and order statistics against pandas and plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordering, profile, ranking
from tallyloom.plans import dataset_report


@pytest.fixture(scope="module")
def frame():
    random.seed(3)
    n = 500
    return pd.DataFrame(
        {
            "a": [random.choice([float("nan"), 1.5, 2.5, random.random()]) for _ in range(n)],
            "b": [random.randint(-50, 50) for _ in range(n)],
            "c": [random.choice([None, "x", "y", "z"]) for _ in range(n)],
            "d": [random.random() < 0.5 for _ in range(n)],
            "hot": [7.0 if i % 3 else random.random() for i in range(n)],
        }
    )


@pytest.fixture(scope="module")
def table(spark, frame):
    schema = "a double, b long, c string, d boolean, hot double"
    rows = [[None if v is None else v for v in row] for row in frame.astype(object).values.tolist()]
    return spark.createDataFrame(rows, schema).repartition(5)


def by_column(df):
    return {r.column_name: r for r in df.collect()}


def test_counts_match_pandas(table, frame):
    missing, unique = by_column(profile.missing_counts(table)), by_column(profile.distinct_counts(table))
    for c in frame.columns:
        assert missing[c].n_missing == frame[c].isnull().sum()
        assert unique[c].n_unique == frame[c].nunique()
    assert profile.shape(table).first() == (500, 5)


def test_describe_matches_pandas(table, frame):
    expected = frame.describe()
    for name, row in by_column(profile.describe(table)).items():
        for mine, theirs in dataset_report.SUMMARY_ROWS.items():
            assert row[theirs] == pytest.approx(expected[name][mine], rel=1e-12), (name, mine)


def test_overview_of_a_small_frame(spark):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, None, "y"), (4, 1.5, "y")], "n long, v double, s string")
    assert dataset_report.overview(df) == """\
Shape: (3, 3)
Columns: ['n', 'v', 's']
Data Types:
n      int64
v    float64
s     object
dtype: object
Missing Values:
n    0
v    1
s    0
dtype: int64
Unique Values:
n    3
v    2
s    2
dtype: int64
Numerical Columns Summary:
              n         v
count  3.000000  2.000000
mean   2.333333  1.000000
std    1.527525  0.707107
min    1.000000  0.500000
25%    1.500000  0.750000
50%    2.000000  1.000000
75%    3.000000  1.250000
max    4.000000  1.500000"""


def test_overview_lists_every_column(spark):
    df = spark.range(3).select(*[F.col("id").alias(f"column_{i}") for i in range(81)])
    lines = dataset_report.overview(df).split("\n")
    for i in range(81):
        assert sum(line.split(" ")[0] == f"column_{i}" for line in lines) == 3
    assert not any(line.startswith("...") for line in lines)


def test_published_invariant():
    """Missing plus counted is the number of rows, as in the published passenger profile."""
    published = {"Age": (179, 8514), "RoomService": (181, 8512), "FoodCourt": (183, 8510), "ShoppingMall": (208, 8485)}
    assert all(missing + counted == 8693 for missing, counted in published.values())


def test_integers_beyond_double_precision_stay_apart(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (big + 2,)], "v long")
    assert profile.distinct_counts(df).first().n_unique == 3


def test_all_missing_column(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "v double, w double")
    rows = by_column(profile.describe(df))
    assert (rows["v"]["count"], rows["v"].n_missing, rows["v"].p50) == (0, 2, None)
    assert rows["w"].p50 == 1.5
    assert by_column(profile.describe_all(df))["v"]["mean"] is None


@pytest.mark.parametrize("max_block", [1, 3, 10**6])
def test_every_rank_is_exact(spark, max_block):
    random.seed(max_block)
    values = [random.choice([5.0, 5.0, 5.0, random.randint(0, 40) / 4]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = ordering.order_counts(ordering.value_counts(df, ["v"]))
    wanted = [0, 1, 57, 199, 200, 398, 399]
    found = {r["rank"]: r.value for r in ordered.at_ranks({"v": wanted}, max_block).collect()}
    assert found == {k: sorted(values)[k] for k in wanted}
    assert ordered.total("v") == 400 and ordered.distinct("v") == len(set(values))


@pytest.mark.parametrize("n", [0, 1, 9, 10, 25, 203])
def test_top_decile_mean(spark, n):
    random.seed(n)
    scores = [random.choice([3.0, random.random() * 10]) for _ in range(n)]
    row = ranking.top_decile_mean(spark.createDataFrame([(s,) for s in scores], "s double"), F.col("s")).first()
    top = sorted(scores, reverse=True)[: max(1, n // 10)]
    assert row.top_decile_mean == pytest.approx(sum(top) / len(top) if top else 0.0)
    assert row.n_scores == n


def test_latest_row_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, "2024-01-02"), (0, "2024-01-02"), (2, "2024-01-01")], "pos int, date string")
    assert ranking.latest(df, F.col("date"), [F.asc("pos")]).first().pos == 0


def test_describe_all_breaks_ties_by_lowest_value(spark):
    df = spark.createDataFrame([("b", True), ("a", True), ("b", False), ("a", False), (None, None)], "s string, f boolean")
    rows = by_column(profile.describe_all(df))
    assert (rows["s"].top, rows["s"].freq, rows["s"]["count"], rows["s"]["unique"]) == ("a", 2, 4, 2)
    assert rows["f"].top == "false"


def test_head_markdown(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    assert dataset_report.head_markdown(df, ["a"]).split("\n")[2:] == ["| 0 | 1 | x |", "| 1 | 2 | nan |"]


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_ranks_of_columns(spark, monkeypatch, accuracy):
    """Exact with a fine sketch, and with one so coarse that brackets are wide or miss."""
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", accuracy)
    random.seed(accuracy)
    a = [random.choice([1.0, 2.0, random.random() * 50]) for _ in range(700)]
    df = spark.createDataFrame([(x, int(x) if x > 2 else None) for x in a], "a double, b int")
    b = [int(x) for x in a if x > 2]
    ranks = {"a": [0, 1, 350, 698, 699], "b": [0, len(b) // 3, len(b) - 1], "c": [0]}
    found = ordering.values_at_ranks(df, {"a": F.col("a"), "b": F.col("b"), "c": F.lit(None).cast("int")}, ranks, {"a": 700, "b": len(b), "c": 0})
    assert found == {**{("a", r): sorted(a)[r] for r in ranks["a"]}, **{("b", r): float(sorted(b)[r]) for r in ranks["b"]}}
