"""Every registered query against the SQL that states its result, and the plans it runs with."""

import compare
import pytest

import __spark_entry__ as entry_point
from tallyloom import catalogue

SMALL = "/root/testdata/sf0.001"
QUERIES = catalogue.QUERIES
SQL = catalogue.SQL


@pytest.fixture(scope="module")
def duck():
    con = compare.connection(SMALL)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    found = compare.difference(QUERIES[name](spark, SMALL), duck, SQL[name])
    assert found is None, found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert not QUERIES[name](spark, SMALL).isEmpty()


def test_entry(spark):
    profile = entry_point.entry(spark)
    assert profile.columns[:3] == ["column_name", "count", "mean"]
    assert profile.count() == 8


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairing_of_whole_tables(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["checkpoint_latest", "weighted_memory", "history_last_n", "knn_per_type", "previous_result"])
def test_rank_filter_runs_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    shuffle = text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text[shuffle:], text


@pytest.mark.parametrize("name", ["knn", "knn_filtered", "latest_row", "profile_head", "checkpoint_list_limit"])
def test_global_top_n_keeps_n_rows_per_task(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SMALL))


def test_lookup_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["point_lookup"](spark, SMALL))
    assert "EqualTo(doc_id" in text
    text = plan(QUERIES["impute_mean"](spark, SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text
