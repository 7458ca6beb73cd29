"""Features, splits, evaluation, models and retrieval against NumPy and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evaluation, features, retrieval
from tallyloom.plans import tabular_model

ROWS = [(i, None if i % 5 == 0 else (float("nan") if i % 7 == 0 else i * 1.5), None if i % 3 == 0 else "xyz"[i % 2], float(i % 2)) for i in range(60)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, n double, c string, label double").repartition(4)


def test_impute_and_scale(table):
    known = np.array([n for _, n, _, _ in ROWS if n is not None and n == n])
    filled = features.fill(table, features.column_means(table, ["n"]))
    values = np.array([known.mean() if n is None or n != n else n for _, n, _, _ in ROWS])
    scaled = features.standardize(filled, features.column_scales(filled, ["n"]))
    found = {r.id: r.n for r in scaled.collect()}
    expected = (values - values.mean()) / values.std()
    assert all(found[i] == pytest.approx(expected[i]) for i in found)


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "n double")
    assert [r.n for r in features.standardize(df, features.column_scales(df, ["n"])).collect()] == [0.0, 0.0]


def test_mode_takes_the_lowest_of_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1), ("a", 2), (None, None)], "s string, i int")
    assert features.column_modes(df, ["s", "i"]) == {"s": "a", "i": 1}


def test_codes_number_values_in_order(spark):
    random.seed(4)
    words = [str(random.randint(0, 500)) for _ in range(3000)]
    codes = features.category_codes(spark.createDataFrame([(w,) for w in words], "w string").repartition(5), ["w"])
    expected = {w: i for i, w in enumerate(sorted(set(words)))}
    assert {r.value: r.code for r in codes.collect()} == expected
    assert {r.width for r in codes.collect()} == {len(expected)}


def test_unknown_category_is_all_zeros(table, spark):
    ready = tabular_model.Preprocessor(["n"], ["c"]).fit(table)
    rows = spark.createDataFrame([(0, 1.0, "x"), (1, 1.0, "never"), (2, None, None)], "id int, n double, c string")
    found = {r.id: r.features.toArray().tolist() for r in ready.transform(rows).collect()}
    assert found[0][1:] == [1.0, 0.0] and found[1][1:] == [0.0, 0.0] and sum(found[2][1:]) == 1.0


@pytest.mark.parametrize("n,share", [(1, 0.2), (10, 0.2), (11, 0.2), (997, 0.25), (5000, 0.2), (50, 1.0), (50, 0.0)])
def test_split_is_exact_and_repeatable(spark, n, share):
    df = spark.range(n).repartition(3)
    marked = {r.id: r.is_test for r in features.mark_test_rows(df, "id", share).collect()}
    assert sum(marked.values()) == int(np.ceil(share * n))
    again = {r.id: r.is_test for r in features.mark_test_rows(df.repartition(7), "id", share).collect()}
    assert marked == again


def test_class_report_by_hand(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]
    df = spark.createDataFrame(pairs, "y int, p int")
    rows = {r.label: r for r in evaluation.class_report(df, "y", "p").collect()}
    assert (rows["0"].precision, rows["0"].recall, rows["0"].support) == (0.5, 0.5, 2)
    assert rows["1"].precision == pytest.approx(2 / 3) and rows["1"].recall == 1.0 and rows["1"].f1 == pytest.approx(0.8)
    assert (rows["2"].precision, rows["2"].recall, rows["2"].f1) == (0.0, 0.0, 0.0)
    assert rows["accuracy"].f1 == pytest.approx(0.6)
    assert rows["macro avg"].f1 == pytest.approx((0.5 + 0.8) / 3)
    assert rows["weighted avg"].f1 == pytest.approx((2 * 0.5 + 2 * 0.8) / 5)
    matrix = {r.y: (r.predicted_0, r.predicted_1, r.predicted_2) for r in evaluation.confusion_matrix(df, "y", "p", [0, 1, 2]).collect()}
    assert matrix == {0: (1, 1, 0), 1: (0, 2, 0), 2: (1, 0, 0)}


def test_model_job_end_to_end(table, tmp_path):
    marked = features.mark_test_rows(table, "id")
    ready = tabular_model.Preprocessor(["n"], ["c"]).fit(table).transform(marked)
    train, valid = ready.where(~F.col("is_test")), ready.where("is_test")
    found = tabular_model.grid_search(train, "label", {"maxIter": [2], "maxDepth": [2]}, folds=2)
    submission = tabular_model.predict(found.bestModel, valid, "id", "Transported")
    assert submission.columns == ["id", "Transported"] and submission.count() == 12
    ranked = tabular_model.compare(train, valid, "label", {"forest": tabular_model.forest("label", 5)})
    assert ranked[0][0] == "forest" and 0 <= ranked[0][1] <= 1


def test_default_grid():
    assert np.prod([len(v) for v in tabular_model.GRID.values()]) * tabular_model.FOLDS == 54


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_matches_brute_force(spark, metric):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(200, 8)).astype(np.float32)
    vectors[10] = vectors[3]
    query = vectors[3].astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(vectors)], "id int, embedding array<float>, kind int").repartition(5)
    x = vectors.astype(float)
    distance = ((x - query) ** 2).sum(1) if metric == "l2" else 1 - x @ query / (np.linalg.norm(x, axis=1) * np.linalg.norm(query))
    order = sorted(range(200), key=lambda i: (round(distance[i], 12), i))
    found = [r.id for r in retrieval.nearest(df, query.tolist(), 5, metric=metric).collect()]
    assert found[2:] == order[2:5] and set(found[:2]) == {3, 10}
    filtered = [r.id for r in retrieval.nearest(df, query.tolist(), 5, where=F.col("kind") == 1, metric=metric).collect()]
    assert filtered == [i for i in order if i % 4 == 1][:5]
    per_kind = retrieval.nearest_per_type(df, query.tolist(), 2, "kind", metric=metric).where("kind = 2").orderBy("rank").collect()
    assert {r.id for r in per_kind} == set([i for i in order if i % 4 == 2][:2])


def test_few_shots_keep_rank_order_and_missing_examples(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id int, embedding array<float>")
    examples = spark.createDataFrame([(i, f"task {i}") for i in (0, 2, 3)], "id int, task string")
    found = retrieval.few_shots(df, [0.0], examples).collect()
    assert [(r.id, r.task) for r in found] == [(0, "task 0"), (1, None), (2, "task 2"), (3, "task 3")]


def test_document_lookup(spark):
    store = spark.createDataFrame([("a", "text", {"doc_type": "report"}), ("b", "other", {})], "id string, text string, metadata map<string,string>")
    row = retrieval.load_document(store, "a").first()
    assert (row.content, row.doc_type, row.metadata) == ("text", "report", {"doc_type": "report"})
    assert retrieval.load_document(store, "zzz").first() is None
    assert [(r.id, r.doc_type) for r in retrieval.list_documents(store).collect()] == [("a", "report"), ("b", "")]
