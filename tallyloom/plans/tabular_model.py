"""A tabular classification job: impute, scale, one-hot, split, fit, evaluate, predict."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.features import column_means, column_modes, column_scales, fill, standardize

# The searched grid, folds and seed.
GRID = {"maxIter": [100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2]}
FOLDS = 3
SEED = 42


class Preprocessor:
    """Fitted imputation and scaling values plus a fitted category encoder."""

    def __init__(self, numeric: list[str], categorical: list[str]):
        self.numeric, self.categorical = numeric, categorical

    def fit(self, train: DataFrame) -> Preprocessor:
        self.means = column_means(train, self.numeric)
        self.scales = column_scales(fill(train, self.means), self.numeric)
        self.modes = column_modes(train, self.categorical)
        self.encoder: PipelineModel = Pipeline(stages=self._stages()).fit(self._columns(train))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `features`; a category not seen in training is all zeros."""
        return self.encoder.transform(self._columns(df))

    def _columns(self, df: DataFrame) -> DataFrame:
        scaled = standardize(fill(df, self.means), self.scales)
        return fill(scaled, self.modes).withColumns({c: F.col(c).cast("string") for c in self.categorical})

    def _stages(self) -> list:
        indexed = [f"{c}__index" for c in self.categorical]
        encoded = [f"{c}__hot" for c in self.categorical]
        stages: list = []
        if self.categorical:
            stages = [
                StringIndexer(inputCols=self.categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
                OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True, handleInvalid="error"),
            ]
        return [*stages, VectorAssembler(inputCols=[*self.numeric, *encoded], outputCol="features")]


def embedding_features(df: DataFrame, embedding: Column) -> DataFrame:
    return df.withColumn("features", array_to_vector(embedding.cast("array<double>")))


def forest(label: str, trees: int = 100) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=SEED)


def boosted(label: str) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol="features", seed=SEED)


def grid_search(train: DataFrame, label: str, grid: dict[str, list] | None = None, folds: int = FOLDS, parallelism: int = 4) -> CrossValidatorModel:
    """Boosted trees over every combination of the grid, chosen by cross-validated accuracy."""
    model = boosted(label)
    combinations = ParamGridBuilder()
    for name, values in (grid or GRID).items():
        combinations.addGrid(model.getParam(name), values)
    score = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    search = CrossValidator(
        estimator=model, estimatorParamMaps=combinations.build(), evaluator=score, numFolds=folds, seed=SEED, parallelism=parallelism
    )
    return search.fit(train)


def compare(train: DataFrame, valid: DataFrame, label: str, estimators: dict[str, Estimator]) -> list[tuple[str, float]]:
    """Validation accuracy of each estimator, best first."""
    score = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    found = [(name, score.evaluate(estimator.fit(train).transform(valid))) for name, estimator in estimators.items()]
    return sorted(found, key=lambda pair: -pair[1])


def predict(model: Model, rows: DataFrame, id_column: str, target: str, as_type: str = "boolean") -> DataFrame:
    """Id and prediction; the id rides along, so rows need no re-alignment."""
    return model.transform(rows).select(id_column, F.col("prediction").cast(as_type).alias(target))
