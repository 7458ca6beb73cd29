"""CSV tables with missing-value tokens and inferred types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing" in a CSV cell, and the texts of booleans and numbers.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOLEAN = r"\A(?:True|TRUE|true|False|FALSE|false)\z"
INTEGER = r"\A\s*[+-]?\d+\s*\z"
NUMBER = r"(?i)\A\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*\z"


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING), text)


def _candidates(text: Column) -> dict[str, Column]:
    """Parsed value per candidate type, null where the text does not fit it; narrowest type first."""
    return {
        "boolean": F.when(text.rlike(BOOLEAN), F.lower(text).try_cast("boolean")),
        "bigint": F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint")),
        "double": F.when(text.rlike(NUMBER), F.trim(text).try_cast("double")),
    }


def infer_types(texts: DataFrame) -> T.StructType:
    """Narrowest type every non-missing cell of a text column fits, from one aggregation over all columns.

    A column without any value reads as double, like the all-missing column it is.
    """
    measures = []
    for i, name in enumerate(texts.columns):
        text = missing_to_null(F.col(f"`{name}`"))
        measures.append(F.count(text).alias(f"all_{i}"))
        measures += [F.count(value).alias(f"{kind}_{i}") for kind, value in _candidates(text).items()]
    row = texts.agg(*measures).first()
    schema = T.StructType()
    for i, name in enumerate(texts.columns):
        fitting = [k for k in ("boolean", "bigint", "double") if row[f"{k}_{i}"] == row[f"all_{i}"]]
        kind = "double" if not row[f"all_{i}"] else (fitting or ["string"])[0]
        schema.add(name, {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType()}.get(kind, T.StringType()))
    return schema


def apply_types(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns with missing tokens as null; a projection, so column pruning still reaches the scan."""
    typed = []
    for field in schema.fields:
        text = missing_to_null(F.col(f"`{field.name}`"))
        typed.append(_candidates(text).get(field.dataType.simpleString(), text).alias(field.name))
    return texts.select(*typed)


def read_texts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line, emptyValue="")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV table at `path`. Without a schema the types are inferred once; pass that schema on later reads.

    `multi_line` reads quoted line feeds, at the price of one task per file.
    """
    texts = read_texts(spark, path, multi_line)
    return apply_types(texts, schema or infer_types(texts))


def read_train_and_test(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, train), read_table(spark, test)


def write_submission(rows: DataFrame, id_column: str, prediction: str, path: str) -> None:
    """Id and prediction as CSV with a header; one file per partition, so nothing is funnelled through one task."""
    rows.select(id_column, prediction).write.csv(path, header=True)
