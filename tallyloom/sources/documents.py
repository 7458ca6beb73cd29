"""JSON, text and notebook documents. One file is one row until it is exploded, and files are read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.templates import problem_document
from tallyloom.functions.urls import path_part
from tallyloom.schemas import LEADERBOARD, OUTPUT


RECORD_END = "\x1e"  # record separator: the texts span lines


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_scores(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Score texts of leaderboards, one row per submission; a board without submissions gives none.

    A file is one board, or with `one_per_line` one board per line.
    """
    boards = spark.read.schema(LEADERBOARD).json(path, multiLine=not one_per_line)
    return boards.select(F.explode("submissions").alias("submission")).select("submission.score")


def field_rows(json: Column) -> Column:
    """A JSON object text as (source, page_content) rows."""
    return F.explode(F.from_json(json, T.MapType(T.StringType(), T.StringType()))).alias("source", "page_content")


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return read_whole_text(spark, path).select(field_rows(F.col("value")))


def plan_rows(json: Column) -> Column:
    """A JSON array of strings as (seq, task) rows; a text that is no such array gives none."""
    return F.posexplode(F.from_json(json, T.ArrayType(T.StringType()))).alias("seq", "task")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return read_whole_text(spark, path).select(plan_rows(F.col("value")))


def frame_rows(json: Column, schema: T.StructType) -> Column:
    """Rows of a column-oriented data-frame JSON text ({column: {index: value}}) as an array of structs."""
    kinds = T.MapType(T.StringType(), T.StringType())
    columns = F.from_json(json, T.StructType([T.StructField(f.name, kinds) for f in schema.fields]))
    index = F.map_keys(columns[schema.fields[0].name])

    def values(column: Column) -> Column:
        """The column's values in the order of the index; in a frame all columns have it, and no value is searched for."""
        found = F.transform(index, lambda key: F.try_element_at(column, key))
        return F.when(F.map_keys(column) == index, F.map_values(column)).otherwise(found)

    whole = F.arrays_zip(index.alias("index"), *[values(columns[f.name]).alias(f"c{i}") for i, f in enumerate(schema.fields)])
    cells = lambda row: [row[f"c{i}"].try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    return F.transform(whole, lambda row: F.struct(row["index"].alias("index"), *cells(row)))


# A text of a notebook is one string or a list of strings.
_TEXT = T.VariantType()
_CELL = T.StructType(
    [
        T.StructField("cell_type", T.StringType()),
        T.StructField("source", _TEXT),
        T.StructField("outputs", T.ArrayType(T.StructType([
            *[T.StructField(n, T.StringType()) for n in ("output_type", "name", "ename", "evalue")],
            T.StructField("text", _TEXT),
            T.StructField("data", T.MapType(T.StringType(), _TEXT)),
            T.StructField("traceback", T.ArrayType(T.StringType())),
        ]))),
    ]
)


def _joined(value: Column) -> Column:
    """The text of a string or of a list of strings; any other value as JSON."""
    return F.coalesce(F.array_join(F.try_variant_get(value, "$", "array<string>"), ""), F.try_variant_get(value, "$", "string"), F.to_json(value))


def notebook_cells(df: DataFrame, book: str) -> DataFrame:
    """Cells of a notebook text column, one row each: (..., seq, cell_type, code, outputs)."""
    kept = [c for c in df.columns if c != book]
    parsed = F.from_json(book, T.StructType([T.StructField("cells", T.ArrayType(_CELL))]))
    cells = df.select(*kept, F.posexplode(parsed["cells"]).alias("seq", "cell"))

    def output(o: Column) -> Column:
        made = {**{f.name: o[f.name] for f in OUTPUT.fields}, "text": _joined(o["text"]), "data": F.transform_values(o["data"], lambda _, v: _joined(v))}
        return F.struct(*[made[f.name].alias(f.name) for f in OUTPUT.fields])

    return cells.select(
        *kept, "seq", "cell.cell_type",
        _joined(F.col("cell.source")).alias("code"),
        F.transform("cell.outputs", output).alias("outputs"),
    )


def read_notebook(spark: SparkSession, path: str) -> DataFrame:
    books = read_whole_text(spark, path).select(F.input_file_name().alias("notebook"), "value")
    return notebook_cells(books, "value")


def pretty_json(record: Column) -> Column:
    """A record as JSON with one field a line, indented by two, and a colon right after each name."""
    spaced = F.to_json(record, {"pretty": "true", "ignoreNullFields": "false"})
    return F.regexp_replace(spaced, r'(?m)^(\s*"(?:[^"\\]|\\.)*+") : ', "$1: ")


def write_json(rows: DataFrame, record: Column, path: str) -> None:
    """One indented JSON text per row."""
    rows.select(pretty_json(record).alias("value")).write.text(path)


def read_indented(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records that `write_json` wrote, with the columns of `schema`.

    A record ends with the only brace that stands alone on a line without indent, so files of many records are split between
    tasks like files of lines.
    """
    texts = spark.read.text(path, lineSep="\n}\n").where(F.trim("value") != "")
    return texts.select(F.from_json(F.concat("value", F.lit("\n}")), schema).alias("record")).select("record.*")


def write_fields(rows: DataFrame, fields: list[str], path: str, keys: list[str] | None = None) -> None:
    """Each text field of the rows under its own folder field=<name>, as JSON records of the row's keys and the value.

    A text may span lines, and a null stays null.
    """
    picked = rows.select(*(keys or []), *fields).unpivot(keys or [], fields, "field", "value")
    picked.write.option("ignoreNullFields", "false").partitionBy("field").json(path)


def read_field(spark: SparkSession, path: str, field: str, schema: str = "value string") -> DataFrame:
    """The records of one field."""
    return spark.read.schema(schema).json(f"{path}/field={field}")


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# The fields of a problem document, in file order.
DOCUMENT_FIELDS = [
    "challenge_name", "problem_description", "quantitative_analysis", "qualitative_analysis",
    "feature_recommendations", "dataset_info", "evaluation", "important_notes",
]


def write_problem_documents(problems: DataFrame, path: str) -> None:
    """Per problem its rendered text and its fields as JSON, under kind=text and kind=json."""
    named = problems.withColumn("challenge_name", path_part(F.col("challenge_url"), 2))
    text = problem_document(*[F.col(c) for c in (
        "challenge_name", "problem_description", "quantitative_analysis", "qualitative_analysis", "dataset_info", "evaluation"
    )])
    fields = F.to_json(F.struct(*DOCUMENT_FIELDS), {"ignoreNullFields": "false"})
    marked = F.raise_error(F.lit("a problem document holds the record mark"))
    text = F.when(text.contains(RECORD_END), marked.cast("string")).otherwise(text)
    kinds = F.array(F.struct(F.lit("text").alias("kind"), text.alias("value")), F.struct(F.lit("json").alias("kind"), fields.alias("value")))
    named.select(F.inline(kinds)).write.option("lineSep", RECORD_END).partitionBy("kind").text(path)


def read_problem_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("lineSep", RECORD_END).text(f"{path}/kind={kind}")
