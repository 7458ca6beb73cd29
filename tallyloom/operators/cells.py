"""Notebook cells as rows: kernel messages to outputs, and outputs to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Message types, mime types and labels of the notebook format.
OUTPUT_TYPES = ["stream", "execute_result", "error"]
PLAIN = "text/plain"
FRAME = "application/vnd.dataframe+json"
TEXT_OUTPUT = "Text Output:\n"
FRAME_OUTPUT = "DataFrame Output:"
UNKNOWN_DATA = "Unknown Display Data"
UNKNOWN_TYPE = "Unknown Output Type: "


def until_idle(messages: DataFrame) -> DataFrame:
    """Messages of each request up to its first idle status; (parent_id, seq, msg_type, execution_state, ...)."""
    done = (
        messages.where((F.col("msg_type") == "status") & (F.col("execution_state") == "idle"))
        .groupBy("parent_id")
        .agg(F.min("seq").alias("idle_seq"))
    )
    joined = messages.join(done, "parent_id", "left")
    return joined.where(F.col("idle_seq").isNull() | (F.col("seq") < F.col("idle_seq"))).drop("idle_seq")


def outputs_of(messages: DataFrame) -> DataFrame:
    """Output rows of each request in arrival order: streams, results and errors."""
    kept = until_idle(messages).where(F.col("msg_type").isin(OUTPUT_TYPES))
    only = {"name": "stream", "text": "stream", "data": "execute_result", "ename": "error", "evalue": "error"}
    fields = [F.when(F.col("msg_type") == kind, F.col(f)).alias(f) for f, kind in only.items()]
    return kept.select("parent_id", "seq", F.col("msg_type").alias("output_type"), *fields)


def _data(output: Column, mime: str) -> Column:
    return F.try_element_at(output["data"], F.lit(mime))


def _error(output: Column, with_trace: bool) -> Column:
    parts = [F.lit("Error: "), output["ename"], F.lit("\n"), output["evalue"]]
    if with_trace:
        trace = F.concat(F.lit("["), F.array_join(F.transform(output["traceback"], lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
        parts += [F.lit("\n"), trace]
    return F.concat(*parts)


def first_output(outputs: Column) -> Column:
    """Text of the first output of a known type, null when there is none."""
    known = F.filter(outputs, lambda o: o["output_type"].isin("execute_result", "stream", "display_data", "error"))
    o = F.get(known, F.lit(0))
    kind = o["output_type"]
    return (
        F.when(kind == "execute_result", _data(o, PLAIN))
        .when(kind == "stream", o["text"])
        .when(kind == "display_data", F.coalesce(_data(o, PLAIN), F.to_json(o["data"])))
        .when(kind == "error", _error(o, with_trace=False))
    )


def output_texts(outputs: Column, render_frame=lambda json: json) -> Column:
    """Every output formatted by its type; `render_frame` turns a data-frame JSON text into a table text."""

    def texts(o: Column) -> Column:
        kind = o["output_type"]
        plain, frame = _data(o, PLAIN), _data(o, FRAME)
        display = (
            F.when(plain.isNotNull(), F.array(plain))
            .when(frame.isNotNull(), F.array(F.lit(FRAME_OUTPUT), render_frame(frame)))
            .otherwise(F.array(F.lit(UNKNOWN_DATA)))
        )
        return (
            F.when((kind == "stream") & (o["name"] == "stdout"), F.array(F.concat(F.lit(TEXT_OUTPUT), o["text"])))
            .when(kind == "display_data", display)
            .when(kind == "execute_result", F.array(plain))
            .when(o["ename"].isNotNull(), F.array(_error(o, with_trace=True)))
            .otherwise(F.array(F.concat(F.lit(UNKNOWN_TYPE), kind)))
        )

    return F.flatten(F.transform(outputs, texts))


def new_cells(code: DataFrame, status: str) -> DataFrame:
    """Rows for the cells log from (notebook, seq, code, outputs); failed cells carry status `error`."""
    return code.select("notebook", "seq", F.lit("code").alias("cell_type"), "code", "outputs", F.lit(status).alias("status"))
