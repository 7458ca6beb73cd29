"""Schemas of the stored tables and run records."""

from __future__ import annotations

from pyspark.sql import types as T

_text = T.StringType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _text) for n in names]


ENTRY = T.StructType(_strings("task", "code", "result"))
OUTPUT = T.StructType(
    [
        *_strings("output_type", "name", "text"),
        T.StructField("data", T.MapType(_text, _text)),
        *_strings("ename", "evalue"),
        T.StructField("traceback", T.ArrayType(_text)),
    ]
)
LEADERBOARD = T.StructType(
    [T.StructField("submissions", T.ArrayType(T.StructType([T.StructField("score", _text)])))]
)
