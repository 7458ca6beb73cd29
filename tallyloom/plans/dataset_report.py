"""The profile as one report text, and its hand-over to a caller's model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.urls import with_slash
from tallyloom.operators.keyed_log import cached_results
from tallyloom.operators.profile import describe, distinct_counts, head, missing_counts, numeric_columns, pandas_type, shape

SUMMARY_ROWS = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "p25", "50%": "p50", "75%": "p75", "max": "max"}


def overview(df: DataFrame) -> str:
    """Shape, columns, types, missing, distinct and numeric summary. The driver holds one row per column."""
    n_rows, n_columns = shape(df).first()
    numeric = numeric_columns(df)
    others = [c for c in df.columns if c not in numeric]
    figures = {r.column_name: r for r in describe(df, numeric).collect()} if numeric else {}
    missing = {c: r.n_missing for c, r in figures.items()}
    unique = {r.column_name: r.n_unique for r in distinct_counts(df).collect()}
    if others:
        missing |= {r.column_name: r.n_missing for r in missing_counts(df, others).collect()}
    types = {f.name: pandas_type(f.dataType, missing[f.name] > 0) for f in df.schema.fields}
    summary = pd.DataFrame({c: [figures[c][f] for f in SUMMARY_ROWS.values()] for c in numeric}, index=list(SUMMARY_ROWS))
    # The titles of the sections, in order. Every column has its line, however many there are.
    listed = lambda values: pd.Series(values).to_string(dtype=True)
    sections = {
        "Shape: ": (n_rows, n_columns),
        "Columns: ": df.columns,
        "Data Types:\n": listed(types),
        "Missing Values:\n": listed({c: missing[c] for c in df.columns}),
        "Unique Values:\n": listed({c: unique[c] for c in df.columns}),
        "Numerical Columns Summary:\n": summary.to_string(),
    }
    return "\n".join(f"{title}{body}" for title, body in sections.items())


def head_markdown(df: DataFrame, order_by: list, n: int = 5) -> str:
    """First n rows as a Markdown table with a leading row number."""
    rows = head(df, order_by, n).collect()
    width = len(df.columns)
    lines = ["| | " + " | ".join(df.columns) + " |", "|" + " --- |" * (width + 1)]
    cell = lambda v: "nan" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")
    lines += ["| " + " | ".join([str(i), *map(cell, row)]) + " |" for i, row in enumerate(rows)]
    return "\n".join(lines)


def analyze(df: DataFrame, order_by: list, dataset_info: str, model: Callable[[dict], dict]) -> dict:
    """The overview with what the caller's model says about it."""
    text = overview(df)
    said = model({"data_initial_info": text, "dataset_overview": dataset_info, "dataset_head": head_markdown(df, order_by)})
    return {"dataset_info": text, **said}


def summarize_pages(pages: DataFrame, fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Each text field replaced by what the caller's column function makes of it; the batch runs on executors."""
    return pages.withColumns({name: summarize(F.col(name)) for name, summarize in fields.items()})


def summarize_problems(
    problems: DataFrame, describe_text: Callable[[Column], Column], judge: Callable[[Column], Column], detail: Callable[[Column], Column], scraped: str = "scraped_data"
) -> DataFrame:
    """`problems` with a column `summarized` {description, evaluation {description, metric}, data_details} made of the texts of the
    struct `scraped`. `judge` returns a struct (description, metric). Where a text is missing, so is its summary."""
    def made(field: str, summarize: Callable[[Column], Column]) -> Column:
        return F.when(F.col(f"{scraped}.{field}").isNotNull(), summarize(F.col(f"{scraped}.{field}"))).alias(field)

    return problems.withColumn("summarized", F.struct(made("description", describe_text), made("evaluation", judge), made("data_details", detail)))


def through_cache(cache: DataFrame, requests: DataFrame, url: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all results, new results): cached rows for known URLs, computed rows for the others; append the new ones."""
    hits, misses = cached_results(cache, requests, url)
    made = compute(misses).withColumn(url, with_slash(F.col(url))).select(*cache.columns)
    return hits.unionByName(made), made
