"""Projections of run records and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields logged for each kind of step.
LOGGED = {
    "code_agent": ["problem_description", "model_info", "planned_tasks", "previous_tasks", "current_task", "output"],
    "data_utils": ["dataset_info"],
    "enhancer": [
        "current_task", "problem_description", "dataset_info", "previous_tasks", "planned_tasks", "future_tasks", "evaluation_metric", "best_score", "output",
    ],
    "planner": ["problem_description", "dataset_info", "planned_tasks"],
}


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def as_json(*columns: str) -> Column:
    """A record as JSON text with its null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def log_view(records: DataFrame, step: str) -> DataFrame:
    """The fields logged for a kind of step; one that is missing raises."""
    return records.select("run_id", *LOGGED[step])


def if_present(value: Column, present: Column) -> Column:
    return F.when(present, value)
