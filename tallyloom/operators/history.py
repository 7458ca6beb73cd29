"""Run-history views over a log with one row per entry.

A log row is (run_id, seq, ...); seq is the entry's place in its run, dense from
0, assigned when the entry was appended. Because the place is stored, the
past/future views are filters, and the last-n views keep n rows per run before
the shuffle. A run is gathered into one text only where n bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import templates as t
from tallyloom.functions.text import truncate
from tallyloom.operators.ranking import top_n_per_key


def last_entries(log: DataFrame, n: int) -> DataFrame:
    """The last n entries of each run; `age` 1 is the newest."""
    return top_n_per_key(log, ["run_id"], [F.desc("seq")], n, rank="age")


def executed_codes(log: DataFrame, n: int = -1) -> DataFrame:
    """Code cells newest first: the last n-1 of a run, or all but the oldest for n = -1 or 0."""
    cell = F.concat(F.lit(t.CODE_CELL), F.col("code")).alias("cell")
    if n in (-1, 0):
        return log.where(F.col("seq") > 0).select("run_id", "seq", cell)
    return last_entries(log, n - 1).select("run_id", "seq", cell)


def previous_results(log: DataFrame, n: int = 2) -> DataFrame:
    """One text per run: its last n entries, newest first, long results cut."""
    block = t.fill(t.PREVIOUS_RESULT, F.col("task"), F.col("code"), truncate(F.col("result")))
    blocks = last_entries(log, n).withColumn("block", block)
    return joined(blocks, ["run_id"], "block", "age", "\n", "previous_result")


def history(log: DataFrame, n: int) -> DataFrame:
    """(run_id, position, role, text): three messages for each of the last n entries, oldest first."""
    messages = F.array(
        *[
            F.struct(F.lit(role).alias("role"), t.fill(layout, F.col(field)).alias("text"))
            for role, layout, field in (
                ("human", t.TASK_MESSAGE, "task"),
                ("ai", t.CODE_MESSAGE, "code"),
                ("human", t.RESULT_MESSAGE, "result"),
            )
        ]
    )
    return last_entries(log, n).select("run_id", "seq", F.posexplode(messages).alias("part", "message")).select(
        "run_id", (F.col("seq") * 3 + F.col("part")).alias("position"), "message.*"
    )


def _task_line(number: Column) -> Column:
    return F.concat(F.lit("- "), number.cast("string"), F.lit(". "), F.col("task"), F.lit("\n")).alias("line")


def future_tasks(plan: DataFrame, index: str = "index") -> DataFrame:
    """Lines of the tasks after the run's current index; the first is labelled index + 1."""
    return plan.where(F.col("seq") > F.col(index)).select("run_id", "seq", _task_line(F.col("seq")))


def executed_tasks(plan: DataFrame, index: str = "index") -> DataFrame:
    """Lines of the tasks up to the run's current index, numbered from 1."""
    return plan.where(F.col("seq") <= F.col(index)).select("run_id", "seq", _task_line(F.col("seq") + 1))


def joined(df: DataFrame, keys: list[str], text: str, order: str, separator: str, alias: str) -> DataFrame:
    """Texts of each key joined in order. Only for groups a rank filter has bounded."""
    pairs = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p[text]), separator).alias(alias))


def append_entries(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Log with new entries numbered after the run's last one; `entries` has one row per run."""
    ends = log.groupBy("run_id").agg(F.max("seq").alias("end"))
    numbered = entries.join(ends, "run_id", "left").withColumn("seq", F.coalesce(F.col("end") + 1, F.lit(0))).drop("end")
    return log.unionByName(numbered.select(*log.columns))
