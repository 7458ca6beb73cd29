"""Views over the ordered arrays kept in one run record.

A run record holds its plan as an array of strings and its log as an array of
(task, code, result) structs. For logs kept as one row per entry see
`tallyloom.operators.history`, which never gathers a run into one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import templates as t
from tallyloom.functions.text import truncate


def last(items: Column, n: int | Column) -> Column:
    """The last n items, in order; all of them when there are fewer."""
    size = F.size(items)
    count = F.greatest(F.least(F.lit(n) if isinstance(n, int) else n, size), F.lit(0))
    return F.when(count > 0, F.slice(items, size - count + 1, count)).otherwise(F.slice(items, 1, 0))


def newest_first(items: Column, n: int) -> Column:
    """Slice [:-n:-1]: n-1 items from the end, newest first; n = -1 means n = size, which leaves out the oldest, as n = 0 does."""
    count = F.size(items) - 1 if n in (-1, 0) else F.lit(n - 1)
    return F.reverse(last(items, count))


def executed_codes(codes: Column, n: int = -1) -> Column:
    cells = F.transform(newest_first(codes, n), lambda code: F.concat(F.lit(t.CODE_CELL), code))
    return F.array_join(cells, "")


def previous_results(entries: Column, n: int = 2) -> Column:
    """The last n (task, code, result) entries as text, newest first, long results cut."""
    texts = F.transform(
        F.reverse(last(entries, n)), lambda e: t.fill(t.PREVIOUS_RESULT, e["task"], e["code"], truncate(e["result"]))
    )
    return F.when(F.size(entries) == 0, F.lit(t.NO_PREVIOUS_RESULT)).otherwise(F.array_join(texts, "\n"))


def history(entries: Column, n: int) -> Column:
    """Three (role, text) messages per entry for the last n entries, oldest first."""

    def messages(e: Column) -> Column:
        def message(role: str, layout: str, field: str) -> Column:
            return F.struct(F.lit(role).alias("role"), t.fill(layout, e[field]).alias("text"))

        return F.array(
            message("human", t.TASK_MESSAGE, "task"),
            message("ai", t.CODE_MESSAGE, "code"),
            message("human", t.RESULT_MESSAGE, "result"),
        )

    return F.flatten(F.transform(last(entries, n), messages))


def _task_line(number: Column, task: Column) -> Column:
    return F.concat(F.lit("- "), number.cast("string"), F.lit(". "), task, F.lit("\n"))


def future_tasks(plan: Column, index: Column) -> Column:
    """Tasks after the current one; numbers continue from the current index."""
    done = F.greatest(index + 1, F.lit(0))
    rest = last(plan, F.size(plan) - done)
    return F.array_join(F.transform(rest, lambda task, i: _task_line(index + i + 1, task)), "")


def executed_tasks(plan: Column, index: Column) -> Column:
    """Tasks up to and including the current one, numbered from 1."""
    done = F.slice(plan, F.lit(1), F.greatest(index + 1, F.lit(0)))
    lines = F.array_join(F.transform(done, lambda task, i: _task_line(i + 1, task)), "")
    return F.when(index + 1 <= 0, F.lit(t.NOTHING_EXECUTED)).otherwise(F.concat(F.lit(t.EXECUTED_HEADER), lines))


def current_task(plan: Column, index: Column) -> Column:
    return F.get(plan, index)


def append_entry(entries: Column, entry: Column) -> Column:
    return F.concat(entries, F.array(entry))


def result_of(results: Column, task: Column) -> Column:
    """Result recorded for a task in a map, or the default text."""
    return F.coalesce(F.try_element_at(results, task), F.lit(t.NO_RESULT))


def fold_summary(entries: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Rolling summary: merge(summary, entry) over the entries in order."""
    return F.aggregate(entries, start, merge)
