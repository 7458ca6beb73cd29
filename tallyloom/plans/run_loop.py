"""Control logic of runs, for a whole table of runs at a time.

Routing is column expressions. A step is a DataFrame -> DataFrame function
applied to every active run at once; models and code executors are the caller's
column functions or mapInPandas steps. Each round is written to durable storage,
so the plan stays short and a lost executor only re-reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.scratch import materialize

# Step names and limits.
END = "__end__"
NEXT_TASK = "enhancer"
REFLECT = "reflect_on_error"
FAIL = "fail"
MAX_ITERATIONS = 4
DEBUG_UNTIL = 3
STEP_CAP = 50
UNFINISHED = "step_cap"

Step = Callable[[DataFrame], DataFrame]


def plan_route(index: Column, plan: Column) -> Column:
    """Ends a run after its last task, and one without tasks."""
    return F.when(F.coalesce(index >= F.size(plan) - 1, F.lit(True)), F.lit(END)).otherwise(F.lit(NEXT_TASK))


def attempt_route(error: Column, iterations: Column, max_iterations: int = MAX_ITERATIONS) -> Column:
    """After executing code: finish, reflect and try again, or give up."""
    failed = error == "yes"
    return (
        F.when(failed & (iterations > max_iterations), F.lit(FAIL))
        .when(failed, F.lit(REFLECT))
        .otherwise(F.lit(END))
    )


def prompt_choice(error: Column, iterations: Column) -> Column:
    return (
        F.when((error == "yes") & (iterations <= DEBUG_UNTIL), F.lit("debug"))
        .when(error == "yes", F.lit("new_solution"))
        .otherwise(F.lit("generate"))
    )


def replanned(changes_needed: Column, new_plan: Column, old_plan: Column) -> Column:
    """The new plan where changes are needed; the old one otherwise or when the answer could not be read."""
    return F.when(F.coalesce(changes_needed, F.lit(False)) & new_plan.isNotNull(), new_plan).otherwise(old_plan)


def repeat(runs: DataFrame, step: Step, route: Column, stop: list[str], cap: int = STEP_CAP) -> DataFrame:
    """Apply `step` to the runs whose `route` is not a stop until all have stopped; adds `route`.

    Stopped runs are set aside after each round, so a round costs what is still
    active. Runs that have not stopped after `cap` rounds get the route `step_cap`;
    a null route stops nothing.
    """
    finished = []
    active = runs
    for _ in range(cap):
        active = materialize(active.drop("route").transform(step).withColumn("route", route), "runs")
        halted = F.coalesce(F.col("route").isin(stop), F.lit(False))
        finished.append(active.where(halted))
        active = active.where(~halted)
        if active.isEmpty():
            break
    whole = active.withColumn("route", F.lit(UNFINISHED))
    for part in finished:
        whole = whole.unionByName(part)
    return whole


def solve_task(runs: DataFrame, generate: Step, execute: Step, reflect: Step, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Generate and execute until the code runs or the limit is passed; both steps count towards `iterations`.

    `reflect` sees only failed attempts and is applied before they are generated again.
    """

    def attempt(df: DataFrame) -> DataFrame:
        failed = F.coalesce((F.col("error") == "yes") & (F.col("iterations") > 0), F.lit(False))
        again, fresh = df.where(failed), df.where(~failed)
        ready = fresh.unionByName(again.transform(reflect))
        counted = F.col("iterations") + 1
        return (
            ready.transform(generate).withColumn("iterations", counted)
            .transform(execute).withColumn("iterations", counted)
        )

    route = attempt_route(F.col("error"), F.col("iterations"), max_iterations)
    return repeat(runs, attempt, route, [END, FAIL]).withColumnRenamed("route", "outcome")


def run_plan(runs: DataFrame, enhance: Step, solve: Step, cap: int = STEP_CAP) -> DataFrame:
    """Work through each run's plan: advance the index, enhance the task, solve it, until the last one is done."""

    def task(df: DataFrame) -> DataFrame:
        return df.withColumn("index", F.col("index") + 1).transform(enhance).transform(solve)

    return repeat(runs, task, plan_route(F.col("index"), F.col("planned_tasks")), [END], cap)
