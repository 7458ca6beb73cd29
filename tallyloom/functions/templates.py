"""Fixed text layouts of run records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts that readers of these texts rely on.
PLANNED_TASK = "\n<TaskTitle>\n%s\n</TaskTitle>\n<TaskDetails>\n%s\n</TaskDetails>\n\n"
TASK_TEXT = ["**the Task:**", "**code genratin recommendations:**\n", "============"]
PREVIOUS_RESULT = "<Task>%s</Task>\n<Code>%s</Code>\nResult:\n%s\n"
CODE_CELL = "\n# %% \n\n#############################\n\n"
EXECUTED_HEADER = "** Number of executed tasks: ** \n "
NOTHING_EXECUTED = "NO Task Executed"
NO_PREVIOUS_RESULT = "No previous results available."
NO_RESULT = "No result available"
TASK_MESSAGE = "<Task>\n%s\n</Task>"
CODE_MESSAGE = "<CODE>\n%s\n</CODE>"
RESULT_MESSAGE = "Result is :\n\n%s"
MEMORY_QUESTION = "Context: %s\n\nQuestion: %s"
MEMORY_ANSWER = "Q: %s\nA: %s"
MEMORY_SUMMARY = "Task: %s\nResult Summary: %s"
DATA_PATHS = "\n\n\n---\n trian dataset path: ~/train.csv \n\n\n---\n test dataset path: ~/test.csv"
PROBLEM_DOCUMENT = """
# %s
## problem description:
%s

Data set Info

### quantitative_analysis
%s

### qualitative_analysis
%s

## scraped data

### dataset_info
%s

### evaluation_metric
%s

"""


def fill(layout: str, *values: Column) -> Column:
    """`layout` with each %s replaced by a value, in order; a null value reads None."""
    pieces = layout.split("%s")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [F.coalesce(value.cast("string"), F.lit("None")), F.lit(piece)]
    return F.concat(*parts)


def planned_task(title: Column, details: Column) -> Column:
    return fill(PLANNED_TASK, title, details)


def task_text(task: Column, recommendation: Column) -> Column:
    heading, advice, rule = (F.lit(t) for t in TASK_TEXT)
    return F.concat_ws("\n", heading, task, advice, recommendation, rule)


def problem_document(name, description, quantitative, qualitative, dataset_info, metric) -> Column:
    return fill(PROBLEM_DOCUMENT, name, description, quantitative, qualitative, dataset_info, metric)


def numbered_lines(items: Column) -> Column:
    """`1. first`, `2. second`, ... one per line."""
    numbered = F.transform(items, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item))
    return F.array_join(numbered, "\n")


def dataset_info(details: Column) -> Column:
    return F.concat(details, F.lit(DATA_PATHS))


def question_with_memory(memories: Column, question: Column) -> Column:
    return fill(MEMORY_QUESTION, memories, question)


def answered_question(question: Column, answer: Column) -> Column:
    """What is remembered of an answered question."""
    return fill(MEMORY_ANSWER, question, answer)


def task_summary(task: Column, summary: Column) -> Column:
    """What is remembered of a finished task."""
    return fill(MEMORY_SUMMARY, task, summary)
