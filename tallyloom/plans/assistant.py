"""Questions answered from memory and documents, and examples remembered: memory, retrieval and logs in one step.

Memories are items (owner, importance, seq, text). Models are the caller's column
functions. Each function returns what was computed and the rows to append, so the
caller writes both with the sinks of its tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import templates
from tallyloom.functions.text import join_blocks
from tallyloom.operators.memory import MAX_ITEMS, memory_text, strongest
from tallyloom.operators.ranking import top_n_per_key
from tallyloom.operators.retrieval import HITS, look_up, nearest, ranked

# How important an answer and a finished task are.
ANSWER_IMPORTANCE, TASK_IMPORTANCE = 1.0, 2.0
ITEM = ["owner", "importance", "seq", "text"]


def remember(items: DataFrame, new: DataFrame, n: int = MAX_ITEMS) -> DataFrame:
    """Memory after adding `new` (owner, importance, text), and the n strongest stay. New items go to the end of their owner's in
    the order of their importance, greatest first, and then of their text; more than n of one owner never leave their task."""
    last = items.groupBy("owner").agg(F.max("seq").alias("last"))
    best = top_n_per_key(new, ["owner"], [F.desc("importance"), F.asc("text")], n, rank="place")
    added = best.join(last, "owner", "left").withColumn("seq", F.coalesce(F.col("last"), F.lit(-1)) + F.col("place"))
    return strongest(items.select(*ITEM).unionByName(added.select(*ITEM)), "owner", "importance", "seq", n).select(*ITEM)


def ask(
    items: DataFrame, vectors: DataFrame, documents: DataFrame, query: list[float], question: str, model: Callable[[Column, Column], Column],
    *, where: Column | None = None, k: int = HITS, id_column: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """(answers, memory): every owner's question with its memories, answered by `model(context, question)` and remembered.

    The context is the texts of the k nearest documents that `where` lets through,
    fetched once for all owners.
    """
    hits = ranked(nearest(vectors, query, k, id_column=id_column, where=where).select(id_column, "distance"))
    found = look_up(hits, documents, id_column)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"])
    context = found.agg(join_blocks(texts).alias("context")).first()[0]
    memories = memory_text(items, "owner", "importance", "seq", "text")
    asked = templates.question_with_memory(F.col("memories"), F.lit(question))
    answers = memories.select("owner", asked.alias("question")).withColumn("answer", model(F.lit(context), F.col("question")))
    said = templates.answered_question(F.lit(question), F.col("answer"))
    new = answers.select("owner", F.lit(ANSWER_IMPORTANCE).alias("importance"), said.alias("text"))
    return answers, remember(items, new)


def add_examples(
    items: DataFrame, examples: DataFrame, summarize: Callable[[Column, Column, Column], Column], embed: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, vectors, memory) for finished tasks (owner, id, task, code, result): one per owner at a time.

    The row and the vector of a task carry the same id; what is remembered is the
    task with the updated summary.
    """
    rows = examples.select("id", "task", "code", "result")
    vectors = examples.select("id", F.col("task").alias("text"), embed(F.col("task")).alias("embedding"), F.create_map(F.lit("source"), F.lit("enhanced task")).alias("metadata"))
    summary = templates.task_summary(F.col("task"), summarize(F.col("task"), F.col("code"), F.col("result")))
    new = examples.select("owner", F.lit(TASK_IMPORTANCE).alias("importance"), summary.alias("text"))
    return rows, vectors, remember(items, new)
