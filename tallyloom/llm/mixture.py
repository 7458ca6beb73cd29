"""Mixing sources to target weights by a low-discrepancy schedule.

Sources get shares of the words to take. The points of the golden-ratio sequence,
mapped through the cumulative shares, say which source fills each slot, so that
every stretch of the schedule holds the sources in nearly their shares. A source's
documents stand in a shuffled order, twice over, cut into blocks of equally many
words; the source's n-th slot takes its n-th block. The schedule is settled at its end:
each source has the blocks of its target, rounded to words and one at least, and no
more, and of its last block only the words still due.

Defined cases: a null or blank text has no words and is never taken. Null is a
source, the last one. Rows are mixed row by row; rows equal in doc_id and text are
interchangeable. An empty table gives an empty mix. Order and schedule depend on
the data and SEED only, so reruns agree. Extra columns are ignored by `mix` and
passed on by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.prefix import numbered, numbered_in_groups
from tallyloom.scratch import materialize

#: By the source's place in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a multiple of all words; and the most of a source or document.
BUDGET, PASSES = 1.5, 2
#: Slots of the schedule at most: the resolution of the shares. A block holds 1 / SLOTS of the budget, one word at least.
SLOTS = 1 << 20
SEED = 11
_GOLDEN = 0.6180339887498949
_BINS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source of `sizes` (source, size): source, number, source_size, target.

    Targets share the budget by weight. A target above PASSES times its source's
    size stops there and the excess goes to the others by weight, until none is
    above. Each round sends two numbers to the driver.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = numbered(per_source, [F.col("source").asc_nulls_last()], F.lit(0)).drop("before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    per_source = materialize(per_source.withColumn("weight", weight), "sources")
    most = PASSES * F.col("source_size")
    budget = BUDGET * (per_source.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while budget:
        above = F.col("weight") * level > most
        row = per_source.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)).alias("stopped_words"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
            F.count(F.when(above, 1)).alias("stopped"),
        ).first()
        if row.stopped == stopped or not row.weight:
            break
        level, stopped = (budget - row.stopped_words) / row.weight, row.stopped
    return per_source.withColumn("target", F.least(most.cast("double"), F.col("weight") * level)).drop("weight")


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """(slot, number, block): which source fills a slot, and with which of its blocks. `shares` has number and target."""
    laid = shares.where("target > 0").select(F.col("number").alias("source_number"), "target")
    laid = numbered(laid, [F.col("source_number")], F.col("target"))
    total = shares.agg(F.sum("target")).first()[0]
    low, high = F.col("before") / total, (F.col("before") + F.col("target")) / total
    # Each source stands in every bin that its interval touches; the last interval is closed by the bin's end.
    parts = laid.select("source_number", low.alias("low"), high.alias("high"))
    last = parts.agg(F.max("high")).first()[0]
    parts = parts.withColumn("high", F.when(F.col("high") >= last, 2.0).otherwise(F.col("high")))
    bins = F.sequence(F.floor(F.col("low") * _BINS), F.least(F.floor(F.col("high") * _BINS), F.lit(_BINS - 1)))
    parts = parts.withColumn("bin", F.explode(bins))
    points = shares.sparkSession.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 1) * _GOLDEN) % 1.0).alias("point"))
    points = points.withColumn("bin", F.least(F.floor(F.col("point") * _BINS), F.lit(_BINS - 1)))
    owned = points.join(parts, "bin").where("low <= point AND point < high").select("slot", "source_number")
    ranked = numbered_in_groups(owned, "source_number", F.expr("slot div 4096"), [F.col("slot")], F.lit(0))
    return ranked.select("slot", F.col("source_number").alias("number"), F.col("number").alias("block"))


def settled(order: DataFrame, shares: DataFrame, block: int) -> DataFrame:
    """(number, block, due): the blocks of each source in `order` up to its target, those that the schedule left out added, and how many words of each are taken."""
    due = F.least(F.greatest(F.round("target"), F.lit(1.0)).cast("long"), PASSES * F.col("source_size"))
    given = order.groupBy(F.col("number").alias("g_number")).agg(F.count("*").alias("given"))
    goals = shares.where("target > 0").select("number", due.alias("goal")).withColumn("blocks", F.expr(f"(goal + {block - 1}) div {block}"))
    goals = materialize(goals.join(given, F.col("number") == F.col("g_number"), "left").select("number", "goal", "blocks", F.coalesce("given", F.lit(0)).alias("given")), "goals")
    words = F.least(F.lit(block), F.col("goal") - F.col("block") * block).alias("due")
    on = goals.select(F.col("number").alias("o_number"), "goal", "blocks")
    taken = order.join(on, F.col("number") == F.col("o_number")).where("block < blocks").select("number", "block", words)
    added = goals.where("given < blocks").withColumn("block", F.explode(F.sequence("given", F.col("blocks") - 1))).select("number", "block", words)
    return taken.union(added)


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, print (hash of the text), size, source, source_size, target, taken, uses (passes that take some of its words)."""
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.xxhash64(text).alias("print"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = materialize(rows.withColumn("draw", F.xxhash64(F.lit(SEED), "id", "print")), "sizes")
    shares = materialize(targets(rows), "targets")
    budget = shares.agg(F.sum("target")).first()[0] or 0
    block = max(1, int(budget // SLOTS))
    slots = int(budget // block)

    known = shares.select(F.col("source").alias("s_source"), F.col("number").alias("source_number"), "source_size", "target")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    placed = numbered_in_groups(placed, "source_number", F.shiftright("draw", 54), [F.col("draw"), F.col("id"), F.col("size")], F.col("size"))
    placed = materialize(placed.drop("draw", "bucket"), "shuffled")
    starts = F.transform(F.sequence(F.lit(0), F.lit(PASSES - 1)), lambda i: i * F.col("source_size") + F.col("before"))
    passes = placed.where("size > 0").select("source_number", "number", "size", F.explode(starts).alias("start"))
    cut = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    pieces = passes.withColumn("block", F.explode(cut))
    words = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("due")) - F.greatest(F.col("start"), F.col("block") * block)
    order = schedule(shares, slots) if slots else None
    if order is None:
        return placed.select("id", "print", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("uses")).withColumnRenamed("id", id_column)
    order = settled(order, shares, block).select(F.col("number").alias("o_source"), F.col("block").alias("o_block"), "due")
    took = pieces.join(order, (F.col("source_number") == F.col("o_source")) & (F.col("block") == F.col("o_block"))).withColumn("words", words).where("words > 0")
    took = took.groupBy(F.col("source_number").alias("t_source"), F.col("number").alias("t_number")).agg(F.sum("words").alias("taken"), F.countDistinct("start").alias("uses"))
    found = placed.join(took, (F.col("source_number") == F.col("t_source")) & (F.col("number") == F.col("t_number")), "left")
    return found.select(
        F.col("id").alias(id_column), "print", "size", "source", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("uses", F.lit(0)).cast("int").alias("uses"),
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs`, each once for every pass of the mix that takes words of it, with all columns."""
    taken = mix(docs, id_column, text, source).where("uses > 0").groupBy(F.col(id_column).alias("m_id"), F.col("print").alias("m_print")).agg(F.max("uses").alias("uses_"))
    found = docs.join(taken, F.col(id_column).eqNullSafe(F.col("m_id")) & (F.xxhash64(text) == F.col("m_print")))
    return found.withColumn("use_", F.explode(F.sequence(F.lit(1), F.col("uses_")))).select(*(docs[c] for c in docs.columns))
