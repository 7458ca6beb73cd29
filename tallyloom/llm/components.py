"""Connected components of a table of links, and candidate pairs of buckets without all pairs.

Links stay in tables; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.scratch import drop, materialize, release

#: Further rounds in which one member of a bucket is compared with the others.
ROUNDS = 3
#: Members of a bucket that are compared with each other at once; only larger buckets go through the rounds.
FEW = 64

Condition = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b of one orderable type); root is the smallest node that can be reached.

    Each round points every node at the neighbour that comes first in a random
    order, and replaces the ends of all links by what they point at. The number
    of nodes with links at least halves on average, so the rounds grow with the
    logarithm of the input. Intermediate links are stored. Null ends and links of
    a node with itself are ignored.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left = materialize(links.where("a != b").select("a", "b").distinct(), "links")
    steps = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("first"))
        step = materialize(first.select(F.col("a").alias("node"), F.least("first", order("a"))["n"].alias("next")), "step")
        steps.append(step)
        # All ends have a step. Left joins, as links compress well and are many more rows than Spark takes them for: they must not be sent to the driver.
        moved = (
            left.join(step, F.col("a") == F.col("node"), "left").select(F.col("next").alias("a"), "b")
            .join(step, F.col("b") == F.col("node"), "left").select("a", F.col("next").alias("b"))
        )
        before, left = left, materialize(moved.where("a != b").distinct(), "links")
        drop(before)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        on = step.select(F.col("node").alias("at"), F.col("next").alias("then"))
        found = found.join(on, F.col("next") == F.col("at"), "left").select("node", F.coalesce("then", "next").alias("next"))
    found = materialize(found, "found")
    roots = found.groupBy(F.col("next").alias("at")).agg(F.min("node").alias("root"))
    done = materialize(found.join(roots, F.col("next") == F.col("at")).select("node", "root"), "components")
    drop(*steps, found)
    return done


def _possible(pairs: DataFrame, attributes: DataFrame | None, condition: Condition | None) -> DataFrame:
    """The pairs (a, b) of nodes whose attributes meet the condition."""
    if condition is None or attributes is None:
        return pairs
    own = F.struct(*[c for c in attributes.columns if c != "node"])
    both = pairs
    for end in ("a", "b"):
        both = both.join(attributes.select(F.col("node").alias(end), own.alias(f"of_{end}")), end)
    return both.where(condition(lambda c: F.col(f"of_a.{c}"), lambda c: F.col(f"of_b.{c}"))).select("a", "b")


def linked_groups(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    to_heaviest: Condition | None = None,
    to_each_other: Condition | None = None,
    attributes: DataFrame | None = None,
    spend: bool = False,
) -> DataFrame:
    """(node, root) of the nodes that verified links join, where only nodes in one bucket can be linked.

    `members` has columns bucket, node, weight; it is read several times, so give a stored
    table. Columns that the conditions read stand once for each node in `attributes`, also a stored table.
    `verify` takes distinct pairs (a, b) and returns those that are linked; tables that it stores for this may be listed in
    `verify.spent`, and are deleted once the linked pairs are stored. `spend` says that `members` may be deleted too.

    Of buckets that hold the same nodes one is enough: they are known by the number of their nodes, a sum of the nodes'
    hashes and their heaviest node. A bucket is not expanded into pairs. Its heaviest node is compared with all
    others first, which joins a group of copies in as many comparisons as it has
    members; in ROUNDS further rounds another member of each bucket of more than FEW that still holds several groups is. Only nodes of one bucket that are then still in different groups are
    compared with each other, so no link between groups is lost. The conditions say
    which pairs of either kind are candidates at all; each takes two functions from
    a column's name to the column of one member, and holds for (x, y) where it holds for (y, x).
    Pairs with heaviest nodes are made distinct before attributes are looked up for them.
    """
    def linked(pairs: DataFrame, label: str) -> DataFrame:
        found = materialize(verify(pairs).select("a", "b"), label)
        spent = getattr(verify, "spent", [])
        drop(*spent)
        spent.clear()
        release(found.sparkSession)
        return found

    hashed = F.xxhash64("node")
    first = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(F.shiftright(hashed, 32)).alias("s"), F.max(F.struct("weight", "node")).alias("pivot")
    )
    kept = first.where("n > 1").groupBy("n", "x", "s", F.col("pivot.node").alias("pivot")).agg(F.min("bucket").alias("bucket"))
    kept = materialize(kept.select("bucket", "pivot"), "pivots")
    shared = materialize(members.select("bucket", "node").join(kept, "bucket"), "shared")
    drop(kept, *([members] if spend else []))
    release(members.sparkSession)
    stars = shared.where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    stars = linked(_possible(stars, attributes, to_heaviest), "stars")
    groups = components(stars)
    drop(stars)

    def placed(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold several groups, with their groups."""
        own = rows.join(groups.withColumnRenamed("node", "g_node"), F.col("node") == F.col("g_node"), "left")
        own = own.withColumn("root", F.coalesce("root", "node")).drop("g_node")
        mixed = own.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low != high").select("bucket", "n")
        return materialize(own.join(mixed, "bucket").select("bucket", "node", "root", "n"), "placed")

    # A member that has been compared with all others of its bucket has no part in further rounds.
    left = placed(shared.where("node != pivot").select("bucket", "node"))
    drop(shared)
    release(members.sparkSession)
    few, left, spent = left.where(F.col("n") <= FEW).select("bucket", "node"), left.where(F.col("n") > FEW), []
    for round_ in range(ROUNDS):
        if left.isEmpty():
            break
        # One more member, another in each round, is compared with all that are in other groups.
        chosen = left.groupBy("bucket").agg(F.max(F.struct(F.xxhash64(F.lit(round_), "node").alias("h"), "node", "root")).alias("pivot"))
        chosen = materialize(chosen, "chosen")
        others = left.join(chosen, "bucket").where("node != pivot.node")
        more = others.where("root != pivot.root").select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
        more = linked(_possible(more, attributes, to_heaviest), "stars")
        if not more.isEmpty():
            groups = components(groups.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        rest, before = others.select("bucket", "node"), [*spent, chosen]
        left = placed(rest)
        drop(*before)
        spent = [left]
        release(members.sparkSession)
    left = placed(few.union(left.select("bucket", "node"))).drop("n")
    left = left if attributes is None else left.join(attributes, "node")
    x, y = left.alias("x"), left.alias("y")
    condition = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    if to_each_other:
        condition &= to_each_other(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    pairs = x.join(y, condition).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = linked(pairs, "more")
    if more.isEmpty():
        return groups
    return components(groups.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
