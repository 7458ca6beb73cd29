"""Exact order statistics without a single-task sort.

`value_counts` reduces rows to (column_name, value, n) with map-side combining,
so a value that fills a third of the table costs one row per task.
`order_counts` range-partitions those distinct values into ordered blocks and
writes them down. Block sizes (one row per partition and column) say which block
holds a rank, and only that block is then put in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyloom.local import local_table
from tallyloom.scratch import materialize

MAX_BLOCK = 2_000_000
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def without_nan(df: DataFrame, name: str):
    """The column with NaN turned into null, so there is one notion of missing."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def _count(df: DataFrame, columns: list[str], cells: list[dict]) -> DataFrame:
    """Counted cells per column. Columns go by number until rows have been combined: short keys hash faster."""
    numbered = [
        F.struct(F.lit(i).alias("place"), *[value.alias(key) for key, value in cell.items()]) for i, cell in enumerate(cells)
    ]
    long = df.select(F.inline(F.array(*numbered))).where(F.col("value").isNotNull())
    keys = list(cells[0])
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("place")).alias("column_name")
    return long.groupBy("place", *keys).agg(F.count("*").alias("n")).select(name, *keys, "n")


def value_counts(df: DataFrame, columns: list[str], kind: T.DataType | None = None) -> DataFrame:
    """(column_name, value, n) over the non-missing values of columns that share a type."""
    values = [without_nan(df, name) for name in columns]
    return _count(df, columns, [{"value": v.cast(kind) if kind else v} for v in values])


@dataclass(frozen=True)
class Block:
    block: int
    rows: int
    distinct: int
    below: int
    low: object
    high: object
    total: float | None  # sum of all values, for numbers


@dataclass(frozen=True)
class OrderedCounts:
    """Distinct values in ordered blocks on durable storage, and the size of each block."""

    values: DataFrame  # column_name, value, n, block
    blocks: dict[str, list[Block]]

    def total(self, column: str) -> int:
        return sum(b.rows for b in self.blocks.get(column, []))

    def distinct(self, column: str) -> int:
        return sum(b.distinct for b in self.blocks.get(column, []))

    def mean(self, column: str) -> float | None:
        rows = self.total(column)
        return sum(b.total for b in self.blocks[column]) / rows if rows else None

    def bounds(self, column: str) -> tuple:
        blocks = self.blocks.get(column)
        return (blocks[0].low, blocks[-1].high) if blocks else (None, None)

    def at_ranks(self, ranks: dict[str, list[int]], max_block: int = MAX_BLOCK) -> DataFrame:
        """(column_name, rank, value) at 0-based ascending ranks, a few per column.

        A block with more than `max_block` distinct values is laid out once more
        in finer blocks before it is put in order, so the work of one task does
        not depend on the partition count of the session.
        """
        direct, parts = [], []
        for column, wanted in ranks.items():
            for b in self.blocks.get(column, []):
                inside = [rank for rank in sorted(set(wanted)) if b.below <= rank < b.below + b.rows]
                if inside and b.distinct > max_block:
                    one = self.values.where((F.col("column_name") == column) & (F.col("block") == b.block)).drop("block")
                    finer = order_counts(one, partitions=2 * ceil(b.distinct / max_block))
                    found = finer.at_ranks({column: [rank - b.below for rank in inside]}, max_block)
                    parts.append(found.withColumn("rank", F.col("rank") + F.lit(b.below)))
                else:
                    direct += [(column, b.block, rank, rank - b.below) for rank in inside]
        return reduce(DataFrame.unionByName, parts, self._in_blocks(direct))

    def _in_blocks(self, located: list[tuple[str, int, int, int]]) -> DataFrame:
        """Values at (column, block, rank, offset in block); each block is ordered under a short number of its own."""
        spark = self.values.sparkSession
        slots = {key: i for i, key in enumerate(sorted({(c, b) for c, b, _, _ in located}))}
        named = local_table(spark, [(*key, i) for key, i in slots.items()], "column_name string, block int, slot int")
        requests = local_table(
            spark, [(slots[c, b], c, r, o) for c, b, r, o in located], "slot int, column_name string, rank long, offset long"
        )
        wanted = [(F.col("column_name") == c) & (F.col("block") == b) for c, b in slots]
        order = W.partitionBy("slot").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
        return (
            self.values.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))
            .join(F.broadcast(named), ["column_name", "block"])
            .select("slot", "value", "n", F.sum("n").over(order).alias("upto"))
            .join(F.broadcast(requests), "slot")
            .where((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("n")))
            .select("column_name", "rank", "value")
        )


def order_counts(counts: DataFrame, partitions: int | None = None) -> OrderedCounts:
    """Lay (column_name, value, n) out in ordered blocks and collect the block sizes.

    The driver receives one row per partition and column it holds.
    """
    count = [partitions] if partitions else []
    ranged = counts.repartitionByRange(*count, "column_name", "value")
    values = materialize(ranged.withColumn("block", F.spark_partition_id()), "ordered-counts")
    is_number = isinstance(values.schema["value"].dataType, T.NumericType)
    sizes = values.groupBy("column_name", "block").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("distinct"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        (F.sum(F.col("value").cast("double") * F.col("n")) if is_number else F.lit(None)).alias("total"),
    )
    blocks: dict[str, list[Block]] = {}
    for row in sorted(sizes.collect(), key=lambda r: (r.column_name, r.block)):
        before = blocks.setdefault(row.column_name, [])
        below = before[-1].below + before[-1].rows if before else 0
        before.append(Block(row.block, row.rows, row.distinct, below, row.low, row.high, row.total))
    return OrderedCounts(values, blocks)


#: Ranks that the quantile sketch may be off by, as a share of the rows, is one over this.
SKETCH_ACCURACY = 10_000


def values_at_ranks(df: DataFrame, numbers: dict[str, Column], ranks: dict[str, list[int]], totals: dict[str, int]) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ascending ranks of some number columns, by (name, rank); a few per column reach the driver.

    A sketch brackets each rank, a second scan counts what lies below the bracket
    and puts in order only what lies inside, a few ten-thousandths of the rows. Should
    a bracket miss its rank, that column is put in order whole.
    """
    names = [name for name in numbers if totals[name]]
    wanted = [(name, rank) for name in names for rank in sorted(set(ranks[name]))]
    if not wanted:
        return {}
    # Each value once more under a short name, so that it is computed before the sketches and counts.
    plain = df.select(*[numbers[name].cast("double").alias(f"v{i}") for i, name in enumerate(names)])
    place = {name: f"v{i}" for i, name in enumerate(names)}
    slack = 2 / SKETCH_ACCURACY

    def share(name: str, rank: int, off: float) -> float:
        return min(1.0, max(0.0, rank / max(1, totals[name] - 1) + off))

    shares = {name: [share(name, rank, off) for rank in sorted(set(ranks[name])) for off in (-slack, slack)] for name in names}
    found = plain.agg(*[F.percentile_approx(place[name], shares[name], SKETCH_ACCURACY).alias(place[name]) for name in names]).first()
    brackets = {}
    for name in names:
        for i, rank in enumerate(sorted(set(ranks[name]))):
            brackets[name, rank] = found[place[name]][2 * i], found[place[name]][2 * i + 1]
    counts = plain.agg(*[
        F.count(F.when(F.col(place[name]) < brackets[name, rank][0] if below else F.col(place[name]) <= brackets[name, rank][1], True)).alias(f"{kind}{i}")
        for i, (name, rank) in enumerate(wanted) for kind, below in (("below", True), ("upto", False))
    ]).first()
    held = [i for i, (_, rank) in enumerate(wanted) if counts[f"below{i}"] <= rank < counts[f"upto{i}"]]
    bands = [F.when(F.col(place[wanted[i][0]]).between(*brackets[wanted[i]]), F.col(place[wanted[i][0]])).alias(str(i)) for i in held]
    out: dict[tuple[str, int], float] = {}
    if held:
        ordered = order_counts(value_counts(plain.select(*bands), [str(i) for i in held]))
        for row in ordered.at_ranks({str(i): [wanted[i][1] - counts[f"below{i}"]] for i in held}).collect():
            out[wanted[int(row.column_name)]] = row.value
    missed = {wanted[i][0] for i in range(len(wanted)) if i not in held}
    if missed:
        whole = order_counts(value_counts(plain.select(*[F.col(place[name]).alias(place[name]) for name in missed]), [place[name] for name in missed]))
        for row in whole.at_ranks({place[name]: [r for n, r in wanted if n == name] for name in missed}).collect():
            out[names[int(row.column_name[1:])], row.rank] = row.value
    return out
