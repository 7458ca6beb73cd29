"""Near-duplicate vectors by iterative quantisation.

Vectors of length one are centred (unless there are too few to have a centre), turned into their principal axes, and rotated so
that their signs lose little: binary codes with balanced bits. Two such rotations
give two codes, and more where vectors have a strong common mean. Each code is cut into substrings, one Hamming table each; a vector
stands in a table under its substring and under all that differ in one bit, so
vectors whose substrings differ in at most two bits meet. Pairs with close codes are
compared by the cosine of the vectors themselves, in double precision.

The rotations are fitted on at most FIT_ROWS vectors, and there are as many as pairs measured on the sample need to meet; every vector is indexed.

Defined cases: vectors are compared within one label only. A null label, and a vector
that is null, empty, zero, or holds null, NaN or infinity, is linked to none. Vectors of
different lengths are not compared. Equal vectors are one class, compared once, and
count as links of each other. Rows are counted one by one. A null id is allowed; the
smallest id of a group without ids is a negative number made from the vector. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.sample import drawn
from tallyloom.scratch import materialize

LEAST = 0.93
FIT_ROWS = 20_000
ROTATIONS, TABLES, TABLE_BITS = 2, 3, 21
#: Bits in which both codes together may differ: at a cosine of 0.93 each bit differs with probability 0.12, so 15 of 126 on average; unrelated vectors differ in 63.
CODE_BITS_APART = 34
#: Codes are added until pairs at the least cosine, made from the sample and found in it, meet with this probability, up to so many centred and plain ones.
RECALL, MAX_CENTRED, MAX_PLAIN = 0.95, 8, 4
#: Vectors and pairs of the sample that recall is measured on.
MEASURED, MEASURED_PAIRS = 2_000, 20_000
SEED = 3


def fit_rotations(sample: np.ndarray, width: int, count: int = ROTATIONS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, projection) for each code, from vectors of length one padded to `width`."""
    bits = TABLES * TABLE_BITS
    # The centre of a few vectors lies between near copies and would part them.
    mean = sample.mean(axis=0) if len(sample) > 2 * width else np.zeros(width)
    centred = sample - mean
    values, axes = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(width))
    axes = axes[:, np.argsort(-values, kind="stable")]
    # More bits than axes: further bits come from random turns of all axes.
    while axes.shape[1] < bits:
        axes = np.concatenate([axes, axes[:, :width]], axis=1)
    axes = axes[:, :bits]
    random = np.random.default_rng(SEED)
    found = []
    for _ in range(count):
        turn, _r = np.linalg.qr(random.normal(size=(bits, bits)))
        projected = centred @ axes
        for _step in range(30 if len(sample) else 0):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _s, right = np.linalg.svd(projected.T @ signs)
            turn = left @ right
        found.append((mean, axes @ turn))
    return found


def _pairs_to_measure(sample: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs the index has to find: vectors of the sample with partners made at the least cosine, and the pairs in the sample itself."""
    random = np.random.default_rng(SEED)
    x = sample[random.permutation(len(sample))[:MEASURED]]
    off = random.normal(size=x.shape) * (x != 0)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off = off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
    pairs = [(x, least * x + np.sqrt(1 - least**2) * off)]
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    if len(a):
        some = random.permutation(len(a))[:MEASURED_PAIRS]
        pairs.append((x[a[some]], x[b[some]]))
    return pairs


def fit_index(sample: np.ndarray, width: int, least: float = LEAST) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Rotations, and the bits in which all codes together may differ.

    ROTATIONS codes do unless vectors have a strong common mean: near pairs are then far apart about the centre. Further
    rotations are learned until the measured pairs meet, and where they still don't, vectors are turned without centring.
    """
    pairs = _pairs_to_measure(sample, least)
    met = [np.zeros(len(x), bool) for x, _ in pairs]
    apart = [np.zeros(len(x), int) for x, _ in pairs]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def enough() -> bool:
        return all(m.mean() >= RECALL for m in met if len(m))

    def add(rotation: tuple[np.ndarray, np.ndarray]) -> None:
        mean, projection = rotation
        found.append(rotation)
        for i, (x, y) in enumerate(pairs):
            differ = (((x - mean) @ projection >= 0) != ((y - mean) @ projection >= 0)).reshape(len(x), TABLES, TABLE_BITS).sum(axis=2)
            met[i] |= (differ <= 2).any(axis=1)
            apart[i] += differ.sum(axis=1)

    for rotation in fit_rotations(sample, width):
        add(rotation)
    if not enough():
        for rotation in fit_rotations(sample, width, MAX_CENTRED)[ROTATIONS:]:
            if not enough():
                add(rotation)
    random = np.random.default_rng(SEED + 1)
    for _ in range(MAX_PLAIN):
        if not enough():
            add((np.zeros(width), random.normal(size=(width, TABLES * TABLE_BITS))))
    # The cut loses next to none of the pairs that meet.
    seen = np.concatenate([a[m] for a, m in zip(apart, met)])
    cut = int(np.quantile(seen, 0.999)) + 1 if len(seen) else 0
    return found, max(CODE_BITS_APART * len(found) // ROTATIONS, cut)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of one width, zeros at the end."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
    at = at - at[0]
    size = np.diff(at)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(scale > 0, scale, 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _coded(classes: DataFrame, rotations, width: int) -> DataFrame:
    """(label, dim, node, codes): the substrings of all codes of each class."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_padded(batch.column("vector"), width))
            codes = []
            for mean, projection in rotations:
                bits = ((x - mean) @ projection >= 0).reshape(len(x), TABLES, TABLE_BITS)
                codes.append(bits @ (1 << np.arange(TABLE_BITS, dtype=np.int64)))
            codes = np.concatenate(codes, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "dim", "node")] + [pa.array(codes[:, i]) for i in range(codes.shape[1])], names=["label", "dim", "node", *(f"c{i}" for i in range(codes.shape[1]))])

    fields = ", ".join(f"c{i} int" for i in range(len(rotations) * TABLES))
    return classes.select("label", "dim", "node", "vector").mapInArrow(compute, f"label {classes.schema['label'].dataType.simpleString()}, dim int, node {classes.schema['node'].dataType.simpleString()}, {fields}")


def _close_pairs(coded: DataFrame, bits_apart: int) -> DataFrame:
    """(a, b) of nodes that meet in a table and whose codes are close, each pair once: in the first table where it meets, under one of the keys it shares there.

    Spark sizes the rows as if they were not exploded, so it must not choose to send them to the driver.
    """
    codes = [c for c in coded.columns if c not in ("label", "dim", "node")]
    flips = F.array(F.lit(0), *(F.lit(1 << i) for i in range(TABLE_BITS)))
    rows = coded.withColumn("own", F.array(*codes)).select("label", "dim", "node", *codes, F.posexplode("own").alias("table", "own"))
    rows = rows.select("*", F.explode(F.transform(flips, lambda f: F.col("own").bitwiseXOR(f))).alias("key"))
    x, y = rows.alias("x"), rows.alias("y")
    both = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    apart = lambda c: F.bit_count(both(c)[0].bitwiseXOR(both(c)[1]))
    diff = F.col("x.own").bitwiseXOR(F.col("y.own"))
    low = diff.bitwiseAND(-diff)
    via = F.least(F.col("x.own").bitwiseXOR(low), F.col("y.own").bitwiseXOR(low))
    one_key = F.when(F.bit_count(diff) <= 1, F.col("x.key") == F.col("x.own")).otherwise((F.bit_count(diff) == 2) & (F.col("x.key") == via))
    earlier = F.lit(False)
    for i, c in enumerate(codes):
        earlier |= (F.col("x.table") > i) & (apart(c) <= 2)
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.table") == F.col("y.table")) & (F.col("x.key") == F.col("y.key"))
    close = sum((apart(c) for c in codes[1:]), apart(codes[0])) <= bits_apart
    return x.join(y.hint("merge"), same & (F.col("x.node") < F.col("y.node")) & close & one_key & ~earlier).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _linked(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose vectors have at least this cosine. Vectors are sized as one number each, so Spark must not choose to send them to the driver."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                width = max(1, int(np.diff(part.column("va").offsets.to_numpy()).max(initial=0)))
                x, y = _unit(_padded(part.column("va"), width)), _unit(_padded(part.column("vb"), width))
                yield part.select(["a", "b"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= least))

    of = lambda end: classes.select(F.col("node").alias(end), F.col("vector").alias(f"v{end}"))
    return pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").mapInArrow(compare, pairs.schema)


def _usable(vector: Column) -> Column:
    """Not null, and all components finite, and one of them not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    rows = rows.select(
        "id", "label", "vector", (_usable(F.col("vector")) & F.col("label").isNotNull()).alias("usable"),
        F.coalesce(F.size("vector"), F.lit(0)).alias("dim"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"),
    )
    node_id = F.coalesce("id", -1 - F.shiftrightunsigned("h1", 2))
    usable = rows.where("usable")
    same = ["label", "dim", "h1", "h2"]
    classes = usable.groupBy(*same).agg(F.min(node_id).alias("smallest"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = materialize(classes.select(*same, F.struct(F.col("smallest").alias("id"), "h1", "label", "dim").alias("node"), "copies", "vector"), "vectors")

    width = classes.agg(F.max("dim")).first()[0] or 1
    sample = drawn(classes, FIT_ROWS, "h1", "h2").select("vector").toArrow().column("vector").combine_chunks()
    rotations, bits_apart = fit_index(_unit(_padded(sample, width)), width, least)
    coded = materialize(_coded(classes, rotations, width), "codes")
    links = materialize(_linked(_close_pairs(coded, bits_apart), classes, least), "vector-links")

    of_copies = classes.select(F.col("node").alias("other"), F.col("copies").alias("other_copies"))
    both = links.union(links.select("b", "a"))
    # A left join, as links far outnumber vectors in large groups and only classes may be sent to all.
    counts = both.join(of_copies, F.col("b") == F.col("other"), "left").groupBy(F.col("a").alias("n_node")).agg(F.sum("other_copies").alias("others"))
    groups = components(links).select(F.col("node").alias("g_node"), F.col("root.id").alias("root_id"))
    found = classes.join(counts, F.col("node") == F.col("n_node"), "left").join(groups, F.col("node") == F.col("g_node"), "left")
    found = found.select(*(F.col(c).alias(f"k_{c}") for c in same), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root_id", F.col("node.id")).alias("component_id"))
    on = F.col("usable")
    for c in same:
        on &= F.col(c) == F.col(f"k_{c}")
    placed = rows.drop("vector").join(found, on, "left")
    component = F.coalesce("component_id", node_id)
    return placed.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (node_id == component).alias("kept"))
