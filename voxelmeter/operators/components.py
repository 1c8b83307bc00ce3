"""26-connected components of sparse masks.

Two passes: within a slab of planes the runs of voxels are joined by a union-find in one task, whose size the volume bounds; runs that touch
across slabs then give the edges of a small graph of slab parts, over which minimum labels are spread by alternating neighbour minima with
pointer jumping. A mask that fits in one slab needs no round. Every round is cut with a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.functions import ratio, salted_join
from voxelmeter.operators.masks import CERTIFIED, KEY, OFF_LOCATION, PARTITION, VOXEL, WORD, voxel_volume, words
from voxelmeter.session import checkpointed, release

# Lines after (i, j) in C order that can touch it.
_FORWARD_LINES = [(0, 1), (1, -1), (1, 0), (1, 1)]

# A voxel is one bigint in C order, 21 bits per axis, so label minima stay hash-aggregated.
_BITS = 21
SLAB = 32  # planes of one slab
TASK_WORDS = 200_000  # words of small slabs that share a task


def _code(i, j, k):
    return (i * (1 << _BITS) + j) * (1 << _BITS) + k


def _checked_slab() -> F.Column:
    """Slab of a word; an index that the code of a voxel cannot hold is an error."""
    wide = 1 << _BITS
    fits = F.col("i").between(0, wide - 1) & F.col("j").between(0, wide - 1) & F.col("w").between(0, wide // 64 - 1)
    return F.when(fits, F.floor(F.col("i") / SLAB).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("voxel index outside 0 to 2^21 - 1 in line and word: "), F.concat_ws(",", "i", "j", "w"))).cast("int"))


def _group_numbers(table: pa.Table, key: list[str]) -> np.ndarray:
    group = np.zeros(table.num_rows, np.int64)
    for name in key:
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1].reshape(-1)
    return group


def _touching(group: np.ndarray, i: np.ndarray, j: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs that touch; runs come in order of group, line and first voxel."""
    axis, wide = _BITS + 1, 1 << (_BITS + 1)
    if group[-1] >= 1 << (63 - 2 * axis):
        raise ValueError("too many masks in one task; lower TASK_WORDS")
    line = ((group << axis) + i << axis) + j + 1
    lines, rank = np.unique(line, return_inverse=True)
    first, last = rank * wide + k0 + 1, rank * wide + k1 + 1
    follows = np.flatnonzero((rank[1:] == rank[:-1]) & (k0[1:] == k1[:-1] + 1))  # a run that goes on in the next word
    one, other = [follows], [follows + 1]
    for di, dj in _FORWARD_LINES:
        aim = line + (di << axis) + dj
        at = np.minimum(np.searchsorted(lines, aim), len(lines) - 1)
        runs = np.flatnonzero(lines[at] == aim)
        low = np.searchsorted(last, at[runs] * wide + k0[runs])
        count = np.searchsorted(first, at[runs] * wide + k1[runs] + 2, "right") - low
        one.append(np.repeat(runs, count))
        other.append(np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count))
    return np.concatenate(one), np.concatenate(other)


def _first_of_each(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Least node of the component of each node: roots hook to the smaller root, then all paths are cut short."""
    root = np.arange(n)
    while True:
        a, b = root[one], root[other]
        apart = a != b
        if not apart.any():
            return root
        one, other, a, b = one[apart], other[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            short = root[root]
            if (short == root).all():
                break
            root = short


def _slab_parts(key: list[str]):
    def label(table: pa.Table) -> pa.Table:
        group, (i, j, w) = _group_numbers(table, key), (table[c].to_numpy().astype(np.int64) for c in WORD)
        order = np.lexsort((w, j, i, group))
        bits = table["bits"].to_numpy()[order].astype("<i8").view(np.uint8).reshape(-1, 8)
        on = np.pad(np.unpackbits(bits, axis=1, bitorder="little").view(np.int8), ((0, 0), (1, 1)))
        step = np.diff(on, axis=1)
        at, start = np.nonzero(step == 1)
        end = np.nonzero(step == -1)[1] - 1
        row = order[at]
        i, j, k0, k1 = i[row], j[row], w[row] * 64 + start, w[row] * 64 + end
        root = _first_of_each(len(row), *_touching(group[row], i, j, k0, k1)) if len(row) else row
        node = _code(i, j, k0)
        own = table.select(key).take(pa.array(row))
        for name, values in [("i", i), ("j", j), ("k0", k0), ("k1", k1)]:
            own = own.append_column(name, pa.array(values.astype(np.int32)))
        return own.append_column("node", pa.array(node)).append_column("part", pa.array(node[root]))
    return label


def _across(runs: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of slab parts that touch, from the runs in the last plane of a slab and the first of the next."""
    word = lambda k: F.floor(k / 64).cast("int")
    below = runs.where(F.col("i") % SLAB == SLAB - 1).select(
        *key, (F.col("i") + 1).alias("i"), F.explode(F.array(*[F.col("j") + n for n in (-1, 0, 1)])).alias("j"),
        F.col("k0").alias("a0"), F.col("k1").alias("a1"), F.col("part").alias("a"))
    below = below.withColumn("w", F.explode(F.sequence(word(F.col("a0") - 1), word(F.col("a1") + 1))))
    above = runs.where(F.col("i") % SLAB == 0).select(*key, "i", "j", word(F.col("k0")).alias("w"), "k0", "k1", F.col("part").alias("b"))
    pairs = below.join(above, [*key, *WORD]).where("k0 <= a1 + 1 and k1 >= a0 - 1 and a <> b")
    return pairs.select(*key, "a", "b").distinct()


def components(voxels: DataFrame, key: list[str] = KEY, max_rounds: int = 200) -> DataFrame:
    """``voxels`` (or words of them) with ``component``, numbered from 1 by first voxel in C order.

    The label of a run is the code of its first voxel, so the minimum label of a component
    is its first voxel and the numbering needs no second search. An index that is negative
    or not below 2^21 is an error. Repeated rows count once.
    """
    cells = checkpointed(words(voxels, key).withColumn("slab", _checked_slab()))
    tasks = max(cells.count() // TASK_WORDS, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in key)
    runs = checkpointed(cells.groupBy(F.pmod(F.xxhash64(*key, "slab"), F.lit(tasks)).alias("task")).applyInArrow(
        _slab_parts(key), f"{fields}, i int, j int, k0 int, k1 int, node bigint, part bigint"))
    release(cells)
    half = checkpointed(_across(runs, key))
    if half.isEmpty():
        labels = runs.withColumnRenamed("part", "label")
    else:
        joined = _spread(half, key, max_rounds).withColumnRenamed("node", "part")
        labels = runs.join(joined, [*key, "part"], "left").withColumn("label", F.coalesce("label", "part")).drop("part")
    release(half)
    number = _number_roots(labels.where(F.col("node") == F.col("label")).select(*key, "label"), key)
    kept = {c: voxels.schema[c].dataType if c in voxels.columns else "int" for c in VOXEL}
    return labels.join(number, [*key, "label"]).withColumn("k", F.explode(F.sequence("k0", "k1"))).select(
        *key, *[F.col(c).cast(kept[c]).alias(c) for c in VOXEL], "component")


def _spread(half: DataFrame, key: list[str], max_rounds: int) -> DataFrame:
    """Least label of each node of a graph given by its edges ``a``, ``b``."""
    edges = checkpointed(half.union(half.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = edges.select(*key, F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    moved = None
    for _ in range(max_rounds):
        before = moved
        pulled = (edges.join(labels.select(*key, F.col("node").alias("b"), "label"), [*key, "b"])
                  .groupBy(*key, F.col("a").alias("node")).agg(F.min("label").alias("near")))
        stepped = labels.join(pulled, [*key, "node"], "left").select(
            *key, "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = stepped.select(*key, F.col("node").alias("label"), F.col("label").alias("root"))
        # A huge component makes its label a hot key of the left side; the right side has one
        # row per key, so adaptive execution splits that partition without copying rows.
        moved = checkpointed(stepped.join(jump, [*key, "label"]).select(
            *key, "node", F.col("root").alias("label"), (F.col("root") != F.col("was")).alias("changed")))
        labels = moved.drop("changed")
        if before is not None:
            release(before)
        if moved.where("changed").isEmpty():
            break
    else:
        raise RuntimeError(f"component labels did not settle in {max_rounds} rounds")
    release(edges)
    return labels


def _number_roots(roots: DataFrame, key: list[str]) -> DataFrame:
    """Dense ids by first voxel: count per i-slab, then rank inside a slab."""
    rows = roots.withColumn("s", F.shiftright("label", 2 * _BITS))
    slab = rows.groupBy(*key, "s").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(*key).orderBy("s").rowsBetween(W.unboundedPreceding, -1))
    slab = slab.select(*key, "s", F.coalesce(before, F.lit(0)).alias("off"))
    rank = F.row_number().over(W.partitionBy(*key, "s").orderBy("label"))
    return rows.join(slab, [*key, "s"]).select(*key, "label", (F.col("off") + rank).alias("component"))


def component_records(labels: DataFrame, headers: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Size, centroid, half-open box, world bounds and share of each component."""
    sizes = labels.groupBy(*key, "component").agg(
        F.count(F.lit(1)).alias("voxels"),
        *[F.avg(a).alias(f"centroid_{a}") for a in VOXEL],
        *[F.min(a).alias(f"{a}_lo") for a in VOXEL],
        *[(F.max(a) + 1).alias(f"{a}_hi") for a in VOXEL])
    totals = sizes.groupBy(*key).agg(F.sum("voxels").alias("__all"), F.max("voxels").alias("__top"),
                                     F.count(F.lit(1)).alias("components"))
    rows = salted_join(sizes, totals, key, ["component"])
    rows = salted_join(rows, headers.select("case_id", "affine"), ["case_id"], ["component"])
    a = lambda n: F.col("affine")[n]
    world, low, high = [], [], []
    for row, name in enumerate("xyz"):
        world.append((sum((a(4 * row + n) * F.col(f"centroid_{ax}") for n, ax in enumerate(VOXEL)), a(4 * row + 3)))
                     .alias(f"centroid_{name}"))
        ends = [(a(4 * row + n) * F.col(f"{ax}_lo"), a(4 * row + n) * (F.col(f"{ax}_hi") - 1)) for n, ax in enumerate(VOXEL)]
        low.append(sum((F.least(*e) for e in ends), a(4 * row + 3)).alias(f"{name}_min"))
        high.append(sum((F.greatest(*e) for e in ends), a(4 * row + 3)).alias(f"{name}_max"))
    return rows.select(
        *sizes.columns, *world, *low, *high, (F.col("voxels") * voxel_volume("affine")).alias("mm3"),
        (F.col("voxels") / F.col("__all")).alias("share"), (F.col("__top") / F.col("__all")).alias("largest_share"))


def component_relations(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """Per predicted component the voxels in each class of :func:`partition_words`."""
    rows = words(labels, [*KEY, "component"]).join(parts, [*KEY, *WORD])
    inside = {c: F.bit_count(F.col("bits").bitwiseAND(F.col(c))) for c in PARTITION}
    counts = rows.groupBy(*KEY, "component").agg(
        F.sum(sum(inside.values(), F.lit(0))).alias("voxels"), *[F.sum(n).alias(c) for c, n in inside.items()])
    off = sum((F.col(c) for c in OFF_LOCATION), F.lit(0))
    certified = sum((F.col(c) for c in CERTIFIED), F.lit(0))
    return counts.select(
        *KEY, "component", "voxels", *PARTITION, off.alias("off_location"),
        (F.col("known_positive") == 0).alias("detached"),
        ((F.col("known_positive") == 0) & (off > 0)).alias("detached_off_location"),
        (certified == F.col("voxels")).alias("fully_certified"))


def relation_summary(findings: DataFrame, relations: DataFrame, gt_labels: DataFrame, pred: DataFrame) -> DataFrame:
    """Component counts per finding and the share of truth components that were touched."""
    counts = relations.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("components"), F.count_if("detached").alias("detached"),
        F.count_if("detached_off_location").alias("detached_off_location"))
    marks = words(pred).withColumnRenamed("bits", "p")
    touched = (words(gt_labels, [*KEY, "component"]).join(marks, [*KEY, *WORD], "left")
               .groupBy(*KEY, "component").agg(F.max(F.coalesce(F.col("bits").bitwiseAND(F.col("p")), F.lit(0)) != 0).alias("seen"))
               .groupBy(*KEY).agg(F.count(F.lit(1)).alias("gt_components"), F.count_if("seen").alias("recalled")))
    names = ["components", "detached", "detached_off_location", "gt_components", "recalled"]
    out = findings.select(*KEY).join(counts, KEY, "left").join(touched, KEY, "left").fillna(0, names)
    return out.select(*KEY, *names, ratio("detached", "components").alias("detached_fraction"),
                      ratio("recalled", "gt_components").alias("candidate_recall"))


def same_partition(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Per key, whether two labellings are equal up to renaming, and missing voxels."""
    rows = a.select(*key, *VOXEL, F.col("component").alias("la")).join(
        b.select(*key, *VOXEL, F.col("component").alias("lb")), [*key, *VOXEL], "full_outer")
    pairs = rows.groupBy(*key, "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    stats = pairs.groupBy(*key).agg(
        F.sum(F.when(F.col("la").isNull() | F.col("lb").isNull(), F.col("n")).otherwise(0)).alias("mismatch_voxels"),
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("la").alias("a_components"),
        F.countDistinct("lb").alias("b_components"))
    same = ((F.col("mismatch_voxels") == 0) & (F.col("pairs") == F.col("a_components"))
            & (F.col("pairs") == F.col("b_components")))
    return stats.select(*key, "a_components", "b_components", "mismatch_voxels", same.alias("same_partition"))
