"""Near-duplicate groups: MinHash bands give candidates, odd sketches sort out the dissimilar ones, full sets confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmeter.llm.arrays import BYTE_SYMBOLS, LOWER, NOT_SPACE, byte_chunks, mix, thrifty, word_bounds, word_hashes
from voxelmeter.llm.io import checkpointed, release

BANDS, ROWS = 40, 4
SKETCH_BITS = 1024
MARGIN = 0.15
SURE = 5.0
SPLIT_ROWS = 4096
_rng = np.random.RandomState(77)
_SALT = _rng.randint(0, 1 << 62, BANDS * ROWS).astype(np.uint64)
_ODD = _rng.randint(0, 1 << 62, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The set of shingle hashes of each row, sorted: runs of ``width`` words, or all words if there are fewer; empty without words."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
    words = word_hashes(data, starts, ends, BYTE_SYMBOLS)
    runs = words.copy()
    for j in range(1, width):
        runs[:len(words) - j] = mix(runs[:len(words) - j] * _U(0x9E3779B97F4A7C15) + words[j:]) if len(words) > j else runs[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a:b - width + 1])
        elif b > a:
            yield mix(np.frombuffer(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), np.uint64) ^ _U(b - a))
        else:
            yield words[:0]


def _minima(found: np.ndarray) -> np.ndarray:
    out = np.full(len(_SALT), np.iinfo(np.uint64).max, _U)
    for lo in range(0, len(found), 512):
        out = np.minimum(out, ((found[lo:lo + 512, None] ^ _SALT) * _ODD).min(axis=0))
    return out >> _U(24)


def _sketch(minima: np.ndarray) -> bytes:
    """Odd sketch: each sample flips the bit that it and its place hash to."""
    at = mix(minima ^ _SALT) % _U(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def _likely(flipped: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches with so many unequal bits can come from sets of that similarity.

    Of k samples, k (1 - J) differ, and each flips two bits at random: the estimate of J inverts the expected share of
    unequal bits. Pairs more than MARGIN below the threshold are let go; that is over four deviations of the estimate.
    """
    share = np.minimum(2 * flipped / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS / (4 * len(_SALT)) * np.log1p(-share) >= threshold - MARGIN


def _parity(found: np.ndarray) -> bytes:
    """Parity bitmap of the whole set, of two to four bits per member. Halves of a bitmap, XORed, are the bitmap of half the size."""
    size = max(64, 1 << (2 * max(len(found), 1) - 1).bit_length())
    at = (mix(found ^ _SALT[0]) & _U(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest, bands, sketch, parity) per row; digest is 128 bits of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, bands, sketch, parity = [], [], [], [], []
            for _, _, data, offsets in byte_chunks(batch.column("text")):
                for found in _shingles(data, offsets, width):
                    n.append(len(found))
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    low = _minima(found)
                    keys = np.zeros(BANDS, _U) + np.arange(BANDS, dtype=_U)
                    for row in low.reshape(BANDS, ROWS).T:
                        keys = mix(keys * _U(0x9E3779B97F4A7C15) + row)
                    bands.append(keys.view(np.int64))
                    sketch.append(_sketch(low))
                    parity.append(_parity(found))
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *bands]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(sketch, pa.binary()), pa.array(parity, pa.binary())],
                                             ["doc_id", "n", "digest", "bands", "sketch", "parity"])
    return documents.mapInArrow(thrifty(run), "doc_id long, n long, digest binary, bands array<long>, sketch binary, parity binary")


def _sets(documents: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column("text")):
                found = [s.view(np.int64) for s in _shingles(data, offsets, width)]
                ends = np.cumsum([0] + [len(s) for s in found])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], ["doc_id", "found"])
    return documents.mapInArrow(thrifty(run), "doc_id long, found array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold. A hot ``a`` is a skewed join, which Spark splits."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("found_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("found").alias("found_b"))
    both = pairs.join(two, "b").join(one, "a").withColumn("inter", F.size(F.array_intersect("found_a", "found_b")))
    return checkpointed(both.where(100 * F.col("inter") >= percent * (F.size("found_a") + F.size("found_b") - F.col("inter"))).select("a", "b"))


def _grouped(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, group): the least id each vertex reaches, by alternating large and small stars of the links."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = checkpointed(edges), None
    while True:
        # Large star: larger neighbours go to the least neighbour (or self). Small star: smaller neighbours and self do.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before_edges, edges = edges, checkpointed(small.where("u <> v").distinct())
        release(before_edges)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    out = checkpointed(vertices.join(edges.groupBy("u").agg(F.min("v").alias("v")), F.col("doc_id") == F.col("u"), "left").select("doc_id", F.coalesce("v", "doc_id").alias("group")))
    release(edges)
    return out


def _cells(rows: DataFrame) -> DataFrame:
    """The rows of mixed buckets, each once for every cell (key, x, y) that it is compared in.

    A bucket is cut into blocks of about SPLIT_ROWS rows, by a hash of the id, and each pair of blocks is a cell, so that no task holds more than
    two blocks. A largest group of more than a block is cut for itself (``hub``): its rows need no comparison among themselves, so its block h meets only the
    blocks of the rest, in the cells x = -1 - h.
    """
    large = F.col("most") > SPLIT_ROWS
    parts = {True: F.ceil(F.col("most") / SPLIT_ROWS), False: F.ceil((F.col("rows") - F.when(large, F.col("most")).otherwise(0)) / SPLIT_ROWS)}
    hubs, rest = F.when(large, parts[True]).otherwise(0).cast("int"), parts[False].cast("int")
    rows = rows.withColumn("hub", large & (F.col("group") == F.col("largest")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("hub"), hubs).otherwise(rest)).cast("int"))

    def cell(x: Column, y: Column) -> Column:
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    own = F.transform(F.sequence(F.lit(0), rest - 1), lambda j: cell(F.least(F.col("block"), j), F.greatest(F.col("block"), j)))
    across = F.when(hubs > 0, F.transform(F.sequence(F.lit(0), hubs - 1), lambda h: cell(-1 - h, F.col("block")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    hub = F.transform(F.sequence(F.lit(0), rest - 1), lambda j: cell(-1 - F.col("block"), j))
    return rows.withColumn("cell", F.explode(F.when(F.col("hub"), hub).otherwise(F.concat(own, across)))).select("*", "cell.x", "cell.y")


class _Parities:
    """Bitmaps of the rows of a bucket, at their own size and folded to half of it."""

    def __init__(self, bitmaps: list[bytes]):
        self.size = np.array([8 * len(b) for b in bitmaps])
        self.rows, self.place = {}, {}
        for level in {x for s in set(self.size.tolist()) for x in (s, s // 2) if x >= 64}:
            at = np.flatnonzero((self.size == level) | (self.size == 2 * level))
            own = [np.frombuffer(bitmaps[i], np.uint64) for i in at]
            self.rows[level] = np.vstack([b if len(b) * 64 == level else b[:len(b) // 2] ^ b[len(b) // 2:] for b in own])
            self.place[level] = np.full(len(bitmaps), -1)
            self.place[level][at] = np.arange(len(at))

    def unequal(self, i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unequal bits of row i and rows whose sizes are at most a factor of two apart, and the size they were compared at."""
        level, z = np.minimum(self.size[i], self.size[at]), np.zeros(len(at), np.int64)
        for k in np.unique(level).tolist():
            here, place = level == k, self.place[k]
            z[here] = np.bitwise_count(self.rows[k][place[at[here]]] ^ self.rows[k][place[i]]).sum(axis=1)
        return z, level


def _cross_pairs(percent: int, spare: bool):
    """Pairs (a, b, sure) of one bucket that lie in different groups and may meet the threshold.

    Sets of n and m members meet it if their symmetric difference is at most (100 - p) (n + m) / (100 + p). It is at least the
    number of unequal parity bits, so pairs with more are let go for certain. A pair far within the bound is ``sure``; with ``spare``,
    of pairs between groups that sure pairs connect in this bucket only those sure ones are given.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, n, hub = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "hub"))
        _, group = np.unique(table.column("group").to_numpy(), return_inverse=True)
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        parities = _Parities(table.column("parity").to_pylist())
        block = table.column("block").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        joined, sure, other = group.copy(), [], []
        # Rows of block x are held against those of block y; within one block against those of larger id.
        for i in np.flatnonzero(~hub & (block == y)) if x < 0 else np.flatnonzero(block == x):
            near = (joined if spare else group) != (joined if spare else group)[i]
            near &= (hub if x < 0 else (ids > ids[i]) if x == y else block == y) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            at = np.flatnonzero(near)
            at = at[_likely(np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1), percent / 100)]
            if not len(at):
                continue
            z, size = parities.unequal(i, at)
            bound = (100 - percent) * (n[at] + n[i]) / (100 + percent)
            at, z, size, bound = at[z <= bound], z[z <= bound], size[z <= bound], bound[z <= bound]
            left = np.maximum(1 - 2 * z / size, 1e-3)
            guess = -size / 2 * np.log(left)
            spread = np.sqrt(size / 4 * (1 - left ** 2)) / left
            safe = guess + SURE * spread + 1 <= bound
            if spare:
                for j in at[safe].tolist():
                    if joined[j] != joined[i]:
                        sure.append((i, j))
                        joined[joined == joined[j]] = joined[i]
                other += [(i, j) for j in at[~safe].tolist()]
            else:
                other += [(i, j) for j in at.tolist()]
        other = [(i, j) for i, j in other if joined[i] != joined[j]]
        a, b = (np.array([p[k] for p in (*sure, *other)], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "sure": np.arange(len(a)) < len(sure)})
    return run


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per doc_id row: groups of texts linked by Jaccard similarity of word shingles.

    Words are cut at ASCII white space, ASCII-lower-cased. Texts link if 100 * intersection >= percent * union of their
    shingle sets; component_id is the least doc_id a document reaches over links, and the document with that id is kept.
    A text of fewer words than ``width`` has its whole word sequence as its one shingle; a null text, or one without
    words, has none and links with nothing. Rows that repeat a doc_id are one document, and give one row; of several texts the least counts. A row without
    doc_id is not compared: its component_id is null and it is kept.

    1. Equal sets are one class, whose least id stands for it. 2. Representatives with an equal MinHash band share a
    bucket; each is paired with the least id of all its buckets, never with all others. 3. Full sets confirm pairs, and confirmed
    ones make groups. 4. Only buckets that then hold several groups are searched for pairs across groups: odd sketches and parity bitmaps let
    go of those below the threshold, full sets confirm the rest, and groups are made anew. Pairs between groups that sure pairs connect are
    spared; should a sure one not be confirmed, the search is done again without sparing. A bucket of many rows is cut into
    blocks, and pairs of blocks are compared each in a task. With 40 bands of 4 a pair at 0.8 shares no bucket with probability 7e-10.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.where("doc_id is not null")
    signed = checkpointed(signatures(known, width))
    done = []
    if not signed.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        known = checkpointed(known.groupBy("doc_id").agg(F.min("text").alias("text")))
        done += [signed, known]
        signed = checkpointed(signatures(known, width))
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    shared = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    reps = classes.where("n > 0").select(F.col("rep").alias("doc_id"))
    one_each = checkpointed(signed.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key")))
    hubs = one_each.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).where("size > 1")
    members = checkpointed(one_each.join(hubs, "key").select("key", "a", F.col("doc_id").alias("b")))
    # Every pair below is of documents that share a bucket. Their number grows with the input, so their ids are never broadcast.
    candidates = members.select(F.col("b").alias("doc_id")).distinct().hint("merge")
    sets = checkpointed(_sets(known.join(candidates, "doc_id", "left_semi"), width))
    pairs = checkpointed(members.where("a < b").groupBy("b").agg(F.min("a").alias("a")))
    links = _confirmed(pairs, sets, percent)
    release(pairs)
    groups = _grouped(reps, links)

    tagged = checkpointed(members.join(groups.withColumnRenamed("doc_id", "b"), "b").select("key", F.col("b").alias("doc_id"), "group"))
    sizes = tagged.groupBy("key", "group").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum("size").alias("rows"), F.max("size").alias("most"), F.max_by("group", F.struct("size", "group")).alias("largest")).where("groups > 1")
    spread = _cells(tagged.join(mixed, "key")).join(signed.select("doc_id", "n", "sketch", "parity"), "doc_id")
    spread = spread.select("key", "x", "y", "doc_id", "group", "hub", "block", "n", "sketch", "parity")
    for spare in (True, False):
        cross = spread.groupBy("key", "x", "y").applyInArrow(_cross_pairs(percent, spare), "a long, b long, sure boolean")
        cross = checkpointed(cross.groupBy("a", "b").agg(F.max("sure").alias("sure")))
        more = _confirmed(cross.select("a", "b"), sets, percent)
        if cross.where("sure").join(more, ["a", "b"], "left_anti").isEmpty():
            break
    before, groups = groups, _grouped(reps, links.unionByName(more))

    found = signed.select("doc_id", "n", "digest").join(shared, "digest", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).alias("rep"))
    found = found.join(groups.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("group", "doc_id").alias("component_id"))
    unknown = signatures(rows.where("doc_id is null"), width).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    out = checkpointed(found.unionByName(unknown).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    for table in (*done, signed, one_each, members, sets, links, tagged, cross, more, before, groups):
        release(table)
    return out
