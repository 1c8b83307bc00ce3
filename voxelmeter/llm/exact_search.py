"""Exact top-k search by inner product: bounds from segment means and deviations, coarse to fine, then exact scores of survivors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.llm.io import checkpointed

SCALE = 64
TOP = 20
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_CELLS = 4096, 32_768, 24
_CHUNK = {True: 256, False: 1024}
_TILE = (256, 2048)
_SLACK = 1e-5
_NO_ID = np.iinfo(np.int64).max


def finite(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def levels(dims: int) -> list[np.ndarray]:
    """Bounds of the segments of each level: segments of about 16, of 4 and of 2 entries."""
    counts = dict.fromkeys(max(1, dims // size) for size in (16, 4, 2))
    return [np.linspace(0, dims, n + 1).astype(int) for n in counts]


def features(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Means and deviations of the segments, weighted by the root of their length, side by side.

    For vectors q and v the sum over segments of len ((mean q - mean v)^2 + (dev q - dev v)^2) is at most their squared distance. As these
    features keep the length of a vector, their inner product is then at least that of q and v.
    """
    size = np.diff(edges)
    mean = np.add.reduceat(codes, edges[:-1], axis=1) / size
    spread = codes - np.repeat(mean, size, axis=1)
    return np.hstack([mean * np.sqrt(size), np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1))]).astype(np.float32)


class Best:
    """The best ``top`` candidates of each query so far, by falling score, then by id."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, top: int):
        self.own, self.codes, self.top = ids, codes, top
        self.score, self.ids = np.full((len(ids), top), -_NO_ID), np.full((len(ids), top), _NO_ID)
        self.floats = codes.astype(float)
        self.norm = np.sqrt((self.floats ** 2).sum(axis=1))
        self.levels = [(e, features(self.floats, e)) for e in levels(codes.shape[1])]
        self.compared = self.exact = 0

    def _exact(self, a: np.ndarray, codes: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Scores of the pairs that are alive, exactly, as 64-bit integers."""
        q, c = self.codes[a], codes[b]
        safe = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2 ** 53
        if alive.mean() > 0.05:
            return (self.floats[a] @ c.T.astype(float)).astype(np.int64) if safe else q @ c.T
        out, (i, j) = np.zeros(alive.shape, np.int64), np.nonzero(alive)
        for lo in range(0, len(i), 65_536):
            x, y = i[lo:lo + 65_536], j[lo:lo + 65_536]
            out[x, y] = (q[x] * c[y]).sum(axis=1)
        return out

    def _seeded(self, a: np.ndarray, codes: np.ndarray, fine: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """A score that ``top`` candidates of a tile reach for certain: the least exact one of those of highest bound."""
        bound = np.where(alive, self.levels[-1][1][a] @ fine.T, -np.inf)
        pick = np.argpartition(-bound, self.top, axis=1)[:, :self.top]
        score = np.einsum("qd,qcd->qc", self.codes[a], codes[pick]).astype(float)
        return np.where(np.take_along_axis(alive, pick, axis=1), score, -np.inf).min(axis=1) - 0.5

    def offer(self, ids: np.ndarray, codes: np.ndarray) -> None:
        floats = codes.astype(float)
        norm = np.sqrt((floats ** 2).sum(axis=1))
        theirs = [features(floats, e) for e, _ in self.levels]
        for lo in range(0, len(self.own), _TILE[0]):
            a, b = np.arange(lo, min(lo + _TILE[0], len(self.own))), np.arange(len(ids))
            alive = self.own[a][:, None] != ids
            self.compared += alive.size
            # The least score that still counts, less what rounding of the bounds may take.
            last = self.score[a, -1].astype(float)
            last -= _SLACK * self.norm[a] * (norm.max() if len(norm) else 0) + 1e-3
            if (self.ids[a, -1] == _NO_ID).any() and len(ids) > 2 * self.top:
                last = np.maximum(last, self._seeded(a, codes, theirs[-1], alive))
            for (_, ours), their in zip(self.levels, theirs, strict=True):
                alive &= ours[a] @ their[b].T >= last[:, None]
                rows, cols = alive.any(axis=1), alive.any(axis=0)
                a, b, last, alive = a[rows], b[cols], last[rows], alive[np.ix_(rows, cols)]
                if not len(a):
                    break
            if not len(a):
                continue
            self.exact += int(alive.sum())
            score = self._exact(a, codes, b, alive)
            fit = alive & (score >= self.score[a, -1][:, None])
            for i in np.flatnonzero(fit.any(axis=1)).tolist():
                at, own = np.flatnonzero(fit[i]), a[i]
                value, who = np.concatenate([self.score[own], score[i, at]]), np.concatenate([self.ids[own], ids[b[at]]])
                best = np.lexsort((who, -value))[:self.top]
                self.score[own], self.ids[own] = value[best], who[best]


def _packed(rows: DataFrame, every: int) -> DataFrame:
    """(query, dims, n, ids, codes): rows put together in chunks, once as candidates and, where they are queries, once as those."""
    def chunk(query: bool, dims: int, ids: np.ndarray, codes: np.ndarray) -> tuple:
        small = len(codes) == 0 or np.abs(codes).max() < 1 << 15
        return query, dims, len(ids), 2 if small else 8, ids.tobytes(), codes.astype("<i2" if small else "<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], list] = {}

        def out(key: tuple[bool, int], least: int) -> list[tuple]:
            if key not in held or sum(len(x[0]) for x in held[key]) < least:
                return []
            ids, codes = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            return [chunk(*key, ids[i:i + _CHUNK[key[0]]], codes[i:i + _CHUNK[key[0]]]) for i in range(0, len(ids), _CHUNK[key[0]])]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["query", "dims", "n", "width", "ids", "codes"])
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("codes")
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            front, rows = np.cumsum(size) - size, []
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                codes = flat[front[at][:, None] + np.arange(dims)]
                held.setdefault((False, dims), []).append((ids[at], codes))
                if (asks := ids[at] % every == 0).any():
                    held.setdefault((True, dims), []).append((ids[at][asks], codes[asks]))
                rows += out((False, dims), _CHUNK[False]) + out((True, dims), _CHUNK[True])
            if rows:
                yield batch_of(rows)
        if rows := [r for key in list(held) for r in out(key, 1)]:
            yield batch_of(rows)
    return rows.mapInArrow(run, "query boolean, dims int, n int, width int, ids binary, codes binary")


def _solved(top: int):
    def load(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.frombuffer(r["ids"], "<i8") for r in rows]
        return np.concatenate(ids), np.concatenate([np.frombuffer(r["codes"], f"<i{r['width']}").reshape(r["n"], -1).astype(np.int64) for r in rows])

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["query", "n", "width", "ids", "codes"]).to_pylist()
        asks, rest = [r for r in rows if r["query"]], [r for r in rows if not r["query"]]
        if not asks or not rest:
            return pa.table([pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])
        best = Best(*load(asks), top)
        for lo in range(0, len(rest), _TILE[1] // _CHUNK[False]):
            best.offer(*load(rest[lo:lo + _TILE[1] // _CHUNK[False]]))
        query, place = np.nonzero(best.ids != _NO_ID)
        return pa.table([pa.array(best.own[query]), pa.array(best.ids[query, place]), pa.array(best.score[query, place])], ["query_id", "vec_id", "score"])
    return run


def top_k(embeddings: DataFrame, every: int = 20, top: int = TOP, scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of highest integer inner product for each query, ties by smaller vec_id.

    Entries become floor(scale * x). Queries are rows whose vec_id is divisible by ``every``, candidates all rows but those of the
    query's own vec_id. Every query meets every candidate in a cell of a query block and a candidate block: chunks of rows go to
    the cells, never single pairs. In a cell, bounds from segments of 16, 4 and 2 entries let go of candidates that cannot reach the query's last place;
    what is left is scored exactly.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do rows without vec_id. Rows that repeat a vec_id
    with the same codes are one; with other codes each is a candidate, and the query's places go to the best over its vectors. Vectors meet
    only those of their own length. Scores must fit 64 bits.
    """
    vector = F.col("embedding")
    rows = embeddings.where(F.col("vec_id").isNotNull() & finite(vector)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("codes")).distinct()
    packed = checkpointed(_packed(rows, every))
    count = {r["query"]: r["n"] for r in packed.groupBy("query").agg(F.sum("n").alias("n")).collect()}
    across = max(1, -(-count.get(True, 0) // query_block))
    down = max(-(-LEAST_CELLS // across), -(-count.get(False, 0) // candidate_block))
    mine = F.pmod(F.xxhash64("ids", "codes"), F.when(F.col("query"), across).otherwise(down)).cast("int")
    # Beside its own block, a chunk goes to all blocks of the other side.
    cells = packed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), down - 1).otherwise(across - 1))))
    cells = cells.withColumns({"row": F.when(F.col("query"), F.col("mine")).otherwise(F.col("other")), "col": F.when(F.col("query"), F.col("other")).otherwise(F.col("mine"))})
    found = cells.drop("mine", "other").groupBy("dims", "row", "col").applyInArrow(_solved(top), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
