"""Shared machinery for long repeats: which windows of L symbols also start earlier in the corpus.

Sorting every suffix of a corpus would move many times its size. Instead, suffixes are grouped by a content-defined stretch
of k symbols that each window of L symbols holds (the least hash of its k-grams, rightmost on ties): equal windows hold the
same stretch at the same place, so they meet in one group. Neighbouring windows with the same stretch form one
*superwindow*, of which two hashes are shuffled: of the stretch (the group), and of the whole text (the class).

1. Equal superwindows are one class. All occurrences but the first repeat it; each task settles its own before the
   shuffle, so a group of copies, however large, sends one row per task.
2. A group with one class is done. Only in groups with several classes, which are the edges of repeats, single windows
   have to be told apart: the texts of the first occurrences are fetched, and a solver orders their suffixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmeter.llm.arrays import SECOND_BASE, Rolling, byte_chunks, window_min
from voxelmeter.llm.io import checkpointed

BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 192
PIECES_PER_BUCKET = 40_000
FLUSH_ROWS = 1_000_000
_PLACE_BITS = 24
_SEGMENT = 1 << 23
_U = np.uint64
# Symbols of a chunk: (two arrays of 64-bit symbols, index of each row's first symbol and one more at the end).
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def superwindows(one: np.ndarray, two: np.ndarray, first: np.ndarray, length: int, k: int) -> np.ndarray:
    """Rows (group, class, row, start in the row, windows) as unsigned 64-bit columns."""
    out = []
    low = _U((1 << _PLACE_BITS) - 1)
    for lo in range(0, max(len(one) - length + 1, 0), _SEGMENT):
        hi = min(len(one), lo + _SEGMENT + length - 1)
        a, b = Rolling(one[lo:hi]), Rolling(two[lo:hi], SECOND_BASE)
        at = np.arange(hi - lo - k + 1)
        gram = a.of(at, at + k)
        least = window_min(gram & ~low | (low - at.astype(_U)), length - k + 1)
        anchor = (low - (least & low)).astype(np.int64)
        start = np.arange(len(anchor))
        row = np.searchsorted(first, start + lo, "right") - 1
        whole = start + lo + length <= first[row + 1]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (row[1:] != row[:-1])
        begin = np.flatnonzero(new & whole)
        stop = np.flatnonzero(np.append((new | ~whole)[1:], True) & whole) + 1
        n = stop - begin
        text = b.of(begin, stop - 1 + length)
        out.append(np.vstack([gram[anchor[begin]], text >> _U(16), row[begin].astype(_U), (begin + lo - first[row[begin]]).astype(_U), n.astype(_U)]))
    return np.concatenate(out, axis=1) if out else np.zeros((5, 0), _U)


def _classes(rows: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrences, later ones) of each class, by (group, class, doc, start).

    ``within``: an earlier start in the same document counts; otherwise all occurrences in the first document stay.
    """
    rows = rows[:, np.lexsort((rows[3], rows[2] ^ _U(1 << 63), rows[1], rows[0]))]
    if not rows.shape[1]:
        return rows, rows
    same = np.zeros(rows.shape[1], bool)
    same[1:] = (rows[:4, 1:] == rows[:4, :-1]).all(axis=0)
    rows = rows[:, ~same]  # a document given twice is one
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    heads = rows[:, np.flatnonzero(new)[np.cumsum(new) - 1]]
    stays = new if within else rows[2] == heads[2]
    return rows[:, stays], rows[:, ~stays]


def merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Adjoining or overlapping stretches of windows put together: rows (doc, start, n)."""
    if not len(doc):
        return np.zeros((3, 0), np.int64)
    doc, start, n = doc.astype(np.int64), start.astype(np.int64), n.astype(np.int64)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    jump = np.cumsum(np.append(False, doc[1:] != doc[:-1])) * (int(end.max()) + 1)  # a document's ends pass all before it
    reach = np.maximum.accumulate(end + jump)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + jump[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return np.vstack([doc[at], start[at], reach[last] - jump[last] - start[at]])


_WIDTHS = (8, 6, 8, 4, 1)  # bytes of group, class, doc, start, windows


def _planes(rows: np.ndarray, widths: tuple[int, ...]) -> bytes:
    """Byte by byte of all rows, so that high bytes, which hardly change, are compressed."""
    return b"".join(np.ascontiguousarray(r).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for r, w in zip(rows, widths, strict=True))


def _unplane(data: bytes, widths: tuple[int, ...]) -> np.ndarray:
    n = len(data) // sum(widths)
    raw, out, at = np.frombuffer(data, np.uint8), np.zeros((len(widths), n), _U), 0
    for i, w in enumerate(widths):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = raw[at:at + w * n].reshape(w, n).T
        out[i], at = wide.view(_U).ravel(), at + w * n
    return out


def _send(symbols: Symbols, length: int, k: int, within: bool, buckets: int):
    """Batches of documents to (bucket, payload) rows of first occurrences, and (bucket, removed) rows of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            stay, go = _classes(np.concatenate(held, axis=1), within)
            held.clear()
            bucket = (stay[0] >> _U(44)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            bucket, stay = bucket[order], stay[:, order]
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            ends = np.append(at[1:], len(bucket))
            payload = [_planes(stay[:, a:b], _WIDTHS) for a, b in zip(at, ends, strict=True)]
            gone = merged(go[2], go[3], go[4]).astype(_U)
            parts = [_planes(gone[:, a:a + 20_000], (8, 4, 4)) for a in range(0, gone.shape[1], 20_000)]
            where = [*bucket[at].tolist(), *(int(gone[0, i * 20_000]) % buckets for i in range(len(parts)))]
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([*payload, *[None] * len(parts)], pa.binary()), pa.array([*[None] * len(payload), *parts], pa.binary())],
                                              ["bucket", "payload", "removed"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            for lo, _, data, offsets in byte_chunks(batch.column("text")):
                rows = superwindows(*symbols(data, offsets), length, k)
                rows[2] = ids[lo:][rows[2].astype(np.int64)]
                held.append(rows)
                if sum(r.shape[1] for r in held) >= FLUSH_ROWS:
                    yield flush()
        if held:
            yield flush()
    return run


_FOUND = "doc_id long, start int, n int, key long"


def _found(doc, start, n, key) -> pa.Table:
    keys = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key)
    return pa.table([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), keys], ["doc_id", "start", "n", "key"])


def _receive(within: bool):
    """One bucket: stretches settled here (key null), and first occurrences in groups of several classes (with the group)."""
    def run(table: pa.Table) -> pa.Table:
        rows = [_unplane(p, _WIDTHS) for p in table.column("payload").to_pylist() if p is not None]
        gone = [_unplane(p, (8, 4, 4)) for p in table.column("removed").to_pylist() if p is not None]
        stay, go = _classes(np.concatenate(rows, axis=1) if rows else np.zeros((5, 0), _U), within)
        settled = merged(*np.concatenate([go[2:5], *gone], axis=1).view(np.int64))
        new = np.ones(stay.shape[1], bool)
        new[1:] = stay[0, 1:] != stay[0, :-1]
        group = np.cumsum(new) - 1
        kind, doc = np.zeros(stay.shape[1], bool), np.zeros(stay.shape[1], bool)
        kind[1:] = ~new[1:] & (stay[1, 1:] != stay[1, :-1])
        doc[1:] = ~new[1:] & (stay[2, 1:] != stay[2, :-1])
        groups = int(group[-1]) + 1 if len(group) else 0
        open_ = np.bincount(group, kind, groups) > 0
        if not within:
            open_ &= np.bincount(group, doc, groups) > 0
        ask = stay[:, open_[group]]
        return pa.concat_tables([_found(*settled, None), _found(ask[2].view(np.int64), ask[3].view(np.int64), ask[4].view(np.int64), ask[0].view(np.int64))])
    return run


def removed_windows(documents: DataFrame, symbols: Symbols, pieces: Callable, solver: Callable, length: int, k: int, within: bool) -> tuple[DataFrame, DataFrame]:
    """(documents, stretches): doc_id and text, and (doc_id, spans of start and n) of windows that also start earlier.

    ``pieces(data, row's symbol spans)`` gives the bytes of a stretch of symbols; ``solver(keys, docs, starts, ns, pieces)`` gives
    the windows to remove among those whose group is contested. Rows without doc_id take no part.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(max(LEAST_BUCKETS, total // BUCKET_BYTES), 1 << 20)
    sent = rows.where("doc_id is not null").mapInArrow(_send(symbols, length, k, within, int(buckets)), "bucket int, payload binary, removed binary")
    found = checkpointed(sent.groupBy("bucket").applyInArrow(_receive(within), _FOUND))
    asked = found.where("key is not null")
    n_buckets = max(LEAST_BUCKETS, asked.count() // PIECES_PER_BUCKET)
    asks = asked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "key")).alias("asks"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(pc.is_valid(batch.column("asks")))
            out: list[tuple] = []
            for doc, text, own in zip(*(wanted.column(c).to_pylist() for c in ("doc_id", "text", "asks")), strict=True):
                spans = [(a["start"], a["start"] + a["n"] + length - 1) for a in own]
                out += [(a["key"] % n_buckets, a["key"], doc, a["start"], a["n"], p) for a, p in zip(own, pieces((text or "").encode(), spans), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                             ["bucket", "key", "doc_id", "start", "n", "piece"])

    def solve(table: pa.Table) -> pa.Table:
        key, doc, start, n = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "doc_id", "start", "n"))
        who, where = solver(key, doc, start, n, table.column("piece").to_pylist())
        return _found(*merged(who, where, np.ones(len(who), np.int64)), None)

    fetched = rows.join(asks, "doc_id", "left").mapInArrow(fetch, "bucket long, key long, doc_id long, start int, n int, piece binary")
    solved = fetched.groupBy("bucket").applyInArrow(solve, _FOUND)
    spans = found.where("key is null").unionByName(solved).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return rows, spans
