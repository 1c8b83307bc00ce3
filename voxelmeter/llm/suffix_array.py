"""Exact-substring dedup: blockwise suffix sorting with difference-cover samples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelmeter.llm.arrays import BYTE_SYMBOLS, BYTE_SYMBOLS_2
from voxelmeter.llm.repeats import merged, removed_windows

LENGTH = 50
GRAM = 16
PERIOD = 7
COVER = (0, 1, 3)  # fixed: every difference modulo 7 is one of two of these
BLOCK_BYTES = 1 << 20


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return BYTE_SYMBOLS[data], BYTE_SYMBOLS_2[data], offsets


def _pieces(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [raw[a:b] for a, b in spans]


def _numbers(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (up to 8) bytes at each place as one number."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out << np.uint64(8) | text[at + j]
    return out


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Rank among distinct rows, columns compared from the first on."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_block(text: np.ndarray, windows: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """Least owner among the windows (places in ``text``) that spell the same ``length`` bytes, for each window.

    Windows are sorted by their first and last 7 bytes and 8 in the middle. Those that tie there with a window of another owner go on:
    sample places, which are 0, 1 or 3 modulo 7, are ranked once by the length - 6 bytes behind each; then one pair of classes of
    places modulo 7 at a time is sorted by first bytes, by the rank of the sample place that both classes reach by the same step,
    and by last bytes. No comparison is longer than that, however long the tie.
    """
    least = owners.copy()
    front, back = (_ranks([_numbers(text, windows + j, PERIOD)]) for j in (0, length - PERIOD)) if len(windows) else (owners, owners)
    tie = _ranks([front, back, _numbers(text, windows + length // 2, 8)]) if len(windows) else owners
    low = _lowest(tie, owners)
    open_ = np.flatnonzero(np.bincount(tie, low[tie] < owners)[tie] > 0) if len(windows) else owners[:0]
    if not len(open_):
        return least
    at, front, back, own = windows[open_], front[open_], back[open_], owners[open_]
    deep = length - PERIOD + 1
    shift = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)])
    sample = np.unique((at[:, None] + shift[at % PERIOD]).ravel())
    sample = sample[sample + deep <= len(text)]
    rank = _ranks([_numbers(text, sample + j, 8) for j in (*range(0, deep - 8, 8), deep - 8)])
    classes = [np.flatnonzero(at % PERIOD == r) for r in range(PERIOD)]
    found = own.copy()
    for r in range(PERIOD):
        for s in range(r, PERIOD):
            both = np.concatenate([classes[r], classes[s]]) if r < s else classes[r]
            if len(both):
                key = _ranks([front[both], rank[np.searchsorted(sample, at[both] + shift[r, s])], back[both]])
                found[both] = np.minimum(found[both], _lowest(key, own[both])[key])
    least[open_] = found
    return least


def _lowest(key: np.ndarray, owners: np.ndarray) -> np.ndarray:
    out = np.full(int(key.max()) + 1 if len(key) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, key, owners)
    return out


def _solve(key, doc, start, n, pieces):
    """Windows whose bytes also start in a smaller document, one block of whole groups at a time."""
    order = np.argsort(key, kind="stable")
    sizes = np.array([len(p) for p in pieces], np.int64)[order]
    new = np.append(True, key[order][1:] != key[order][:-1])
    who, where = [], []
    lo = 0
    total = np.cumsum(sizes)
    while lo < len(order):
        hi = int(np.searchsorted(total, total[lo] - sizes[lo] + BLOCK_BYTES, "right"))
        hi = max(hi, lo + 1)
        while hi < len(order) and not new[hi]:
            hi += 1
        own = order[lo:hi]
        text = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)
        at = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        count = n[own]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        windows, owners = np.repeat(at, count) + step, np.repeat(doc[own], count)
        gone = sort_block(text, windows, owners, LENGTH) < owners
        who.append(owners[gone])
        where.append((np.repeat(start[own], count) + step)[gone])
        lo = hi
    return np.concatenate([np.zeros(0, np.int64), *who]), np.concatenate([np.zeros(0, np.int64), *where])


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row: UTF-8 texts without bytes that repeat earlier documents.

    Each byte covered by a string of 50 bytes that also starts in a document with a smaller doc_id goes, judged on the
    texts as given. A null text is empty; texts under 50 bytes stay whole. Rows that repeat a doc_id are one document for
    the comparison (should their texts differ, each loses what any of them loses at these places). A row without doc_id takes
    no part and stays whole. ``kept`` holds the remaining bytes, which may split a character.
    """
    rows, spans = removed_windows(documents, _symbols, _pieces, _solve, LENGTH, GRAM, within=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                runs, kept, at = 0, [], 0
                if own:
                    zero = np.zeros(len(own), np.int64)
                    # Windows reach LENGTH - 1 bytes further; runs that then touch are one.
                    for _, a, size in merged(zero, np.array([s["start"] for s in own]), np.array([s["n"] for s in own]) + LENGTH - 1).T.tolist():
                        if a >= len(raw):
                            break
                        kept.append(raw[at:a])
                        at, runs = min(len(raw), a + size), runs + 1
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return rows.join(spans, "doc_id", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
