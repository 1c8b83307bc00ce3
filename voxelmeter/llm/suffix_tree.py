"""Substring dedup over words: suffixes split by prefixes of variable length into groups that fit memory, a subtree for each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelmeter.llm.arrays import BYTE_SYMBOLS_2, NOT_SPACE, SECOND_BASE, Rolling, word_bounds, word_hashes
from voxelmeter.llm.repeats import merged, removed_windows

LENGTH = 20
GRAM = 5
GROUP_SUFFIXES = 1 << 16


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
    return word_hashes(data, starts, ends), Rolling(BYTE_SYMBOLS_2[data], SECOND_BASE).of(starts, ends), first


def _pieces(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    words = raw.split()
    return [b" ".join(words[a:b]) for a, b in spans]


def _prefix_groups(words: np.ndarray, suffixes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """(suffixes, length of their common prefix): groups of at most ``limit`` suffixes, or whose prefix is a window.

    Small groups of one parent are given together. Prefixes are lengthened only where a group is too large.
    """
    todo = [(suffixes, 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) <= limit or depth == LENGTH:
            yield own, depth
            continue
        own = own[np.argsort(words[own + depth], kind="stable")]
        edges = np.append(np.flatnonzero(np.append(True, np.diff(words[own + depth]) != 0)), len(own))
        lo = 0
        while lo < len(edges) - 1:
            hi = max(int(np.searchsorted(edges, edges[lo] + limit, "right")) - 1, lo + 1)
            part = own[edges[lo]:edges[hi]]
            todo.append((part, depth + 1 if hi == lo + 1 else depth))
            if hi > lo + 1:
                yield todo.pop()
            lo = hi


def _deep_nodes(words: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtree, level by level from the prefix down: (suffixes, node) for nodes LENGTH words deep with several leaves.

    A node with one suffix is a leaf edge: no repeat is below it.
    """
    node = np.zeros(len(suffixes), np.int64)
    for d in range(depth, LENGTH):
        order = np.lexsort((words[suffixes + d], node))
        suffixes, node = suffixes[order], node[order]
        word = words[suffixes + d]
        new = np.append(True, (node[1:] != node[:-1]) | (word[1:] != word[:-1])) if len(node) else np.zeros(0, bool)
        node = np.cumsum(new) - 1
        several = np.bincount(node, minlength=1)[node] > 1
        suffixes, node = suffixes[several], node[several]
    return suffixes, node


def _solve(key, doc, start, n, pieces):
    """Windows whose words also start earlier: all leaves but the first of each node that deep."""
    split = [p.split(b" ") for p in pieces]
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64)
    at = np.cumsum([0] + [len(s) for s in split])[:-1]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place, owner, first = np.repeat(at, n) + step, np.repeat(doc, n), np.repeat(start, n) + step
    index = np.zeros(len(words), np.int64)
    index[place] = np.arange(len(place))
    who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own, depth in _prefix_groups(words, place, GROUP_SUFFIXES):
        leaves, node = _deep_nodes(words, own, depth)
        i = index[leaves]
        order = np.lexsort((first[i], owner[i], node))
        i, node = i[order], node[order]
        head = np.append(True, node[1:] != node[:-1]) if len(node) else np.zeros(0, bool)
        lead = i[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(i) else i
        later = (owner[i] != owner[lead]) | (first[i] != first[lead])
        who.append(owner[i][later])
        where.append(first[i][later])
    return np.concatenate(who), np.concatenate(where)


def dedup_word_windows(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row: texts without words that repeat earlier text.

    Words are stretches without ASCII white space. Each word covered by 20 consecutive words that also start earlier (smaller
    doc_id, or same document and earlier place) goes, judged on the texts as given; ``kept`` has the others, joined by one space. A null
    text has no word. Rows that repeat a doc_id are one document for the comparison (should their texts differ, each loses what any
    of them loses at these places). A row without doc_id takes no part and stays whole.
    """
    rows, spans = removed_windows(documents, _symbols, _pieces, _solve, LENGTH, GRAM, within=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept, at = words, 0
                if own:
                    kept = []
                    for _, a, size in merged(np.zeros(len(own), np.int64), np.array([s["start"] for s in own]), np.array([s["n"] for s in own]) + LENGTH - 1).T.tolist():
                        kept += words[at:a]
                        at = a + size
                    kept += words[at:]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return rows.join(spans, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
