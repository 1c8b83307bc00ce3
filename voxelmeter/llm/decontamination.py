"""Benchmark decontamination: a broadcast hash set of test windows is scanned for in documents and hits are verified."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxelmeter.llm.arrays import ALNUM, LOWER, Rolling, byte_chunks, hash_text_words, thrifty, word_bounds, word_hashes
from voxelmeter.llm.io import checkpointed, release

N_GRAM = 10
MAX_BROADCAST_BYTES = 64 << 20
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


class _Windows:
    """Item windows by length: sorted hashes for the scan, their words for the check."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.n, self.words = n, {}
        for item, text in items:
            words = text.split(b" ")
            size = min(n, len(words))
            for i in range(len(words) - size + 1):
                self.words.setdefault(b" ".join(words[i:i + size]), set()).add(item)
        sizes: dict[int, list[bytes]] = {}
        for w in self.words:
            sizes.setdefault(w.count(b" ") + 1, []).append(w)
        self.by_size = {}
        for size, windows in sizes.items():
            flat = [w for x in windows for w in x.split(b" ")]
            at = np.arange(0, len(flat), size)
            found = np.unique(Rolling(hash_text_words(flat)).of(at, at + size))
            bits = np.zeros(1 << 22, bool)
            bits[(found >> np.uint64(42)).astype(np.int64)] = True
            self.by_size[size] = (found, bits)

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(row, first word, end word, window) of each verified occurrence; and the number of words of each row."""
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, ALNUM)
        hits = []
        if len(starts):
            rolling = Rolling(word_hashes(data, starts, ends))
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for size, (found, bits) in self.by_size.items():
                if len(starts) < size:
                    continue
                at = np.arange(len(starts) - size + 1)
                at = at[row[at] == row[at + size - 1]]
                hashes = rolling.of(at, at + size)
                maybe = bits[(hashes >> np.uint64(42)).astype(np.int64)]
                at, hashes = at[maybe], hashes[maybe]
                place = np.minimum(np.searchsorted(found, hashes), len(found) - 1)
                for i in at[found[place] == hashes]:
                    window = b" ".join(data[starts[j]:ends[j]].tobytes() for j in range(i, i + size))
                    if window in self.words:
                        r = int(row[i])
                        hits.append((r, int(i - first[r]), int(i - first[r] + size), window))
        return hits, np.diff(first)


Finish = Callable[[list[str], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _scan(rows: DataFrame, items: list[tuple[str, bytes]], n: int, finish: Finish | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Adds the hits of these items to the columns __lo, __hi and __items of each row; ``finish`` works on the outcome in the same step."""
    names = rows.columns

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(items, n)
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            lo, hi, found = (columns[c].to_pylist() for c in ("__lo", "__hi", "__items"))
            n_words = np.zeros(batch.num_rows, np.int64)
            for at, end, data, offsets in byte_chunks(batch.column("text")):
                hits, n_words[at:end] = windows.scan(data, offsets)
                for r, a, b, window in hits:
                    mine, theirs = lo[at + r], hi[at + r]
                    if theirs and mine[-1] <= a <= theirs[-1]:
                        theirs[-1] = max(b, theirs[-1])
                    else:
                        mine.append(a)
                        theirs.append(b)
                    found[at + r] = sorted({*found[at + r], *windows.words[window]})
            columns |= {"__n": pa.array(n_words), "__lo": pa.array(lo, pa.list_(pa.int32())), "__hi": pa.array(hi, pa.list_(pa.int32())),
                        "__items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return finish(names, found_in(batches)) if finish else found_in(batches)
    return rows.mapInArrow(thrifty(run), schema or rows.schema)


def _scanned(rows: DataFrame, benchmark: DataFrame, n: int, max_broadcast_bytes: int, finish: Finish | None = None, schema: StructType | str | None = None) -> DataFrame:
    """One scan of the rows for each slice of the items; the hits of a slice are written before the next, so no task holds two."""
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = benchmark.select(F.col("item_id").cast("string").alias("item"), F.array_join(F.regexp_extract_all(folded, F.lit(WORD), 0), " ").alias("words")).where(
        "words <> '' and item is not null").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("words") + 64), F.lit(0))).first()[0]
    slices = max(1, -(-size // max_broadcast_bytes))
    out = rows.withColumns({"__n": F.lit(0).cast("long"), "__lo": F.array().cast("array<int>"), "__hi": F.array().cast("array<int>"), "__items": F.array().cast("array<string>")})
    for k in range(slices):
        own = wanted if slices == 1 else wanted.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == k)
        items, before = [(r["item"], r["words"].encode()) for r in own.toLocalIterator()], out
        if k == slices - 1:
            return _scan(out, items, n, finish, schema)
        out = checkpointed(_scan(out, items, n))
        release(before)


def hits(documents: DataFrame, benchmark: DataFrame, n: int = N_GRAM, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, lo, hi, items) per document row: stretches of words covered by item windows, and the items found.

    Text is folded to ASCII lower case and cut into words of letters, digits and characters beyond ASCII. An item of
    fewer than ``n`` words is one window; an item without words, without id or null has none. A null text has no words.
    Every row is scanned for itself, whether or not its doc_id repeats or is null. An item set larger than
    ``max_broadcast_bytes`` is cut into slices by a hash of the item, and rows pass one scan per slice, one after the other. A
    text may be as long as a row may; it is scanned whole.
    """
    out = _scanned(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, n, max_broadcast_bytes)
    return out.select("doc_id", F.col("__n").alias("n_words"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.col("__items").alias("items"))


def report(found: DataFrame) -> DataFrame:
    """One row per row of :func:`hits` with word counts, hit counts and a digest of the items."""
    def run(batches):
        for batch in batches:
            n_hit, digests = [], []
            for lo, hi, items in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "items")), strict=True):
                total = at = 0
                for a, b in sorted(zip(lo, hi, strict=True)):
                    total += max(0, b - max(a, at))
                    at = max(at, b)
                n_hit.append(total)
                digests.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in batch.column("items").to_pylist()], pa.int64()),
                 pa.array(digests), pa.array([h > 0 for h in n_hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    return found.mapInArrow(thrifty(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = N_GRAM, drop_above: float = 0.5,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Documents without the stretches of text that benchmark windows cover; columns as given.

    A document more than ``drop_above`` of whose words are hit goes as a whole. The stretch from the first to the last
    hit word of a run is cut out of the text; a column ``n_chars`` follows it. Other rows, columns and null texts stay.
    """
    own = documents.columns
    counted = "n_chars" in own

    def run(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c for c in names if c in own]
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            lo, hi = (batch.column(c).to_pylist() for c in ("__lo", "__hi"))
            texts, keep = columns["text"].to_pylist(), []
            sizes = columns["n_chars"].to_pylist() if counted else []
            for i, spans in enumerate(lo):
                if not spans:
                    keep.append(True)
                    continue
                raw = texts[i].encode()
                starts, ends, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
                kept, at, total, done = [], 0, 0, 0
                for a, b in sorted(zip(spans, hi[i], strict=True)):
                    total += max(0, b - max(a, done))
                    done = max(done, b)
                    kept.append(raw[at:max(at, int(starts[a]))])
                    at = max(at, int(ends[b - 1]))
                texts[i] = (b"".join(kept) + raw[at:]).decode()
                keep.append(total <= drop_above * len(starts))
                if counted:
                    sizes[i] = len(texts[i])
            columns["text"] = pa.array(texts, columns["text"].type)
            if counted:
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array(keep))
    return _scanned(documents, benchmark, n, max_broadcast_bytes, run, documents.schema)
