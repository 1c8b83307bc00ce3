"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROFILE = 300
MAX_LANGUAGES = 10_000
SLICE_CHARS = 400_000
KEEP_GRAMS = 1_000_000
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter n-grams of one to three of lower-cased texts, with one blank around each word: (text, gram, count).

    A gram packs its code points, 21 bits each, first one highest. Rows come by text, then shorter grams first.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[:len(points)]
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters, the first stays as the blank
    points, letter, text = points[keep], letter[keep], text[keep]
    there = np.zeros(0x110000, bool)
    there[points[letter]] = True
    alphabet = np.concatenate([np.array([0, 32], np.int64), np.flatnonzero(there)])
    base, bits = len(alphabet), int(len(alphabet) ** 3).bit_length()
    if bits + len(texts).bit_length() > 62:
        raise ValueError("too many letters and texts in one slice")
    kind = np.int32 if bits + len(texts).bit_length() < 31 else np.int64
    code = np.ones(0x110000, kind)
    code[alphabet[2:]] = np.arange(2, base)
    edge = np.ones(1, kind)
    codes = np.concatenate([edge, code[points] if letter.all() else np.where(letter, code[points], kind(1)), edge])
    text = np.concatenate([edge, text, edge]).astype(kind)
    word = codes != 1
    owner = np.where(word[:-1], text[:-1], text[1:]) << bits
    two = codes[:-1] * kind(base) + codes[1:]
    three = two[:-1] * kind(base) + codes[2:]
    ok1, ok2, ok3 = word[:-1], word[:-1] | word[1:], word[1:-1]
    both = np.concatenate([(owner | codes[:-1])[ok1], (owner | two)[ok2], (owner[:-1] | three)[ok3]])
    both.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]]))
    both, count = both[first].astype(np.int64), np.diff(np.append(first, len(both)))
    gram = both & ((1 << bits) - 1)
    spelled = alphabet[gram // (base * base)] << 42 | alphabet[gram // base % base] << 21 | alphabet[gram % base]
    return both >> bits, spelled, count


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_CHARS characters, at most 500 rows."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (size + len(t) > SLICE_CHARS or i - lo == 500):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the most frequent n-grams of each language, rank 0 first; equal counts by gram.

    ``labelled`` has text and lang; rows that lack one are passed over. Counts cover all rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            first = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))
            return np.vstack([rows[:2, first], np.add.reduceat(rows[2], first)])

        def out(rows: np.ndarray) -> pa.RecordBatch:
            lang = pa.array(list(names)).take(pa.array(rows[0]))
            return pa.RecordBatch.from_arrays([lang, pa.array(rows[1]), pa.array(rows[2])], ["lang", "gram", "count"])

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lo, hi in _slices(texts):
                text, gram, count = gram_counts(texts[lo:hi])
                if len(text):
                    own = np.array([names.setdefault(x, len(names)) for x in langs[lo:hi]])
                    held.append(np.vstack([own[text], gram, count]))
                if sum(x.shape[1] for x in held) > KEEP_GRAMS:
                    held[:] = [merged()]
                    if held[0].shape[1] > KEEP_GRAMS // 2:
                        yield out(held.pop())
        if held:
            yield out(merged())
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = rows.mapInArrow(run, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    by = W.partitionBy("lang").orderBy(F.desc("count"), "gram")
    # As a limit on the row number itself, Spark cuts each task's groups before it shuffles and sorts them.
    return counted.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class _Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)  # the last row: a gram of no profile
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank

    def nearest(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        text, gram, count = gram_counts(texts)
        order = np.argsort(text << 32 | (1 << 31) - np.minimum(count, (1 << 31) - 1), kind="stable")
        text, gram = text[order], gram[order]
        begin = np.searchsorted(text, np.arange(len(texts) + 1))
        rank = np.arange(len(text)) - begin[text]
        top = rank < self.size
        text, gram, rank = text[top], gram[top], rank[top]
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        theirs = self.ranks[np.where(self.grams[place] == gram, place, len(self.grams))]
        away = np.where(theirs < 0, self.size, np.abs(theirs - rank[:, None]))
        begin = np.searchsorted(text, np.arange(len(texts) + 1))
        sums = np.vstack([np.zeros((1, len(self.langs)), np.int64), np.cumsum(away, axis=0, dtype=np.int64)])
        distance, n = sums[begin[1:]] - sums[begin[:-1]], np.diff(begin)
        best = distance.argmin(axis=1)
        score = 1 - distance[np.arange(len(texts)), best] / np.maximum(n * self.size, 1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def identify(documents: DataFrame, learned: DataFrame, size: int = PROFILE, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns ``keep`` per row: the language of least out-of-place distance.

    A document's most frequent n-grams are ranked; a gram's distance to a language is the difference of ranks, or
    ``size`` if the profile lacks it. The score is 1 less the share of the largest distance possible. A null text, one
    without letters, and any text when nothing was learned is ``und`` with score 0; equal distances go to the
    language first by name. Every row is judged for itself, whether or not its doc_id repeats or is null, and by its whole text, however
    long. The profiles are broadcast: ``size`` grams for each of at most MAX_LANGUAGES languages.
    """
    rows = [(r["lang"], r["gram"], r["rank"]) for r in learned.limit(MAX_LANGUAGES * size + 1).collect()]
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Profiles(rows, size) if rows else None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores = [], []
            for lo, hi in _slices(texts):
                lang, score = model.nearest(texts[lo:hi]) if model else ([UNKNOWN] * (hi - lo), np.zeros(hi - lo))
                langs += lang
                scores += score.tolist()
            columns = {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    chosen = documents.select("doc_id", *keep, F.col("text").cast("string").alias("text"))
    schema = chosen.drop("text").schema.add("lang_pred", "string").add("score", "double")
    return chosen.mapInArrow(run, schema)
