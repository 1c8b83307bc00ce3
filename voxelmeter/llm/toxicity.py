"""Toxic passages: maximal-scoring segments of token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmeter.llm.arrays import ALNUM, LOWER, byte_chunks, thrifty, word_bounds, word_hashes

SAMPLE_ROWS = 50_000
PRIOR_TOKENS = 20_000.0
MIN_Z = 3.0
MAX_TOKENS = 1_000_000
DRIFT = -0.25
KEEP_TOKENS = 400_000
THRESHOLD = 0.3


@dataclass
class Model:
    """Scores of significant tokens (the others score ``rest``), the parameters of the extreme-value law, and the calibration."""

    tokens: np.ndarray
    scores: np.ndarray
    rest: float
    lam: float
    k: float
    weights: np.ndarray


def training_rows(labels: DataFrame, held_out: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most ``sample_rows`` labelled documents, those of least hash of the id; conflicting labels count as toxic."""
    known = labels.where(~held_out & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, in order; and where each row's begin."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    return word_hashes(data, starts, ends).view(np.int64), first


def _counts(rows: DataFrame) -> DataFrame:
    """(token, n, n_toxic, n_clean) over all rows; toxic is null where a row is not a training row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            token, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return np.vstack([token, *(np.bincount(back, np.concatenate([x[i] for x in held]), len(token)).astype(np.int64) for i in (1, 2, 3))])

        def out() -> pa.RecordBatch:
            rows = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["token", "n", "n_toxic", "n_clean"])

        for batch in batches:
            label = batch.column("toxic").fill_null(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in byte_chunks(batch.column("text")):
                token, first = _tokens(data, offsets)
                kind = np.repeat(label[lo:hi], np.diff(first))
                unique, back = np.unique(token, return_inverse=True)
                held.append(np.vstack([unique, *(np.bincount(back[which], minlength=len(unique)) for which in (slice(None), kind == 1, kind == 0))]))
            if sum(x.shape[1] for x in held) > KEEP_TOKENS:
                held[:] = [merged()]
                if held[0].shape[1] > KEEP_TOKENS // 2:
                    yield out()
        if held:
            yield out()
    return rows.mapInArrow(thrifty(run), "token long, n long, n_toxic long, n_clean long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "n_toxic", "n_clean")))


def _log_odds(counts: DataFrame, prior_tokens: float, min_z: float) -> tuple[list, tuple[int, int, int]]:
    """Tokens whose log-odds between the classes differ from 0 by ``min_z`` deviations; and the totals.

    The prior of a token is its share of all documents' tokens, worth ``prior_tokens`` tokens in all.
    """
    counts = counts.persist()
    total, toxic, clean = counts.agg(F.sum("n"), F.sum("n_toxic"), F.sum("n_clean")).first()
    total, toxic, clean = total or 0, toxic or 0, clean or 0
    prior = F.col("n") / F.lit(float(max(total, 1))) * prior_tokens

    def odds(have: str, n: int) -> Column:
        return F.log((F.col(have) + prior) / (F.lit(n + prior_tokens) - F.col(have) - prior))
    scored = counts.where((F.col("n_toxic") > 0) | (F.col("n_clean") > 0)).select(
        "token", "n", "n_toxic", "n_clean", (odds("n_toxic", toxic) - odds("n_clean", clean)).alias("score"),
        (1 / (F.col("n_toxic") + prior) + 1 / (F.col("n_clean") + prior)).alias("variance"))
    z = F.abs(F.col("score")) / F.sqrt("variance")
    significant = scored.where(z >= min_z)
    found = significant.count()
    if found > MAX_TOKENS:
        raise ValueError(f"{found} tokens are significant; every task holds them, so {MAX_TOKENS} is the most. Raise min_z or take a smaller sample of labels.")
    rows = significant.collect()
    counts.unpersist()
    return rows, (total, toxic, clean)


def _extreme_law(values: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """lambda with E[exp(lambda s)] = 1, and a bound-type K, for tokens drawn independently from the background."""
    if not len(values) or values.max() <= 0 or values @ shares >= 0:
        return 1.0, 0.1
    lo, hi = 1e-6, 300 / values.max()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if shares @ np.exp(mid * values) < 1 else (lo, mid)
    mean, drift = shares @ (values * np.exp(lo * values)), -(values @ shares)
    return lo, float(np.clip(lo * drift * drift / max(mean, 1e-9), 1e-6, 1.0))


def segments(positions: np.ndarray, scores: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, end token, score) of a text, in linear time.

    ``positions`` of the tokens that do not score ``rest`` (negative), and their scores. Runs of ``rest`` between them
    are taken as one step. A candidate keeps the running sums before and behind it; a new one is merged with the
    nearest candidate on its left that starts from a lower sum, if that one ends lower than the new one.
    """
    found: list[list] = []  # first, end, sum before, sum behind, link to the last candidate that starts lower
    total, at = 0.0, 0
    for p, s in zip(positions.tolist(), scores.tolist(), strict=True):
        total += (p - at) * rest
        at = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        new = [p, p + 1, before, total, -1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], found[j][4]]
            del found[j:]
            j = new[4]
    return [(f[0], f[1], f[3] - f[2]) for f in found]


def _features(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Per row: the calibrated surprise of the best segment, of all significant ones together, and their number; the significant segments."""
    token, first = _tokens(data, offsets)
    n = np.diff(first)
    features, spans = np.zeros((len(n), 3)), [[] for _ in n]
    if not len(model.tokens):
        return features, spans
    place = np.minimum(np.searchsorted(model.tokens, token), len(model.tokens) - 1)
    known = np.flatnonzero(model.tokens[place] == token)
    scores = model.scores[place[known]]
    cut = np.searchsorted(known, first)
    positive = np.add.reduceat(np.append(scores > 0, False), np.minimum(cut[:-1], len(scores))) if len(cut) > 1 else []
    for r in range(len(n)):
        lo, hi = cut[r], cut[r + 1]
        if lo == hi or not positive[r]:
            continue
        floor = math.log(max(model.k * n[r], 1e-9))
        best = 0.0
        for a, b, s in segments(known[lo:hi] - first[r], scores[lo:hi], model.rest):
            bits = model.lam * s - floor  # minus the log of the number of such segments expected by chance
            best = max(best, bits)
            if bits > 0:
                features[r, 1] += bits
                features[r, 2] += 1
                spans[r].append((a, b, bits))
        features[r, 0] = best
    return np.log1p(features), spans


def _probability(model: Model, features: np.ndarray) -> np.ndarray:
    x = np.hstack([features, np.ones((len(features), 1))])
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(documents: DataFrame, training: DataFrame, prior_tokens: float = PRIOR_TOKENS, min_z: float = MIN_Z) -> Model:
    """Model from all documents' token counts (the prior) and a bounded table of training rows (doc_id, toxic).

    Tokens are ASCII-lower-cased words of letters, digits and characters beyond ASCII. Without training rows of both
    kinds every text gets the share of toxic rows, or 0 if there are none. All tokens that are significant among the training rows are
    kept, and their number is bounded by that of the rows; more than MAX_TOKENS are an error.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.join(F.broadcast(training), "doc_id", "left").select("text", "toxic")
    tokens, (total, n_toxic, n_clean) = _log_odds(_counts(marked), prior_tokens, min_z)
    order = np.argsort([t["token"] for t in tokens]) if tokens else []
    hashes = np.array([tokens[i]["token"] for i in order], np.int64)
    scores = np.array([tokens[i]["score"] for i in order], float)
    shares = np.array([tokens[i]["n_clean"] + prior_tokens * tokens[i]["n"] / total for i in order], float) / (n_clean + prior_tokens)
    lam, k = _extreme_law(np.append(scores, DRIFT), np.append(shares, max(0.0, 1 - shares.sum())))
    model = Model(hashes, scores, DRIFT, lam, k, np.array([0.0, 0, 0, -30.0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column("text")):
                x, _ = _features(model, data, offsets)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column("toxic").slice(lo, hi - lo)], ["a", "b", "c", "toxic"])
    got = rows.join(F.broadcast(training), "doc_id").select("text", "toxic").mapInArrow(thrifty(run), "a double, b double, c double, toxic int").toPandas()
    y = got["toxic"].to_numpy(float)
    if len(y):
        share = float(np.clip(y.mean(), 1e-9, 1 - 1e-9))
        model.weights = _logistic(got[["a", "b", "c"]].to_numpy(float), y) if 0 < y.mean() < 1 else np.array([0.0, 0, 0, math.log(share / (1 - share))])
    return model


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, name: str = "score", flag: str = "predicted", spans: str = "passages") -> DataFrame:
    """``documents`` with columns ``name`` (0 to 1), ``flag`` (0 or 1) and ``spans`` (first and end token, surprise in nats).

    Passages are the maximal segments whose score is rarer than chance in a clean text of that length. A null or empty
    text has no token and gets the score of a text without any passage. Every row is scored for itself, whether or not its doc_id repeats
    or is null, and however long its text is. Columns of these names are replaced.
    """
    names = [c for c in documents.columns if c not in (name, flag, spans)]
    kept = documents.select(*names)
    schema = kept.select("*", F.lit(0.0).alias(name), F.lit(0).alias(flag), F.expr("cast(null as array<struct<first:int,end:int,surprise:double>>)").alias(spans)).schema
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, passages = [], []
            for _, _, data, offsets in byte_chunks(batch.column("text")):
                x, found = _features(model, data, offsets)
                p.append(_probability(model, x))
                passages += [[{"first": a, "end": b, "surprise": s} for a, b, s in row] for row in found]
            p = np.concatenate([np.zeros(0), *p])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(passages, kind)], [*names, name, flag, spans])
    return kept.mapInArrow(thrifty(run), schema)
