"""Document fingerprints by winnowing, from DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmeter.llm.sanitisation import let

GRAM = 4
WINDOW = 8
UNIT = r"[^\x20\x09-\x0D]{1,16}"
MIN_RANGES, MAX_RANGES, ROWS_PER_RANGE = 256, 4096, 2000
_PLACE_BITS = 27


def _window_min(values: Column, width: int) -> Column:
    """Least of each run of ``width`` values; one value for a shorter array."""
    def step(a: Column, by: int) -> Column:
        return F.zip_with(F.slice(a, F.lit(1), F.size(a) - by), F.slice(a, F.lit(by + 1), F.size(a) - by), lambda x, y: F.least(x, y))

    def fold(a: Column, have: int) -> Column:
        if have == width:
            return a
        by = min(have, width - have)
        return let(step(a, by), lambda b: fold(b, have + by))
    return let(values, lambda v: F.when(F.size(v) < width, F.array(F.array_min(v))).otherwise(fold(v, 1)))


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Selected k-gram hashes with their places, packed into longs: 36 bits of hash, then the place from the end of a range.

    A k-gram is ``gram`` consecutive units, a unit a run of up to 16 characters without ASCII white space. Of each ``window`` k-grams
    the least hash is taken, the rightmost of equal ones, and each selected place is kept once: any two texts that share
    gram + window - 1 units in a row share a selected hash. A text of fewer units is one k-gram; one without units has none.
    """
    far = F.lit((1 << _PLACE_BITS) - 1).cast("long")

    def rolled(h: Column) -> Column:
        def chain(acc: Column, j: int) -> Column:
            return acc if j == gram else chain(F.zip_with(F.slice(acc, F.lit(1), F.size(h) - gram + 1), F.slice(h, F.lit(j + 1), F.size(h) - gram + 1), lambda a, b: F.xxhash64(a, b)), j + 1)
        whole = F.array(F.xxhash64(h))
        return F.when(F.size(h) < gram, whole).otherwise(chain(F.slice(h, F.lit(1), F.size(h) - gram + 1), 1))

    def chosen(h: Column) -> Column:
        packed = F.transform(rolled(h), lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 28), _PLACE_BITS).bitwiseOR(far - i))
        return F.array_distinct(_window_min(packed, window))
    hashes = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(chosen(h)))


def _hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, _PLACE_BITS)))


def as_text(selected: Column) -> Column:
    """place:hash of each selection, in order of place."""
    far = F.lit((1 << _PLACE_BITS) - 1).cast("long")
    return F.array_join(F.transform(selected, lambda x: F.concat_ws(":", far - x.bitwiseAND(far), F.lower(F.hex(F.shiftright(x, _PLACE_BITS))))), ",")


def likeness(one: Column, two: Column) -> Column:
    """Jaccard similarity of the selected hashes; 1 for two empty fingerprints, 0 if one is empty."""
    return let(F.struct(_hashes(one).alias("a"), _hashes(two).alias("b")), lambda s: let(
        F.size(F.array_intersect(s["a"], s["b"])), lambda both: F.when(
            F.size(s["a"]) + F.size(s["b"]) == 0, F.lit(1.0)).otherwise(both / (F.size(s["a"]) + F.size(s["b"]) - both))))


def _range_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below the value, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    wide = math.isqrt(len(cuts)) + 1
    groups = [cuts[i:i + wide] for i in range(0, len(cuts), wide)]
    tops = F.array(*(F.lit(g[-1]) for g in groups))
    inner = F.array(*(F.array(*(F.lit(c) for c in g)) for g in groups), F.array().cast("array<bigint>"))
    return let(F.size(F.filter(tops, lambda t: t < value)), lambda i: i * wide + F.size(F.filter(F.get(inner, i), lambda c: c < value)))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row of next lower doc_id; the last one has those of the first.

    Rows are dealt by ranges of doc_id, so no task orders the whole table; only the last row of a range is joined with the first of
    the next. Rows of one doc_id follow in order of their columns; a row without doc_id comes behind all others.
    """
    ranges = min(MAX_RANGES, max(MIN_RANGES, rows.count() // ROWS_PER_RANGE))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(F.col("doc_id"), sorted(set(cuts))))
    within = W.partitionBy("__range").orderBy(F.col("doc_id").desc_nulls_last(), *columns)
    held = rows.withColumn("__range", bucket)
    ranked = held.select("*", *(F.lead(c).over(within).alias(f"next_{c}") for c in columns), F.lead(F.lit(True)).over(within).alias("__more"))
    heads = held.groupBy("__range").agg(F.min_by(F.struct(*columns), F.struct(-F.col("doc_id"), *columns)).alias("__head"))
    down = W.orderBy(F.desc("__range"))  # one short row for each range
    links = heads.select("__range").select(F.col("__range").alias("__from"), F.coalesce(F.lead("__range").over(down), F.first("__range").over(down)).alias("__range"))
    follow = links.join(heads, "__range").select("__from", "__head")
    out = ranked.join(follow, (F.col("__range") == F.col("__from")) & F.col("__more").isNull(), "left")
    return out.select(*rows.columns, *(F.when(F.col("__more").isNull(), F.col(f"__head.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns))


def fingerprints(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half gives way to the front of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. A null text is empty and has an
    empty fingerprint. Equal texts have equal fingerprints.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("chosen", winnow(F.col("text"), gram, window)), ["text", "chosen"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "chosen", "next_chosen", edited.alias("edited"))
    rows = rows.withColumn("edited_chosen", winnow(F.col("edited"), gram, window))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("chosen")).alias("fingerprint"),
                       as_text(F.col("edited_chosen")).alias("edited_fingerprint"), likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
                       likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"))
