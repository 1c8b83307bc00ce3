"""Reconciliation, fingerprints and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmeter.functions import (RECOMPOSE_TOLERANCE, exact_quantiles, hash_smallest, hit, row_digest, salted_join)
from voxelmeter.operators.masks import KEY
from voxelmeter.session import checkpointed


def align(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """B1: ``missing``, ``extra`` and ``duplicate`` keys; no rows means exact alignment.

    One aggregate over both sides: a key that is repeated a billion times is one partial
    count per task.
    """
    both = observed.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("e")).union(
        expected.select(*keys, F.lit(0), F.lit(1)))
    seen = both.groupBy(*keys).agg(F.sum("o").alias("observed"), F.sum("e").alias("expected"))
    issue = F.filter(F.array(F.when(F.col("observed") == 0, "missing"), F.when(F.col("expected") == 0, "extra"),
                             F.when(F.col("observed") > 1, "duplicate")), lambda x: x.isNotNull())
    return seen.select(*keys, F.explode(issue).alias("issue"), "observed", "expected")


def recompose(evals: DataFrame, reported: DataFrame, tolerance: float = RECOMPOSE_TOLERANCE) -> DataFrame:
    """B2: reported means and hits against the rows, and the category recomposition.

    ``evals`` has ``category``; ``reported`` has ``candidate_id, dice, hits, findings``.
    """
    per = evals.groupBy("candidate_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dice").alias("mean"), F.sum("dice").alias("total"), F.count_if("hit").alias("h"),
        F.count_if(F.col("hit") != hit("dice")).alias("bad"))
    own = per.groupBy("candidate_id").agg(
        F.sum("n").alias("row_findings"), (F.sum("total") / F.sum("n")).alias("row_dice"), F.sum("h").alias("row_hits"),
        F.sum("bad").alias("bad_hit_rows"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("recomposed_dice"))
    rows = own.join(reported, "candidate_id", "full_outer")
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    return rows.select(
        "candidate_id", "row_findings", "row_dice", "row_hits", "bad_hit_rows",
        near("row_dice", "dice").alias("dice_ok"),
        F.coalesce(F.col("row_hits") == F.col("hits"), F.lit(False)).alias("hits_ok"),
        F.coalesce(F.col("row_findings") == F.col("findings"), F.lit(False)).alias("findings_ok"),
        near("recomposed_dice", "row_dice").alias("category_ok"),
        (F.col("bad_hit_rows") == 0).alias("hit_rule_ok"))


def fingerprint(df: DataFrame, exclude: tuple[str, ...] = (), by: list[str] | None = None) -> DataFrame:
    """sha256 of a row set, independent of physical order.

    Rows become digests of canonical JSON; each digest is cut into eight 32-bit words, and their sums over all rows, with the row count,
    are hashed. Sums combine before the shuffle, so one short row per task moves, however many rows there are.
    """
    by = by or []
    rows = df.select(*by, row_digest(df, exclude).alias("d"))
    words = [F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = rows.groupBy(*by).agg(*[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)], F.count(F.lit(1)).alias("rows"))
    marks = [F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(8)]
    return sums.select(*by, F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *marks), 256).alias("fingerprint"), "rows")


def manifest(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Relative path, size and sha256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = (root or path).rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def manifest_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``missing``, ``unexpected``, ``size_mismatch`` or ``hash_mismatch`` files."""
    a = stored.select("path", F.col("bytes").alias("b0"), F.col("sha256").alias("h0"))
    b = current.select("path", F.col("bytes").alias("b1"), F.col("sha256").alias("h1"))
    status = (F.when(F.col("h1").isNull(), "missing").when(F.col("h0").isNull(), "unexpected")
              .when(F.col("b0") != F.col("b1"), "size_mismatch").when(F.col("h0") != F.col("h1"), "hash_mismatch"))
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def readiness(expected: DataFrame, present: DataFrame, by: list[str]) -> DataFrame:
    """Arrival of expected files; ``present`` has ``path, bytes, incomplete``."""
    rows = expected.select(*by, "path").join(present, "path", "left")
    done = F.col("bytes").isNotNull() & ~F.coalesce(F.col("incomplete"), F.lit(False))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(done).alias("present"),
        F.count_if(F.col("incomplete")).alias("in_progress"), F.count_if(F.col("bytes").isNull()).alias("missing"),
        F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).alias("bytes"))
    return out.withColumn("ready", F.col("present") == F.col("expected"))


def validate_chain(events: DataFrame, part: list[str], seq: str, payload: Column) -> DataFrame:
    """Sequence, link and hash state of every row of an append-only log.

    The row before is found by an equi-join on (part, seq - 1), so one long log is spread
    over tasks; ``payload`` is the canonical text that the row hash covers.
    """
    before = events.groupBy(*part, (F.col(seq) + 1).alias(seq)).agg(
        F.min("hash").alias("__prev"), F.count(F.lit(1)).alias("__n"))
    own = events.groupBy(*part, seq).agg(F.count(F.lit(1)).alias("__own"))
    rows = events.join(before, [*part, seq], "left").join(own, [*part, seq])
    first = F.col(seq) == 1
    return rows.select(
        *part, seq,
        ((F.col("__own") == 1) & (first | (F.col("__n") == 1)) & (F.col(seq) >= 1)).alias("seq_ok"),
        F.when(first, F.col("previous_hash").isNull()).otherwise(
            F.coalesce(F.col("previous_hash") == F.col("__prev"), F.lit(False))).alias("link_ok"),
        (F.col("hash") == F.sha2(payload, 256)).alias("hash_ok"))


def merge_journal(segments: DataFrame, key: list[str], index: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row per (key, index) from overlapping segments, and a report per key.

    Equal copies collapse. Indices with different copies are conflicts and leave the merged
    rows; a gap is an index above 1 whose predecessor is missing.
    """
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    copies = segments.select(*key, index, *fields, digest.alias("__d")).groupBy(*key, index, "__d").agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(f).alias(f) for f in fields])
    rows = copies.groupBy(*key, index).agg(
        F.sum("__n").alias("copies"), F.count(F.lit(1)).alias("versions"), *[F.first(f).alias(f) for f in fields])
    follow = rows.select(*key, (F.col(index) + 1).alias(index)).withColumn("__has", F.lit(True))
    linked = rows.join(follow, [*key, index], "left")
    report = linked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("indices"), F.sum(F.col("copies") - 1).alias("duplicates"),
        F.count_if(F.col("versions") > 1).alias("conflicts"),
        F.count_if(F.col("__has").isNull() & (F.col(index) != 1)).alias("gaps"),
        F.min(index).alias("first_index"), F.max(index).alias("last_index"))
    report = report.withColumn("contiguous", (F.col("gaps") == 0) & (F.col("first_index") == 1))
    return rows.where(F.col("versions") == 1).select(*key, index, *fields), report


def reconcile(journal: DataFrame, cursor: DataFrame, key: list[str], index: str) -> DataFrame:
    """Rows past the checkpoint cursor are ``archived``, the rest ``kept``."""
    rows = salted_join(journal, cursor.select(*key, "cursor"), key, [index], "left")
    return rows.withColumn("state", F.when(F.col(index) <= F.coalesce("cursor", F.lit(0)), "kept").otherwise("archived")).drop("cursor")


def _det3(m) -> Column:
    return (m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0))
            + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0)))


def geometry_check(a: DataFrame, b: DataFrame, tol_vox: float, tol_mm: float) -> DataFrame:
    """Index and world agreement of two grids of the same case.

    ``inv(A) B`` comes from the adjugate in column arithmetic; residuals are taken at the
    eight corners of the grid.
    """
    rows = a.select("case_id", F.col("shape").alias("sa"), F.col("affine").alias("aa")).join(
        b.select("case_id", F.col("shape").alias("sb"), F.col("affine").alias("ab")), "case_id")
    m = lambda r, c: F.col("aa")[4 * r + c]
    n = lambda r, c: F.col("ab")[4 * r + c]
    det = _det3(m)
    minor = lambda r, c: (m((c + 1) % 3, (r + 1) % 3) * m((c + 2) % 3, (r + 2) % 3)
                          - m((c + 1) % 3, (r + 2) % 3) * m((c + 2) % 3, (r + 1) % 3))
    rows = rows.withColumn("det_a", det).withColumn("det_b", _det3(n))
    errors = []
    for r in range(3):
        for c in range(4):
            rhs = [n(k, c) - (m(k, 3) if c == 3 else F.lit(0.0)) for k in range(3)]
            value = sum((minor(r, k) * rhs[k] for k in range(3)), F.lit(0.0)) / F.col("det_a")
            errors.append(F.abs(value - F.lit(1.0 if r == c else 0.0)))
    corners = []
    for x in (0, 1):
        for y in (0, 1):
            for z in (0, 1):
                at = [F.lit(f) * (F.col("sa")[d] - 1) for d, f in enumerate((x, y, z))]
                gap = [sum(((m(r, d) - n(r, d)) * at[d] for d in range(3)), m(r, 3) - n(r, 3)) for r in range(3)]
                corners.append(F.sqrt(sum((g * g for g in gap), F.lit(0.0))))
    same = F.col("sa") == F.col("sb")
    vox = F.when(F.col("det_a") != 0, F.greatest(*errors))
    mm = F.when(same & (F.col("det_a") != 0), F.greatest(*corners))
    invalid, mismatch = F.lit("INVALID_CT_AFFINE"), F.lit("SHAPE_MISMATCH")
    state = lambda ok, name: (F.when(F.col("det_a") == 0, invalid).when(~same, mismatch)
                              .when(ok, "PASS").otherwise(name))
    hand = lambda c: F.when(F.col(c) > 0, "right").otherwise("left")
    return rows.select("case_id", same.alias("shape_identical"), vox.alias("max_index_error_vox"), mm.alias("max_corner_mm"),
                       hand("det_a").alias("handedness_a"), hand("det_b").alias("handedness_b"),
                       state(vox <= tol_vox, "INDEX_TRANSFORM_MISMATCH").alias("index_grid_status"),
                       state(mm <= tol_mm, "WORLD_CORNER_MISMATCH").alias("world_header_status"))


def label_qc(voxels: DataFrame, lut: DataFrame, headers: DataFrame) -> DataFrame:
    """Per case, labels outside the lookup table, fractional labels and foreground share.

    ``voxels`` holds one ``label`` (double) per voxel; ``lut`` the known label ids.
    """
    per = voxels.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))
    known = lut.select(F.col("label").cast("double").alias("label")).distinct().withColumn("known", F.lit(True))
    per = per.join(known, "label", "left")
    fg = F.col("label") > 0
    rows = per.groupBy("case_id").agg(
        F.count_if(fg).alias("labels"), F.sum(F.when(fg, F.col("n")).otherwise(0)).alias("foreground"),
        F.sum(F.when(F.col("label") != F.floor("label"), F.col("n")).otherwise(0)).alias("non_integer_voxels"),
        F.count_if(fg & F.col("known").isNull()).alias("unexpected_labels"))
    size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n)
    out = headers.select("case_id", size.alias("size")).join(rows, "case_id", "left").fillna(
        0, ["labels", "foreground", "non_integer_voxels", "unexpected_labels"])
    flags = F.filter(F.array(F.when(F.col("foreground") == 0, "empty"), F.when(F.col("non_integer_voxels") > 0, "non_integer"),
                             F.when(F.col("unexpected_labels") > 0, "unexpected")), lambda x: x.isNotNull())
    return out.select("case_id", "labels", "foreground", "non_integer_voxels", "unexpected_labels",
                      (F.col("foreground") / F.col("size")).alias("foreground_fraction"), F.array_join(flags, "|").alias("flags"))


def reconcile_counts(findings: DataFrame, voxels: DataFrame, cases: int, seed: int) -> DataFrame:
    """Recorded pixel count against counted mask voxels for a seeded sample of cases."""
    picked = hash_smallest(findings.select("case_id").distinct(), cases, seed, ["case_id"])
    rows = findings.select(*KEY, "pixels").join(picked, "case_id", "left_semi")
    counted = voxels.join(picked, "case_id", "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("counted"))
    status = (F.when(F.col("counted").isNull(), F.when(F.col("pixels") == 0, "ok").otherwise("missing"))
              .when(F.col("counted") == F.col("pixels"), "ok").otherwise("pixel_mismatch"))
    return rows.join(counted, KEY, "left").select(*KEY, "pixels", F.coalesce("counted", F.lit(0)).alias("counted"),
                                                  status.alias("status"))


def variant_audit(df: DataFrame, key: list[str], variant: str, baseline: str, fields: list[str],
                  ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """First field in which a variant differs from the baseline copy of the same key.

    ``ranges`` gives closed bounds for statistics; the first one out of bounds is named too.
    """
    base = df.where(F.col(variant) == baseline).select(*key, *[F.col(f).alias(f"b_{f}") for f in fields]).withColumn("has", F.lit(True))
    rows = df.where(F.col(variant) != baseline).join(base, key, "left")
    differ = F.array_compact(F.array(F.when(F.col("has").isNull(), "baseline_missing"), *[
        F.when(~F.col(f).eqNullSafe(F.col(f"b_{f}")), f) for f in fields]))
    beyond = F.array_compact(F.array(F.lit(None).cast("string"), *[
        F.when(~F.coalesce(F.col(f).between(lo, hi), F.lit(False)), f) for f, (lo, hi) in (ranges or {}).items()]))
    return rows.select(*key, variant, F.get(differ, F.lit(0)).alias("first_difference"), F.size(differ).alias("differences"),
                       F.get(beyond, F.lit(0)).alias("first_out_of_range"))


def mad_flags(df: DataFrame, key: list[str], value: str, group: list[str], threshold: float = 3.5) -> DataFrame:
    """Modified z = 0.6745 |x - median| / MAD, flagged above ``threshold``.

    Only positive values take part; groups under four values or with MAD 0 flag nothing.
    """
    rows = df.where(F.col(value) > 0)
    mid = exact_quantiles(rows, group, value, {"median": 0.5}).join(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("eligible")), group)
    tagged = salted_join(rows, mid, group, key)
    tagged = tagged.withColumn("__dev", F.abs(F.col(value) - F.col("median")))
    spread = exact_quantiles(tagged, group, "__dev", {"mad": 0.5})
    out = salted_join(tagged, spread, group, key)
    z = F.when((F.col("eligible") >= 4) & (F.col("mad") > 0), 0.6745 * F.col("__dev") / F.col("mad"))
    return out.select(*key, *[g for g in group if g not in key], value, "median", "mad", z.alias("modified_z"),
                      F.coalesce(z > threshold, F.lit(False)).alias("outlier"))


def pair_flags(df: DataFrame, key: list[str], left: str, right: str, floor: float, min_ratio: float = 0.25,
               fragments: str | None = None, largest: str | None = None) -> DataFrame:
    """left/right imbalance, absolute floor and fragmentation flags per row."""
    share = F.when((F.col(left) > 0) & (F.col(right) > 0), F.least(left, right) / F.greatest(left, right))
    flags = [F.when((F.col(left) == 0) | (F.col(right) == 0), "empty"), F.when(share < min_ratio, "left_right_volume_imbalance"),
             F.when(F.least(left, right) < floor, "very_small_volume")]
    if fragments:
        flags.append(F.when((F.col(fragments) > 5) | (F.col(largest) < 0.95), "fragmented"))
    return df.select(*key, left, right, share.alias("volume_ratio"), F.array_join(F.array_compact(F.array(*flags)), "|").alias("flags"))


def embedding_audit(prompts: DataFrame, bank: DataFrame, dim: int, key: str) -> DataFrame:
    """One row per problem: ``missing``, ``unused``, ``wrong_dimension``, ``non_finite``, ``zero``, ``duplicate``."""
    need = prompts.groupBy(key).agg(F.lit(True).alias("used"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    state = bank.select(key, (F.size("embedding") != dim).alias("wrong"),
                        F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("nonfinite"),
                        (norm == 0).alias("zero"))
    state = state.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("wrong", "nonfinite", "zero")])
    rows = need.join(state, key, "full_outer")
    problems = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "missing"), F.when(F.col("used").isNull(), "unused"), F.when(F.col("wrong"), "wrong_dimension"),
        F.when(F.col("nonfinite"), "non_finite"), F.when(F.col("zero"), "zero"), F.when(F.col("n") > 1, "duplicate")))
    return rows.select(key, F.explode(problems).alias("problem"))


def dedup_candidates(rows: DataFrame, identity: Column, signature: Column, prefer: list[str], eligible: Column) -> DataFrame:
    """One canonical row per identity (content hash), the rest ``duplicate`` or ``conflict``.

    The canonical row is the first by the ``prefer`` columns, which must tell rows apart.
    Copies whose metric signature differs from it are conflicts.
    """
    # Written once: a mean that is worked out again may differ in its last bits, and with it the signature.
    tagged = checkpointed(rows.withColumn("identity", identity).withColumn("signature", signature).withColumn("eligible", eligible))
    rank = F.struct(*prefer)
    first = tagged.groupBy("identity").agg(F.min(rank).alias("__first"), F.min_by("signature", rank).alias("__sig"))
    out = tagged.join(first, "identity")  # one row per identity on the right, as many as there are rows; hot identities are split by adaptive execution
    status = (F.when(rank == F.col("__first"), "canonical").when(F.col("signature") == F.col("__sig"), "duplicate").otherwise("conflict"))
    return out.withColumn("status", status).drop("__first", "__sig")


def storage_estimate(headers: DataFrame, targets: dict[str, tuple[float, float, float]], channels: str, by: list[str]) -> DataFrame:
    """Grid size, voxels and GiB of float images and byte targets at each spacing."""
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(float(s)) for s in sp]).alias("to"))
                                 for name, sp in targets.items()]))
    rows = headers.withColumn("t", wanted)
    size = lambda d: F.greatest(F.lit(1), F.bround(F.col("shape")[d] * F.col("spacing")[d] / F.col("t.to")[d], 0).cast("bigint"))
    rows = rows.withColumn("voxels", size(0) * size(1) * size(2))
    gib = float(1024 ** 3)
    return rows.groupBy(*by, F.col("t.name").alias("target")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("voxels").alias("voxels"), F.max("voxels").alias("max_voxels"),
        (F.sum(F.col("voxels") * 4) / gib).alias("image_gib"),
        (F.sum(F.col("voxels") * F.col(channels)) / gib).alias("target_gib"))


def leakage(df: DataFrame, split: str, keys: dict[str, Column], allowed: DataFrame | None = None) -> DataFrame:
    """Values of any key that occur in more than one split, minus an allowed list.

    Splits are few, so the collected set per value is small.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in keys.items()]))
    rows = df.select(F.col(split).alias("split"), kinds.alias("k")).select("split", "k.kind", "k.value")
    found = rows.groupBy("kind", "value").agg(F.array_join(F.sort_array(F.collect_set("split")), "|").alias("splits"),
                                              F.countDistinct("split").alias("n")).where("n > 1").drop("n")
    return found if allowed is None else found.join(allowed.select("kind", "value"), ["kind", "value"], "left_anti")
