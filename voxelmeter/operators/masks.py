"""Overlap metrics on sparse voxel tables.

A mask is one row per foreground voxel, ``(case_id, finding_id, i, j, k)``, repeated rows count once. It may also be stored as words,
``(case_id, finding_id, i, j, w, bits)``: bit ``k % 64`` of word ``k div 64`` of the line ``(i, j)`` (:func:`words`). Masks are compared word by
word: voxels are put into words before they are shuffled (a bitwise or is map-side combined), and an overlap is the number of bits that two
words share, so neither the shuffle nor the count has a row per voxel. The second aggregate per finding is map-side combined as well, so a huge
case only adds partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmeter.functions import (dice, exact_quantiles, hit, precision, ratio, recall, salted_join)

KEY = ["case_id", "finding_id"]
VOXEL = ["i", "j", "k"]
WORD = ["i", "j", "w"]


def _no_bits() -> F.Column:
    return F.lit(0).cast("bigint")


def _in_words(mask: DataFrame) -> bool:
    return {"w", "bits"} <= set(mask.columns)


def _bits(mask: DataFrame) -> list[F.Column]:
    """Place and bits of each row of a mask; a voxel is a word with one bit."""
    if _in_words(mask):
        return [F.col("i"), F.col("j"), F.col("w"), F.col("bits").alias("__bits")]
    return [F.col("i"), F.col("j"), F.expr("shiftright(k, 6)").cast("int").alias("w"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("__bits")]


def words(mask: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The mask as words, one row per word; takes voxels or words, and repeated rows of either."""
    return mask.select(*key, *_bits(mask)).groupBy(*key, *WORD).agg(F.bit_or("__bits").alias("bits"))


def voxels(table: DataFrame, bits: str | F.Column = "bits", keep: list[str] = KEY) -> DataFrame:
    """One row per set bit, ``keep`` and the voxel; no shuffle."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    rows = table.select(*keep, *WORD, bits.alias("__bits"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__at"))
    return rows.where("getbit(__bits, __at) = 1").select(*keep, "i", "j", F.expr("w * 64 + __at").cast("int").alias("k"))


def word_flags(masks: dict[str, DataFrame], key: list[str] = KEY, named: tuple[DataFrame, dict[str, F.Column]] | None = None) -> DataFrame:
    """One row per word of any mask with the bits of each. ``named`` adds a table whose rows belong to the mask whose condition they meet."""
    sources = [(mask, {name: F.lit(True)}) for name, mask in masks.items()] + ([named] if named else [])
    columns = [name for _, parts in sources for name in parts]
    rows = None
    for mask, parts in sources:
        own = {name: F.when(when, F.col("__bits")).otherwise(_no_bits()) for name, when in parts.items()}
        part = mask.withColumns({c: v for c, v in zip(["__i", "__j", "__w", "__bits"], _bits(mask))}).select(
            *key, F.col("__i").alias("i"), F.col("__j").alias("j"), F.col("__w").alias("w"), *[own.get(name, _no_bits()).alias(name) for name in columns])
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(*key, *WORD).agg(*[F.bit_or(name).alias(name) for name in columns])


def flagged(masks: dict[str, DataFrame], key: list[str] = KEY) -> DataFrame:
    """One row per voxel of any mask with a boolean column per mask."""
    rows = word_flags(masks, key).withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(63))))
    any_bit = " | ".join(f"`{name}`" for name in masks)
    return rows.where(f"getbit({any_bit}, __at) = 1").select(
        *key, "i", "j", F.expr("w * 64 + __at").cast("int").alias("k"), *[F.expr(f"getbit(`{name}`, __at) = 1").alias(name) for name in masks])


def _counts(rows: DataFrame, by: list[str], bits: dict[str, F.Column]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(F.bit_count(value)).alias(name) for name, value in bits.items()])


def _both(a: str | F.Column, b: str | F.Column) -> F.Column:
    one, two = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return one.bitwiseAND(two)


def _without(a: str | F.Column, b: str | F.Column) -> F.Column:
    return _both(a, F.bitwise_not(F.col(b) if isinstance(b, str) else b))


def with_counts(findings: DataFrame, counts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Left join onto the finding list so that findings without any voxel keep a zero row."""
    names = [c for c in counts.columns if c not in key]
    return findings.join(counts, key, "left").fillna(0, names)


def mask_metrics(findings: DataFrame, pred: DataFrame, gt: DataFrame, epsilon: float = 1e-6,
                 precision_empty: str = "both_empty_is_one", recall_empty: str = "one",
                 hit_threshold: float = 0.1) -> DataFrame:
    """Tp, fp, fn, dice, hit, precision, recall per finding, empties included."""
    rows = _counts(word_flags({"p": pred, "g": gt}), KEY, {"tp": _both("p", "g"), "n_pred": F.col("p"), "n_gt": F.col("g")})
    out = with_counts(findings, rows)
    return out.select(
        *findings.columns, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"),
        dice("tp", "n_pred", "n_gt", epsilon).alias("dice"),
        hit(dice("tp", "n_pred", "n_gt", epsilon), hit_threshold).alias("hit"),
        precision("tp", "n_pred", "n_gt", precision_empty).alias("precision"),
        recall("tp", "n_gt", recall_empty).alias("recall"))


def supported_metrics(findings: DataFrame, pred: DataFrame, gt: DataFrame, allowed: DataFrame) -> DataFrame:
    """Metrics of ``pred & allowed`` against the whole truth, and what the gate removed.

    ``allowed`` is a set of voxels per case ``(case_id, i, j, k)``, or words of it.
    """
    gate = words(allowed, ["case_id"]).withColumnRenamed("bits", "a").hint("merge")  # words of grids are never broadcast
    rows = word_flags({"p": pred, "g": gt}).join(gate, ["case_id", *WORD], "left").fillna(0, ["a"])
    hits = _both("p", "g")
    out = with_counts(findings, _counts(rows, KEY, {
        "tp0": hits, "p0": F.col("p"), "g0": F.col("g"), "tp": _both(hits, "a"), "pn": _both("p", "a"), "gn": _both("g", "a")}))
    return out.select(*findings.columns, *support_columns())


def support_columns() -> list[F.Column]:
    """Metric columns from tp0, p0, g0 (before) and tp, pn, gn (inside the gate)."""
    c = F.col
    return [
        dice("tp", "pn", "g0").alias("dice"), hit(dice("tp", "pn", "g0")).alias("hit"),
        precision("tp", "pn", "g0", "zero").alias("precision"), recall("tp", "g0").alias("recall"),
        F.when(c("g0") > 0, c("gn") / c("g0")).otherwise(F.lit(1.0)).alias("gt_coverage"),
        c("g0").alias("gt_voxels"), c("pn").alias("pred_voxels"), c("tp"), (c("pn") - c("tp")).alias("fp"),
        (c("tp0") - c("tp")).alias("tp_removed"),
        ((c("p0") - c("tp0")) - (c("pn") - c("tp"))).alias("fp_removed"),
        ((c("g0") > 0) & (c("gn") == 0)).alias("gt_completely_excluded"),
        ((c("p0") > 0) & (c("pn") == 0)).alias("prediction_emptied")]


def edit_metrics(findings: DataFrame, base: DataFrame, final: DataFrame, gt: DataFrame,
                 headers: DataFrame | None = None) -> DataFrame:
    """What an edit of ``base`` into ``final`` removed, recovered and added.

    With ``headers`` the edited share of the whole extent is given as well.
    """
    b, f, y = F.col("b"), F.col("f"), F.col("y")
    gone, new = _without(b, f), _without(f, b)
    rows = _counts(word_flags({"b": base, "f": final, "y": gt}), KEY, {
        "base_tp": _both(b, y), "base_pred": b, "tp": _both(f, y), "n_pred": f, "n_gt": y,
        "fp_removed": _without(gone, y), "fn_recovered": _both(new, y), "tp_removed": _both(gone, y),
        "fp_added": _without(new, y), "edited": b.bitwiseXOR(f), "touched": b.bitwiseOR(f).bitwiseOR(y)})
    out = with_counts(findings, rows)
    before, after = dice("base_tp", "base_pred", "n_gt"), dice("tp", "n_pred", "n_gt")
    out = out.select(
        *findings.columns, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"),
        before.alias("base_dice"), after.alias("dice"), (after - before).alias("delta_dice"),
        hit(before).alias("base_hit"), hit(after).alias("hit"),
        "fp_removed", "fn_recovered", "tp_removed", F.col("fp_added").alias("tn_added"), "edited",
        (F.col("edited") / F.greatest(F.lit(1), F.col("touched"))).alias("edited_fraction_union"))
    if headers is not None:
        size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n)
        out = salted_join(out, headers.select("case_id", size.alias("__n")), ["case_id"], ["finding_id"], "left")
        out = out.withColumn("edited_fraction", F.col("edited") / F.col("__n")).drop("__n")
    return out


def tristate(domain: DataFrame, positive: DataFrame, negative: DataFrame,
             unknown: DataFrame | None = None, key: list[str] = KEY) -> DataFrame:
    """C4: label every domain voxel 1 (known positive), 0 (certified negative) or -1 (unknown).

    Rows that break the contract carry a ``violation``: ``overlap`` when two states claim
    a voxel, ``gap`` when an explicit unknown mask leaves it unclaimed, ``outside`` when
    a mask leaves the domain.
    """
    masks = {"d": domain, "y": positive, "n": negative}
    if unknown is not None:
        masks["u"] = unknown
    rows = flagged(masks, key)
    y, n = F.col("y"), F.col("n")
    u = F.col("u") if unknown is not None else ~(y | n)
    claims = y.cast("int") + n.cast("int") + u.cast("int")
    return rows.select(
        *key, *VOXEL, F.when(y, 1).when(n, 0).otherwise(-1).cast("tinyint").alias("state"),
        F.when(claims > 1, "overlap").when(claims == 0, "gap").when(~F.col("d"), "outside").alias("violation"))


# The six classes of a predicted voxel, in priority order.
PARTITION = ["known_positive", "ipsilateral", "contralateral", "outside_lung", "other_certified", "unknown"]
OFF_LOCATION = ["ipsilateral", "contralateral", "outside_lung"]
CERTIFIED = OFF_LOCATION + ["other_certified"]


def partition_words(pred: DataFrame, positive: DataFrame, regions: DataFrame) -> DataFrame:
    """The classes of :func:`partition_fp` as words, a column of bits for each and one for ``violation``."""
    where = {name: F.col("region") == name for name in CERTIFIED}
    where["named"] = F.col("region").isNotNull()
    where["uncertified"] = F.col("region").isNotNull() & ~F.col("region").isin(CERTIFIED)
    rows = word_flags({"p": pred, "y": positive}, named=(regions, where)).where("p <> 0")
    taken, twice, own = _no_bits(), _no_bits(), {}
    for name in sorted(CERTIFIED):  # the first name in order wins a disputed voxel
        own[name] = _without(name, taken)
        twice, taken = twice.bitwiseOR(_both(name, taken)), taken.bitwiseOR(F.col(name))
    twice = twice.bitwiseOR(_both("uncertified", taken))
    classes = {"known_positive": F.col("y"), **{name: _without(own[name], "y") for name in CERTIFIED}, "unknown": F.bitwise_not(taken.bitwiseOR(F.col("y")))}
    return rows.select(*KEY, *WORD, *[_both("p", classes[name]).alias(name) for name in PARTITION],
                       _both("p", twice.bitwiseOR(_both("y", "named"))).alias("violation"))


def partition_fp(pred: DataFrame, positive: DataFrame, regions: DataFrame) -> DataFrame:
    """Class of every predicted voxel.

    ``regions`` maps ``(case_id, finding_id, i, j, k)`` to one of ``ipsilateral``,
    ``contralateral``, ``outside_lung`` or ``other_certified``. A voxel that is certified
    negative and also known positive, or that two regions claim, breaks the contract and gets
    ``violation``; of two certified regions the first by name counts, and regions of other names count as one.
    """
    rows = partition_words(pred, positive, regions).withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(63))))
    part = F.coalesce(*[F.when(F.expr(f"getbit({name}, __at) = 1"), name) for name in PARTITION])
    return rows.select(*KEY, "i", "j", F.expr("w * 64 + __at").cast("int").alias("k"), part.alias("part"),
                       F.expr("getbit(violation, __at) = 1").alias("violation")).where("part is not null")


def partition_summary(findings: DataFrame, parts: DataFrame, headers: DataFrame) -> DataFrame:
    """Counts, volumes and the two guarded fractions per finding, from the classes as voxels or as words."""
    if "part" in parts.columns:
        counts = parts.groupBy(*KEY).agg(*[F.count_if(F.col("part") == name).alias(name) for name in PARTITION])
    else:
        counts = _counts(parts, KEY, {name: F.col(name) for name in PARTITION})
    out = with_counts(findings.select(*KEY), counts)
    unit = headers.select("case_id", voxel_volume("affine").alias("unit"))
    out = salted_join(out, unit, ["case_id"], ["finding_id"], "left")
    off = sum((F.col(c) for c in OFF_LOCATION), F.lit(0))
    certified = sum((F.col(c) for c in CERTIFIED), F.lit(0))
    total = sum((F.col(c) for c in PARTITION), F.lit(0))
    return out.select(
        *KEY, *[F.col(c).alias(f"{c}_voxels") for c in PARTITION],
        *[(F.col(c) * F.col("unit")).alias(f"{c}_mm3") for c in PARTITION],
        off.alias("off_location_voxels"), (off * F.col("unit")).alias("off_location_mm3"),
        certified.alias("certified_fp_voxels"), total.alias("predicted_voxels"),
        ratio(off, total).alias("off_location_fraction"),
        ratio(F.col("known_positive"), F.col("known_positive") + certified).alias("certified_precision"))


def voxel_volume(affine: str) -> F.Column:
    """|det| of the linear part of a row-major 4x4 affine."""
    a = lambda n: F.col(affine)[n]
    return F.abs(a(0) * (a(5) * a(10) - a(6) * a(9)) - a(1) * (a(4) * a(10) - a(6) * a(8))
                 + a(2) * (a(4) * a(9) - a(5) * a(8)))


def to_world(points: DataFrame, headers: DataFrame, midline: float = 0.0, tolerance: float = 1e-6) -> DataFrame:
    """World coordinates, voxel volume and laterality of voxel centres."""
    need = headers.select("case_id", "affine")
    rows = salted_join(points, need, ["case_id"], VOXEL)
    a = lambda n: F.col("affine")[n]
    world = [(a(4 * row) * F.col("i") + a(4 * row + 1) * F.col("j") + a(4 * row + 2) * F.col("k") + a(4 * row + 3))
             for row in range(3)]
    rows = rows.select(*points.columns, world[0].alias("x"), world[1].alias("y"), world[2].alias("z"),
                       voxel_volume("affine").alias("voxel_mm3"))
    side = (F.when(F.col("x") > midline + tolerance, "right").when(F.col("x") < midline - tolerance, "left")
            .otherwise("midline"))
    return rows.withColumn("side", side)


def left_right_axis(headers: DataFrame) -> DataFrame:
    """Voxel axis that contributes most to world x, and the side it points to."""
    parts = F.array(*[F.struct(F.abs(F.col("affine")[n]).alias("m"), F.lit(-n).alias("o"),
                               F.col("affine")[n].alias("v")) for n in range(3)])
    best = F.array_max(parts)
    return headers.select("case_id", (-best["o"]).alias("voxel_axis"), best["v"].alias("mm_per_voxel"),
                          F.when(best["v"] > 0, "right").otherwise("left").alias("positive_direction"))


def reindex(voxels: DataFrame, headers: DataFrame, order: tuple[int, int, int], flip: tuple[bool, bool, bool]):
    """Swap and flip axes; ``order[a]`` is the old axis that becomes new axis ``a``."""
    rows = salted_join(voxels, headers.select("case_id", "shape"), ["case_id"], VOXEL)
    moved = []
    for new, (old, turn) in enumerate(zip(order, flip)):
        axis = F.col(VOXEL[old])
        moved.append(((F.col("shape")[old] - 1 - axis) if turn else axis).alias(VOXEL[new]))
    return rows.select(*[c for c in voxels.columns if c not in VOXEL], *moved)


def label_overlap(target: DataFrame, atlas: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """C14: voxels of each target per atlas label, best label, background and group shares."""
    labels = atlas.select("case_id", *VOXEL, "label").where(F.col("label") > 0).hint("merge")  # a grid is never broadcast, however small it is taken for
    per = (target.join(labels, ["case_id", *VOXEL], "left").fillna(0, ["label"])
           .groupBy(*KEY, "label").agg(F.count(F.lit(1)).alias("n")))
    fg = F.col("label") > 0
    share = lambda cond: ratio(F.sum(F.when(cond, F.col("n")).otherwise(0)), F.sum("n"))
    return per.groupBy(*KEY).agg(
        F.sum("n").alias("voxels"), F.count_if(fg).alias("labels_touched"),
        F.max_by(F.when(fg, F.col("label")), F.when(fg, F.struct(F.col("n"), -F.col("label")))).alias("best_label"),
        F.coalesce(F.max(F.when(fg, F.col("n"))), F.lit(0)).alias("best_voxels"),
        share(~fg).alias("background_share"),
        *[share(F.col("label").isin(members)).alias(f"{name}_share") for name, members in groups.items()])


def label_presence(atlas: DataFrame, headers: DataFrame) -> DataFrame:
    """Per label, cases that have it and the distribution of its volume where present."""
    per = atlas.where(F.col("label") > 0).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))
    unit = headers.select("case_id", voxel_volume("affine").alias("unit"))
    per = salted_join(per, unit, ["case_id"], ["label"]).withColumn("mm3", F.col("n") * F.col("unit"))
    cases = headers.agg(F.countDistinct("case_id").alias("cases_total"))
    stats = per.groupBy("label").agg(
        F.count(F.lit(1)).alias("cases_present"), F.sum("n").alias("voxels"), F.sum("mm3").alias("volume_mm3"),
        F.min("n").alias("min_voxels"), F.max("n").alias("max_voxels"))
    median = exact_quantiles(per, ["label"], "n", {"median_voxels": 0.5})
    out = stats.join(median, "label").crossJoin(F.broadcast(cases))
    return out.withColumn("present_fraction", F.col("cases_present") / F.col("cases_total")).drop("cases_total")


def outside_support(findings: DataFrame, gt: DataFrame, support: DataFrame) -> DataFrame:
    """Truth voxels outside the support, per finding."""
    rows = with_counts(findings, _outside(words(gt), support, KEY))
    return rows.withColumn("outside_fraction", ratio("outside_voxels", "gt_voxels"))


def outside_by_case(gt: DataFrame, support: DataFrame) -> DataFrame:
    """The same for the union of a case's findings; a shared voxel counts once."""
    return _outside(words(gt, ["case_id"]), support, ["case_id"])


def _outside(truth: DataFrame, support: DataFrame, key: list[str]) -> DataFrame:
    inside = words(support, ["case_id"]).withColumnRenamed("bits", "a").hint("merge")  # words of grids are never broadcast
    rows = truth.join(inside, ["case_id", *WORD], "left").fillna(0, ["a"])
    return _counts(rows, key, {"gt_voxels": F.col("bits"), "outside_voxels": _without("bits", "a")})


def outside_by_category(rows: DataFrame) -> DataFrame:
    """Distribution over the findings of a category."""
    base = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("outside_voxels") > 0).alias("affected"),
        F.sum("outside_voxels").alias("outside_voxels"), F.avg("outside_voxels").alias("mean_outside"),
        F.max("outside_voxels").alias("max_outside"))
    qs = exact_quantiles(rows, ["category"], "outside_voxels", {"median_outside": 0.5, "p95_outside": 0.95})
    return base.join(qs, "category")


def compose(masks: DataFrame, winners: DataFrame, findings: DataFrame) -> DataFrame:
    """Per finding the mask of the model chosen for its category.

    ``masks`` has ``candidate_id``; ``winners`` is one ``(category, candidate_id)`` row per category.
    """
    chosen = findings.select(*KEY, "category").join(winners, "category")
    return masks.join(chosen, [*KEY, "candidate_id"]).select(*masks.columns)
