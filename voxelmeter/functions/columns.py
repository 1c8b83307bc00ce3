"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every operator must use the same numbers.
DICE_EPSILON = 1e-6
HIT_THRESHOLD = 0.1
Z_95 = 1.959963984540054
RECOMPOSE_TOLERANCE = 1e-12
CATEGORIES = ["1a", "1b", "1c", "1d", "1e", "1f", "2a", "2b", "2c", "2d", "2e", "2f", "2g", "2h"]

__all__ = [
    "DICE_EPSILON", "HIT_THRESHOLD", "Z_95", "RECOMPOSE_TOLERANCE", "CATEGORIES",
    "col", "dice", "hit", "precision", "recall", "ratio", "safe_mean", "logit", "sigmoid", "wilson_low",
    "wilson_high", "erfc", "two_proportion_p", "sha_unit", "md5_int", "tidy", "finite",
    "row_digest",
]


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dice(tp, pred, gt, epsilon: float = DICE_EPSILON) -> Column:
    """Smoothed overlap; exactly 1 when both masks are empty."""
    tp, pred, gt = col(tp), col(pred), col(gt)
    total = pred + gt
    return F.when(total == 0, F.lit(1.0)).otherwise((2 * tp + F.lit(epsilon)) / (total + F.lit(epsilon)))


def hit(dice_col, threshold: float = HIT_THRESHOLD) -> Column:
    return col(dice_col) >= F.lit(threshold)


def precision(tp, pred, gt, empty: str = "both_empty_is_one") -> Column:
    """``both_empty_is_one``: 1 when truth is empty too, else 0; ``zero``: always 0; ``null``."""
    tp, pred, gt = col(tp), col(pred), col(gt)
    fallback = {
        "both_empty_is_one": F.when(gt == 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        "zero": F.lit(0.0),
        "null": F.lit(None).cast("double"),
    }[empty]
    return F.when(pred > 0, tp / pred).otherwise(fallback)


def recall(tp, gt, empty: str = "one") -> Column:
    """Recall of an empty truth is 1 (``one``) or null (``null``)."""
    tp, gt = col(tp), col(gt)
    fallback = {"one": F.lit(1.0), "null": F.lit(None).cast("double")}[empty]
    return F.when(gt > 0, tp / gt).otherwise(fallback)


def ratio(numerator, denominator) -> Column:
    """Null, never NaN, when the denominator is zero."""
    denominator = col(denominator)
    return F.when(denominator != 0, col(numerator) / denominator)


def safe_mean(value) -> Column:
    return F.avg(col(value))


def logit(p) -> Column:
    p = col(p)
    return F.log(p / (F.lit(1.0) - p))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def _wilson(k, n, sign: int) -> Column:
    k, n = col(k).cast("double"), col(n).cast("double")
    z2 = Z_95 * Z_95
    share = k / n
    centre = (share + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(Z_95) * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    bounded = F.greatest(F.lit(0.0), centre - half) if sign < 0 else F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, bounded).otherwise(F.lit(0.0))


def wilson_low(k, n) -> Column:
    return _wilson(k, n, -1)


def wilson_high(k, n) -> Column:
    return _wilson(k, n, 1)


def erfc(x) -> Column:
    """Complementary error function from built-ins only.

    Below 3 the all-positive series ``erf(x) = 2/sqrt(pi) e^{-x^2} sum 2^n x^{2n+1}/(2n+1)!!``
    is summed; from 3 on the Laplace continued fraction keeps relative accuracy in the tail.
    """
    x = F.abs(col(x))
    start = F.struct(x.alias("term"), x.alias("total"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), start,
        lambda acc, n: F.struct(
            (acc["term"] * 2 * x * x / (2 * n + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * x * x / (2 * n + 1)).alias("total")),
        lambda acc: acc["total"])
    near = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * series
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda acc, n: x + (n / F.lit(2.0)) / acc)
    far = F.exp(-x * x) / (F.lit(math.sqrt(math.pi)) * tail)
    return F.when(x < 3, near).otherwise(far)


def two_proportion_p(k1, n1, k2, n2) -> Column:
    """Two-sided pooled z test; 1 when the pooled variance is zero."""
    k1, n1, k2, n2 = (col(c).cast("double") for c in (k1, n1, k2, n2))
    pooled = (k1 + k2) / (n1 + n2)
    variance = pooled * (1 - pooled) * (1 / n1 + 1 / n2)
    z = F.abs(k1 / n1 - k2 / n2) / F.sqrt(variance)
    return F.when(variance > 0, erfc(z / F.lit(math.sqrt(2.0)))).otherwise(F.lit(1.0))


def sha_unit(seed: int | str, *keys) -> Column:
    """Uniform draw in [0, 1): the first 13 hex digits of sha256("seed:key:...") over 16^13."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    digits = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")
    return digits.cast("double") / F.lit(float(16 ** 13))


def md5_int(seed: int | str, *keys) -> Column:
    """Non-negative 32-bit integer from md5("seed:key:...")."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def finite(x) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def row_digest(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """sha256 of one row as canonical JSON: columns in name order, nulls kept."""
    names = sorted(c for c in df.columns if c not in exclude)
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"}), 256)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns for comparison and turn -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])
