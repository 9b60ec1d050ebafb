"""Scalar and aggregate column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe: never raises)."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def weighted_mean(x, w) -> Column:
    """Aggregate: sum(x*w) / sum(w), NULL when the weights sum to 0."""
    x, w = _col(x), _col(w)
    return F.try_divide(F.sum(x.cast("double") * w.cast("double")), F.sum(w.cast("double")))


def ratio_of_sums(num, den) -> Column:
    """Aggregate: sum(num) / sum(den).

    Equal to ``weighted_mean(num/den, den)`` wherever den > 0; the sums are taken in
    the input type (exact for DECIMAL) before one division.
    """
    return F.try_divide(F.sum(_col(num)).cast("double"), F.sum(_col(den)).cast("double"))


def nan_to_null(c) -> Column:
    """Treat NaN as missing: NaN -> NULL, other values unchanged."""
    c = _col(c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


# Chebyshev coefficients of the complementary error function
# approximation "erfcc" (Numerical Recipes, 2nd ed., section 6.2), relative error < 1.2e-7.
ERFC_COEFFS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x) -> Column:
    """Complementary error function as one Column expression (Spark has no erf/erfc)."""
    x = _col(x).cast("double")
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFFS[-1])
    for coef in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(coef) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def erfc_sql(x: str) -> str:
    """The same approximation as SQL text (used by oracle queries)."""
    z = f"abs({x})"
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    poly = repr(ERFC_COEFFS[-1])
    for coef in reversed(ERFC_COEFFS[:-1]):
        poly = f"({coef!r} + {t} * {poly})"
    ans = f"({t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def normal_two_sided_p(z) -> Column:
    """Two-sided normal tail probability 2*(1-Phi(|z|)) = erfc(|z|/sqrt 2)."""
    return erfc(F.abs(_col(z)) / F.lit(math.sqrt(2.0)))


def hash_u32(*parts) -> Column:
    """Deterministic 32-bit unsigned hash of the ':'-joined text of ``parts``.

    md5 is used because the same value is reproducible in SQL engines
    (``('0x' || substr(md5(s), 1, 8))::BIGINT``), which makes Monte-Carlo
    permutations exactly testable.
    """
    text = F.concat_ws(":", *[_col(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column to ``digits`` places (stable comparison form)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
