"""Row-level expressions. NULL is the only missing value; NaN never leaves these helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """a / b, NULL where b is NULL or 0."""
    return F.try_divide(_c(a), F.nullif(_c(b), F.lit(0.0)))


def nan_to_null(x) -> Column:
    return F.when(~F.isnan(_c(x)), _c(x))


def finite_or_null(x) -> Column:
    """NULL for NaN and both infinities."""
    c = _c(x)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clip(x, lo=None, hi=None) -> Column:
    """Bounds a value and keeps NULL (``greatest``/``least`` alone would skip it)."""
    c = _c(x)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def flag(condition: Column) -> Column:
    """1/0 with NULL counted as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


# Abramowitz and Stegun 7.1.26 rational approximation of erf, |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x) -> Column:
    c = _c(x)
    a = F.abs(c)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * a)
    poly = F.lit(0.0)
    for coefficient in reversed(ERF_A):
        poly = (poly + F.lit(coefficient)) * t
    return F.signum(c) * (F.lit(1.0) - poly * F.exp(-a * a))


def normal_cdf(z) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(_c(z) / F.lit(math.sqrt(2.0))))


def hash_uniform(*parts) -> Column:
    """Deterministic number in [0, 1) from the first 32 bits of an md5 over the joined parts."""
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def poisson_one_cdf(upper: int = 12) -> list[float]:
    """P(X <= k), k = 0 .. upper, for a Poisson variable with mean one."""
    total, out = 0.0, []
    for k in range(upper + 1):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inversion of a uniform number; what lies beyond the table is capped at its end,
    an event of probability below 1e-10."""
    out = None
    for k, edge in enumerate(poisson_one_cdf()):
        hit = u < F.lit(edge)
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return out.otherwise(F.lit(13))
