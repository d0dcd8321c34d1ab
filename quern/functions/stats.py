"""Column expressions and small numeric routines shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unbiased_skew(x: Column) -> Column:
    """Bias-corrected G1; null with fewer than 3 values; 0 for a constant column."""
    n = F.count(x).cast("double")
    g = F.when(F.stddev_pop(x) == 0, F.lit(0.0)).otherwise(F.skewness(x))
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis G2; null with fewer than 4 values; 0 for a constant column."""
    n = F.count(x).cast("double")
    g = F.when(F.stddev_pop(x) == 0, F.lit(None).cast("double")).otherwise(F.kurtosis(x))
    return F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6), F.lit(0.0)))


def plain_missing(name: str, kind: str) -> Column:
    """The column with NaN as null, so that both count as missing."""
    c = F.col(f"`{name}`")
    return F.nanvl(c, F.lit(None).cast(kind)) if kind in ("double", "float") else c


def hash_bucket(*keys: Column, seed: str | int = 0) -> Column:
    """A whole number of 32 bits from the seed and the keys, the same in any engine and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_share(*keys: Column, seed: str | int = 0) -> Column:
    return hash_bucket(*keys, seed=seed) / F.lit(float(1 << 32))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        k = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            step = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / max(1 + step * d, 1e-300) if 1 + step * d > 0 else 1 / min(1 + step * d, -1e-300)
        c = 1 + step / (c or 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) / a if f != 1 else 0.0


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection, for p above 0.5."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2
