"""Statistics: column expressions for intervals and tests, and small exact computations on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fisher_low_high(r: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a correlation by Fisher's z, r held within 0.999; null under four points."""
    at = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), r)))
    half = z / F.sqrt(n - 3)
    return F.when(n >= 4, F.tanh(at - half)), F.when(n >= 4, F.tanh(at + half))


def wilson_low_high(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; null without trials."""
    p, w = k / n, z * z / n
    mid, half = (p + w / 2) / (1 + w), z * F.sqrt(p * (1 - p) / n + w / (4 * n)) / (1 + w)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def verdict(r: Column, limit: float = 0.3) -> Column:
    return F.when(r > limit, "positive").when(r < -limit, "negative").when(r.isNotNull(), "weak")


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) of a binomial, exactly, by the incomplete beta function; its time does not depend on n."""
    return 1.0 if k <= 0 else 0.0 if k > n else min(1.0, incomplete_beta(p, k, n - k + 1))


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from one."""
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def permutation_p(x: np.ndarray, y: np.ndarray, n: int = 100_000, seed: int = 42, rank: bool = False) -> tuple[float, float]:
    """Correlation and its two-sided p-value (hits + 1) / (n + 1) over random orders of ``y``; ``rank`` for Spearman.

    For the few points of a table of classes; blocks of orders keep memory bounded."""
    a, b = (ranks(x), ranks(y)) if rank else (np.asarray(x, float), np.asarray(y, float))
    if len(a) < 3 or a.std() == 0 or b.std() == 0:
        raise ValueError("a correlation needs three points and some variation")
    a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
    r, rng, hits = float(a @ b / len(a)), np.random.default_rng(seed), 0
    for at in range(0, n, 10_000):
        orders = rng.permuted(np.tile(b, (min(10_000, n - at), 1)), axis=1)
        hits += int((np.abs(orders @ a / len(a)) >= abs(r) - 1e-12).sum())
    return r, (hits + 1) / (n + 1)


def student_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction, which needs some root of a + b terms."""

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 400 + int(10 * math.sqrt(a + b))):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
