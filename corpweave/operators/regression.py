"""Linear models on large tables: cross products are aggregated in Spark, the k x k systems are solved on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpweave.functions.stats import student_tail


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    error: np.ndarray
    t: np.ndarray
    p: np.ndarray
    r2: float
    adjusted: float
    n: int
    clusters: int


def varied(df: DataFrame, names: list[str]) -> list[str]:
    """The columns that are not constant."""
    sd = df.agg(*(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if sd[i] and sd[i] > 1e-12]


def dummies(df: DataFrame, column: str, values: list, prefix: str) -> tuple[DataFrame, list[str]]:
    """Adds 0/1 columns for all but the first of ``values``."""
    names = [f"{prefix}{v}" for v in values[1:]]
    return df.withColumns({n: (F.col(column) == v).cast("double") for n, v in zip(names, values[1:])}), names


def least_squares(df: DataFrame, y: str, x: list[str], cluster: str, weight: str | None = None) -> Fit:
    """Least squares with cluster-robust errors: sandwich variance times G/(G-1), t with G-1 degrees. Weights are
    brought to sum to n.

    Three sums of products are taken: X'X and X'y over all rows, and each cluster's score, whose products add up to the
    middle of the sandwich without a cluster leaving Spark."""
    names = ["const", *x]
    d = df.select(F.col(y).cast("double").alias("y"), F.col(cluster).alias("g"), F.lit(1.0).alias("x0"), *(F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(x)), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    xs = [f"x{i}" for i in range(len(names))]
    d = d.where(" and ".join(f"{c} is not null" for c in ["y", "g", *xs, "w"]))
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    s = d.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") ** 2).alias("wyy"), *(F.sum(F.col("w") * F.col(c) * F.col("y")).alias(f"b{i}") for i, c in enumerate(xs)), *(F.sum(F.col("w") * F.col(xs[i]) * F.col(xs[j])).alias(f"a{i}_{j}") for i, j in pairs)).first()
    n, scale = s["n"], s["n"] / s["w"]
    a = np.zeros((len(xs), len(xs)))
    for i, j in pairs:
        a[i, j] = a[j, i] = s[f"a{i}_{j}"] * scale
    b = np.array([s[f"b{i}"] for i in range(len(xs))]) * scale
    beta = np.linalg.solve(a, b)
    fitted = sum((F.col(c) * float(v) for c, v in zip(xs, beta)), F.lit(0.0))
    scores = d.withColumn("e", (F.col("y") - fitted) * F.col("w") * scale).groupBy("g").agg(*(F.sum(F.col("e") * F.col(c)).alias(f"s{i}") for i, c in enumerate(xs)))
    m = scores.agg(F.count("*").alias("g"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs)).first()
    middle = np.zeros_like(a)
    for i, j in pairs:
        middle[i, j] = middle[j, i] = m[f"m{i}_{j}"]
    inverse = np.linalg.inv(a)
    variance = inverse @ middle @ inverse * m["g"] / max(m["g"] - 1, 1)
    error = np.sqrt(np.maximum(np.diag(variance), 0))
    t = np.divide(beta, error, out=np.zeros_like(beta), where=error > 0)
    total = (s["wyy"] - s["wy"] ** 2 / s["w"]) * scale
    rest = s["wyy"] * scale - beta @ b
    r2 = 1 - rest / total if total > 0 else 0.0
    k = len(xs)
    return Fit(names, beta, error, t, np.array([student_tail(abs(v), max(m["g"] - 1, 1)) for v in t]), r2, 1 - (1 - r2) * (n - 1) / max(n - k, 1), n, m["g"])


def as_table(spark, fit: Fit, **labels) -> DataFrame:
    rows = [(*labels.values(), c, float(b), float(e), float(t), float(p), float(fit.r2), fit.n) for c, b, e, t, p in zip(fit.names, fit.beta, fit.error, fit.t, fit.p)]
    return spark.createDataFrame(rows, ", ".join([*(f"{k} string" for k in labels), "term string, beta double, error double, t double, p double, r2 double, n long"]))
