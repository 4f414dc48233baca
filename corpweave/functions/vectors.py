"""Vector functions over array columns. Short sums are column expressions; products with many centroids or directions
run over Arrow batches as one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors that are shorter count as zero.
ZERO = 1e-8
DOUBLES = T.ArrayType(T.DoubleType())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length one; null for a zero vector."""
    n = norm(a)
    return F.when(n >= ZERO, F.transform(a, lambda x: x / n))


def _rows(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the rows that are not null, their places)."""
    ok = np.flatnonzero(~np.asarray(a.is_null()))
    some = a.take(pa.array(ok))
    flat = some.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(ok), -1) if len(ok) else np.zeros((0, 0)), ok


def _lists(m: np.ndarray, ok: np.ndarray, n: int) -> pa.Array:
    """Rows of a matrix as lists at their places, null elsewhere."""
    sizes = np.zeros(n + 1, np.int32)
    if len(ok):
        sizes[ok + 1] = m.shape[1]
    there = np.zeros(n, bool)
    there[ok] = True
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(m.reshape(-1), pa.float64()), mask=pa.array(~there))


def products(v: Column, rows: np.ndarray) -> Column:
    """Inner products of a vector column with each of ``rows``, a small matrix that travels with the tasks."""

    @F.arrow_udf(DOUBLES)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            m, ok = _rows(a)
            yield _lists(m @ rows.T if len(ok) else m, ok, len(a))

    return of(v)


def best(scores: Column) -> Column:
    """Place of the greatest score at nine decimals, the lowest of ties."""
    flat = F.transform(scores, lambda x: F.round(x, 9))
    return (F.array_position(flat, F.array_max(flat)) - 1).cast("int")


def without(v: Column, basis: np.ndarray) -> Column:
    """The vector less its part in the span of orthonormal ``basis`` rows, at length one again; null if nothing is left."""

    @F.arrow_udf(DOUBLES)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            m, ok = _rows(a)
            if len(ok):
                m = m - (m @ basis.T) @ basis
                n = np.linalg.norm(m, axis=1)
                m, ok = m[n >= ZERO] / n[n >= ZERO][:, None], ok[n >= ZERO]
            yield _lists(m, ok, len(a))

    return of(v)


def without_each(v: Column, directions: np.ndarray) -> Column:
    """The same, a direction at a time, at length one after each."""
    for g in directions:
        v = without(v, g[None])
    return v


def orthonormal(rows: np.ndarray) -> np.ndarray:
    """Gram-Schmidt in order; rows within 1e-8 of the span before them are left out."""
    out: list[np.ndarray] = []
    for r in rows:
        r = r.astype(float)
        for _ in range(2):
            for g in out:
                r = r - (r @ g) * g
        n = np.linalg.norm(r)
        if n >= ZERO:
            out.append(r / n)
    return np.array(out).reshape(-1, rows.shape[1])
