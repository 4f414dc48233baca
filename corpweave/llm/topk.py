"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate. A histogram of its scores, summed over all tasks, locates the bin of
the kth best score; that bin is split again until it is one score wide. Then only scores from that value on are kept,
and ties at it go to smaller ids. A task sends no bins below its own kth best score (they can't hold the global one),
and no more than its k best rows, so what is shuffled is bounded by queries x tasks x k. Queries go out in blocks of a
fixed size, each block in a few passes over the candidates.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; missing ids take
no part; a shorter vector counts as filled up with zeros, an empty one has zeros alone; every row that asks is a query of its own, also
where its id repeats, and its candidates are all rows but itself; scores are exact integers of any size, ranked as such,
and one that a long can't hold is returned as the long nearest to it; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpweave.session import cut, removed, shared_dir

K = 5
#: Queries of a block, bins of a histogram, and candidates scored at once.
BLOCK = 1024
BINS = 1024
ROWS = 2048
#: Integers up to here are exact as floating-point numbers; differences of two below the second stay within a long.
EXACT, LONG = 1 << 53, 1 << 62


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a double, which holds such an integer exactly; null for vectors that take no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    # a double of 2^52 or more is an integer already
    return F.when(ok, F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < float(1 << 52), F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as a matrix of d columns; shorter ones are filled up with zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    at = at - at[0]
    if len(at) > 1 and (np.diff(at) == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(at) - 1, d))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def _integers(m: np.ndarray) -> np.ndarray:
    """A matrix of whole doubles as Python integers."""
    return np.array([int(x) for x in m.ravel()], object).reshape(m.shape)


class Block:
    """Queries that are asked together: their rows, and how their scores are to be computed."""

    def __init__(self, rows: list[int], vectors: np.ndarray, most: int, k: int, bins: int):
        self.rows, self.k, self.bins = np.array(rows, np.int64), k, bins
        self.kind = np.float64 if most < EXACT else np.int64 if most < LONG else object
        self.q = vectors if self.kind is np.float64 else vectors.astype(np.int64) if self.kind is np.int64 else _integers(vectors)
        self.long = object if self.kind is object else np.int64

    def scores(self, c: np.ndarray) -> np.ndarray:
        """Inner products as exact integers."""
        if self.kind is np.float64:
            return (self.q @ c.T).astype(np.int64)
        c = c.astype(np.int64) if self.kind is np.int64 else _integers(c)
        return self.q @ c.T if c.shape[1] else np.zeros((len(self.q), len(c)), self.long)

    def scored(self, batches: Iterator[pa.RecordBatch]):
        """(ids, rows, scores) of the candidates (row, id, v) by chunks, and for each query's own row whether it is there."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row = part.column(0).to_numpy()
                own = np.flatnonzero(np.isin(row, self.rows))
                yield part.column(1).to_numpy(), row, self.scores(_matrix(part.column(2), self.q.shape[1])), (self.rows[:, None] == row[None, own], own)

    def counts(self, low: np.ndarray, width: np.ndarray):
        """A task's histogram: for each query the number of scores in each bin from ``low`` on, the last bin open above."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, bins = len(self.rows), self.bins
            counts, row = np.zeros(n * bins, np.int64), np.arange(n)[:, None] * bins
            for _, _, s, (own, where) in self.scored(batches):
                b = np.clip((s - low[:, None]) // width[:, None], -1, bins - 1).astype(np.int64)
                inside = b >= 0
                inside[:, where] &= ~own
                counts += np.bincount((row + b)[inside], minlength=n * bins)
            counts = counts.reshape(n, bins)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            i, b = np.nonzero((counts > 0) & (above < self.k))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[i, b])], names=["q", "bin", "n"])

        return run

    def best(self, least: np.ndarray, ids: np.ndarray, most: int):
        """A task's k best rows of each query with scores from ``least`` on: (query, asker, id, score, order).

        The order is a text that sorts as the scores do, which are integers of up to ``most``; empty where a long does."""
        digits = len(str(2 * most)) if self.kind is object else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.long))

            def trimmed(i, v, s):
                order = np.lexsort((v, -np.unique(s, return_inverse=True)[1] if digits else -s, i))
                i, v, s = i[order], v[order], s[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < self.k
                return i[keep], v[keep], s[keep]

            for cand, _, s, (own, where) in self.scored(batches):
                ok = (s >= least[:, None]).astype(bool)
                ok[:, where] &= ~own
                i, j = np.nonzero(ok)
                held = tuple(np.concatenate(x) for x in zip(held, trimmed(i, cand[j], s[i, j])))
                if len(held[0]) > 4 * self.k * len(ids):
                    held = trimmed(*held)
            i, v, s = trimmed(*held)
            order = [f"{x + most:0{digits}d}" for x in s] if digits else [""] * len(s)
            s = np.clip(s, -(1 << 63), (1 << 63) - 1).astype(np.int64) if len(s) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(self.rows[i]), pa.array(ids[i]), pa.array(v), pa.array(s), pa.array(order, pa.string())], names=["asker", "query_id", "vec_id", "score", "order"])

        return run

    def kth(self, candidates: DataFrame, bound: int) -> np.ndarray:
        """The kth best score of each query (or a bound below all scores, if there are fewer)."""
        n, k, bins = len(self.rows), self.k, self.bins
        low, width = np.full(n, -bound, self.long), np.full(n, -(-(2 * bound + 1) // bins), self.long)
        done = np.zeros(n, bool)
        while True:
            counted = candidates.mapInArrow(self.counts(low, width), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            up = counted.withColumn("upto", F.expr("sum(n) over (partition by q order by bin desc)"))
            at = {r[0]: r[1] for r in up.where(f"upto >= {k}").groupBy("q").agg(F.max("bin")).collect()}  # a bin for each query of the block
            for i in range(n):
                if i not in at:  # fewer than k candidates
                    done[i] = True
                elif not done[i]:
                    low[i] += at[i] * width[i]
            done |= (width == 1).astype(bool)
            if done.all():
                return low
            # the last bin is open above, so scores beyond the bin that is split count as its best
            width = np.where(done, width, -(-width // (bins - 1)))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = 256, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest inner products of quantised vectors.

    With several blocks of queries, the result of each is written to the shared folder before the next one is asked; they are
    gathered in a checkpoint in the end."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v", "asks"))
    schema = "asker long, query_id long, vec_id long, score long, order string"
    d, top = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    candidates, asked = rows.select("row", "id", "v"), rows.where("asks").select("row", "id", "v")
    n = asked.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = d * int(top or 0) ** 2 + 1
    blocks = max(1, -(-n // (block * 3 // 4)))
    asked = (cut(asked) if blocks > 1 else asked).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    at, found = f"{shared_dir(spark).rstrip('/')}/topk-{uuid.uuid4().hex}", None
    for part in range(blocks):
        mine = sorted(asked.where(F.col("block") == part).select("row", "id", "v").collect())  # near three quarters of a block
        for first in range(0, len(mine), block):
            some = mine[first : first + block]
            one = Block([r[0] for r in some], _matrix(pa.array([r[2] for r in some], pa.list_(pa.float64())), d), bound, k, bins)
            found = candidates.mapInArrow(one.best(one.kth(candidates, bound), np.array([r[1] for r in some], np.int64), bound), schema)
            if blocks > 1 or len(mine) > block:
                found.write.parquet(f"{at}/block={part}-{first}")
                found = None
    if found is None:
        found = cut(spark.read.schema(schema).parquet(at))
        removed(spark, at)
    rank = F.expr("row_number() over (partition by asker order by `order` desc, score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
