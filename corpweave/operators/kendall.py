"""Kendall's rank correlation of tables of any size: inversions by blocks of both orders.

Rows are dealt twice by ranges: to blocks in the order of (x, y) and to cells in the order of (y, x). A pair in two blocks and
two cells is an inversion or not by their numbers alone, so a table of counts by block and cell tells those; pairs of one
block, and pairs of one cell in two blocks, are counted within a task by merging. Ties are counted by value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpweave.session import cut


def inversions(order: np.ndarray) -> int:
    """Pairs i < j with order[i] > order[j]: pieces of 64 are compared at once, then merged by halves."""
    n, step = len(order), 64
    total, parts = 0, []
    for at in range(0, n, step):
        p = order[at : at + step]
        total += int(np.triu(p[:, None] > p[None], 1).sum())
        parts.append(np.sort(p))
    while len(parts) > 1:
        merged = []
        for k in range(0, len(parts) - 1, 2):
            left, right = parts[k], parts[k + 1]
            total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            merged.append(np.sort(np.concatenate([left, right]), kind="stable"))
        parts = merged + parts[len(parts) - len(parts) % 2 :]
    return total


def _ranks(*keys: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys[::-1])] = np.arange(len(keys[0]))
    return out


def _counted(batches: Iterator[pa.RecordBatch], cells: bool) -> Iterator[pa.RecordBatch]:
    """Inversions within a block; of a cell only those between rows of two blocks. Rows are (x, y, id, block)."""
    held = [b for b in batches if b.num_rows]
    total = 0
    if held:
        x, y, i, block = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(4))
        place, rank = _ranks(x, y, i), _ranks(y, x, i)
        by_place = np.argsort(place)
        total = inversions(rank[by_place])
        if cells:
            same = block[by_place]  # blocks are ranges of the same order, so each one's rows stand together
            for part in np.split(rank[by_place], np.flatnonzero(same[1:] != same[:-1]) + 1):
                total -= inversions(part)
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])


def tau_b(df: DataFrame, x: str, y: str, key: str) -> float | None:
    """Kendall's tau-b of two columns; ``key`` is a number that tells rows with the same values apart. None without any variation.

    Rows with a missing value take no part."""
    plain = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(key).cast("long").alias("i")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    blocks = cut(plain.repartitionByRange("x", "y", "i").withColumn("block", F.spark_partition_id()))
    cells = cut(blocks.repartitionByRange("y", "x", "i").withColumn("cell", F.spark_partition_id()))
    within = lambda d, two: d.select("x", "y", "i", "block").mapInArrow(lambda it: _counted(it, two), "n long").agg(F.sum("n")).first()[0] or 0
    discordant = within(blocks, False) + within(cells, True)
    table = {(r[0], r[1]): r[2] for r in cells.groupBy("block", "cell").count().collect()}  # a row for each block and cell
    if not table:
        return None
    counts = np.zeros((max(k[0] for k in table) + 1, max(k[1] for k in table) + 1), object)
    for k, n in table.items():
        counts[k] = n
    later = np.zeros(counts.shape[1], object)  # rows of the blocks behind, by cell
    for row in counts[::-1]:
        below = np.concatenate([[0], np.cumsum(later)[:-1]])
        discordant += int((row * below).sum())
        later = later + row
    n = int(counts.sum())
    pairs = lambda *by: plain.groupBy(*by).agg((F.count("*") * (F.count("*") - 1) / 2).cast("decimal(38,0)").alias("p")).agg(F.sum("p")).first()[0] or 0
    every, tied_x, tied_y, tied = n * (n - 1) // 2, int(pairs("x")), int(pairs("y")), int(pairs("x", "y"))
    concordant = every - discordant - tied_x - tied_y + tied
    below = (every - tied_x) * (every - tied_y)
    return (concordant - discordant) / below**0.5 if below else None
