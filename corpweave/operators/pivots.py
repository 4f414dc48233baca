"""Exact nearest neighbours with pivots: whole cells of vectors are left out by the triangle inequality.

A bounded sample of the right side of each group are its pivots; every right vector belongs to the cell of its nearest one,
of which the radius and the longest vector are kept. A left vector is compared with the cell of its own nearest pivot
first, which bounds its gap; then only with cells that could hold something nearer: no vector of a cell is nearer than the
distance to its pivot less its radius.

Vectors travel in blocks. Both sides of a group are dealt into SIDE parts in the order of their cells, and a pair of parts is a
task's; a block goes once to each part that it needs, with a bit for each of its rows and each cell. So a comparison sends nothing more
than SIDE times, however many cells can't be left out, and a large cell is many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpweave.operators.distances import BLOCK, _matrix
from corpweave.operators.relational import capped
from corpweave.session import cut

#: Pivots of a group, and of all groups together, which go out with the tasks.
PIVOTS, ALL = 64, 100_000
#: Parts of each side of a group; a vector goes to no more tasks than that.
SIDE = 6
#: What rounding may add to a bound.
SLACK = 1e-9


class Pivots:
    """Pivots of all groups, and the cells of the right side: radius, longest vector and the parts that they lie in."""

    def __init__(self, right: DataFrame, by: str, d: int, k: int = PIVOTS, key: str = "vec_id", size: int = BLOCK):
        self.by, self.d, self.size = by, d, size
        some = capped(right.select(by, key, "v"), [by], k, F.xxhash64(F.lit(17), key), key).limit(ALL + 1).collect()
        if len(some) > ALL:
            raise ValueError(f"more than {ALL} pivots")
        self.of: dict = {}
        for r in sorted(some, key=lambda r: r[1]):
            self.of.setdefault(r[0], []).append(r[2])
        self.of = {g: np.array(v, float) for g, v in self.of.items()}
        rows = cut(self.placed(right.select(by, F.col(key).alias("id"), "v")))
        longest = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
        cells = self.numbered(rows, F.max("far").alias("radius"), longest.alias("longest"))
        #: By group, each an array over its pivots: radius, longest vector, first and last part. An empty cell has no radius.
        self.stats: dict = {}
        for g, c, n, before, total, radius, long in cells.collect():  # one for each pivot
            stats = self.stats.setdefault(g, np.full((4, len(self.of[g])), np.nan))
            stats[:, c] = radius, long, before * SIDE // total, (before + n - 1) * SIDE // total
        b = self.dealt(rows, cells.select(by, "cell", "n", "before", "total"), "cell").groupBy(by, "part", "cell", "block").agg(F.collect_list("v").alias("r"))
        self.blocks = cut(b.select(by, F.col("part").alias("column"), "cell", F.size("r").cast("long").alias("pairs"), F.flatten("r").alias("y")))

    def numbered(self, rows: DataFrame, *more) -> DataFrame:
        """(by, cell, n, before, total, more): how many rows each cell has, those before it and the group; a row for each pivot."""
        w = Window.partitionBy(self.by)
        n = rows.groupBy(self.by, "cell").agg(F.count("*").alias("n"), *more)
        counted = n.withColumn("before", F.sum("n").over(w.orderBy("cell")) - F.col("n")).withColumn("total", F.sum("n").over(w))
        return counted.select(self.by, "cell", "n", "before", "total", *(c for c in n.columns if c not in (self.by, "cell", "n")))

    def dealt(self, rows: DataFrame, cells: DataFrame, *more: str) -> DataFrame:
        """(by, part, block, id, v, more): rows in the order of their cells, at random within one, in SIDE parts and in blocks of near ``size``."""
        at = rows.join(F.broadcast(cells), [self.by, "cell"]).withColumn("__at", F.col("before") + F.pmod(F.xxhash64("id"), F.col("n")))
        return at.select(self.by, F.floor(F.col("__at") * SIDE / F.col("total")).alias("part"), F.floor(F.col("__at") / self.size).alias("block"), "id", "v", *more)

    def placed(self, df: DataFrame) -> DataFrame:
        """Adds ``cell``, the nearest pivot's number, and ``far``, the distance to it; rows of groups without pivots go."""
        of = self.of

        @F.arrow_udf("struct<cell:int,far:double>")
        def nearest(groups: pa.Array, vectors: pa.Array) -> pa.Array:
            cell, far = [], []
            for g, v in zip(groups.to_pylist(), vectors):
                p = of.get(g)
                if p is None:
                    cell.append(None), far.append(None)
                    continue
                e = np.sqrt(((p - v.values.to_numpy(zero_copy_only=False)) ** 2).sum(axis=1))
                cell.append(int(e.argmin())), far.append(float(e.min()))
            return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=["cell", "far"])

        return df.withColumn("__p", nearest(self.by, "v")).where("__p.cell is not null").select(*df.columns, F.col("__p.cell").alias("cell"), F.col("__p.far").alias("far"))

    def packed(self, rows: DataFrame) -> DataFrame:
        """(by, row, block, ids, own, x): placed left rows in blocks, ``own`` their cells."""
        r = self.dealt(rows, self.numbered(rows), "cell").groupBy(self.by, F.col("part").alias("row"), "block").agg(F.collect_list(F.struct("id", "cell", "v")).alias("r"))
        each = lambda c: F.transform("r", lambda x: x[c])
        return r.select(self.by, "row", "block", each("id").alias("ids"), each("cell").alias("own"), F.flatten(each("v")).alias("x"))

    def wanted(self, blocks: DataFrame) -> DataFrame:
        """Adds (cells, columns, mask): the cells that a block's rows are to be compared with, the parts these lie in, and a bit for each
        row and cell. These are the rows' own cells; if there are ``gaps`` (of the rows ``at``), the others that may hold a smaller one."""
        d, stats, of = self.d, self.stats, self.of if "gaps" in blocks.columns else {}

        @F.arrow_udf("struct<cells:array<int>,columns:array<long>,mask:binary>")
        def open_(groups: pa.Array, own: pa.Array, *known: pa.Array) -> pa.Array:
            out = []
            for i, (g, c) in enumerate(zip(groups.to_pylist(), own)):
                radius, longest, low, high = stats[g]
                mask = (c.values.to_numpy()[:, None] == np.arange(len(radius))) & ~np.isnan(low)
                if known:
                    x, gap = _matrix(known[0][i].values.to_numpy(), d), np.full(len(c), -np.inf)
                    gap[known[1][i].values.to_numpy()] = known[2][i].values.to_numpy()
                    far = np.stack([np.sqrt(((of[g] - r) ** 2).sum(axis=1)) for r in x])
                    near = np.maximum(far - radius - SLACK, 0.0)
                    # x.y is half of both squares less that of their distance
                    least = 1 - ((x * x).sum(axis=1)[:, None] + longest**2 - near**2) / 2
                    mask = ~mask & ~np.isnan(low) & (least < gap[:, None] + SLACK)
                cells = np.flatnonzero(mask.any(axis=0))
                columns = {k for c in cells for k in range(int(low[c]), int(high[c]) + 1)}
                out.append({"cells": cells.tolist(), "columns": sorted(columns), "mask": np.packbits(mask, axis=1).tobytes()})
            return pa.array(out, pa.struct([("cells", pa.list_(pa.int32())), ("columns", pa.list_(pa.int64())), ("mask", pa.binary())]))

        named = blocks.withColumn("__w", open_(self.by, "own", *(("x", "at", "gaps") if of else ())))
        return named.select(*blocks.columns, "__w.cells", "__w.columns", "__w.mask")

    def compared(self, blocks: DataFrame) -> DataFrame:
        """(by, row, block, pairs, e: at, id, gap): for each row of ``wanted`` blocks and each right block that it is to be compared with
        the smallest gap, and how many rows that has."""
        d, by, kind = self.d, self.by, dict(blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
        left = blocks.select(by, "row", "block", "ids", "x", "cells", "mask", F.explode("columns").alias("column"))
        tiles = blocks.select(by, "row", F.explode("columns").alias("column")).distinct()  # SIDE squared for a group at most
        right = self.blocks.join(tiles, [by, "column"])

        @F.arrow_udf(f"array<struct<at:int,id:{kind},gap:double>>")
        def least(ids: pa.Array, x: pa.Array, masks: pa.Array, cells: pa.Array, y: pa.Array) -> pa.Array:
            found, ends = [], [0]
            for i, p, m, c, q in zip(ids, x, masks, cells.to_pylist(), y):
                bits = np.frombuffer(m.as_buffer(), np.uint8).reshape(len(i), -1)
                at = np.flatnonzero(bits[:, c // 8] >> (7 - c % 8) & 1)
                gap = (1.0 - _matrix(p.values.to_numpy(), d)[at] @ _matrix(q.values.to_numpy(), d).T).min(axis=1)
                found.append((at, i.values.take(pa.array(at)), gap))
                ends.append(ends[-1] + len(at))
            at, gap = (np.concatenate([f[k] for f in found] or [[]]) for k in (0, 2))
            i = pa.concat_arrays([f[1] for f in found]) if found else ids.flatten()
            rows = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), i, pa.array(gap)], names=["at", "id", "gap"])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

        both = left.join(right, [by, "row", "column"]).where(F.array_contains("cells", F.col("cell")))
        return both.select(by, "row", "block", "pairs", F.explode(least("ids", "x", "mask", "cell", "y")).alias("e"))


def nearest(left: DataFrame, right: DataFrame, by: str, d: int, k: int = PIVOTS, key: str = "vec_id") -> DataFrame:
    """(by, id, gap, pairs): for each left vector the smallest gap (1 - inner product) to a right vector of its group, and with how many
    it was compared."""
    p = Pivots(right, by, d, k, key)
    rows = cut(p.placed(left.select(by, F.col(key).alias("id"), "v")))
    blocks = cut(p.wanted(p.packed(rows)))
    least = (F.min("e.gap").alias("gap"), F.sum("pairs").alias("pairs"))
    first = cut(p.compared(blocks).groupBy(by, "row", "block", F.col("e.at").alias("at"), F.col("e.id").alias("id")).agg(*least))
    gaps = first.groupBy(by, "row", "block").agg(F.array_sort(F.collect_list(F.struct("at", "gap"))).alias("r"))
    gaps = gaps.select(by, "row", "block", F.transform("r", lambda x: x["at"]).alias("at"), F.transform("r", lambda x: x["gap"]).alias("gaps"))
    known = blocks.drop("cells", "columns", "mask").join(gaps, [by, "row", "block"])
    more = p.compared(cut(p.wanted(known))).groupBy(by, F.col("e.id").alias("id")).agg(*least)
    return first.select(by, "id", "gap", "pairs").unionByName(more).groupBy(by, "id").agg(F.min("gap").alias("gap"), F.sum("pairs").alias("pairs"))
