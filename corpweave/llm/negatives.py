"""Hard-negative mining by bit-sliced integer products.

Components are whole numbers in two's complement. A candidate's bit-planes are multiplied with the anchors one after
another, the most significant first, the sign's plane with a negative weight. What the planes that are left can add to a
score is bounded by the sums of an anchor's positive and of its negative components, so every score lies in an interval
that each plane halves. A candidate is dropped for an anchor as soon as its interval can't qualify: it ends below as many
lower ends as are wanted (of its own rows or of those found before in the task), or lies outside all ranges that are
asked for. What is left after a few planes is few pairs, which are carried on alone.

Anchors go out in blocks of a fixed size, each in two passes over all rows: one finds their positives, one the negatives
in the ranges of the positives' scores. A task sends no more than its best rows for each anchor and range, so what is
shuffled is bounded by anchors x tasks x what is wanted, whatever a label's or a score's rows.

Defined results: rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no
part; a shorter vector counts as filled up with zeros; every row is a candidate of its own, also where its id repeats,
and every anchor row is an anchor of its own; equal scores are ordered by id; scores are exact whole numbers of any
size, one that a long can't hold is returned as the nearest; a positive with a score below zero has no negatives, since
its range is empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpweave.llm.topk import EXACT, _integers, _matrix, quantised
from corpweave.session import cut, removed, shared_dir

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors of a block, those that are multiplied at once, and rows of a chunk.
BLOCK, SIDE, ROWS = 4096, 256, 2048
#: Below this share of pairs they are carried on one by one.
SPARSE = 0.05
#: Planes from one look at the intervals to the next.
EVERY = 2
OUTPUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Slicer:
    """Products of a block of anchors with chunks of rows, plane by plane."""

    def __init__(self, anchors: np.ndarray, most: int, largest: int):
        """``most`` bounds all scores, ``largest`` all components' sizes."""
        self.kind = np.float64 if most < EXACT // 256 else object
        self.a = anchors if self.kind is np.float64 else _integers(anchors)
        self.bits = int(largest).bit_length()  # and one plane for the sign
        zero = self.a * 0
        self.up, self.down = np.maximum(self.a, zero).sum(axis=1), np.minimum(self.a, zero).sum(axis=1)

    def planes(self, c: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(weight, the most that all later planes weigh, plane), the most significant first."""
        whole = c.astype(np.int64) if self.kind is np.float64 else _integers(c)
        yield -(1 << self.bits), (1 << self.bits) - 1, (whole < 0).astype(self.kind)
        for k in range(self.bits - 1, -1, -1):
            yield 1 << k, (1 << k) - 1, ((whole >> k) & 1).astype(self.kind)

    def scores(self, c: np.ndarray, alive: np.ndarray, some: slice, decide) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(anchor, row, score) of the pairs that ``decide`` leaves, and the number of products of a pair and a plane.

        ``decide(i, j, low, high)`` says which pairs of anchors i and rows j stay, given their intervals."""
        a, up, down = self.a[some], self.up[some], self.down[some]
        i, j = np.nonzero(alive)
        s = np.zeros(len(i), self.kind)
        done = 0
        for weight, left, plane in self.planes(c):
            if not len(i):
                break
            if len(i) > SPARSE * alive.size:
                s = s + weight * (a @ plane.T)[i, j]
            else:
                for at in range(0, len(i), 1 << 16):
                    p = slice(at, at + (1 << 16))
                    s[p] += weight * (a[i[p]] * plane[j[p]]).sum(axis=1)
            done += len(i)
            if (left.bit_length() - self.bits) % EVERY == 0 or not left:
                stay = decide(i, j, s + left * down[i], s + left * up[i])
                i, j, s = i[stay], j[stay], s[stay]
        return i, j, s, done


def _groups_kth(group: np.ndarray, value: np.ndarray, n: int, k: int) -> list:
    """The kth largest value of each of ``n`` groups, which are sorted; None where there are fewer."""
    out: list = [None] * n
    ends = np.searchsorted(group, np.arange(n + 1))
    for g in np.flatnonzero(np.diff(ends) >= k):
        v = value[ends[g] : ends[g + 1]]
        out[g] = np.partition(v, len(v) - k)[len(v) - k] if v.dtype != object else sorted(v)[-k]
    return out


class Best:
    """The best ``k`` rows of each slot (an anchor and range), ordered by score and id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def least(self, slot: int):
        h = self.held.get(slot)
        return h[-1][0] if h and len(h) >= self.k else None

    def add(self, slot: int, rows: list[tuple]) -> None:
        every = self.held.get(slot, []) + rows
        every.sort(key=lambda r: (-r[0], r[1]))
        self.held[slot] = every[: self.k]


class Block:
    """Anchors that are asked together: (row, id, label) and vectors."""

    def __init__(self, rows: list[tuple], vectors: np.ndarray, most: int, largest: int, k: int, side: int = SIDE):
        self.rows, self.labels, self.k, self.side = [r[0] for r in rows], [r[2] for r in rows], k, side
        self.slicer = Slicer(vectors, most, largest)
        self.counted = [0, 0]  # products of a pair and a plane, and as many as all pairs would need

    def run(self, ranges: list[list[tuple[int, int]]] | None):
        """A task's best rows: of the anchor's label without ranges, else of other labels in each of its ranges."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(self.k)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    self.chunk(batch.slice(at, ROWS), ranges, best)
            rows = [(slot[0], slot[1], r[1], str(int(r[0])), r[2]) for slot, held in best.held.items() for r in held]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64()))], names=["anchor", "part", "id", "score", "row"])

        return of

    def chunk(self, batch: pa.RecordBatch, ranges: list | None, best: Best) -> None:
        row, ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        names, label = np.unique(np.concatenate([labels, self.labels]).astype(str), return_inverse=True)
        c, mine = _matrix(batch.column(3), self.slicer.a.shape[1]), label[len(labels) :]
        for begin in range(0, len(self.rows), self.side):
            some = slice(begin, begin + self.side)
            alive = mine[some, None] == label[None, : len(labels)]
            if ranges is None:
                alive &= np.array(self.rows[some])[:, None] != row[None]
                lists = None
            else:
                lists = ranges[some]
                alive = ~alive & np.array([bool(x) for x in lists])[:, None]
            parts = [1 if lists is None else len(x) for x in (lists or alive)]
            self.counted[1] += int(alive.sum()) * (self.slicer.bits + 1)
            i, j, s, done = self.slicer.scores(c, alive, some, Interval(lists, [[best.least((begin + a, p)) for p in range(n)] for a, n in enumerate(parts)], self.k, self.slicer.kind))
            self.counted[0] += done
            for a, (at, end) in enumerate(zip(ends := np.searchsorted(i, np.arange(len(alive) + 1)), ends[1:])):
                if at == end:
                    continue
                own, rows = s[at:end], j[at:end]
                for p in range(parts[a]):
                    k = np.arange(len(own)) if lists is None else np.flatnonzero((own >= lists[a][p][0]) & (own <= lists[a][p][1]))
                    k = k[np.lexsort((ids[rows[k]], -own[k]))][: self.k]
                    best.add((begin + a, p), [(own[x], int(ids[rows[x]]), int(row[rows[x]])) for x in k])


class Interval:
    """Which pairs stay, given the intervals that their scores lie in: those that may reach into a range of their anchor and
    above what is sure to be among its best.

    ``known`` are scores that the best rows so far have at least, for each anchor and range. A row that is sure to lie in
    all ranges of its anchor counts in each, so the kth of their lower ends holds for all."""

    def __init__(self, lists: list | None, known: list[list], k: int, kind):
        self.k, self.ranged, n = k, lists is not None, len(known)
        self.floor = [None if not x or any(y is None for y in x) else min(x) for x in known]
        if self.ranged:
            ends = [(min(y[0] for y in x), max(y[1] for y in x), max(y[0] for y in x), min(y[1] for y in x)) if x else (0, -1, 0, -1) for x in lists]
            self.least, self.most, self.inner, self.outer = (np.array([e[q] for e in ends], kind) for q in range(4))
        self.n, self.kind = n, kind

    def __call__(self, i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        sure_i, sure_low = i, low
        if self.ranged:
            sure = ((low >= self.inner[i]) & (high <= self.outer[i])).astype(bool)
            sure_i, sure_low = i[sure], low[sure]
        kth = _groups_kth(sure_i, sure_low, self.n, self.k)
        floor = [max((y for y in x if y is not None), default=None) for x in zip(kth, self.floor)]
        open_ = np.array([f is None for f in floor], bool)
        out = open_[i] | (high >= np.array([0 if f is None else f for f in floor], self.kind)[i]).astype(bool)
        if self.ranged:
            out &= ((high >= self.least[i]) & (low <= self.most[i])).astype(bool)
        return out


def _ranked(found: DataFrame, k: int, wide: bool, by: list[str]) -> DataFrame:
    """The ``k`` best rows of each group, from those of all tasks; scores are whole numbers as text."""
    if wide:  # beyond what a decimal holds: sign and number of digits, then digits
        digits = F.regexp_replace("score", "^-", "")
        up = ~F.col("score").startswith("-")
        size = F.length(digits)
        order = [F.desc(up), F.desc(F.when(up, size).otherwise(-size)), F.desc(F.when(up, digits)), F.when(~up, digits), "id", "row"]
    else:
        order = [F.desc(F.col("score").cast("decimal(38,0)")), "id", "row"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _long(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def mined(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """Rows as OUTPUT says: for each anchor and each of its ``positives`` best rows of the same label the ``negatives`` best
    rows of other labels whose scores are ``low`` to ``high`` hundredths of the positive's.

    With several blocks of anchors, the result of each is written to the shared folder before the next one is asked."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), quantised(F.col(f"`{vector_col}`"), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and label is not null and v is not null")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", "asks"))
    d, top, n = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count_if("asks")).first()
    if not n:
        return spark.createDataFrame([], OUTPUT)
    largest = int(top or 0)
    most = d * max(largest, 1) ** 2 + 1
    wide = 100 * most >= 10**37
    candidates, blocks = rows.select("row", "id", "label", "v"), max(1, -(-n // (block * 3 // 4)))
    asked = rows.where("asks").select("row", "id", "label", "v")
    asked = (cut(asked) if blocks > 1 else asked).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    at, found = f"{shared_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}", None
    for part in range(blocks):
        mine = sorted(asked.where(F.col("block") == part).drop("block").collect())  # near three quarters of a block
        for first in range(0, len(mine), block):
            some = [tuple(r) for r in mine[first : first + block]]
            found = _block(candidates, some, d, most, largest, wide, positives, negatives, low, high)
            if blocks > 1 or len(mine) > block:
                found.write.parquet(f"{at}/block={part}-{first}")
                found = None
    if found is None:
        names = [x.split()[0] for x in OUTPUT.split(", ")]
        found = cut(spark.read.schema(OUTPUT).parquet(at).select(*names))  # without the folders' column
        removed(spark, at)
    return found


def _block(candidates: DataFrame, some: list[tuple], d: int, most: int, largest: int, wide: bool, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of one block of anchors (row, id, label, v)."""
    spark = candidates.sparkSession
    schema = "anchor int, part int, id long, score string, row long"
    vectors = _matrix(pa.array([r[3] for r in some], pa.list_(pa.float64())), d)
    rows = [r[:3] for r in some]
    near = candidates.mapInArrow(Block(rows, vectors, most, largest, positives).run(None), schema)
    of: list[list[tuple[int, int]]] = [[] for _ in some]
    for r in _ranked(near, positives, wide, ["anchor"]).select("anchor", "rank", "id", "score").collect():  # a few for each anchor of the block
        of[r[0]].append((r[1], r[2], int(r[3])))
    # positives of one score share a range
    ranges, pairs = [], []
    for a, found in enumerate(of):
        scores = sorted({s for _, _, s in found if s >= 0})
        ranges.append([(-(-low * s // 100), high * s // 100) for s in scores])
        pairs += [(a, scores.index(s), some[a][1], i, _long(s)) for _, i, s in sorted(found) if s >= 0]
    if not pairs:
        return spark.createDataFrame([], OUTPUT)
    far = candidates.mapInArrow(Block(rows, vectors, most, largest, negatives).run(ranges), schema)
    best = _ranked(far, negatives, wide, ["anchor", "part"])
    least, greatest = -(1 << 63), (1 << 63) - 1
    score = F.coalesce(F.expr("try_cast(score as decimal(38,0))"), F.when(F.col("score").startswith("-"), F.lit(least)).otherwise(F.lit(greatest)))
    score = F.greatest(F.least(score, F.lit(greatest)), F.lit(least))
    of_pairs = spark.createDataFrame(pairs, "anchor int, part int, anchor_id long, positive_id long, positive_score long")
    out = best.join(F.broadcast(of_pairs), ["anchor", "part"])  # at most ``positives`` rows for each anchor of the block
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", score.cast("long").alias("negative_score"))
