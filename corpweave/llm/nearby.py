"""Near-duplicate groups of texts: the SimHash index brings pairs, the exact Jaccard similarity of their shingles decides.

Two texts are linked if their fingerprints of five-word shingles differ in RADIUS bits or fewer and the sets of these
shingles have a Jaccard similarity of 4/5 or more. Texts of equal words collapse first. A pair that the index brings is
dropped where the texts' sketches differ in more bits than similar sets can, and otherwise compared on the sets. A text
with many others near it is compared with the nearest in each component of its bucket; what that leaves apart in such a
dense region is compared in tiles: those outside the region's largest group against all of it, a task for each pair of
tiles. So no link is lost, none is made below the similarity, and no task holds more than two tiles.

Defined results: null and blank texts are copies of one another, and a text of fewer than five words is one shingle; of
rows that repeat the id that stays in a group, one row stays; a missing id stays only if a group has no other; an
empty table gives no rows; columns pass through, whatever their names and types. Texts stand for themselves as
64-bit digests of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpweave.llm import simhash
from corpweave.session import cut, map_arrow

SHINGLE = 5
#: Nearly all similar texts differ in so many bits at most; README has the share.
RADIUS = 13
#: Segments (bits, radius) that find all within RADIUS bits.
SEGMENTS = ((13, 2), (13, 2), (13, 2), (13, 2), (12, 1))
#: Texts near one in a bucket that it is compared with each; more make a dense region.
MOST = 4
#: Bits of a sketch: the parity of the elements that fall on each, so sets that differ in d elements differ in at most d bits.
SKETCH = 1024
#: Texts of a tile on the side that is held; the other side has four times as many.
TILE = 256
#: Texts turned into sets at once.
PIECE = 256
#: Up to so many ids are broadcast, more are joined by a shuffle.
SENT = 200_000


def similar(both: int | np.ndarray | Column, a, b):
    """Whether sets of sizes ``a`` and ``b`` that share ``both`` elements have a similarity of 4/5 or more."""
    return 9 * both >= 4 * (a + b)


def digest(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(simhash.shingle_hashes(words, SHINGLE), np.uint64)


def shingles(data: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a UTF-8 text."""
    return np.unique(_hashes((data or b"").lower().split()))


def sketch(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s % SKETCH).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _signed_long(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _words(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            yield piece, [(x.as_py() or b"").lower().split() for x in piece.column(text_at).cast(pa.binary())]


def signed(docs: DataFrame) -> DataFrame:
    """(id, node, fp, size, sketch) of the documents (id, text): the node is a digest of the words."""

    def run(batches):
        for b, words in _words(batches, 1):
            out = [[], [], [], []]
            for w in words:
                h = _hashes(w)
                s = np.unique(h)
                for to, x in zip(out, (digest(w), simhash.majority(h), len(s), sketch(s))):
                    to.append(x)
            yield [b.column(0), _signed_long(out[0]), _signed_long(out[1]), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())]

    return map_arrow(docs, run, ["id"], [("node", "long"), ("fp", "long"), ("size", "int"), ("sketch", "binary")])


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, set) of the documents (id, text)."""

    def run(batches):
        for b, words in _words(batches, 1):
            sets = [np.sort(np.unique(_hashes(w)).view(np.int64)) for w in words]
            ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            yield [b.column(0), _signed_long([digest(w) for w in words]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))]

    return map_arrow(docs, run, ["id"], [("node", "long"), ("set", "array<long>")]).select("node", "set")


def _lists(a: pa.Array) -> list[np.ndarray]:
    values, ends = a.values.to_numpy(), a.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]


def _differing(x: Column, y: Column) -> Column:
    """The number of bits in which two sketches differ."""

    @F.arrow_udf("long")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        p, q = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (a, b))
        return pa.array(np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64))

    return of(x, y)


def _sharing(x: Column, y: Column) -> Column:
    """How many elements two sorted sets share."""

    @F.arrow_udf("long")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(_lists(a), _lists(b))], pa.int64())

    return of(x, y)


def tile_links(left: list[tuple[int, int, np.ndarray]], right: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Links between the groups of texts (group, fingerprint, set) of the left and the right side.

    One link for each pair of groups that the pairs of texts connect directly, and no other does so far."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    groups = [x[0] for x in left]
    fps, sizes = np.array([x[1] for x in left], np.int64).view(np.uint64), np.array([len(x[2]) for x in left])
    tokens = np.concatenate([x[2] for x in left])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(left)), sizes)[order]
    label = np.array(groups, np.int64)
    for group, fp, s in right:
        ok = np.bitwise_count(fps ^ np.uint64(fp & 0xFFFFFFFFFFFFFFFF)) <= RADIUS
        ok &= (label != root(group)) & (5 * sizes >= 4 * len(s)) & (4 * sizes <= 5 * len(s))
        if not ok.any():
            continue
        low, high = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(left))
        for i in np.flatnonzero(ok & similar(both, sizes, len(s))).tolist():
            a, b = root(groups[i]), root(group)
            if a != b:
                yield a, b
                parent[max(a, b)] = min(a, b)
                label[label == max(a, b)] = min(a, b)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (region, left, right, side, group, fp, set) sorted by the first four to links (a, b) of groups."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                yield from zip(*(part.column(i).to_pylist() for i in range(6)), _lists(part.column(6)))

    def close(left, right) -> pa.RecordBatch:
        found = np.array(list(tile_links(left, iter(right))) if left and right else [], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    now, held = None, ([], [])
    for region, i, j, side, *row in rows():
        if (region, i, j) != now:
            if held[0]:
                yield close(*held)
            now, held = (region, i, j), ([], [])
        held[side].append(row)
    if held[0]:
        yield close(*held)


def _apart(spans: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(region, node, group, fp, main) for the texts of dense regions that hold several groups; main marks the largest.

    A region is what ``spans`` (a, b) connect; None if each is one group."""
    of_a, of_b = (groups.select(F.col("node").alias(k), F.col("group").alias(f"group_{k}")) for k in "ab")
    both = spans.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("group_a", "a").alias("a"), F.coalesce("group_b", "b").alias("b"))
    between = cut(both.where("a <> b").distinct(), spans.count())
    if not (n := between.count()):
        return None
    regions = simhash.components(between, rows=n).select(F.col("node").alias("group"), F.col("root").alias("region"))
    ends = spans.select(F.col("a").alias("node")).distinct().unionByName(spans.select(F.col("b").alias("node")).distinct()).distinct()
    m = ends.join(groups, "node", "left").select("node", F.coalesce("group", "node").alias("group"))
    m = cut(m.join(regions, "group").join(nodes.select("node", "fp"), "node"), 2 * spans.count())
    sizes = m.groupBy("region", "group").agg(F.count("*").alias("n"))
    main = sizes.groupBy("region").agg(F.max_by("group", F.struct("n", "group")).alias("largest"))
    return m.join(main, "region").select("region", "node", "group", "fp", (F.col("group") == F.col("largest")).alias("main"))


def _region_links(apart: DataFrame, sets: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) of groups of a region: all texts outside its largest group against all of the region, in tiles."""
    rows = cut(apart.join(sets, "node"), 8 * apart.count())  # sets are large rows
    sizes = rows.groupBy("region").agg(F.ceil(F.count_if(~F.col("main")) / F.lit(tile)).cast("int").alias("lefts"), F.ceil(F.count("*") / F.lit(4 * tile)).cast("int").alias("rights"))
    rows = rows.join(sizes, "region")

    def dealt(side: int, one: Column, other: Column) -> DataFrame:
        some = rows.where(~F.col("main")) if side == 0 else rows
        return some.select("region", one.alias("left"), other.alias("right"), F.lit(side).alias("side"), "group", "fp", "set")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def spot(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    both = dealt(0, spot("lefts"), every("rights")).unionByName(dealt(1, every("lefts"), spot("rights")))
    key = ["region", "left", "right"]
    return both.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(_tiles, "a long, b long")


def roots(docs: DataFrame, prints: DataFrame, unique: bool = False) -> DataFrame:
    """(node, root) of the nodes that have links: the root is the same for what links connect, directly or not.

    ``docs`` has (id, text) and ``prints`` is what ``signed`` makes of it, stored; ``unique`` says that no id repeats."""
    nodes = cut(prints.groupBy("node").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), prints.count())
    found = simhash.met(nodes, SEGMENTS, RADIUS, MOST, rows=prints.count())
    of_a, of_b = (nodes.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    pairs = found.select("a", "b").distinct().join(of_a, "a").join(of_b, "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")
    # of na + nb elements of similar sets at most a ninth is in one set only
    pairs = cut(pairs.where(9 * _differing(F.col("sketch_a"), F.col("sketch_b")) <= F.col("na") + F.col("nb")).select("a", "b"), found.count())

    def sets_for(some: DataFrame, rows: int) -> DataFrame:
        ids = cut(some.distinct().join(nodes, "node").select(F.col("id").alias("of")).distinct(), rows)
        of = F.broadcast(ids) if ids.count() <= SENT else ids
        sets = sets_of(docs.join(of, F.col("id").eqNullSafe(F.col("of")), "left_semi"))
        return cut(sets if unique else sets.dropDuplicates(["node"]), rows)

    n = pairs.count()
    sets = sets_for(pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()), 2 * n)
    of_a, of_b = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    met = pairs.join(of_a, "a").join(of_b, "b")
    linked = cut(met.where(similar(_sharing(F.col("set_a"), F.col("set_b")), F.size("set_a"), F.size("set_b"))).select("a", "b"), n)
    groups = simhash.components(linked, rows=n).withColumnRenamed("root", "group")
    apart = _apart(found.where(F.col("kind") == simhash.SPAN).select("a", "b"), groups, nodes)
    if apart is None:
        return groups.withColumnRenamed("group", "root")
    joined = simhash.components(_region_links(apart, sets_for(apart.select("node"), apart.count()))).select(F.col("node").alias("group"), "root")
    moved = groups.join(joined, "group", "left").select("node", F.coalesce("root", "group").alias("root"))
    single = joined.select(F.col("group").alias("node"), "root").join(groups.select("node"), "node", "left_anti")
    return moved.unionByName(single)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the smallest id of each group of near-duplicates, all columns as they were.

    A group is what links connect."""
    names, at = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*at)
    id_, text = (F.col(at[names.index(c)]) for c in (id_col, text_col))
    texts = plain.select(id_.alias("id"), text.alias("text"))
    prints = cut(signed(texts), texts.count())
    unique = prints.groupBy("id").count().where("count > 1").isEmpty()
    named = simhash.named_by(prints.select("id", F.col("node").alias("fp")), roots(texts, prints, unique))
    if unique:
        gone = cut(prints.join(named, prints.node == named.fp).where("not (id <=> component)").select("id"), prints.count())
        gone = F.broadcast(gone) if gone.count() <= SENT else gone
        return plain.join(gone, id_.eqNullSafe(gone["id"]), "left_anti").toDF(*names)
    text_at = at.index(at[names.index(text_col)])

    def run(batches):
        for b, words in _words(batches, text_at):
            yield [*b.columns, _signed_long([digest(w) for w in words])]

    rows = map_arrow(plain, run, at, [("fp", "long")]).join(named, "fp").where(id_.eqNullSafe(F.col("component")))
    one = rows.groupBy("root").agg(F.min_by(F.struct(*at), F.to_json(F.struct(*at))).alias("row"))
    return one.select("row.*").toDF(*names)
