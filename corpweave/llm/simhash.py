"""SimHash near-duplicates, found by multi-index hashing.

A fingerprint's 64 bits are cut into segments, each with a radius of its own, such that any two fingerprints within the
whole radius lie within the segment's radius in one of them at least (the radii plus one add up to more than the whole
radius). So every distinct fingerprint is filed under the small Hamming ball around each segment's value, and all that
meet in a bucket are verified on the 64 bits. Of a ball only those values are filed that have further bits set: two
values within a radius meet in their union. Copies collapse first, and buckets return a spanning forest of their links
instead of all pairs. Buckets beyond a fixed size are met a second time in tiles of that size, a task for each pair of
tiles. Components come from alternating star contraction.

Defined results: null or blank texts have fingerprint zero and link like any other; a missing id never becomes a
component's id unless all its ids are missing; repeated rows each get a row; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpweave.session import cut

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Segments (bits, radius) that find all within RADIUS bits.
SEGMENTS = ((32, 1), (32, 1))
#: Shingles whose bits are counted at once, so that a very long text needs no more memory.
CHUNK = 1 << 15
#: Rows of a bucket that one task takes; larger buckets are met in tiles of this size.
LARGE = 1 << 15
#: Fingerprints compared at once.
BLOCK = 1 << 18
#: What a row of a bucket's result is.
PAIR, SPAN, TOO_LARGE = 0, 1, 2


def shingle_hashes(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> Iterator[int]:
    """XXH64 of every word shingle, repeats included; of fewer words, of the whole sequence."""
    if len(words) < size:
        return iter([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [])
    return map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), repeat(seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as unsigned integer; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(data: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, as unsigned integer; zero for no words."""
    return majority(np.fromiter(shingle_hashes((data or b"").lower().split(), size, seed), np.uint64))


def fingerprint_column(text: Column, size: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            values = np.fromiter((fingerprint(x.as_py(), size, seed) for x in a.cast(pa.binary())), np.uint64, len(a))
            yield pa.array(values.view(np.int64))

    return of(text)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def complete(segments: tuple[tuple[int, int], ...], radius: int) -> bool:
    """Whether these segments find every pair within ``radius`` bits."""
    return sum(bits for bits, _ in segments) == 64 and sum(r + 1 for _, r in segments) > radius


def _keys(batches: Iterator[pa.RecordBatch], segments: tuple[tuple[int, int], ...]) -> Iterator[pa.RecordBatch]:
    """From (node, fp) to (key, node, fp): a key is the segment's number and value, and in its last two bits the level,
    which is how many bits were added to the value."""
    masks = [[sum(1 << b for b in c) for n in range(r + 1) for c in combinations(range(bits), n)] for bits, r in segments]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            fp, keys, rows, shift = part.column(1).to_numpy().view(np.uint64), [], [], 0
            for tag, ((bits, _), added) in enumerate(zip(segments, masks)):
                value = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                added = np.array(added, np.uint64)
                row, k = np.nonzero((value[:, None] & added) == 0)
                level = np.bitwise_count(added[k]).astype(np.int64)
                keys.append((tag << 48) | ((value[row] | added[k]).astype(np.int64) << 2) | level)
                rows.append(row)
                shift += bits
            at_ = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(0).take(at_), part.column(1).take(at_)], names=["key", "node", "fp"])


def bucket_links(level: np.ndarray, node: np.ndarray, fp: np.ndarray, reach: int, mask: int, before: list[tuple[int, int]], radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(a, b, kind) for the rows of a bucket, sorted by level: what its nodes within ``radius`` bits are to one another.

    Two nodes meet here if the bucket's value is the union of theirs, so once in a segment, whose bits are ``mask``, and if they
    do not meet in one of the segments ``before`` (mask, radius): each pair is looked at in one bucket. A node
    with up to ``most`` others gives a PAIR with each. One with more gives SPANs that connect it with all of them, to the
    nearest in each component that it touches; a bucket has fewer SPANs than nodes."""
    label = np.unique(node, return_inverse=True)[1]
    starts = np.searchsorted(level, np.arange(reach + 2))
    for own in range(reach // 2 + 1):  # levels that add up to the segment's radius at most
        begin, end = int(starts[own]), int(starts[reach - own + 1])
        step = max(1, BLOCK // max(1, end - begin))
        for at in range(begin, int(starts[own + 1]), step):
            some = fp[at : min(at + step, int(starts[own + 1]))]
            away = np.bitwise_count(some[:, None] ^ fp[begin:end])
            i, j = np.nonzero(away <= radius)
            after = j + begin > i + at
            i, j = i[after], j[after]
            union = own + level[j + begin] == np.bitwise_count((some[i] ^ fp[j + begin]) & np.uint64(mask))
            union &= node[j + begin] != node[i + at]
            i, j = i[union], j[union]
            for other, near in before:
                later = np.bitwise_count((some[i] ^ fp[j + begin]) & np.uint64(other)) > near
                i, j = i[later], j[later]
            if not len(i):
                continue
            many = np.bincount(i, minlength=len(some))
            open_ = many > most
            few = ~open_[i]
            if few.any():
                yield node[i[few] + at], node[j[few] + begin], PAIR
            ends = np.cumsum(many)
            for x in np.flatnonzero(open_):
                near = j[ends[x] - many[x] : ends[x]]
                near = near[label[near + begin] != label[x + at]]
                near = near[np.lexsort((node[near + begin], away[x, near]))]
                labels, first = np.unique(label[near + begin], return_index=True)
                if len(labels):
                    yield np.repeat(node[x + at], len(labels)), node[near[first] + begin], SPAN
                    joined = np.append(labels, label[x + at])
                    label[np.isin(label, joined)] = joined.min()


def _met(batches: Iterator[pa.RecordBatch], segments: tuple[tuple[int, int], ...], radius: int, most: int, large: int, tiled: bool) -> Iterator[pa.RecordBatch]:
    """From rows (key, node, fp[, left, right]) sorted by all but node and fp to distinct (a, b, kind); holds one bucket at a time.

    A bucket of more than ``large`` rows gives (key without level, 0, TOO_LARGE) instead, unless ``tiled``."""
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    ends = np.cumsum([0, *(bits for bits, _ in segments)]).tolist()
    masks = [((1 << bits) - 1) << at for (bits, _), at in zip(segments, ends)]

    def emit() -> pa.RecordBatch:
        rows = np.concatenate([np.stack([np.minimum(a, b), np.maximum(a, b), np.full(len(a), kind)]) for a, b, kind in out], axis=1) if out else np.zeros((3, 0), np.int64)
        rows = np.unique(rows, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], names=["a", "b", "kind"])

    def close(held: list[tuple[np.ndarray, ...]]) -> None:
        bucket, key, node, fp = (np.concatenate(x) for x in zip(*held))
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for s, e in zip(starts, np.append(starts[1:], len(key))):
            if e - s < 2 or key[s] & 3 and segments[key[s] >> 48][1] < 2:  # nobody's own value
                continue
            if e - s > large and not tiled:
                out.append((np.array([key[s] >> 2]), np.array([np.iinfo(np.int64).max]), TOO_LARGE))
            else:
                order, tag = np.argsort(key[s:e] & 3, kind="stable"), int(key[s] >> 48)
                out.extend(bucket_links((key[s:e] & 3)[order], node[s:e][order], fp[s:e][order], segments[tag][1], masks[tag], [(masks[k], segments[k][1]) for k in range(tag)], radius, most))

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        key, node, fp = columns[0], columns[1], columns[2].view(np.uint64)
        bucket = key >> 2
        if tiled:  # a number for each bucket and pair of tiles
            bucket = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in np.stack([bucket, *columns[3:]], axis=1)], np.uint64).view(np.int64)
        last = len(bucket) - int(np.argmax(bucket[::-1] != bucket[-1])) if (bucket != bucket[-1]).any() else 0
        if held and (last or held[0][0][0] != bucket[0]):
            held.append((bucket[:last], key[:last], node[:last], fp[:last]))
            close(held)
            held = []
        elif last:
            close([(bucket[:last], key[:last], node[:last], fp[:last])])
        held.append((bucket[last:], key[last:], node[last:], fp[last:]))
        if not tiled and sum(len(h[0]) for h in held) > large + 1:  # to be known as too large is all that this bucket needs
            held = [tuple(np.concatenate(x)[: large + 1] for x in zip(*held))]
        if sum(len(a) for a, _, _ in out) > 100_000:
            yield emit()
            out.clear()
    if held:
        close(held)
    yield emit()


def met(nodes: DataFrame, segments: tuple[tuple[int, int], ...] = SEGMENTS, radius: int = RADIUS, most: int = 0, large: int = LARGE, rows: int | None = None) -> DataFrame:
    """(a, b, kind) of the nodes (node, fp), one for each text or fingerprint that counts: see ``bucket_links``.

    ``rows`` says how many nodes there are, about, if it is known."""
    if not complete(segments, radius):
        raise ValueError(f"segments {segments} do not find all within {radius} bits")
    schema = "a long, b long, kind int"
    keyed = nodes.select("node", "fp").mapInArrow(partial(_keys, segments=segments), "key long, node long, fp long")
    dealt = keyed.repartition(F.shiftright("key", 2)).sortWithinPartitions("key")
    of = partial(_met, segments=segments, radius=radius, most=most, large=large)
    found = cut(dealt.mapInArrow(partial(of, tiled=False), schema).distinct(), rows)
    big = found.where(F.col("kind") == TOO_LARGE).select(F.col("a").alias("of"))
    if big.isEmpty():
        return found
    again = cut(keyed.withColumn("of", F.shiftright("key", 2)).join(big, "of"))
    tiles = again.groupBy("of").agg(F.ceil(F.count("*") / F.lit(large / 2)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = again.join(tiles, "of").select("key", "node", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pairs = pairs.select("key", "node", "fp", F.least("own", "other").cast("long").alias("left"), F.greatest("own", "other").cast("long").alias("right"))
    tiled = pairs.withColumn("of", F.shiftright("key", 2)).repartition("of", "left", "right").sortWithinPartitions("of", "left", "right", "key").drop("of")
    return found.where(F.col("kind") != TOO_LARGE).unionByName(cut(tiled.mapInArrow(partial(of, tiled=True), schema).distinct()))


def links(fps: DataFrame, radius: int = RADIUS, segments: tuple[tuple[int, int], ...] = SEGMENTS, rows: int | None = None) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` at ``radius`` or fewer differing bits; no pair is missed."""
    return met(fps.select(F.col("fp").alias("node"), "fp"), segments, radius, rows=rows).select("a", "b")


def components(edges: DataFrame, rounds: int = 100, rows: int | None = None) -> DataFrame:
    """(node, root) for the nodes of the undirected edges (a, b); root is the smallest node that can be reached.

    Alternates large-star and small-star steps, which need a number of rounds logarithmic in a chain's length; each
    round is checkpointed, so that a lost executor costs one round at most. ``rows`` is the number of edges at most, if
    it is known."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    before = state(e)
    for _ in range(rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small, 2 * before[0])
        now = state(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component) for the distinct fingerprints of (id, fp): the root is the same in a component, and the
    component is its smallest id."""
    n = prints.count()
    return named_by(prints, components(links(prints.select("fp").distinct(), radius, rows=n), rows=n))


def named_by(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """As ``classes``, for given (node, root) of the fingerprints that are linked."""
    least, n = prints.groupBy("fp").agg(F.min("id").alias("least")), prints.count()
    linked = cut(roots.join(least, roots.node == least.fp).select("node", "root", "least"), n)
    # on its own, so that the join with a root that very many fingerprints have can be split
    smallest = cut(linked.groupBy("root").agg(F.min("least").alias("component")), n)
    of = linked.select("node", "root").join(smallest, "root")
    both = least.join(of, least.fp == of.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component"))
    return cut(both, n)  # so that a join with a fingerprint that very many documents have can be split as well


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, fp long, component id: the smallest id that can be reached)."""
    prints = cut(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(F.col(f"`{text_col}`")).alias("fp")))
    return prints.join(classes(prints).select("fp", "component"), "fp").select(F.col("id").alias(id_col), "fp", F.col("component").alias("component_id"))
