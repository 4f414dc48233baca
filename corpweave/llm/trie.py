"""Prefix trie of conversations: a Cartesian tree over the common prefixes of sorted neighbours.

Conversations are sorted by the digests of their turns, so that those that share a prefix stand side by side, and each
gets the length of the prefix that it shares with the one before (LCP). A node of the trie of depth d is a longest run of
conversations whose inner LCPs are d or more: it ends on both sides at the nearest smaller value. Each partition of the
sorted table is a block. Within a block one stack finds all nearest smaller values; equal LCPs are one node, and the
depths that no LCP names, down to the end of each conversation, are nodes as well. What is still open at a block's
edges, at most one run for each depth of the prefix that crosses the edge, is looked up in the blocks' minima: the run
began in the nearest block before that has a smaller one. So an edge's runs are named alike in all blocks that they
cross, and their sums are added up by name.

All that a node returns is a sum over its run: conversations, children (nodes that open one deeper), leaves
(conversations that the next one doesn't go on from), and saved bytes, (n - 1) times the size of the last turn for each
node below, which is all members' sizes less each node's once. A hot prefix or a conversation with very many copies spans
as many blocks as it fills; only the digest of the ids that end at a node is by its nature one chain, of joined
pieces of 65,536 ids.

A conversation's digests (16 bytes a turn and 4 for its size) have to fit a task; its texts do not meet.

Defined results: a missing role or text is an empty one; turns without a number come first, and those with one number
are ordered by role, then by digest; rows without a conversation id take no part; repeated rows are turns of their own; a
conversation without turns ends at the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpweave.session import cut

#: Bytes of a turn's digest, and ids of a piece.
DIGEST, PIECE = 16, 1 << 16
#: Runs over edges that are broadcast at most; they are as many as blocks times the depth of what blocks share.
OPEN = 1_000_000
#: What a row of a block's result is.
NODE, RUN, ENDS = 0, 1, 2
SCHEMA = "kind int, start int, depth int, up int, id long, parent long, n long, children long, leaves long, saved long, ends string, block int, piece int"
_TYPES = [pa.int32()] * 4 + [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.int32()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Rows that a task holds before it sends them.
HELD = 20_000


def turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", near: Column | None = None) -> DataFrame:
    """(near, id, turns array<struct<digest, size>>): the turns of each conversation in order, without their texts.

    ``near`` says which conversations come to one task, its own id if it is not given."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{turn_col}`")
    row = F.struct(t.isNotNull().alias("numbered"), F.coalesce(t, F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("size"))
    rows = df.select((i if near is None else near).alias("near"), i.alias("id"), row.alias("row")).where("id is not null")
    grouped = rows.repartition("near").groupBy("near", "id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.select("near", "id", F.transform("rows", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns"))


def spliced(rows: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """(id, turns) with the first ``head`` turns of the conversation ``base`` in the place of a conversation's own first ones.

    ``rows`` as ``turns`` gives them, with ``near`` equal to ``base``; ``head`` is ``longest`` at most."""
    first = F.max(F.when(F.col("id") == base, F.slice("turns", 1, longest))).over(Window.partitionBy("near"))
    both = rows.select("id", "turns", head.cast("int").alias("head"), F.coalesce(first, F.slice("turns", 1, 0)).alias("first"))
    return both.select("id", F.concat(F.slice("first", F.lit(1), F.col("head")), F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """The number of turns that two conversations share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (differ.bit_length() + 7) // 8) // DIGEST


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a block's sorted rows (block, key, ...) to its (block, first key, last key, least LCP between two of its rows)."""
    block = first = last = least = None
    for batch in batches:
        for b, key in zip(batch.column(0).to_pylist(), batch.column(1)):
            key = key.as_py()
            if last is None:
                block, first = b, key
            else:
                least = min(x for x in (least, common(last, key)) if x is not None)
            last = key
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([least], pa.int32())], names=["block", "first", "last", "least"])


class Frame:
    """A run that is open on the stack; ``start`` is the block where it began, if that is an earlier one."""

    __slots__ = ("children", "depth", "ends", "kids", "least", "leaves", "n", "saved", "size", "start")

    def __init__(self, depth: int, size: int, start: int | None):
        self.depth, self.size, self.start = depth, size, start
        self.n = self.children = self.leaves = 0
        self.saved = 0 if start is not None else -size
        self.least, self.ends, self.kids = None, [], []


class Block:
    """The nodes of one block: those that lie in it whole, its parts of runs over its edges, and the ids that end at these.

    ``before`` is the LCP over each block's left edge, ``minima`` the least LCP of each block, its left edge included."""

    def __init__(self, order: dict[int, int], before: list[int], minima: list[int]):
        self.order, self.before, self.minima = order, before, minima

    def starts(self, at: int) -> list[int]:
        """For each depth of the runs over the left edge, the block where the run began."""
        out, k = [], at - 1
        for depth in range(self.before[at], -1, -1):
            while self.minima[k] >= depth:  # the first block's is -1
                k -= 1
            out.append(k)
        return out[::-1]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.out, self.stack, self.at, last, length = [], [], None, None, 0
        for batch in batches:
            for block, key, i, sizes in zip(*(batch.column(k) for k in range(4))):
                key, i, sizes = key.as_py(), i.as_py(), sizes.as_py()
                if last is None:
                    self.at = self.order[block.as_py()]
                    shared = self.before[self.at]
                    self.stack = [Frame(d, sizes[d - 1] if d else 0, s) for d, s in enumerate(self.starts(self.at))]
                else:
                    shared = length if key == last else common(last, key)
                    if shared < length:
                        self.stack[length].leaves += 1
                    while len(self.stack) > shared + 1:
                        self.close()
                last, length = key, len(sizes)
                for d in range(shared + 1, length + 1):
                    if d:
                        self.stack[d - 1].children += 1
                    self.stack.append(Frame(d, sizes[d - 1] if d else 0, None))
                top = self.stack[length]
                top.n += 1
                top.least = i if top.least is None or i < top.least else top.least
                top.ends.append(i)
            if len(self.out) > HELD:
                yield self.sent()
        if last is not None:
            after = self.before[self.at + 1] if self.at + 1 < len(self.before) else -1
            self.stack[length].leaves += after < length
            while self.stack:
                self.close(open_=len(self.stack) <= after + 1)
        yield self.sent()

    def sent(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [()] * len(_NAMES)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    def close(self, open_: bool = False) -> None:
        """Takes the top run off the stack; ``open_`` if it goes on in the next block."""
        f = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        f.saved += f.n * f.size
        if up is not None:
            up.n, up.leaves, up.saved = up.n + f.n, up.leaves + f.leaves, up.saved + f.saved
            up.least = f.least if up.least is None or f.least < up.least else up.least
        above = None if up is None else self.at if up.start is None else up.start
        if f.start is not None or open_:
            start = self.at if f.start is None else f.start
            self.out += [(*k[:1], start, *k[2:]) for k in f.kids]
            self.out.append((RUN, start, f.depth, above, f.least, None, f.n, f.children, f.leaves, f.saved, None, None, None))
            for p in range(0, len(f.ends), PIECE):
                self.out.append((ENDS, start, f.depth, None, None, None, None, None, None, None, ",".join(map(str, f.ends[p : p + PIECE])), self.at, p // PIECE))
            return
        self.out += [(*k[:5], f.least, *k[6:]) for k in f.kids]
        node = (NODE, None, f.depth, None, f.least, None, f.n, f.children, f.leaves, f.saved, hashlib.sha256(",".join(map(str, f.ends)).encode()).hexdigest(), None, None)
        if up is None:
            self.out.append(node)
        elif up.start is None:
            up.kids.append(node)  # until the parent's least id, or its name, is known
        else:
            self.out.append((*node[:1], up.start, *node[2:]))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces (start, depth, ends), in order, to the digest of each run's pieces joined by commas."""
    out, now, digest = [], None, None
    for batch in batches:
        for start, depth, piece in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (start, depth) != now:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (start, depth), hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if now:
        out.append((*now, digest.hexdigest()))
    columns = list(zip(*out)) if out else [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string()))], names=["start", "depth", "digest"])


def nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (id, turns), a row each: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    rows = conversations.select(key.alias("key"), "id", F.transform("turns", lambda x: x["size"]).alias("sizes"))
    dealt = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    parted = cut(dealt.select(F.spark_partition_id().alias("block"), "key", "id", "sizes"))

    @F.arrow_udf("int")
    def edge(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([-1 if y is None else common(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    ends = parted.select("block", "key").mapInArrow(_edges, "block int, first binary, last binary, least int")
    edges = ends.withColumn("before", edge("first", F.lag("last").over(Window.orderBy("block")))).select("block", "before", F.coalesce(F.least("before", "least"), "before").alias("least"))
    blocks = sorted(tuple(r) for r in edges.collect())  # three numbers for each block
    made = Block({b: k for k, (b, _, _) in enumerate(blocks)}, [r[1] for r in blocks], [r[2] for r in blocks])
    found = cut(parted.mapInArrow(partial(_run, made), SCHEMA))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    runs = found.where(F.col("kind") == RUN).groupBy("start", "depth").agg(F.min("id").alias("id"), F.min("up").alias("up"), *sums)
    pieces = found.where(F.col("kind") == ENDS).select("start", "depth", "ends", "block", "piece")
    chained = pieces.repartition("start", "depth").sortWithinPartitions("start", "depth", "block", "piece").select("start", "depth", "ends").mapInArrow(_chained, "start int, depth int, digest string")
    runs = cut(runs.join(chained, ["start", "depth"], "left").withColumn("ends", F.coalesce("digest", F.sha2(F.lit(""), 256))).drop("digest"), OPEN)
    names = runs.select(F.col("start").alias("of"), (F.col("depth") + 1).alias("below"), F.col("id").alias("above"))
    names = F.broadcast(names) if names.count() <= OPEN else names
    kids = found.where(F.col("kind") == NODE)
    out = ["id", "depth", "parent", "n", "children", "leaves", "saved", "ends"]
    inner = kids.where("start is null").select(out)
    lower = kids.where("start is not null").join(names, (F.col("start") == F.col("of")) & (F.col("depth") == F.col("below"))).select("id", "depth", F.col("above").alias("parent"), *out[3:])
    outer = runs.join(names, (F.col("up") == F.col("of")) & (F.col("depth") == F.col("below")), "left").select("id", "depth", F.col("above").alias("parent"), *out[3:])
    every = inner.unionByName(lower).unionByName(outer)
    return every.select(F.col("id").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _run(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return block.run(batches)
