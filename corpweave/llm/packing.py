"""Best-fit packing of tokenised documents into sequences of a fixed capacity by large-item matching.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers whatever the input: pieces
above a third of the capacity fit at most twice into a sequence and are paired by greedy matching (the largest with
the largest that still fits); smaller ones best-fit the remaining gaps, longest first. The plan is a short list of
patterns with repeat counts, so a piece's rank among those of its length gives its sequence and offset. Ranks come
from windows over about sqrt(n) buckets of each length, so a length that a third of all pieces share is spread too.

Defined results: a null or empty text is its end token alone; repeated rows are packed each; equal pieces may swap
places; an empty table gives no rows; the columns of pieces pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpweave.session import map_arrow, named

CAPACITY = 2048
#: Words whose ids a worker remembers, twice at most: those of late, and those before.
REMEMBERED = 250_000

#: Texts of these characters alone are lower-cased and split the same way by Python as by the tokenizer's own rules.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")


@lru_cache(maxsize=2)
def encoder_for(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, with the words it knows; one for all tasks of a Python worker."""
    return WordEncoder(path)


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers, equal to those of the tokenizer file.

    The file's rules split a lower-cased text into words that are encoded one by one, so the ids of a word are
    remembered, and the unknown words of a batch go to the tokenizer together. Texts with characters outside plain
    Latin, or with what may be a special token, go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet, joined by spaces; each ends with its first end-of-word token.

        When too many are known, those not used since the last time are forgotten."""
        if len(self.known) + len(words) > REMEMBERED:
            self.old, self.known = self.known, {}
        found = {w: self.old[w] for w in words if w in self.old}
        self.known |= found
        new = [w for w in words if w not in found]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                data, to = ids.tobytes(), (4 * stops).tolist()
                self.known.update(zip(some, (data[i:j] for i, j in zip([0, *to], to))))
            else:
                self.known.update((w, self.whole(w)) for w in some)

    def batch(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = [_PIECES.findall(t.lower()) if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        words = set().union(*(s for s in split if s))
        if new := words.difference(self.known):
            self.learn(list(new) if len(self.known) + len(new) <= REMEMBERED else list(words))
        get = self.known.__getitem__
        try:
            return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]
        except KeyError:  # one batch has more words than are remembered
            return [self.whole(t) for t in texts]


def tokenised(docs: DataFrame, path: str, text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, then piece, start, length and ids (binary, little-endian
    unsigned 32-bit), which take the place of columns of these names. A document's ids end with ``end_id``; only documents longer than ``capacity`` are cut."""
    rest = [c for c in docs.columns if c not in (text_col, "piece", "start", "length", "ids")]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder = encoder_for(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
                row, piece, start, length, ids = [], [], [], [], []
                for i, data in enumerate(encoder.batch(texts)):
                    data += end
                    for k, s in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[s : s + 4 * capacity]
                        row.append(i), piece.append(k), start.append(s // 4), length.append(len(part) // 4), ids.append(part)
                kept = batch.take(pa.array(row, pa.int64())).columns[:-1] if rest else []
                yield [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]

    fields = [("piece", "int"), ("start", "long"), ("length", "long"), ("ids", "binary")]
    return map_arrow(docs.select(*named(docs, text_col), text_col), run, rest, fields)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, how many of it)]) that hold all pieces of these counts by length."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    gaps: dict[int, list[list]] = defaultdict(list)  # by gap: [how many, pattern]

    def opened(gap: int, many: int, pattern: list[tuple[int, int]]) -> None:
        if many:
            gaps[gap].append([many, pattern])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in (n for n in large if n <= min(a, capacity - a)):
            if not left[a]:
                break
            many = left[a] // 2 if a == b else min(left[a], left[b])
            left[a] -= many
            left[b] -= many
            opened(capacity - a - b, many, [(a, 2)] if a == b else [(a, 1), (b, 1)])
        opened(capacity - a, left[a], [(a, 1)])
        left[a] = 0
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[s]
        for gap in [*sorted(g for g in gaps if g >= s), capacity]:
            each = gap // s
            bins = gaps.pop(gap, []) if gap != capacity else [[-(-rest // each), []]]
            while bins and rest:
                many, pattern = bins.pop()
                full = min(many, rest // each)
                opened(gap - full // max(full, 1) * each * s, full, [*pattern, (s, each)])
                rest, many = rest - full * each, many - full
                if many and rest:
                    opened(gap - rest * s, 1, [*pattern, (s, rest)])
                    rest, many = 0, many - 1
                if gap != capacity:
                    opened(gap, many, pattern)
            if bins:
                gaps[gap].extend(bins)
            if not rest:
                break
    return [(many, pattern) for gap in sorted(gaps) for many, pattern in gaps[gap]]


def placed(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many of it in a sequence, first offset), sorted by the first two."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for many, pattern in patterns:
        offset = 0
        for n, each in pattern:
            rows.append((n, rank[n], sequence, each, offset))
            rank[n] += many * each
            offset += n * each
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


#: Names that the steps of ``pack`` use; columns of these names are called otherwise meanwhile.
_OWN = frozenset({"__bucket", "__n", "__before", "__at", "__rank", "sequence_id", "offset"})


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """The pieces with sequence_id and offset, which take the place of columns of these names: no sequence is longer than
    ``capacity`` or has a gap.

    Reads ``pieces`` twice; checkpoint them first if they are dear."""
    if not _OWN.isdisjoint(pieces.columns):
        kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
        plain = pieces.select(*named(pieces, "sequence_id", "offset")).toDF(*(f"c{i}" for i in range(len(kept))))
        return pack(plain, capacity, f"c{kept.index(length_col)}").toDF(*kept, "sequence_id", "offset")
    counts = {int(n): int(c) for n, c in pieces.groupBy(length_col).count().collect()}
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = placed(plan(counts, capacity))  # bounded by the capacity, not by the rows
    buckets = F.array(*(F.lit(max(1, int(counts.get(n, 0) ** 0.5))) for n in range(capacity + 1)))
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*named(pieces)), F.get(buckets, F.col(length_col).cast("int"))))
    key = [length_col, "__bucket"]
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.expr(f"sum(__n) over (partition by `{length_col}` order by __bucket) - __n")).drop("__n")
    ranked = dealt.withColumn("__at", F.expr(f"row_number() over (partition by `{length_col}`, __bucket order by {', '.join(f'`{c}`' for c in pieces.columns)}) - 1"))
    ranked = ranked.join(before, key).withColumn("__rank", F.col("__at") + F.col("__before")).select(*named(pieces), "__rank")
    steps = table[:, 0] * (1 << 40) + table[:, 1]

    length_at = pieces.columns.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            n = batch.column(length_at).to_numpy().astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy()
            row = table[np.searchsorted(steps, n * (1 << 40) + rank, side="right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 2] + at // row[:, 3], row[:, 4] + at % row[:, 3] * n
            yield [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]

    return map_arrow(ranked, run, pieces.columns, [("sequence_id", "long"), ("offset", "long")])


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, joined in order of their offsets."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(rows, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
