"""Benchmark decontamination: one Aho-Corasick automaton over the normalised word windows of the test items.

Each text is normalised and scanned once; hits are kept as word positions and mapped to character offsets of the
original text only where there are any. The items are broadcast behind a check of their size: up to ITEM_BYTES of text
are one automaton; a larger set is dealt by a hash into parts of about that size, and each part is an automaton that
scans the same rows, with the same hits in the end. A worker builds an automaton once for all its tasks.

Defined results: a null text has no words; an item without words has no window; items that repeat an id count as one
item with the windows of all, and so do items without one; a window that several items share counts for each; an empty
benchmark leaves all documents clean; the columns of the documents pass through, but those named n_words, n_hit or hits
give way to the operator's.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpweave.session import map_arrow, named

WINDOW = 10
#: Bytes of item texts in one automaton, which takes some 500 times as much memory in each worker.
ITEM_BYTES = 1 << 20

_UPPER = bytes(range(65, 91))
_WORD = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Byte by byte: A-Z lower-cased, what belongs to no word becomes a space. Bytes from 0x80 on are parts of word characters.
_TABLE = bytes((b + 32 if b in _UPPER else b) if b in _WORD else 0x20 for b in range(256))

FIELDS = [("n_words", "long"), ("n_hit", "long"), ("hits", "array<struct<start:long,end:long,first_word:long,last_word:long,items:array<string>>>")]


def words(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def windows(items: list[tuple[str | None, bytes]], size: int = WINDOW) -> dict[bytes, set[str | None]]:
    """Word windows, each between single spaces, and the items they come from."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, data in items:
        w = words(data)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            found[b" " + b" ".join(w[i : i + size]) + b" "].add(item)
    return found


def automaton(found: dict[bytes, set[str | None]]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for key, of in found.items():
        built.add_word(key.decode("latin-1"), (len(key), key.count(b" ") - 1, tuple(sorted(of, key=lambda x: (x is None, x or "")))))
    built.make_automaton()
    return built


#: The automaton of this worker by name, the latest.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _built(name: str, sent, size: int) -> ahocorasick.Automaton:
    if name not in _BUILT:
        _BUILT.clear()  # the one before goes first
        _BUILT[name] = automaton(windows(sent.value, size))
    return _BUILT[name]


def _offsets(data: bytes) -> list[tuple[int, int]]:
    """Start and end of every word of the original text, in characters."""
    flat, out, at, chars, last = data.translate(_TABLE), [], 0, 0, 0
    for w in flat.split():
        at = flat.index(w, at)
        chars += len(data[last:at].decode("utf-8", "ignore"))
        n = len(data[at : at + len(w)].decode("utf-8", "ignore"))
        out.append((chars, chars + n))
        chars, last, at = chars + n, at + len(w), at + len(w)
    return out


def scan(data: bytes, built: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int, tuple[str, ...]]]]:
    """Number of words and the hits (first word, last word, items)."""
    w = words(data)
    if not w or not len(built):
        return len(w), []
    flat = (b" " + b" ".join(w) + b" ").decode("latin-1")
    hits, done, at = [], 0, 0
    for end, (_, n, items) in built.iter(flat):
        at += flat.count(" ", done, end + 1)
        done = end + 1
        hits.append((at - 1 - n, at - 2, items))
    return len(w), hits


def _parts(items: DataFrame, item_id: str, item_text: str, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items (id, text) in parts of about ``most`` bytes of text; the driver holds one part at a time."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.encode(F.col(f"`{item_text}`"), "UTF-8").alias("text")).where("text is not null")
    parts = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most))
    for k in range(parts):
        some = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else rows
        yield [(r[0], bytes(r[1])) for r in some.toLocalIterator()]


def scanned(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = ITEM_BYTES) -> DataFrame:
    """The documents with n_words, n_hit (words that hits cover) and hits, one for each occurrence of a window: character and word span, items."""
    out = docs.select(*named(docs, *(n for n, _ in FIELDS)))
    columns, spark = out.columns, docs.sparkSession
    text_at = columns.index(text_col)
    hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("items", pa.list_(pa.string()))]))
    for k, part in enumerate(_parts(items, item_id, item_text, most)):
        sent, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name, first=k == 0) -> Iterator[list[pa.Array]]:
            built = _built(name, sent, size)
            for batch in batches:
                counts, hits = [], []
                before = [None] * batch.num_rows if first else batch.column(batch.num_columns - 1).to_pylist()
                for x, old in zip(batch.column(text_at).cast(pa.binary()), before):
                    data = x.as_py() or b""
                    n, new = scan(data, built)
                    rows = list(old or [])
                    if new:
                        at = _offsets(data)
                        rows += [{"start": at[a][0], "end": at[b][1], "first_word": a, "last_word": b, "items": list(of)} for a, b, of in new]
                    counts.append(n)
                    hits.append(rows)
                kept = batch.columns if first else batch.columns[:-3]
                yield [*kept, pa.array(counts, pa.int64()), pa.array([hit_words(x) for x in hits], pa.int64()), pa.array(hits, hit_type)]

        out = map_arrow(out, run, columns, FIELDS)
    return out


def hit_words(hits: list[dict]) -> int:
    """How many words the hits cover, each counted once."""
    covered, last = 0, -1
    for a, b in sorted((h["first_word"], h["last_word"]) for h in hits):
        covered += max(0, b - max(a, last + 1) + 1)
        last = max(last, b)
    return covered


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without those that contain a window of a test item, all columns as they were."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = scanned(plain, items, f"c{docs.columns.index(text_col)}", **options)
    return found.where("n_hit = 0").select(*plain.columns).toDF(*docs.columns)
