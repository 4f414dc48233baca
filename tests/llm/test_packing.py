import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = packing.WordEncoder(PATH)


def ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aZé'sß ªI²³½0_×÷İĿŉſ-.!|<>\t\n\x0b\x1c\x85\xa0\xad", max_size=60), st.sampled_from(["<|endoftext|>", "it's WE'LL they'Re", "Σας ΟΔΟΣ", "é", "Å"])), max_size=6))
def test_ids_equal_the_tokenizers(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODER.batch(texts)] == [ids(t) for t in texts]


def test_ids_of_documents(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODER.batch(texts)] == [ids(t) for t in texts]


def test_forgets_words(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    e = packing.WordEncoder(PATH)
    for texts in (["a b c"], ["d e f a"], ["g h i j k"], ["a"]):
        assert [np.frombuffer(b, "<u4").tolist() for b in e.batch(texts)] == [ids(t) for t in texts]


def naive(lengths, capacity):
    """Sequence by sequence, as the method says, without counts: number of sequences."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        b = next((i for i, n in enumerate(large) if a + n <= capacity), None)
        gaps.append(capacity - a - (large.pop(b) if b is not None else 0))
    for s in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120), st.just(60))
def test_plan_equals_piece_by_piece_packing(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.plan(counts, capacity)
    assert sum(many for many, _ in patterns) == naive(lengths, capacity)
    assert all(sum(n * k for n, k in p) <= capacity for _, p in patterns)
    used = {n: sum(many * k for many, p in patterns for m, k in p if m == n) for n in counts}
    assert used == counts


def check(rows, capacity=2048):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(v <= capacity for v in at.values())
    return len(at)


def test_documents_are_packed_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = packing.pack(packing.tokenised(docs, PATH).withColumn("crc", F.crc32("ids")).drop("ids")).collect()
    n = check(rows)
    want = {r.doc_id: [*ids(r.text), 0] for r in docs.collect()}
    total = sum(map(len, want.values()))
    assert sum(r.length for r in rows) == total and n <= -(-total // 2048) * 1.02
    for r in rows:
        part = want[r.doc_id][r.start : r.start + 2048]
        assert r.start == 2048 * r.piece and r.length == len(part) and r.crc == zlib.crc32(np.array(part, "<u4").tobytes())


def test_odd_rows_and_round_trip(spark):
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (5, "word " * 9000)] + [(i, "x y " * rnd.randint(0, 900)) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as `sequence id`", "2 as `a.b`")
    packed = packing.pack(packing.tokenised(docs, PATH)).cache()
    check(packed.collect())
    assert set(packed.columns) == {"doc_id", "sequence id", "a.b", "piece", "start", "length", "ids", "sequence_id", "offset"}
    joined = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert joined[r.sequence_id][r.offset : r.offset + r.length].tobytes() == bytes(r.ids)
    assert sum(map(len, joined.values())) == sum(len(ids(t or "")) + 1 for _, t in rows)
    assert packing.pack(packing.tokenised(docs.limit(0), PATH)).count() == 0


def test_columns_with_the_names_of_steps_pass_through(spark):
    rows = spark.createDataFrame([(i, 5 + i % 3) for i in range(200)], "doc_id long, length long")
    own = {"__bucket": "mine", "__n": 7, "__before": 8, "__at": 9, "__rank": 10}
    odd = rows.withColumns({k: F.lit(v) for k, v in own.items()} | {"offset": F.lit(-1), "sequence_id": F.lit("s")})
    got = packing.pack(odd, 16)
    assert got.columns == ["doc_id", "length", *own, "sequence_id", "offset"]
    found = got.collect()
    assert all(tuple(r)[2:7] == tuple(own.values()) for r in found) and sorted(r.doc_id for r in found) == list(range(200))
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
