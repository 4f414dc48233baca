import zlib

import numpy as np

from corpweave.llm import quality as Q
from corpweave.llm import queries


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"  # about 3,000 labels to learn from
    rows = queries.queries()["op8_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.99
    assert np.mean([s >= 0.7 for s in good]) >= 0.99


def test_whole_query_equals_plain_python(spark, sf):
    """Learned from the same labels and features by the plain formulas, every score of the table is the same."""
    rows = {r.doc_id: r for r in queries.queries()["op8_quality"](spark, sf).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.quality in (0, 1):
            marks[r.doc_id] = min(r.quality, marks.get(r.doc_id, 1))
    known = sorted((i for i in marks if i in texts and zlib.crc32(str(i).encode()) % 4 != 2), key=str)
    assert max(sum(marks[i] == c for i in known) for c in (0, 1)) <= Q.SAMPLE
    slots = {i: sorted(brute(texts[i]) | runs(texts[i])) for i in texts}
    order = sorted(known, key=lambda i: (str(i), np.array(slots[i], "<i4").tobytes()))
    model = Q.fit(Q.Rows.of([np.array(slots[i], "<u4").tobytes() for i in order]), [marks[i] for i in order], prior=sum(marks[i] for i in known) / len(known))
    for i in texts:
        margin = sum(model.weights[k] for k in slots[i]) / max(len(slots[i]), 1) ** 0.5 + model.bias
        score = 1 / (1 + np.exp(-(model.slope * margin + model.shift)))
        assert abs(rows[i].score - score) < 1e-4 and rows[i].predicted == int(rows[i].score >= 0.7)


def runs(data):
    """Slots of repeated words and lines, by plain search."""
    low, out = data.lower(), set()
    for first, parts in ((Q.HASHED, low.split()), (Q.HASHED + Q.RUNS, [x for x in low.split(b"\n") if x.strip()])):
        for k in range(1, Q.RUNS + 1):
            if any(len(set(parts[i : i + 2**k])) == 1 for i in range(len(parts) - 2**k + 1)):
                out.add(first + k - 1)
    return out


def brute(data):
    whole = b" " + data + b" "
    grams = {whole[i : i + n] for n in Q.SIZES for i in range(len(whole) - n + 1)}
    slots = set()
    for g in grams:
        code = 0
        for b in g:
            code = (code * 257 + b + 1) % 2**32
        slots.add((code * 2654435761 % 2**32) >> 14)
    return slots


def test_features_equal_plain_search(monkeypatch):
    data = "Ünï code, THE the the\nx\nx\nx\nx " .encode() * 3
    want = brute(data)
    got = Q.features(data)
    assert set(got[got < Q.HASHED].tolist()) == want and len(set(got.tolist())) == len(got)
    assert [int(x) - Q.HASHED for x in got if x >= Q.HASHED] == [0, 1, Q.RUNS]
    monkeypatch.setattr(Q, "CHUNK", 7)
    assert set(Q.features(data)[Q.features(data) < Q.HASHED].tolist()) == want


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    plain = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(60)]
    y = np.array([1.0 if 3 in r or 5 in r else -1.0 for r in plain])
    rows = Q.Rows.of([r.astype("<u4").tobytes() for r in plain])
    ratio = np.zeros(Q.SLOTS)
    ratio[:30] = rng.normal(size=30) + 1
    cost = np.full(60, 0.7)
    w, b = Q.descend(rows, y, cost, ratio, epochs=3000)
    x = np.zeros((60, 31))
    for i, r in enumerate(plain):
        x[i, r] = ratio[r] / np.sqrt(8)
        x[i, 30] = 1
    v = np.append(np.divide(w[:30], ratio[:30]), b)
    loss = lambda v: 0.5 * v @ v + cost @ np.maximum(0, 1 - y * (x @ v))
    best = loss(v)
    assert all(best <= loss(v + d) + 1e-6 for d in rng.normal(scale=0.01, size=(300, 31)))


def test_odd_rows(spark):
    rows = [(i, f"good plain words number {i}", "x") for i in range(30)] + [(100 + i, f"BAD!! $$$ {i} ### bad bad bad bad", "x") for i in range(30)]
    rows += [(200, None, "x"), (201, "", "x"), (201, "", "x"), (None, "some words", "x"), (203, "word " * 200000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").selectExpr("*", "1 as quality", "2 as `a.b`")
    marks = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(5, 1), (None, 0), (7, None), (9, 3)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = Q.learn(docs, labels)
    scores = {r[0]: r[1] for r in docs.select("doc_id", Q.score_column(Q.F.col("text"), model)).collect()}
    assert min(scores[i] for i in range(30)) > max(scores[100 + i] for i in range(30))
    assert scores[200] == scores[201] and all(0 <= s <= 1 for s in scores.values())
    assert Q.learn(docs, labels.where("quality = 1")).score(3.0) == 0.5
    assert Q.learn(docs.limit(0), labels).score(3.0) == 0.5
    assert docs.limit(0).select(Q.score_column(Q.F.col("text"), model)).count() == 0


def test_repeated_ids_are_one_row(spark):
    """One labelled id on very many rows is one row to learn from: the text with the smallest digest. No row comes to the driver."""
    from hashlib import md5

    many = spark.range(20_000).selectExpr("1L as doc_id", "concat('good text number ', id % 500) as text")
    docs = many.unionByName(spark.createDataFrame([(2, "bad bad bad"), (3, None), (3, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    first = min((f"good text number {k}" for k in range(500)), key=lambda t: md5(t.encode()).hexdigest())
    third = min("", "other", key=lambda t: md5(t.encode()).hexdigest())
    rows = [Q.features(t.encode()) for t in (first, "bad bad bad", third)]
    want = Q.fit(Q.Rows.of(r.astype("<u4").tobytes() for r in rows), [1, 0, 1], prior=2 / 3)
    model = Q.learn(docs, labels)
    assert np.array_equal(model.weights, want.weights) and (model.bias, model.slope, model.shift) == (want.bias, want.slope, want.shift)
    few = Q.learn(docs, labels, most=10)  # two rows at least
    assert not np.array_equal(few.weights, want.weights) and 0 <= few.score(few.margin(Q.features(b"good text"))) <= 1
