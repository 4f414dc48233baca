import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpweave.functions import stats as S
from corpweave.functions import text as X
from corpweave.functions import vectors as V
from corpweave.operators import distances as D
from corpweave.operators import gaps as G
from corpweave.operators import models as M
from corpweave.operators import ranges
from corpweave.operators import regression as Reg
from corpweave.operators import relational as R
from corpweave.operators import segmentation
from corpweave.operators.terms import greedy_terms
from corpweave.plans.base import draw, segments


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, corpus long, doc string, class_id int, v array<double>")


def test_text_edges(spark):
    rows = [(None,), ("",), (" \n\t",), ("a  b",), ("x\nx\n\n\nx\n x ",), ("one " * 25,)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    t = F.col("t")
    assert [r[0] for r in df.select(X.word_count(t)).collect()] == [0, 0, 0, 2, 4, 25]
    assert [r[0] for r in df.select(X.lines_deduplicated(t)).collect()][3:5] == ["a  b", "x\n\n\nx"]
    assert [r[0] for r in df.select(X.boilerplate_removed(t)).collect()][:4] == [None, "", "", "a b"]
    assert [r[0] for r in df.select(F.size(X.paragraphs(t))).collect()][-1] == 1
    assert [r[0] for r in df.select(X.normalised(F.lit("ﬁ “x” – ½"))).collect()][0] == 'fi "x" - 1⁄2'
    assert df.where(t.isNull() | (t == "")).select(X.snippet(t), X.usable(t), X.lexical_category(t), X.linguistic_rates(t), X.document_cleaned(t)).count() == 2


def test_topics(spark):
    df = spark.createDataFrame([("the SDGs now",), ("SDG 4",), ("SDG4",), ("SDG13",), ("net-zero",), ("nothing",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(X.on_topic(F.col("t"))).collect()] == [True, True, True, False, True, False]


def test_vector_edges(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, 0.0],)], "v array<double>").coalesce(1)
    g = np.array([[1.0, 0.0]])
    assert [r[0] for r in df.select(V.unit(F.col("v"))).collect()] == [[0.6, 0.8], None, None, [1.0, 0.0]]
    once, twice = V.without(F.col("v"), g), V.without(V.without(F.col("v"), g), g)
    assert [r[0] for r in df.select(once).collect()] == [[0.0, 1.0], None, None, None] == [r[0] for r in df.select(twice).collect()]
    assert [r[0] for r in df.select(V.products(F.col("v"), np.array([[1.0, 1.0], [0.0, 2.0]]))).collect()] == [[7.0, 8.0], [0.0, 0.0], None, [1.0, 0.0]]
    assert df.select(V.best(F.array(F.lit(0.5), F.lit(0.5 + 1e-12), F.lit(0.1)))).first()[0] == 0
    rng = np.random.default_rng(1)
    q = V.orthonormal(np.vstack([rng.normal(size=(4, 6)), np.zeros((1, 6))]))
    assert q.shape == (4, 6) and np.abs(q @ q.T - np.eye(4)).max() < 1e-12
    assert np.allclose(M.cosines(q, V.orthonormal(q[::-1])), 1) and abs(M.alignment(q[0], q) - 1) < 1e-12


def test_gap_edges(spark):
    rows = [(i, 0, f"r{i // 2}", 0, [1.0, 0.0]) for i in range(24)] + [(100 + i, 1, "p", 0, [1.0, 0.0]) for i in range(60)] + [(200, 1, "q", 1, [0.0, 1.0])]
    s = vectors(spark, rows)
    classes = G.Classes([0, 1, 2], np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]))
    a = G.assigned(s, classes)
    docs = G.documents(a, "corpus", classes=classes)
    got = {r.class_id: r for r in G.semantic_gap(docs.where("corpus = 0"), a.where("corpus = 1"), classes.ids, draw(42, "vec_id")).collect()}
    assert abs(got[0].gap) < 1e-12 and not got[0].unreliable and (got[0].n_research, got[0].n_segments, got[0].n_capped, got[0].n_docs) == (12, 60, 50, 1)
    assert got[1].gap is None and got[1].reason == "empty" and got[2].gap is None and got[2].n_segments == 0
    shares = G.profile(docs, classes.ids, "corpus")
    assert {(r.corpus, r.class_id): r.share for r in shares.collect()} == {(0, 0): 1, (0, 1): 0, (0, 2): 0, (1, 0): 0.5, (1, 1): 0.5, (1, 2): 0}
    assert {r.class_id: r.gap for r in G.coverage_gap(shares).collect()} == {0: 0.5, 1: 0.5, 2: 0}


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string")
    with pytest.raises(Exception, match="no match for k b"):
        R.join_or_fail(df, spark.createDataFrame([("a", 1)], "k string, n int"), "k", "n").collect()
    assert R.capped(df, ["k"], 5, F.md5(F.col("id").cast("string")), "id").count() == 3
    one = R.sampled(df, 2, draw(1, "id"), "id").collect()
    assert one == R.sampled(df.repartition(7), 2, draw(1, "id"), "id").collect()
    assert R.class_shares(df.limit(0).withColumn("c", F.lit(1)), "c", range(3)).select("n").collect() == [(0,), (0,), (0,)]
    split = R.grouped_split(df.withColumn("c", F.lit(1)), "k", [], "c", "id", draw(1, "k"), 0.5).collect()
    assert len({(r.k, r.test) for r in split}) == 2


def test_ranges(spark):
    df = spark.range(5000).selectExpr("id", "pmod(xxhash64(id), 900) as x")
    got = ranges.global_index(df.repartition(9), ["x", "id"], "at").collect()
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.x, r.id)))}
    assert {r.id: r["at"] for r in got} == want
    counts = spark.createDataFrame([(k, k % 4) for k in range(50)], "k long, n long")
    bins = ranges.running_offsets(counts, "k", "n")
    rows = spark.range(int(sum(k % 4 for k in range(50)))).withColumnRenamed("id", "at")
    assert [r.k for r in ranges.bin_lookup(rows, "at", bins, "lo", "hi", width=4).orderBy("at").collect()] == [k for k in range(50) for _ in range(k % 4)]


def test_greedy_terms(spark):
    df = spark.createDataFrame([("g", t, s) for t, s in (("climate", 9.0), ("climate change", 8.0), ("mate", 7.0), ("water", 6.0), ("zero", 0.0))], "g string, term string, score double")
    assert [r.term for r in greedy_terms(df, "g", 10).orderBy("rank").collect()] == ["climate", "water"]


def test_segmentation(spark):
    text = " ".join(f"Sentence {i} has some six words." for i in range(40)) + " " + "word " * 500 + ". Short."
    got = segmentation.segmented(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "too short.")], "doc_id long, text string"), budget=60).collect()
    assert {r.doc_id for r in got} == {1} and [r.segment_index for r in got] == list(range(len(got))) and max(r.word_count for r in got) >= 500
    packed = [r for r in got if r.word_count < 400]
    assert all(r.word_count <= 48 and r.text.endswith(".") for r in packed)


def test_solvers():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (4, 4), (3, 5)):
        cost = rng.random((n, m))
        got = cost[np.arange(n), D.hungarian(cost)].sum()
        assert abs(got - min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))) < 1e-12
    a = rng.normal(size=(30, 4))
    a /= np.linalg.norm(a, axis=1)[:, None]
    assert D.sinkhorn(a, a) < 1e-6 < D.sinkhorn(a, -a)
    cov = np.cov(a.T)
    assert D.gaussian_w2(a.mean(0), cov, a.mean(0), cov)[1] < 1e-8 and D.grassmann(cov, cov, 2)[0] < 1e-6
    assert np.allclose(D.root(cov) @ D.root(cov), cov)


def test_distances_of_equal_clouds(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = vectors(spark, [(100 * c + i, c, f"d{i}", 0, x.tolist()) for c in (0, 1) for i, x in enumerate(v)])
    assert max(r.gap for r in D.nearest(s.where("corpus = 0"), s.where("corpus = 1"), "class_id", 5, size=7).collect()) < 1e-9
    assert D.sliced(s, "class_id", np.eye(5)).first()["mean"] < 1e-12
    sums = D.pair_sums(s.where("corpus = 0"), s.where("corpus = 1"), "class_id", 5, lambda x: x, size=7).first()
    assert sums.pairs == 1600 and abs(sums.total - np.linalg.norm(v[:, None] - v[None], axis=2).sum()) < 1e-6
    m = D.moments(s, "class_id", d=5).first()
    assert np.allclose(np.array(m["cov"]).reshape(5, 5), np.cov(np.vstack([v, v]).T)) and np.allclose(m["mean"], v.mean(0))
    solved = D.solved(s, "class_id", 5).first()
    assert solved.emd < 1e-9 and solved.sinkhorn < 1e-6


def test_statistics(spark):
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([2.0, 1, 4, 3, 5])
    r, p = S.permutation_p(x, y, 20_000, rank=True)
    exact = np.mean([abs(np.corrcoef(x, q)[0, 1]) >= abs(r) - 1e-12 for q in itertools.permutations(y)])
    assert abs(r - 0.8) < 1e-12 and abs(p - exact) < 0.02
    assert S.ranks(np.array([3.0, 1, 3])).tolist() == [2.5, 1, 2.5]
    assert abs(S.binomial_tail(8, 10) - 56 / 1024) < 1e-12 and S.binomial_tail(0, 5) == 1
    assert abs(S.student_tail(2.228138852, 10) - 0.05) < 1e-8 and abs(S.student_tail(0, 3) - 1) < 1e-12
    with pytest.raises(ValueError):
        S.permutation_p(x[:2], y[:2])
    e = spark.range(1).select(*S.wilson_low_high(F.lit(0), F.lit(0)), *S.fisher_low_high(F.lit(0.5), F.lit(3)))
    assert all(v is None for v in e.first())


def test_regression(spark):
    rng = np.random.default_rng(5)
    g = np.repeat(np.arange(12), 10)
    x, w = rng.normal(size=(120, 2)), rng.random(120) + 0.5
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=12)[g] + rng.normal(size=120)
    df = spark.createDataFrame([(float(a), *map(float, b), int(c), float(d)) for a, b, c, d in zip(y, x, g, w)], "y double, a double, b double, g int, w double")
    for weight in (None, "w"):
        ww = np.ones(120) if weight is None else w / w.mean()
        m = np.column_stack([np.ones(120), x])
        inv = np.linalg.inv(m.T @ (m * ww[:, None]))
        beta = inv @ m.T @ (ww * y)
        e = ww * (y - m @ beta)
        s = np.array([(m[g == k] * e[g == k][:, None]).sum(0) for k in range(12)])
        error = np.sqrt(np.diag(inv @ (s.T @ s) @ inv * 12 / 11))
        fit = Reg.least_squares(df, "y", ["a", "b"], "g", weight)
        assert np.allclose(fit.beta, beta) and np.allclose(fit.error, error) and fit.clusters == 12
    assert 0 < fit.r2 < 1 and Reg.varied(df.withColumn("one", F.lit(1.0)), ["one", "a"]) == ["a"]


def test_separating_directions(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 6)) * 0.3
    v[:, 0] += np.where(np.arange(400) % 2 == 0, 1.0, -1.0)
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = vectors(spark, [(i, i % 2, f"d{i}", i // 2 % 2, x.tolist()) for i, x in enumerate(v)])
    p = M.separating_directions(s, draw, most=3, iterations=20)
    assert p.accuracy[0] > 0.95 and abs(p.directions[0][0]) > 0.9 and np.abs(p.directions @ p.directions.T - np.eye(len(p.directions))).max() < 1e-9
    again = M.separating_directions(s, draw, most=len(p.directions), start=p)
    assert np.array_equal(again.directions, p.directions)


def test_directions_by_null_spaces(spark):
    """The other method finds the span of the first one; it has no step of Gram-Schmidt."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 6)) * 0.3
    v[:, 0] += np.where(np.arange(400) % 2 == 0, 1.0, -1.0)
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = vectors(spark, [(i, i % 2, f"d{i}", i // 2 % 2, x.tolist()) for i, x in enumerate(v)])
    p = M.separating_directions(s, draw, most=3, stop=0.0, iterations=20)
    other = M.nullspace_directions(s, draw, 3, iterations=20)
    assert len(p.directions) == 3 and np.abs(other @ other.T - np.eye(3)).max() < 1e-9 and np.allclose(M.parity(p.directions, other), 1, atol=1e-9)


def test_stored_directions(spark, tmp_path):
    p = M.Projection(np.eye(3)[:2], [0.9, 0.6])
    M.stored(spark, p, str(tmp_path / "g"))
    q = M.loaded(spark, str(tmp_path / "g"), 2)
    assert np.array_equal(p.directions, q.directions) and q.accuracy == p.accuracy
    with pytest.raises(ValueError):
        M.loaded(spark, str(tmp_path / "g"), 3)


def test_gap_bounds(spark, sf):
    from corpweave.plans.gaps import Base

    b = Base(spark, sf)
    assert all(0 <= r.gap <= 2 for r in b.gap().collect() if r.gap is not None)
    shares = G.profile(b.documents(), b.ids, "corpus").groupBy("corpus").agg(F.sum("share").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in shares) and segments(spark, sf).count() == 500


def test_blocks_go_to_a_bounded_number_of_cells(spark):
    rows = spark.range(600).select(F.lit(0).alias("g"), F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("v"))
    for side, ids in zip(D.celled(rows, rows, "g", size=2, cell=1), ("ids", "others")):
        copies = side.groupBy(ids).count()
        assert copies.agg(F.max("count")).first()[0] <= D.SIDE and copies.agg(F.sum(F.size(ids))).first()[0] == 600


def test_most_similar_sends_some_for_each_cell(spark):
    v = np.round(np.random.default_rng(3).normal(size=(300, 4)), 1)  # many ties
    v[7] = np.nan
    rows = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "g int, vec_id long, v array<double>")
    for held in (64, 0):
        found = D.most_similar(rows, rows, "g", 4, 5, size=10, cell=30, held=held).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r.q, -r.s, r.i)):
            got.setdefault(r.q, []).append((r.i, r.s))
        s = np.round(v @ v.T, 9)
        for q in set(range(300)) - {7}:
            want = sorted(((-s[q, i], i) for i in range(300) if i not in (q, 7)))[:5]
            assert [(i, -x) for i, x in got[q][:5]] == [(i, x) for x, i in want]
        assert 7 not in got and (held == 0 or len(found) == 5 * 299)
