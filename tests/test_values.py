"""Values of the queries that SQL can't say, against NumPy on the collected tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpweave import registry
from corpweave.operators import models as M
from corpweave.operators import ranges
from corpweave.operators import relational as R
from corpweave.operators.terms import greedy_terms
from corpweave.plans import models as P
from corpweave.plans.base import draw, segments


def q(name, spark, sf):
    return registry.queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def seg(spark, sf):
    rows = segments(spark, sf).orderBy("vec_id").collect()
    return {c: np.array([r[c] for r in rows]) for c in ("vec_id", "corpus", "family", "class_id", "v")} | {"doc": np.array([r.doc for r in rows])}


@pytest.fixture(scope="module")
def moved(spark, sf):
    rows = P.shifted(spark, sf).orderBy("vec_id").collect()
    return {c: np.array([r[c] for r in rows]) for c in ("vec_id", "corpus", "family", "class_id", "v")}


@pytest.fixture(scope="module")
def found(spark, sf):
    return P._projection(spark, sf)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_multinomial_model_is_the_optimum(spark, sf, seg):
    """The penalised loss has no slope at the stored model, and classes and probabilities are its own."""
    rows = M.featured(segments(spark, sf))
    model = M.logistic(rows, family="multinomial")
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    p = softmax(seg["v"] @ w.T + b)
    got = {r.vec_id: r for r in q("mlc_03_logistic", spark, sf)}
    k = np.round(p, 9).argmax(axis=1)
    assert [got[i].assigned for i in seg["vec_id"]] == k.tolist()
    assert np.allclose([got[i].top for i in seg["vec_id"]], p.max(axis=1), atol=1e-6)
    y, n = np.eye(len(b))[seg["class_id"]], len(p)
    slope = (p - y).T @ seg["v"] / n + w / (3.0 * n)
    assert np.abs(slope).max() < 1e-3 and np.abs((p - y).mean(axis=0)).max() < 1e-3


def test_grid_search_has_every_configuration_once_and_known_scores(spark, sf):
    rows = {r.config: r for r in q("mlc_04_grid", spark, sf)}
    assert set(rows) == {str(c) for c in P.GRID} and len(rows) == 16
    df = P.folded(M.featured(segments(spark, sf)), 3).cache()
    config, f1 = P.GRID[-1], []
    for k in range(3):
        s = M.scored(M.logistic(df.where(F.col("fold") != k), config["c"], config["iterations"]), df.where(F.col("fold") == k)).select("class_id", "assigned").collect()
        t, p = np.array([r.class_id for r in s]), np.array([r.assigned for r in s])
        each = []
        for c in range(10):
            tp = ((t == c) & (p == c)).sum()
            each.append(2 * tp / max((t == c).sum() + (p == c).sum(), 1))
        f1.append(np.mean(each))
    assert abs(rows[str(config)].mean - np.mean(f1)) < 1e-9 and abs(rows[str(config)].sd - np.std(f1)) < 1e-9


def test_grid_search_goes_on_from_its_log(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2), 1.0], i % 3) for i in range(30)], "vec_id long, class_id int, v array<double>, fold int")
    fitted = []

    def fit(train, p):
        fitted.append(p["c"])
        return M.logistic(train, p["c"], 3)

    at = str(tmp_path / "log")
    first = M.searched(spark, M.featured(rows), [{"c": 1.0}], [0, 1], fit, at).collect()
    both = M.searched(spark, M.featured(rows), [{"c": 1.0}, {"c": 2.0}], [0, 1], fit, at).collect()
    assert fitted == [1.0] * 3 + [2.0] * 3 and len(both) == 2 and first[0] in both


def test_perceptron_is_a_network_of_its_weights(spark, sf, seg):
    """What the query returns are the outputs of the network with the stored weights, after early stopping."""
    rows = P.folded(M.featured(segments(spark, sf)), 5).withColumn("held", F.col("fold") == 0).cache()
    model, rounds = M.stopped_perceptron(rows, [64, 16, 10], list(range(10)), "held")
    assert 1 <= rounds <= 40 and np.allclose(M.perceptron(rows, [64, 16, 10], 5 * rounds).weights.toArray(), model.weights.toArray())
    w = model.weights.toArray()
    a, b = w[: 64 * 16].reshape(16, 64, order="F"), w[64 * 16 : 64 * 16 + 16]
    c, d = w[64 * 16 + 16 : 64 * 16 + 16 + 160].reshape(10, 16, order="F"), w[-10:]
    p = softmax(1 / (1 + np.exp(-(seg["v"] @ a.T + b))) @ c.T + d)
    got = {r.vec_id: r for r in q("mlc_05_perceptron", spark, sf)}
    assert np.allclose([got[i].top for i in seg["vec_id"]], p.max(axis=1), atol=1e-6)
    assert [got[i].assigned for i in seg["vec_id"]] == p.argmax(axis=1).tolist()


def test_directions_separate_until_chance(spark, sf, moved, found):
    rows = q("mlc_08_directions", spark, sf)
    g = np.array([r.direction for r in sorted(rows, key=lambda r: r.k)])
    assert 1 <= len(g) < 200 and np.abs(g @ g.T - np.eye(len(g))).max() < 1e-9
    assert len(found.accuracy) in (len(g), len(g) + 1) and all(a > 0.5 for a in found.accuracy[: len(g)])
    assert len(found.accuracy) == len(g) or found.accuracy[-1] <= 0.5
    assert abs(g[0][0]) > 0.5, "the first one is the axis along which the corpora were moved apart"
    gap = lambda v: abs(v[moved["corpus"] == 1] @ g[0] - 0).mean() - abs(v[moved["corpus"] == 0] @ g[0]).mean()
    left = moved["v"] - (moved["v"] @ g.T) @ g
    assert abs(gap(left)) < 1e-9 < abs(gap(moved["v"]))


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_two_sample_area(spark, sf):
    row = q("mlc_09_two_sample", spark, sf)[0]
    df = M.featured(P.folded(segments(spark, sf), 3), label="corpus").cache()
    want = []
    for k in range(3):
        s = M.scored(M.logistic(df.where(F.col("fold") != k), iterations=30), df.where(F.col("fold") == k)).select("corpus", "scores").collect()
        want.append(auc(np.array([r.scores[1] for r in s]), np.array([r.corpus for r in s])))
    # the evaluator's curve has at most a thousand points
    assert abs(row.mean - np.mean(want)) < 5e-3 and abs(row.sd - np.std(want)) < 5e-3


def test_pooled_accuracy_interval_and_test(spark, sf, seg):
    row = q("mlc_10_pooled_accuracy", spark, sf)[0]
    assert row.n == len(seg["vec_id"]) and 0 <= row.k <= row.n
    p, z = row.k / row.n, 1.96
    mid, half = p + z * z / (2 * row.n), z * math.sqrt(p * (1 - p) / row.n + z * z / (4 * row.n**2))
    assert np.allclose([row.low, row.high], [(mid - half) / (1 + z * z / row.n), (mid + half) / (1 + z * z / row.n)])
    assert abs(row.p - sum(math.comb(row.n, i) for i in range(row.k, row.n + 1)) / 2**row.n) < 1e-9
    df = P.folded(M.featured(segments(spark, sf), label="corpus"), 3).cache()
    hits = 0
    for k in range(3):
        m = M.logistic(df.where(F.col("fold") != k), iterations=10)
        test = df.where(F.col("fold") == k).select("v", "corpus").collect()
        z = np.array([r.v for r in test]) @ m.coefficients.toArray() + m.intercept
        hits += int(((z > 0) == np.array([r.corpus for r in test])).sum())
    assert hits == row.k


def test_leave_one_class_out(spark, sf):
    rows = {r.class_id: r.accuracy for r in q("mlc_12_leave_one_out", spark, sf)}
    assert set(rows) == set(range(10))
    df = M.featured(segments(spark, sf), label="corpus").cache()
    m = M.logistic(df.where("class_id <> 4"), iterations=10)
    test = df.where("class_id = 4").select("v", "corpus").collect()
    z = np.array([r.v for r in test]) @ m.coefficients.toArray() + m.intercept
    assert abs(rows[4] - ((z > 0) == np.array([r.corpus for r in test])).mean()) < 1e-9


def test_principal_components(spark, sf, seg):
    sample = R.balanced(segments(spark, sf), ["corpus"], draw(42, "vec_id"), "vec_id").select("vec_id").collect()
    keep = np.isin(seg["vec_id"], [r.vec_id for r in sample])
    x = seg["v"][keep]
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = (seg["v"] - x.mean(axis=0)) @ vectors[:, ::-1][:, :2]
    got = {r.vec_id: r for r in q("vec_12_pca", spark, sf)}
    xy = np.array([[got[i].x, got[i].y] for i in seg["vec_id"]])
    assert np.allclose(np.abs(xy), np.abs(want), atol=1e-8) and abs(next(iter(got.values())).explained - values[-1] / values.sum()) < 1e-9


def test_subspace_is_aligned_with_itself(spark, sf, found):
    rows = q("vec_16_alignment", spark, sf)
    assert len(rows) == len(found.directions) and all(abs(r.cosine - 1) < 1e-9 and abs(r.alignment - 1) < 1e-9 for r in rows)
    a, b = np.eye(5)[:2], np.array([[math.cos(0.3), 0, math.sin(0.3), 0, 0], [0, 0, 0, 1.0, 0]])
    assert np.allclose(sorted(M.cosines(a, b)), [0, math.cos(0.3)]) and abs(M.alignment(a[0], b) - math.cos(0.3)) < 1e-12


def test_subspace_is_found_anew(spark, sf, monkeypatch):
    """A stored subspace that the rows do not give is told from theirs."""
    monkeypatch.setattr(P, "_projection", lambda spark, sf_dir: M.Projection(np.eye(64)[5:6], [0.9]))
    with pytest.raises(ArithmeticError, match="differ"):
        q("vec_16_alignment", spark, sf)
    with pytest.raises(ArithmeticError):
        M.parity(np.eye(3)[:2], np.eye(3)[:1])
    assert M.alignment(np.zeros(3), np.eye(3)[:2]) == 0


def test_span_calibration(spark, sf, moved, found):
    got = {r.basis: r for r in q("vec_19_span_calibration", spark, sf)}
    chance = np.linalg.qr(np.random.default_rng(42).normal(size=(64, len(found.directions))))[0].T
    for name, basis in (("span", found.directions), ("random", chance)):
        n = np.linalg.norm(moved["v"] @ basis.T, axis=1)
        r = got[name]
        assert np.allclose([r.most, r.p99, r.mean, r.median, r.expected], [n.max(), np.percentile(n, 99), n.mean(), np.median(n), math.sqrt(len(basis) / 64)], atol=1e-8)


def test_direction_probe(spark, sf, moved, found):
    for r in q("vec_20_direction_probe", spark, sf):
        own = moved["family"] == r.family
        assert r.n == own.sum() and abs(r["mean"] - (moved["v"][own] @ found.directions[r.k]).mean()) < 1e-9


def test_convergence_by_directions(spark, sf, found):
    rows = {r.k: r for r in q("gap_09_convergence", spark, sf)}
    assert set(rows) == set(range(len(found.directions) + 1)) and abs(rows[0].correlation - 1) < 1e-9
    gaps = [r.gap for r in q("gap_semantic", spark, sf) if r.gap is not None]
    assert abs(rows[0].mean_gap - np.mean(gaps)) < 1e-5 and all(0 <= r.mean_gap <= 2 for r in rows.values())


def test_specifications_equal_plain_regressions(spark, sf):
    cols = ["l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select(*cols).toPandas()
    rows = {r.spec: r for r in q("sta_15_specifications", spark, sf)}
    assert len(rows) == 14
    for spec in ("l_tax", "l_discount fe", "l_linenumber fe w", "l_tax w"):
        name, w = spec.split()[0], t.l_quantity.to_numpy(float) if spec.endswith(" w") else np.ones(len(t))
        x = np.column_stack([np.ones(len(t)), t[name].astype(float), *([(t.l_returnflag == f).astype(float) for f in "NR"] if "fe" in spec else [])])
        y, w = t.l_extendedprice.to_numpy(float), w * len(w) / w.sum()
        bread = np.linalg.inv(x.T @ (x * w[:, None]))
        beta = bread @ x.T @ (w * y)
        score = x * ((y - x @ beta) * w)[:, None]
        by = np.array([score[(t.l_suppkey == k).to_numpy()].sum(axis=0) for k in t.l_suppkey.unique()])
        error = np.sqrt(np.diag(bread @ by.T @ by @ bread) * len(by) / (len(by) - 1))
        assert abs(rows[spec].beta / beta[1] - 1) < 1e-6 and abs(rows[spec].error / error[1] - 1) < 1e-6 and rows[spec].n == len(t)


def test_register_score_is_the_first_component(spark, sf):
    from corpweave.functions.text import linguistic_rates

    names = ["hedge_rate", "deontic_rate", "passive_proxy_rate", "first_person_rate", "nominal_rate", "mean_sentence_length"]
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", linguistic_rates(F.col("text")).alias("r")).select("doc_id", *(f"r.{n}" for n in names)).collect()
    x = np.array([[r[n] or 0.0 for n in names] for r in rows])
    sd = x.std(axis=0)
    z = np.divide(x - x.mean(axis=0), sd, out=np.zeros_like(x), where=sd > 0)
    w = np.linalg.eigh(z.T @ z / len(z))[1][:, -1]
    score = z @ w
    score = score if score @ z[:, -1] >= 0 else -score
    got = {r.doc_id: r.score for r in q("sta_16_register_score", spark, sf)}
    assert np.allclose([got[r.doc_id] for r in rows], score, atol=1e-8)


def test_subspace_angles_and_shares(spark, sf, seg):
    from corpweave.operators.distances import gaussian_w2

    rows = {r.class_id: r for r in q("dis_04_grassmann", spark, sf)}
    terms = {r.class_id: r for r in q("dis_03_gaussian_w2", spark, sf)}
    for k, r in rows.items():
        bases, shares, parts = [], [], []
        for c in (0, 1):
            x = seg["v"][(seg["class_id"] == k) & (seg["corpus"] == c)]
            values, vectors = np.linalg.eigh(np.cov(x.T))
            parts.append((x.mean(axis=0), np.cov(x.T)))
            bases.append(vectors[:, -10:])
            shares.append(values[-10:].sum() / values.clip(0).sum())
        cos = np.clip(np.linalg.svd(bases[0].T @ bases[1], compute_uv=False), -1, 1)
        angles = np.arccos(cos)
        want = [math.sqrt((angles**2).sum()), np.degrees(angles.mean()), np.degrees(angles.max()), *shares]
        assert np.allclose([r.distance, r.mean_angle, r.largest_angle, r.explained_0, r.explained_1], want, atol=1e-5)
        assert np.allclose([terms[k].mean_term, terms[k].cov_term], gaussian_w2(*parts[0], *parts[1]), atol=1e-6)


def test_assignment_on_sides_of_one_size(spark, sf, seg):
    """On samples of equal sizes the cost is no less than the mean nearest gap of either side, and zero for a cloud and itself."""
    near = {r.class_id: r for r in q("dis_02_chamfer_hausdorff", spark, sf)}
    for r in q("dis_06_emd_sinkhorn", spark, sf):
        sizes = [((seg["class_id"] == r.class_id) & (seg["corpus"] == c)).sum() for c in (0, 1)]
        assert 0 <= r.emd <= 2 and r.sinkhorn >= 0
        if sizes[0] == sizes[1]:
            assert r.emd >= max(near[r.class_id].forward, near[r.class_id].back) - 1e-6


def test_permutation_of_a_table_of_classes(spark, sf):
    rows = {r.kind: r for r in q("sta_03_permutation", spark, sf)}
    c = spark.read.parquet(f"{sf}/customer.parquet").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("y"))
    t = c.join(s, c.c_nationkey == s.s_nationkey).toPandas()
    for kind, method in (("pearson", "pearson"), ("spearman", "spearman")):
        x, y = (t.x, t.y) if method == "pearson" else (t.x.rank(), t.y.rank())
        r = np.corrcoef(x, y)[0, 1]
        rng = np.random.default_rng(5)
        chance = np.array([np.corrcoef(x, rng.permutation(y))[0, 1] for _ in range(4000)])
        assert abs(rows[kind].r - r) < 1e-9 and abs(rows[kind].p - (np.abs(chance) >= abs(r)).mean()) < 0.04


def test_status_checksums_segments_and_stream(spark, sf):
    import glob
    import hashlib
    import os

    status = q("snk_06_status", spark, sf)[0]
    assert (status.stage, status.state, status.counters) == ("documents", "completed", {"rows": spark.read.parquet(f"{sf}/documents.parquet").count()})
    files = [f for f in (glob.glob(f"{sf}/benchmark.parquet/*.parquet") or [f"{sf}/benchmark.parquet"])]
    want = {os.path.basename(f): (os.path.getsize(f), hashlib.sha256(open(f, "rb").read()).hexdigest()) for f in files}
    assert {r.file: (r.bytes, r.sha256) for r in q("snk_08_checksums", spark, sf)} == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = {}
    for r in q("mlc_01_segments", spark, sf):
        words[r.doc_id] = words.get(r.doc_id, 0) + r.word_count
    assert all(n <= len(texts[i].split()) for i, n in words.items()) and sum(words.values()) > 0.5 * sum(len(t.split()) for t in texts.values())
    whole = {(r.start, r.event_type): r.n for r in q("str_08_windowed_counts", spark, sf)}
    stream = {(r.start, r.event_type): r.n for r in q("str_08_windowed_stream", spark, sf)}
    last = max(s for s, _ in whole)
    assert stream.items() <= whole.items() and {k for k in whole if k[0] < last} <= set(stream)


def test_greedy_terms_go_on_behind_the_first_round(spark):
    rows = [("g", f"aa{i}", float(1000 - i)) for i in range(200)] + [("g", "aa", 2000.0), ("g", "bb", 3.0), ("g", "cc", 2.0), ("g", "b", 1.0), ("g", "no", 0.0), ("h", "x", 1.0), (None, "y", 1.0)]
    df = spark.createDataFrame(rows, "k string, term string, score double")
    got = {}
    for r in sorted(greedy_terms(df, "k", 3, depth=2).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.k, []).append(r.term)
    assert got == {"g": ["aa", "bb", "cc"], "h": ["x"], None: ["y"]}
    assert greedy_terms(df.limit(0), "k", 3).count() == 0


def test_terms_of_the_table(spark, sf):
    import re
    from collections import Counter

    counts = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect():
        counts.setdefault(r.lang, Counter()).update(re.findall("[a-z]{3,}", (r.text or "").lower()))
    got = {}
    for r in sorted(q("srt_04_greedy_terms", spark, sf), key=lambda r: r["rank"]):
        got.setdefault(r.lang, []).append(r.term)
    for lang, c in counts.items():
        done = []
        for t, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])):
            if len(done) < 10 and not any(t in d or d in t for d in done):
                done.append(t)
        assert got[lang] == done


def test_ranges_equal_one_window(spark):
    """Ranks by ranges, first rows by buckets and running sums, where one group has most rows, against plain loops."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 10 else f"g{i % 7}", int(rng.integers(0, 400)), i) for i in range(3000)] + [(None, 1, 3000)]
    df = spark.createDataFrame(rows, "g string, x int, id long").repartition(6)
    one, many = ({r.id: r.rank for r in R.average_rank(df, "x", "rank", ["g"], most).collect()} for most in (10**6, 0))
    assert one == many and len(one) == 3000
    values = np.array([r[1] for r in rows if r[0] == "hot"])
    assert all(one[i] == (values < x).sum() + ((values == x).sum() + 1) / 2 for g, x, i in rows if g == "hot")
    counts = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    for r in ranges.running(counts, ["g"], "x", ["n"], "next").collect():
        own = sorted(x for g, x, _ in rows if g == r.g)
        assert r.n_before == sum(x < r.x for x in own) and r.next == min((x for x in own if x > r.x), default=None)
    got = ranges.among_first(df, ["g"], draw(1, "id"), "id", F.ceil(F.col("n") * 0.3), "first").collect()
    assert len(got) == 3001
    from hashlib import md5

    for g in {r[0] for r in rows}:
        own = sorted((md5(f"1:{i}".encode()).hexdigest(), i) for h, _, i in rows if h == g)
        assert {r.id for r in got if r.g == g and r.first} == {i for _, i in own[: math.ceil(0.3 * len(own))]}


def test_block_pairs_in_cells_and_middle_distances(spark):
    from corpweave.operators import distances as D

    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3))
    rows = [(i, int(i % 2), 0 if i % 9 else 1, v.tolist()) for i, v in enumerate(x)]
    s = spark.createDataFrame(rows, "vec_id long, corpus int, class_id int, v array<double>")
    a, b = s.where("corpus = 0"), s.where("corpus = 1")
    pairs = D.paired(a, b, "class_id", size=5, cell=2).collect()
    assert sorted((i, j) for r in pairs for i in r.ids for j in r.others) == sorted((r[0], t[0]) for r in rows for t in rows if r[1] == 0 and t[1] == 1 and r[2] == t[2])
    for r in D.middle_distances(a, b, "class_id", 3, bins=64, passes=5, size=5).collect():
        far = sorted(np.linalg.norm(np.array(p[3]) - np.array(t[3])) for p in rows for t in rows if p[1] == 0 and t[1] == 1 and p[2] == t[2] == r.class_id)
        assert abs(r.low - far[(len(far) - 1) // 2]) < 1e-6 and abs(r.high - far[len(far) // 2]) < 1e-6


def test_addresses_are_found_in_linear_time(spark):
    import time

    from corpweave.functions import text as X

    texts = ["mail a@b.c now", "@x.y", "a@b", "x@y.z@q", "a@@b.c,", "p@q. r", "a@b.c@d.e tail", "a.b@c", "@@a.b c@d.e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    plain = r"\S+@\S+\.\S+"
    got = [r[0] for r in df.select(F.regexp_replace("t", X.LINEAR[plain], "#")).collect()]
    assert got == [r[0] for r in df.select(F.regexp_replace("t", plain, "#")).collect()]
    seconds = []
    for n in (500_000, 1_000_000):
        hostile = spark.createDataFrame([("x" * n,), ("a@" * (n // 2),), ("@" * n,), ("a.b" * (n // 3),)], "t string").repartition(4).cache()
        hostile.count()
        began = time.time()
        hostile.select(F.md5(X.boilerplate_removed(F.col("t")))).collect()
        seconds.append(time.time() - began)
    assert seconds[1] < 4 * seconds[0] + 3, seconds


def test_steps_run_once_after_what_they_need():
    from corpweave.plans.sources import ran

    order = []
    step = lambda name: lambda spark, sf_dir, done: order.append(name) or name
    steps = {"a": (("b", "c"), step("a")), "b": (("c",), step("b")), "c": ((), step("c")), "d": (("e",), step("d")), "e": (("d",), step("e"))}
    assert list(ran(None, "", ["a", "b"], steps)) == order == ["c", "b", "a"]
    for wrong in ("d", "nothing"):
        with pytest.raises(ValueError):
            ran(None, "", [wrong], steps)


def test_vectors_of_a_step_are_made_once(spark, sf, monkeypatch):
    seen, counts, without = [], spark.sparkContext.accumulator(0), M.V.without

    def counted(v, basis):
        seen.append(len(basis))
        one = F.udf(lambda x: counts.add(1) or x, "array<double>")
        return without(one(v), basis)

    monkeypatch.setattr(M.V, "without", counted)
    rows = spark.createDataFrame([(i, i % 2, f"{i % 2}_{i // 8}", 0, [float(i % 2) + (i % 7) / 9, (i % 5) / 9, (i % 3) / 9]) for i in range(400)], "vec_id long, corpus int, doc string, class_id int, v array<double>")
    M.separating_directions(rows, lambda seed, key: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), most=2)
    assert seen and counts.value == 400 * len(seen)
