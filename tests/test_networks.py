"""Networks, logistic models and searches against plain NumPy, and the log that they go on from."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpweave import registry
from corpweave.operators import models as M
from corpweave.operators import networks as N
from corpweave.operators import search as S
from corpweave.streaming.log import RecordLog


def data(n=520, d=3, classes=3, seed=1):
    """Rows (key, v, labels, fold, inner) with one or two labels that a network can learn."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    score = v @ rng.normal(size=(d, classes))
    return [(i, v[i].tolist(), [int(k) for k in np.flatnonzero(score[i] >= score[i].max() - 0.3)], i % 3, i % 10 == 0) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, v array<double>, labels array<int>, fold int, inner boolean").repartition(4)


def plain_gradient(net, x, y, keys, step):
    """One block's gradient, with the normalisation's Jacobian written out for every unit."""
    s, p, n = net.setting, net.parts(), len(x)
    inputs, states = [], []
    for k in range(s.layers):
        w, b, scale, shift = p[4 * k : 4 * k + 4]
        z = x @ w + b
        root = np.sqrt(((z - z.mean(0)) ** 2).mean(0) + 1e-5)
        hat = (z - z.mean(0)) / root
        keep = N.kept(keys, step, k, s.hidden, s.dropout) / (1 - s.dropout)
        inputs.append(x)
        states.append((z, hat, root, keep, hat * scale + shift))
        x = np.where(hat * scale + shift > 0, hat * scale + shift, 0) * keep
    prob = 1 / (1 + np.exp(-(x @ p[-2] + p[-1])))
    d = (prob - y) / y.size
    loss = -(y * np.log(prob) + (1 - y) * np.log(1 - prob)).mean()
    out = [x.T @ d, d.sum(0)]
    d = d @ p[-2].T
    for k in reversed(range(s.layers)):
        _, hat, root, keep, a = states[k]
        d = d * keep * (a > 0)
        grads = [(d * hat).sum(0), d.sum(0)]
        dz = np.empty_like(d)
        for u in range(d.shape[1]):
            j = (np.eye(n) - 1 / n - np.outer(hat[:, u], hat[:, u]) / n) / root[u]
            dz[:, u] = j.T @ (d[:, u] * p[4 * k + 2][u])
        out = [inputs[k].T @ dz, dz.sum(0), *grads, *out]
        d = dz @ p[4 * k].T
    stats = np.array([[z.mean(0) for z, *_ in states], [z.var(0, ddof=1) for z, *_ in states]])
    return loss, np.concatenate([g.ravel() for g in out]), stats.ravel()


def plain_training(blocks, s, d, classes, epochs, per_step, inner):
    """The same training in one process: blocks by number, steps by the same hash, AdamW written out."""
    net = N.Network.fresh(s, d, classes, 42)
    m = v = np.zeros_like(net.weights)
    t, steps, history = 0, max(1, -(-len(blocks) // per_step)), []
    for epoch in range(epochs):
        for step in range(steps):
            g, stats, n = 0, 0, 0
            for number, (keys, x, y, fold, held) in sorted(blocks.items()):
                rows = (fold != s.fold) & ~(held & inner)
                if N._step(epoch, number, steps) == step and rows.any():
                    _, gb, sb = plain_gradient(net, x[rows], y[rows], keys[rows], epoch * steps + step)
                    g, stats, n = g + gb * rows.sum(), stats + sb * rows.sum(), n + rows.sum()
            if not n:
                continue
            g, t = g / n, t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            net.weights = net.weights - s.lr * s.weight_decay * net.weights - s.lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            net.running = 0.9 * net.running + 0.1 * stats / n
        right = wrong = true = 0
        for keys, x, y, fold, held in blocks.values():
            rows = (fold != s.fold) & held
            top = np.eye(classes)[net.logits(x[rows]).argmax(1)]
            right, wrong, true = right + (top * y[rows]).sum(0), wrong + (top * (1 - y[rows])).sum(0), true + y[rows].sum(0)
        history.append(float((2 * right / np.maximum(right + wrong + true, 1)).mean()))
    return net, history


def local(blocks, classes):
    return {r.block: (np.array(r["keys"]), np.array(r.x).reshape(len(r["keys"]), -1), np.array(r.y).reshape(-1, classes), np.array(r.folds), np.array(r.inner)) for r in blocks.collect()}


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    for layers in (1, 3):
        net = N.Network.fresh(N.Setting(layers, 4, dropout=0.25), 3, 2, 5)
        x, y, keys = rng.normal(size=(9, 3)), (rng.random((9, 2)) < 0.5).astype(float), np.arange(9)
        _, g, _ = net.gradient(x, y, keys, 7)
        w = net.weights.copy()
        for i in range(len(w)):
            e = np.zeros_like(w)
            e[i] = 1e-5
            two = []
            for net.weights in (w + e, w - e):
                two.append(net.gradient(x, y, keys, 7)[0])
            assert abs((two[0] - two[1]) / 2e-5 - g[i]) < 1e-6
        net.weights = w
        assert np.allclose(plain_gradient(net, x, y, keys, 7)[1], g, atol=1e-12)


def test_training_equals_a_plain_run(spark, monkeypatch):
    rows = data()
    blocks, n = N.packed(frame(spark, rows), 3, fold="fold", inner="inner", size=64)
    own = local(blocks, 3)
    assert n == 9 and sum(len(b[0]) for b in own.values()) == len(rows)
    settings = [N.Setting(2, 5, 1e-2, 0.01, 0.3), N.Setting(1, 4, 3e-3, 0.0, 0.0, fold=1)]
    for per_step, small in ((1, 1 << 20), (4, 0)):
        monkeypatch.setattr(N, "SMALL", small)
        got = N.trained(blocks, n, settings, 3, 3, epochs=3, patience=None, per_step=per_step)
        for f, s in zip(got, settings):
            want, _ = plain_training(own, s, 3, 3, 3, per_step, inner=False)
            assert np.allclose(f.network.weights, want.weights, atol=1e-9) and np.allclose(f.network.running, want.running, atol=1e-9)
    stopped = N.trained(blocks, n, settings, 3, 3, epochs=4, patience=2)
    for f, s in zip(stopped, settings):
        _, history = plain_training(own, s, 3, 3, len(f.history), 1, inner=True)
        assert np.allclose(f.history, history) and f.held == max(history) and f.epochs == history.index(max(history)) + 1
        want, _ = plain_training(own, s, 3, 3, f.epochs, 1, inner=True)
        assert np.allclose(f.network.weights, want.weights, atol=1e-9)


def test_dropout_does_not_depend_on_the_block():
    a = N.kept(np.arange(1000), 3, 1, 40, 0.3)
    assert (N.kept(np.arange(500, 1000), 3, 1, 40, 0.3) == a[500:]).all() and abs(a.mean() - 0.7) < 0.01
    assert abs(np.corrcoef(a[:, 0], N.kept(np.arange(1000), 4, 1, 40, 0.3)[:, 0])[0, 1]) < 0.1


def test_several_labels_are_learned(spark):
    found = N.refitted(frame(spark, data(900)), N.Setting(2, 16, 2e-2, 0.0, 0.1), 3, 3, most=10, inner="inner")
    assert found.held > 0.75
    rows = frame(spark, data(900)).select("labels", N.probabilities(F.col("v"), found.network).alias("p")).collect()
    every = [(set(r.labels), {k for k, x in enumerate(r.p) if x >= 0.5}) for r in rows]
    assert sum(a == b for a, b in every) > 0.7 * len(every) and any(len(a) > 1 and a == b for a, b in every)


def test_rows_without_vector_or_labels(spark):
    rows = [(1, None, [0], 0, False), (2, [1.0], None, 0, False), (3, [1.0], [0, 1], 0, False), (4, [2.0], [], 1, True)]
    blocks, n = N.packed(frame(spark, rows), 2, fold="fold", inner="inner")
    assert n == 1 and [sorted(r["keys"]) for r in blocks.collect()] == [[3, 4]]
    got = N.trained(blocks, n, [N.Setting(1, 2, fold=0), N.Setting(1, 2)], 1, 2, epochs=2)
    assert all(np.isfinite(f.network.weights).all() for f in got)
    none, n = N.packed(frame(spark, rows).where("false"), 2)
    assert N.trained(none, n, [N.Setting(1, 2)], 1, 2, epochs=1)[0].held <= 0
    p = frame(spark, rows).select("vec_id", N.probabilities(F.col("v"), got[1].network).alias("p")).collect()
    assert {r.vec_id for r in p if r.p is None} == {1}


def test_logistic_models_are_optima(spark):
    rows = [(i, v, labels[:1], fold, inner) for i, v, labels, fold, inner in data(400)]
    blocks, _ = N.packed(frame(spark, rows), 3, fold="fold", size=100)
    settings = [N.Logistic(c, b, f) for c in (0.1, 30.0) for b in (False, True) for f in (-1, 2)]
    found = N.logistic_models(blocks, settings, 3, 3, tolerance=1e-6)
    for s, w in zip(settings, found):
        mine = [r for r in rows if r[3] != s.fold]
        x, y = np.array([[*r[1], 1.0] for r in mine]), np.array([r[2][0] for r in mine])
        n = np.bincount(y, minlength=3)
        share = (len(y) / (3 * n))[y] if s.balanced else np.ones(len(y))
        p = np.exp(x @ w)
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ ((p - np.eye(3)[y]) * share[:, None]) / share.sum()
        slope[:-1] += w[:-1] / (s.c * share.sum())
        assert np.abs(slope).max() < 1e-5
    with_ml = M.logistic(M.featured(frame(spark, rows).select("v", F.col("labels")[0].alias("class_id"))), 0.1, 200, family="multinomial")
    assert np.abs(with_ml.coefficientMatrix.toArray().T - found[0][:-1]).max() < 1e-3


def test_a_search_goes_on_from_its_log(spark, tmp_path, monkeypatch):
    df, log = frame(spark, data(300)), str(tmp_path / "log")
    logistic, nets = [{"c": c, "balanced": False} for c in (0.1, 1.0)], [{"layers": 1, "hidden": h, "lr": 1e-2, "weight_decay": 0.0, "dropout": 0.0} for h in (0.5, 4)]
    search = lambda lo, ne, config: S.searched(df, 3, 3, log, config, lo, ne, folds=3, epochs=3, fold="fold", inner="inner").collect()
    first = search(logistic, nets[:1], {"rows": 300})
    assert len(first) == 3 and {r.model for r in first} == {"logistic", "network"}
    seen = []
    of, trained = N.logistic_models, N.trained
    monkeypatch.setattr(N, "logistic_models", lambda *a, **k: (seen.append("logistic"), of(*a, **k))[1])
    monkeypatch.setattr(N, "trained", lambda *a, **k: (seen.append(len(a[2])), trained(*a, **k))[1])
    second = search(logistic, nets, {"rows": 300})
    assert seen == [3] and len(second) == 4 and {tuple(r) for r in map(str, first)} <= {tuple(r) for r in map(str, second)}
    search(logistic, [], {"rows": 301})  # other data: nothing counts
    assert seen == [3, "logistic"]
    for r in second:
        assert len(r.per_fold) == 3 and abs(r.mean - np.mean(r.per_fold)) < 1e-12 and abs(r.sd - np.std(r.per_fold)) < 1e-12 and abs(np.mean(r.per_class) - r.mean) < 1e-12
    one = next(r for r in second if r.model == "logistic" and json.loads(r.config)["c"] == 1.0)
    rows, scores = data(300), []
    for k, w in enumerate(N.logistic_models(N.packed(df, 3, fold="fold")[0], [N.Logistic(1.0, False, k) for k in range(3)], 3, 3)):
        held = [r for r in rows if r[3] == k]
        top = np.array([[*r[1], 1.0] for r in held]) @ w
        scores.append(N.f1(N.hits(top, np.array([[float(c in r[2]) for c in range(3)] for r in held]))))
    assert np.allclose(one.per_fold, scores)


def test_f1_of_hits():
    y = np.array([[1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1.0]])
    z = np.array([[2, 1, 0], [0, 2, 1], [1, 0, 0], [3, 0, 0.0]])
    assert np.allclose(N.f1(N.hits(z, y), False), [2 / 5, 2 / 3, 0.0])


def test_log_survives_stops(spark, tmp_path):
    at, schema = str(tmp_path / "log"), "k long, x string"
    log = RecordLog(spark, at, schema, {"b": 1, "a": 2})
    assert log.records().collect() == [] and log.repair() == (0, 0)
    rows = lambda *ks: spark.createDataFrame([(k, f"é {k}\n") for k in ks], schema)
    log.append(rows(1, 2))
    RecordLog(spark, at, schema, {"b": 2, "a": 2}).append(rows(3))  # another configuration
    log.append(rows(4).coalesce(1))
    part = next(f for d in tmp_path.glob("log/segment-*") for f in d.glob("part-*") if f.stat().st_size and '"k":4' in f.read_text())
    text = part.read_text()
    part.write_text(text + text[: len(text) // 2])  # torn
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        log.append(rows(9).withColumn("x", F.raise_error(F.lit("stopped")).cast("string")))
    assert not list(tmp_path.glob("log/making-*"))
    again = RecordLog(spark, at, schema, {"a": 2, "b": 1})
    assert sorted(tuple(r) for r in again.records().collect()) == [(k, f"é {k}\n") for k in (1, 2, 4)]
    assert sorted(r.k for r in again.left(rows(1, 3, 4, 5), "k").collect()) == [3, 5]
    assert again.repair() == (1, 1) and len(list(tmp_path.glob("log/segment-*"))) == 1
    assert sorted(r.k for r in again.records().collect()) == [1, 2, 4] and again.repair() == (0, 0)


def test_network_query(spark, sf):
    rows = registry.queries()["mlc_05_network"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert rows[0].epochs >= 1 and 0 <= rows[0].held <= 1 and all(0 <= r.top <= 1 and 0 <= r.assigned < 10 and r.n_labels >= 1 for r in rows)


def test_search_query(spark, sf):
    rows = registry.queries()["mlc_04_search"](spark, sf).collect()
    assert len(rows) == 32 and len({(r.model, r.config) for r in rows}) == 32
    assert all(len(r.per_fold) == 5 and abs(r.mean - np.mean(r.per_fold)) < 1e-12 for r in rows)
    assert max(r.mean for r in rows if r.model == "logistic") > 0.5


def test_an_epoch_is_one_scan_and_shards_are_averaged(spark, monkeypatch):
    """However many blocks there are, an epoch is one scan; shards are trained by themselves and averaged by their rows."""
    blocks, n = N.packed(frame(spark, data()), 3, fold="fold", inner="inner", size=64)
    own, scans, of = local(blocks, 3), [], N.summed
    monkeypatch.setattr(N, "summed", lambda *a, **k: (scans.append(1), of(*a, **k))[1])
    s = N.Setting(2, 5, 1e-2, 0.01, 0.3, fold=1)
    got = N.trained(blocks, n, [s], 3, 3, epochs=1, patience=None, shard=4)[0].network
    assert len(scans) == 1
    rows = lambda of: sum((b[3] != 1).sum() for b in of.values())
    shards = [{b: own[b] for b in own if b % 3 == k} for k in range(3)]
    assert sum(map(rows, shards)) == rows(own) and n == 9
    want = sum(plain_training(b, s, 3, 3, 1, 1, inner=False)[0].weights * rows(b) for b in shards) / rows(own)
    assert np.allclose(got.weights, want, atol=1e-9)
    scans.clear()
    found = N.trained(blocks, n, [N.Setting(2, 16, 2e-2, 0.0, 0.1)], 3, 3, epochs=20, patience=None, shard=4)[0].network
    assert len(scans) == 20
    x, y = (np.concatenate([b[k] for b in own.values()]) for k in (1, 2))
    assert N.f1(N.hits(found.logits(x), y)) > 0.75


def test_a_last_fit_takes_no_scans_of_its_own(spark, monkeypatch):
    """The network of all rows is learned beside the one that stops early, and is the one that a fit from the start gives."""
    df, s, scans, of = frame(spark, data()), N.Setting(2, 8, 2e-2, 0.01, 0.3), [], N.summed
    blocks, n = N.packed(df, 3, inner="inner", size=64)
    monkeypatch.setattr(N, "summed", lambda *a, **k: (scans.append(1), of(*a, **k))[1])
    monkeypatch.setattr(N, "packed", lambda *a, **k: (blocks, n))
    for shard in (64, 4):
        monkeypatch.setattr(N, "SHARD", shard)
        scans.clear()
        found = N.refitted(df, s, 3, 3, most=12, patience=3, inner="inner")
        assert len(scans) == len(found.history) + 1 <= found.epochs + 4
        first = N.trained(blocks, n, [s], 3, 3, 12, 3)[0]
        assert found.epochs == first.epochs and np.allclose(found.history, first.history) and found.held == max(found.history)
        last = N.trained(blocks, n, [s], 3, 3, first.epochs, None)[0].network
        assert np.allclose(found.network.weights, last.weights, atol=1e-9) and np.allclose(found.network.running, last.running, atol=1e-9)
        assert not np.allclose(last.weights, first.network.weights, atol=1e-3)
