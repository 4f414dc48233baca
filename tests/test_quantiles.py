"""Quantiles, tails and areas without a group in one task, the gates, and the registry's further metrics."""

import math

import numpy as np
import pytest

from corpweave import registry
from corpweave.functions import stats as S
from corpweave.operators import quantiles as Q
from corpweave.operators import relational as R
from corpweave.plans import distances as D


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=400), 1), "c": np.array([7.0]), "d": np.r_[-1e308, 1e308, 0.0, 1e-300, 5e-324], "e": np.exp(rng.normal(size=300) * 40), None: np.arange(10.0)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("b", float("nan")), ("z", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"low": 0.0, "p01": 0.01, "half": 0.5, "p93": 0.93, "high": 1.0}
    for bins in (64, 4096):
        got = {r.g: r for r in Q.quantiles(df.where("g <> 'd'" if bins == 64 else "true"), "g", "x", shares, bins).collect()}
        for g, v in groups.items():
            if bins == 64 and g in ("d", None):
                continue
            for name, p in shares.items():
                if g == "d" and p not in (0.0, 0.5, 1.0):
                    continue
                assert math.isclose(got[g][name], np.quantile(v, p), rel_tol=1e-12), (g, name, bins)
        assert "z" not in got
    assert Q.quantiles(df.where("false"), "g", "x", shares).collect() == []


def test_binomial_tail_in_closed_form():
    for n, k in ((1, 1), (10, 8), (500, 260), (1000, 700), (37, 0), (5, 6)):
        want = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
        assert math.isclose(S.binomial_tail(k, n), want, rel_tol=1e-9, abs_tol=1e-300)
    assert math.isclose(S.binomial_tail(3, 12, 0.2), sum(math.comb(12, i) * 0.2**i * 0.8 ** (12 - i) for i in range(3, 13)), rel_tol=1e-12)
    big = 10**9  # by the normal distribution
    assert math.isclose(S.binomial_tail(big // 2 + 31623, big), 0.5 * math.erfc((31623 - 0.5) / math.sqrt(big / 4) / math.sqrt(2)), rel_tol=1e-3)


def test_area_under_curve(spark):
    rows = [(0, 0.1, 0), (0, 0.4, 1), (0, 0.4, 0), (0, 0.9, 1), (1, 0.5, 1)]
    got = {r.g: r.auc for r in R.area_under_curve(spark.createDataFrame(rows, "g int, s double, t int"), ["g"], "s", "t").collect()}
    assert got == {0: 3.5 / 4, 1: None}


@pytest.mark.parametrize("change, gate", [({"n0": 4}, "gate 1"), ({"again": 0.5}, "gate 2"), ({"c": 0.3}, "gate 3"), ({"gap": None}, "gate 2"), ({"gap": 2.5, "c": 2.5, "again": 2.5}, "gate 4")])
def test_gates_name_what_fails(spark, change, gate):
    row = {"class_id": 7, "n0": 3, "n1": 2, "gap": 0.25, "c0": 3, "c1": 2, "c": 0.25, "again": 0.25}
    frame = lambda r: spark.createDataFrame([tuple(r.values())], "class_id int, n0 long, n1 long, gap double, c0 long, c1 long, c double, again double")
    assert D.gates(frame(row)).first().passed
    with pytest.raises(Exception, match=f"{gate}: .*of class 7"):
        D.gates(frame(row | change)).collect()


def test_further_metrics(spark, sf):
    rows = registry.queries()["udf_07_all_metrics"](spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r.metric, {})[r.class_id] = r.value
    assert set(by) == {"gaussian_w2", "gaussian_shape_share", "grassmann", "emd", "sinkhorn", "two_sample_auc"}
    one = {r.class_id: r for r in registry.queries()["dis_03_gaussian_w2"](spark, sf).collect()}
    for k, r in one.items():
        assert math.isclose(by["gaussian_w2"][k] ** 2, r.mean_term + r.cov_term) and math.isclose(by["gaussian_shape_share"][k], r.cov_term / (r.mean_term + r.cov_term))
    assert all(0 <= x <= 1 for x in by["two_sample_auc"].values() if x is not None) and len(by["two_sample_auc"]) == len(by["emd"])


def test_a_query_that_gives_several_metrics_is_run_once(spark, sf, monkeypatch):
    from corpweave.plans import models as P

    seen = []
    table = lambda name, x: lambda spark, _: (seen.append(name), spark.createDataFrame([(1, 2.0, x), (2, 3.0, None)], "class_id int, emd double, sinkhorn double"))[1]
    names = {"dis_06": {"emd": "emd", "sinkhorn": "sinkhorn"}}
    monkeypatch.setattr(P, "MORE", [(table("dis_06", 0.5), names["dis_06"])])
    rows = {tuple(r) for r in registry.queries()["udf_07_all_metrics"](spark, sf).collect()}
    assert seen == ["dis_06"] and rows == {("emd", 1, 2.0), ("emd", 2, 3.0), ("sinkhorn", 1, 0.5), ("sinkhorn", 2, None)}
