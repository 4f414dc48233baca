import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpweave.llm import negatives as N
from corpweave.llm import queries
from tests.util import same


def moved(i, label):
    return int(math.fmod(label + 1, 10)) if i % 7 == 0 else label


def brute(rows, positives=5, wanted=10):
    ok = [(n, i, moved(i, k), [math.floor(256 * x) for x in v]) for n, (i, v, k) in enumerate(rows) if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut, out = lambda x: max(-(2**63), min(2**63 - 1, x)), []
    for n, a, k, v in ok:
        if a % 100:
            continue
        s = [(-sum(x * y for x, y in zip(v, w)), i, label == k) for m, i, label, w in ok if m != n]
        for p, i, _ in sorted(x for x in s if x[2])[:positives]:
            hard = sorted(x for x in s if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p)[:wanted]
            out += [(a, i, r + 1, j, cut(-p), cut(-q)) for r, (q, j, _) in enumerate(hard)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as v", "true as asks", "3 as `a.b`", "0 as row").repartition(5)


def found(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in N.mined(df, F.col("vec_id") % 100 == 0, label, **options).collect())


def test_query_equals_its_oracle(spark, sf, duck):
    df = queries.queries()["op12_hard_negatives"](spark, sf)
    same(df, duck.sql(queries.oracle_sql()["op12_hard_negatives"]))
    assert df.count() > 50


def test_ties_and_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], rnd.randrange(3)) for i in range(900)]
    want = brute(rows)
    assert len(want) > 200 and found(frame(spark, rows)) == want
    assert found(frame(spark, rows), block=2) == want
    copies = [(i, [0.5, 0.5], i % 2) for i in range(0, 3000, 10)] + [(i, [0.25, 0.25], i % 2) for i in range(1, 500, 3)]  # one common vector
    assert found(frame(spark, copies)) == brute(copies)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [0.5, 2.0], 1), (100, None, 1), (200, [], 2), (300, [1.0, None], 3), (400, [float("nan"), 1.0], 1), (500, [1.0, float("inf")], 1), (None, [1.0, 1.0], 1)]
    rows += [(600, [0.0, 0.0], None), (700, [1.0, 1.0], 9), (701, [1.0, 1.0], 1), (702, [-3.0, 0.25, 0.5], 1), (703, [0.5, 0.5], 2), (704, [0.5], 2), (705, [0.5, 0.25], -3), (200, [0.0], 2), (900, [1.0, 0.0], -11)]
    assert found(frame(spark, rows)) == brute(rows) != []
    assert found(frame(spark, rows[:1])) == [] and found(frame(spark, rows).limit(0)) == [] and found(frame(spark, [(7, [1.0], 1)])) == []


def test_large_components_are_exact(spark):
    rnd = random.Random(4)
    for top in (2**15, 2**23, 2**40, 2**100):
        rows = [(i, [float(rnd.randrange(-(2**18), 2**20)) * top / 2**20 for _ in range(3)], rnd.randrange(2)) for i in range(0, 500, 10)]
        assert found(frame(spark, rows)) == brute(rows) != []


def test_query_equals_its_oracle_with_odd_rows(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(rnd.randrange(0, 1000, 50), [rnd.choice([0.1, 0.4, -0.2]) for _ in range(rnd.randrange(4))], rnd.choice([None, 1, 2, 9])) for _ in range(80)] + [(100, None, 1), (100, [0.5, None], 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    same(queries.queries()["op12_hard_negatives"](spark, str(tmp_path)), c.sql(queries.oracle_sql()["op12_hard_negatives"]))
    assert found(frame(spark, rows)) == brute(rows)


def test_planes_give_the_numbers_back_and_intervals_hold():
    rng = np.random.default_rng(2)
    a, c = rng.integers(-300, 300, (3, 8)).astype(float), rng.integers(-300, 300, (50, 8)).astype(float)
    s = N.Slicer(a, 8 * 300**2 + 1, 300)
    assert (sum(w * p for w, _, p in s.planes(c)) == c).all()
    seen = []

    def decide(i, j, low, high):
        exact = (a[i] * c[j]).sum(axis=1)
        assert (low <= exact).all() and (exact <= high).all()
        seen.append((high - low).max())
        return np.ones(len(i), bool)

    s.scores(c, np.ones((3, 50), bool), slice(0, 3), decide)
    assert seen == sorted(seen, reverse=True) and seen[-1] == 0


def test_most_products_are_saved():
    """Candidates drop out before their last plane: far fewer products than all pairs in all planes."""
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(6000, 32)) / 6)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(np.arange(6000)), pa.array(["x"] * 6000), pa.array(list(v), pa.list_(pa.float64()))], names=["row", "id", "label", "v"])
    b = N.Block([(k, k, "x") for k in range(50)], v[:50], int(32 * np.abs(v).max() ** 2) + 1, int(np.abs(v).max()), 5)
    got = next(iter(b.run(None)(iter([batch]))))
    assert got.num_rows == 250 and b.counted[0] < 0.6 * b.counted[1]
