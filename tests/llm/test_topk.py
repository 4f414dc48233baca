import math
import random

from pyspark.sql import functions as F

from corpweave.llm import queries
from corpweave.llm import topk as K
from tests.util import same


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n)
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -x))) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in K.search(df, F.col("vec_id") % 50 == 0, **options).select("query_id", "rank", "vec_id", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as `a.b`").repartition(5)


def test_query_equals_its_oracle(spark, sf, duck):
    same(queries.queries()["op4_exact_topk"](spark, sf), duck.sql(queries.oracle_sql()["op4_exact_topk"]))


def test_ties_blocks_and_few_bins(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(400)]
    want = brute(rows)
    assert found(frame(spark, rows)) == want
    assert found(frame(spark, rows), block=2, bins=3) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 2.0]), (50, None), (100, []), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(300, [0.0, 0.0]), (301, [1.0, 1.0]), (301, [1.0, 1.0]), (302, [-3.0, 0.25, 0.5]), (303, [2.0])]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, rows[:1])) == [] and found(frame(spark, rows).limit(0)) == [] and found(frame(spark, [(7, [1.0]), (8, [1.0])])) == []


def test_query_equals_its_oracle_with_odd_rows(spark, tmp_path):
    import duckdb

    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [0.5, 0.0]), (50, []), (100, None), (150, [1.0, None]), (200, [float("nan")]), (None, [1.0]), (7, [2.0, 1.0]), (8, [2.0]), (9, [2.0, 1.0, 5.0])]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    same(queries.queries()["op4_exact_topk"](spark, str(tmp_path)), c.sql(queries.oracle_sql()["op4_exact_topk"]))
    assert found(frame(spark, rows)) == brute(rows)


def test_large_components_are_exact(spark):
    """Beyond the integers that doubles hold, beyond sums that a long holds, and beyond all that a long holds."""
    f32 = [3.0e6, 2.0e6, 2.0e6 + 0.25, -1.0e6]
    rows = [(0, [3.0e6, -1.0]), (1, [2.0e6, 7.0]), (2, [2.0e6, 7.5]), (3, [-1.0e6, 2.0e6])]
    assert found(frame(spark, rows)) == brute(rows)
    rows = [(50 * i, [f32[i % 4] * 2**k, 1.0]) for i, k in enumerate((0, 5, 9, 3, 20, 21, 22))] + [(1, [0.0, 1.0])]
    assert found(frame(spark, rows)) == brute(rows)
    rnd = random.Random(4)
    for top in (2**15, 2**21, 2**23, 2**40, 2**100):
        rows = [(i, [float(rnd.randrange(-(2**20), 2**20)) * top / 2**20 for _ in range(3)]) for i in range(0, 500, 10)]
        assert found(frame(spark, rows), bins=64) == brute(rows)
