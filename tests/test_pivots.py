"""Pivots give the nearest neighbours that all pairs give, with far fewer comparisons where vectors lie in clusters."""

import numpy as np

from corpweave.operators import pivots as P


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, vec_id long, v array<double>").repartition(4)


def test_same_neighbours_with_few_comparisons(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 6))

    def side(n, first):
        v = centres[rng.integers(30, size=n)] + 0.02 * rng.normal(size=(n, 6))
        v *= rng.uniform(0.98, 1.02, size=(n, 1)) / np.linalg.norm(v, axis=1)[:, None]  # lengths differ a little
        return [(int(i % 2), first + i, v[i].tolist()) for i in range(n)]

    a, b = side(800, 0), side(900, 10_000)
    a += [(5, 99_999, [1.0] * 6)]  # a group without a right side
    got = {r.id: r for r in P.nearest(frame(spark, a), frame(spark, b), "g", 6, 40).collect()}
    assert len(got) == 800 and 99_999 not in got
    for g in (0, 1):
        x, y = ([r for r in s if r[0] == g] for s in (a, b))
        gap = 1 - np.array([r[2] for r in x]) @ np.array([r[2] for r in y]).T
        assert np.allclose([got[r[1]].gap for r in x], gap.min(axis=1), atol=1e-12)
    assert sum(r.pairs for r in got.values()) < 0.4 * 800 * 450


def test_copies_zeros_and_empty_sides(spark):
    rows = [(0, i, [0.0, 0.0]) for i in range(5)] + [(0, 10 + i, [0.6, 0.8]) for i in range(700)]
    got = P.nearest(frame(spark, rows), frame(spark, rows), "g", 2, 8).collect()
    assert len(got) == 705 and all(abs(r.gap - (1.0 if r.id < 5 else 0.0)) < 1e-12 for r in got)
    assert P.nearest(frame(spark, rows), frame(spark, rows).where("false"), "g", 2).collect() == []


def shuffled(spark, df):
    """MB that are shuffled for a table, and its rows."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        s = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (s.apply(i) for i in range(s.size()))}

    before = stages()
    rows = df().collect()
    return sum(n for k, n in stages().items() if k not in before) / 1e6, rows


def test_a_vector_is_sent_a_few_times_however_many_cells_are_open(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(6000, 48))
    v /= np.linalg.norm(v, axis=1)[:, None]  # nothing can be left out
    a, b = (frame(spark, [(0, i, v[i].tolist()) for i in range(k, 6000, 2)]).cache() for k in (0, 1))
    assert a.count() == b.count() == 3000
    mb, got = shuffled(spark, lambda: P.nearest(a, b, "g", 48))
    gap = 1 - v[::2] @ v[1::2].T
    assert all(abs(r.gap - gap[r.id // 2].min()) < 1e-12 for r in got) and len(got) == 3000
    assert np.mean([r.pairs for r in got]) > 2500
    assert mb < 25 * 3000 * 48 * 8 / 1e6  # of one side; each row to 63 cells was 126 times that


def test_odd_rows_of_a_group(spark):
    """Keys of text, the same key twice, and one row on a side."""
    rows = [(0, "a", [1.0, 0.0]), (0, "a", [0.0, 1.0]), (0, "b", [-1.0, 0.0]), (1, "c", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, vec_id string, v array<double>")
    got = {r.id: (round(r.gap, 12), r.pairs) for r in P.nearest(df.where("g = 0"), df.where("vec_id = 'b' or g = 1"), "g", 2).collect()}
    assert got == {"a": (1.0, 2), "b": (0.0, 1)}
