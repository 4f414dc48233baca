"""Distance queries between the two corpora of each class."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpweave.functions import vectors as V
from corpweave.operators import distances as D
from corpweave.operators import gaps as G
from corpweave.operators import pivots
from corpweave.operators.relational import capped
from corpweave.plans.base import SEG, draw, segments
from corpweave.plans.gaps import rounded, unit_means
from corpweave.registry import query
from corpweave.session import cut, removed, shared_dir

DIM = 64

_PAIRS = f"with {SEG}, a as (select * from seg where corpus = 0), b as (select * from seg where corpus = 1), p as (select a.class_id as class_id, a.vec_id as x, b.vec_id as y, 1 - list_dot_product(a.v, b.v) as gap from a join b on a.class_id = b.class_id)"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir)
    return s.where("corpus = 0"), s.where("corpus = 1")


@query("jon_10_nearest", f"{_PAIRS} select x as vec_id, round(min(gap), 6) as gap from p group by 1 union all select y, round(min(gap), 6) from p group by 1")
def jon_10(spark, sf_dir):
    """JON-10: the best match of each vector on the other side, both ways, in blocks."""
    a, b = _sides(spark, sf_dir)
    both = D.nearest(a, b, "class_id", DIM).unionByName(D.nearest(b, a, "class_id", DIM))
    return both.select(F.col("id").alias("vec_id"), F.round("gap", 6).alias("gap"))


@query("jon_10_pruned", f"{_PAIRS} select x as vec_id, round(min(gap), 6) as gap from p group by 1 union all select y, round(min(gap), 6) from p group by 1")
def jon_10_pruned(spark, sf_dir):
    """JON-10: the same by pivots, which leave out cells that can't hold anything nearer."""
    a, b = _sides(spark, sf_dir)
    both = pivots.nearest(a, b, "class_id", DIM).unionByName(pivots.nearest(b, a, "class_id", DIM))
    return both.select(F.col("id").alias("vec_id"), F.round("gap", 6).alias("gap"))


_NEAR = f"{_PAIRS}, u as (select class_id, min(gap) as g from p group by class_id, x), w as (select class_id, min(gap) as g from p group by class_id, y), s as (select class_id, avg(g) as m, max(g) as t from u group by 1), q as (select class_id, avg(g) as m, max(g) as t from w group by 1)"


@query("dis_02_chamfer_hausdorff", f"{_NEAR} select class_id, round(s.m, 6) as forward, round(q.m, 6) as back, round((s.m + q.m) / 2, 6) as chamfer, round(greatest(s.m, q.m), 6) as modified, round(greatest(s.t, q.t), 6) as hausdorff from s join q using (class_id)")
def dis_02(spark, sf_dir):
    """DIS-02 and AGG-16: mean and greatest nearest-neighbour distances, both ways."""
    a, b = _sides(spark, sf_dir)

    def side(x, y, name):
        return D.nearest(x, y, "class_id", DIM).groupBy("class_id").agg(F.avg("gap").alias(f"{name}_m"), F.max("gap").alias(f"{name}_t"))

    j = side(a, b, "f").join(F.broadcast(side(b, a, "b")), "class_id")
    out = j.select("class_id", F.col("f_m").alias("forward"), F.col("b_m").alias("back"), ((F.col("f_m") + F.col("b_m")) / 2).alias("chamfer"), F.greatest("f_m", "b_m").alias("modified"), F.greatest("f_t", "b_t").alias("hausdorff"))
    return rounded(out, "forward", "back", "chamfer", "modified", "hausdorff")


@query("dis_05_linear_mmd", f"with {SEG}, m as (select class_id, corpus, i, avg(v[i]) as y from seg, range(1, 65) r(i) group by 1, 2, 3), d as (select class_id, i, max(y) filter (corpus = 0) - max(y) filter (corpus = 1) as d from m group by 1, 2) select class_id, round(sum(d * d), 6) as mmd from d group by 1")
def dis_05(spark, sf_dir):
    """DIS-05: squared distance of the means."""
    from corpweave.operators.relational import vector_mean

    m = vector_mean(segments(spark, sf_dir), "v", "class_id", "corpus")
    a, b = (m.where(F.col("corpus") == c).select("class_id", F.col("mean").alias(n)) for c, n in ((0, "x"), (1, "y")))
    d = F.zip_with("x", "y", lambda x, y: x - y)
    return a.join(F.broadcast(b), "class_id").select("class_id", d.alias("d")).select("class_id", F.round(V.dot(F.col("d"), F.col("d")), 6).alias("mmd"))


def _euclid(x: str, y: str) -> str:
    return f"sqrt(greatest(list_dot_product({x}, {x}) + list_dot_product({y}, {y}) - 2 * list_dot_product({x}, {y}), 0))"


_ALL = f"with {SEG}, p as (select a.class_id as class_id, a.corpus as c, b.corpus as d, {_euclid('a.v', 'b.v')} as e from seg a join seg b on a.class_id = b.class_id and a.vec_id <> b.vec_id and a.corpus <= b.corpus)"


@query("dis_08_energy", f"{_ALL} select class_id, round(greatest(2 * avg(e) filter (c <> d) - avg(e) filter (c = 0 and d = 0) - avg(e) filter (c = 1 and d = 1), 0), 5) as energy from p group by 1")
def dis_08(spark, sf_dir):
    """DIS-08: energy distance, without pairs of a vector with itself, zero at least."""
    return _unbiased(spark, sf_dir, lambda x: x, lambda ab, aa, bb: F.greatest(2 * ab - aa - bb, F.lit(0.0)), 0.0).select("class_id", F.round("value", 5).alias("energy"))


def _unbiased(spark, sf_dir, kernel, combine, own: float, scale: DataFrame | None = None) -> DataFrame:
    """A statistic of mean kernels between and within the corpora; ``own`` is the kernel at distance zero."""
    a, b = _sides(spark, sf_dir)

    def mean(x, y, name, same):
        s = D.pair_sums(x, y, "class_id", DIM, kernel, scale=scale)
        n = F.sqrt("pairs") if same else F.lit(0)
        return s.select("class_id", F.try_divide(F.col("total") - own * n, F.col("pairs") - n).alias(name))

    j = mean(a, b, "ab", False).join(F.broadcast(mean(a, a, "aa", True)), "class_id").join(F.broadcast(mean(b, b, "bb", True)), "class_id")
    return j.select("class_id", combine(F.col("ab"), F.col("aa"), F.col("bb")).alias("value"))


_RBF = f"{_ALL}, w as (select class_id, median(e * e) as w from p where c <> d group by 1), k as (select class_id, c, d, exp(-e * e / (2 * w)) as k, w from p join w using (class_id)) select class_id, round(sqrt(any_value(w)), 5) as bandwidth, round(avg(k) filter (c = 0 and d = 0) + avg(k) filter (c = 1 and d = 1) - 2 * avg(k) filter (c <> d), 6) as mmd from k group by 1"


@query("dis_09_rbf_mmd", _RBF)
def dis_09(spark, sf_dir):
    """DIS-09: unbiased RBF discrepancy, its bandwidth from the median squared distance between the corpora; may be negative."""
    a, b = _sides(spark, sf_dir)
    m = D.middle_distances(a, b, "class_id", DIM)
    scale = m.select("class_id", F.sqrt((F.col("low") ** 2 + F.col("high") ** 2) / 2).alias("scale"))
    out = _unbiased(spark, sf_dir, lambda x: np.exp(-x * x / 2.0), lambda ab, aa, bb: aa + bb - 2 * ab, 1.0, scale)
    return out.join(F.broadcast(scale), "class_id").select("class_id", F.round("scale", 5).alias("bandwidth"), F.round("value", 6).alias("mmd"))


@query("dis_10_sampled_gap", f"with {SEG}, s as (select * from (select *, row_number() over (partition by class_id, corpus order by md5(concat_ws(':', '42', vec_id)), vec_id) as pos from seg) where pos <= 50000), {unit_means('s', 'class_id', 'corpus', name='u')} select a.class_id as class_id, round(1 - list_dot_product(a.c, b.c), 6) as gap from u a join u b on a.class_id = b.class_id and a.corpus = 0 and b.corpus = 1")
def dis_10(spark, sf_dir):
    """DIS-10: centroid gap on a sample of each side, all rows of a side of up to 50,000."""
    s = capped(segments(spark, sf_dir), ["class_id", "corpus"], 50_000, draw(42, "vec_id"), "vec_id")
    c = G.centroids(s, "class_id", "corpus")
    a, b = (c.where(F.col("corpus") == k).select("class_id", F.col("centroid").alias(n)) for k, n in ((0, "x"), (1, "y")))
    return a.join(F.broadcast(b), "class_id").select("class_id", F.round(1 - V.dot(F.col("x"), F.col("y")), 6).alias("gap"))


def directions(n: int = 512, d: int = DIM) -> np.ndarray:
    """Unit directions with signs from hashes, the same in SQL: minus where the MD5 of j:i begins with 8 or more."""
    from hashlib import md5

    return np.array([[1.0 if md5(f"{j}:{i}".encode()).hexdigest() < "8" else -1.0 for i in range(d)] for j in range(n)]) / np.sqrt(d)


@query("dis_01_sliced_wasserstein", f"""
with {SEG}, g as (select cast(j as int) as j, list(case when md5(concat(j, ':', i)) < '8' then 0.125 else -0.125 end order by i) as g from range(0, 64) a(i), range(0, 512) b(j) group by j),
x as (select class_id, corpus, j, round(list_dot_product(v, g), 12) as x from seg, g),
n as (select class_id, count(*) filter (corpus = 0) as n0, count(*) filter (corpus = 1) as n1 from seg group by 1),
c as (select class_id, j, x, count(*) filter (corpus = 0) as c0, count(*) filter (corpus = 1) as c1 from x group by 1, 2, 3),
f as (select class_id, j, x, sum(c0) over w / n0 as f0, sum(c1) over w / n1 as f1, lead(x) over w as nx from c join n using (class_id) window w as (partition by class_id, j order by x)),
d as (select class_id, j, sum(abs(f0 - f1) * (nx - x)) as w1 from f group by 1, 2)
select class_id, round(avg(w1), 6) as mean, round(stddev_pop(w1), 6) as sd, round(stddev_samp(w1) / sqrt(count(*)), 6) as error from d group by 1""")
def dis_01(spark, sf_dir):
    """DIS-01: sliced Wasserstein distance over 512 fixed directions."""
    return rounded(D.sliced(segments(spark, sf_dir), "class_id", directions()), "mean", "sd", "error")


@query("agg_15_covariance", f"with {SEG} select class_id, cast(i - 1 as int) as i, cast(j - 1 as int) as j, round(covar_samp(v[i], v[j]), 6) + 0.0 as cov from seg, range(1, 65) a(i), range(1, 65) b(j) group by class_id, i, j")
def agg_15(spark, sf_dir):
    """AGG-15: covariance of every class from streamed second moments."""
    m = D.moments(segments(spark, sf_dir), "class_id", d=DIM).select("class_id", F.posexplode("cov").alias("at", "cov"))
    return m.select("class_id", F.floor(F.col("at") / DIM).cast("int").alias("i"), (F.col("at") % DIM).alias("j"), (F.round("cov", 6) + 0.0).alias("cov"))


def _moments(spark, sf_dir) -> dict:
    rows = D.moments(segments(spark, sf_dir), "class_id", "corpus", d=DIM).where("n > 1").collect()  # two rows for each class
    return {(r.class_id, r.corpus): (np.array(r.mean), np.array(r["cov"]).reshape(DIM, DIM)) for r in rows}


@query("dis_03_gaussian_w2")
def dis_03(spark, sf_dir):
    """DIS-03 and VEC-14: mean and covariance terms of the Gaussian 2-Wasserstein distance."""
    m = _moments(spark, sf_dir)
    rows = [(k, *D.gaussian_w2(*m[k, 0], *m[k, 1])) for k in sorted({k for k, _ in m}) if (k, 0) in m and (k, 1) in m]
    return spark.createDataFrame(rows, "class_id int, mean_term double, cov_term double")


@query("dis_04_grassmann")
def dis_04(spark, sf_dir):
    """DIS-04 and VEC-13: distance and principal angles of the leading subspaces, and the variance that they explain."""
    m = _moments(spark, sf_dir)
    rows = [(k, *D.grassmann(m[k, 0][1], m[k, 1][1])) for k in sorted({k for k, _ in m}) if (k, 0) in m and (k, 1) in m]
    return spark.createDataFrame(rows, "class_id int, distance double, mean_angle double, largest_angle double, explained_0 double, explained_1 double, angles array<double>")


@query("dis_06_emd_sinkhorn")
def dis_06(spark, sf_dir):
    """DIS-06 and DIS-07: assignment cost and debiased entropic divergence, on all rows of the smaller side and as many of the other."""
    return D.solved(segments(spark, sf_dir), "class_id", DIM)


@query("dis_11_battery", f"""
with mmd as (with {SEG}, m as (select class_id, corpus, i, avg(v[i]) as y from seg, range(1, 65) r(i) group by 1, 2, 3), d as (select class_id, i, max(y) filter (corpus = 0) - max(y) filter (corpus = 1) as d from m group by 1, 2) select class_id, round(sum(d * d), 6) as value from d group by 1),
ch as ({_NEAR} select class_id, round((s.m + q.m) / 2, 6) as value from s join q using (class_id)),
u as (select 'mmd' as metric, * from mmd union all select 'chamfer', * from ch)
select metric, class_id, value, cast(row_number() over (partition by metric order by value desc, class_id) as int) as rank from u""")
def dis_11(spark, sf_dir):
    """DIS-11: metrics in one long table with ranks."""
    from pyspark.sql import Window

    u = dis_05(spark, sf_dir).select(F.lit("mmd").alias("metric"), "class_id", F.col("mmd").alias("value"))
    u = u.unionByName(dis_02(spark, sf_dir).select(F.lit("chamfer").alias("metric"), "class_id", F.col("chamfer").alias("value")))
    return u.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "class_id")))


@query("dis_12_gates", f"with {SEG}, m as (select class_id, i, avg(v[i]) as y, sum(v[i]) / count(*) as z from seg, range(1, 65) r(i) group by 1, 2), n as (select *, sqrt(sum(y * y) over (partition by class_id)) as a, sqrt(sum(z * z) over (partition by class_id)) as b from m) select class_id, round(max(abs(y / a - z / b)), 6) as difference from n group by 1")
def dis_12(spark, sf_dir):
    """DIS-12: centroids recomputed another way must agree within 1e-4, or the query fails."""
    s = segments(spark, sf_dir)
    a = G.centroids(s, "class_id").select("class_id", F.col("centroid").alias("x"))
    long = s.select("class_id", F.posexplode("v").alias("i", "y")).groupBy("class_id", "i").agg(F.avg("y").alias("y"))
    b = long.groupBy("class_id").agg(V.unit(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda t: t["y"])).alias("z"))
    d = F.array_max(F.zip_with("x", "z", lambda x, z: F.abs(x - z)))
    ok = F.when(F.col("d") <= 1e-4, F.col("d")).otherwise(F.raise_error(F.lit("a recomputed centroid differs")))
    return a.join(F.broadcast(b), "class_id").select("class_id", d.alias("d")).select("class_id", F.round(ok, 6).alias("difference"))


@query("dis_12_all_gates", f"""
with {SEG}, n as (select class_id, cast(count(*) filter (corpus = 0) as bigint) as n0, cast(count(*) filter (corpus = 1) as bigint) as n1 from seg group by 1), {unit_means('seg', 'class_id', 'corpus', name='u')}
select n.class_id as class_id, n0, n1, round(1 - list_dot_product(a.c, b.c), 6) as gap, true as passed from n join u a on a.class_id = n.class_id and a.corpus = 0 join u b on b.class_id = n.class_id and b.corpus = 1""")
def dis_12_all(spark, sf_dir):
    """DIS-12: four gates of each class that fail the query: its rows against a canonical run's, its centroids' gap against one from
    sums of components, against the canonical run's gap, and a gap between nothing and two."""
    s = segments(spark, sf_dir)

    def run(rows: DataFrame) -> DataFrame:
        c = G.centroids(rows, "class_id", "corpus")
        a, b = (c.where(F.col("corpus") == k).select("class_id", F.col("centroid").alias(n)) for k, n in ((0, "x"), (1, "y")))
        gap = a.join(F.broadcast(b), "class_id").select("class_id", (1 - V.dot(F.col("x"), F.col("y"))).alias("gap"))
        n = rows.groupBy("class_id").agg(F.count_if(F.col("corpus") == 0).alias("n0"), F.count_if(F.col("corpus") == 1).alias("n1"))
        return n.join(F.broadcast(gap), "class_id")

    kept = f"{shared_dir(spark).rstrip('/')}/canonical-{uuid.uuid4().hex}"
    run(s).write.parquet(kept)
    canonical = cut(spark.read.parquet(kept)).select("class_id", F.col("n0").alias("c0"), F.col("n1").alias("c1"), F.col("gap").alias("c"))
    removed(spark, kept)
    long = s.select("class_id", "corpus", F.posexplode("v").alias("i", "y")).groupBy("class_id", "i").agg(F.avg(F.when(F.col("corpus") == 0, F.col("y"))).alias("p"), F.avg(F.when(F.col("corpus") == 1, F.col("y"))).alias("q"))
    again = long.groupBy("class_id").agg((1 - F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q")))).alias("again"))
    return gates(run(s).join(F.broadcast(canonical), "class_id", "full").join(F.broadcast(again), "class_id", "left"))


def gates(both: DataFrame) -> DataFrame:
    """(class_id, n0, n1, gap, passed) of rows that also have another run's counts (c0, c1), its gap (c) and one found another way
    (again); the first gate that a class fails is an error that names it."""
    far = lambda a, b, most: ~F.coalesce(F.abs(F.col(a) - F.col(b)) <= most, F.lit(False))
    said = lambda what: F.raise_error(F.concat(F.lit(f"{what} of class "), F.col("class_id").cast("string"))).cast("boolean")
    ok = F.when(~(F.col("n0").eqNullSafe(F.col("c0")) & F.col("n1").eqNullSafe(F.col("c1"))), said("gate 1: other counts than in the canonical run"))
    ok = ok.when(far("gap", "again", 1e-4), said("gate 2: another gap from sums of components"))
    ok = ok.when(far("gap", "c", 1e-6), said("gate 3: another gap than in the canonical run"))
    ok = ok.when(~F.coalesce(F.col("gap").between(-1e-9, 2 + 1e-9), F.lit(False)), said("gate 4: no gap between zero and two"))
    return both.select("class_id", "n0", "n1", F.round("gap", 6).alias("gap"), ok.otherwise(True).alias("passed"))
