"""Vector and gap queries over the segment table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpweave.functions import vectors as V
from corpweave.operators import gaps as G
from corpweave.operators import relational as R
from corpweave.plans.base import SEG, draw, segments, table
from corpweave.registry import query
from corpweave.session import cut

# SQL of the common steps: reference centroids, scores, assigned segments, documents

CEN = f"""{SEG},
cm as (select class_id, i, avg(v[i]) as y from seg, range(1, 65) r(i) group by 1, 2),
cen as (select class_id as k, list(y / norm order by i) as c, any_value(norm) as norm, any_value(n) as n
  from cm join (select class_id, sqrt(sum(y * y)) as norm from cm group by 1) using (class_id) join (select class_id, count(*) as n from seg group by 1) using (class_id) group by 1)"""

SCORED = f"""{CEN},
sc as (select vec_id, corpus, doc, family, class_id, v, k, list_dot_product(v, c) as s from seg, cen),
asg as (select vec_id, corpus, doc, family, class_id, v, k as assigned, s as top from (select *, row_number() over (partition by vec_id order by round(s, 9) desc, k) as pos from sc) where pos = 1)"""

DOCS = f"""{SCORED},
ds as (select corpus, doc, any_value(family) as family, k, avg(s) as s from sc group by corpus, doc, k),
da as (select corpus, doc, family, k as assigned, s as top from (select *, row_number() over (partition by doc order by round(s, 9) desc, k) as pos from ds) where pos = 1),
dm as (select corpus, doc, i, avg(v[i]) as y from seg, range(1, 65) r(i) group by 1, 2, 3),
dn as (select doc, sqrt(sum(y * y)) as norm from dm group by 1),
du as (select corpus, doc, list(y / norm order by i) as v from dm join dn using (doc) group by 1, 2),
docs as (select du.corpus as corpus, du.doc as doc, family, assigned, top, v from du join da on du.doc = da.doc)"""


def unit_means(source: str, *by: str, name: str) -> str:
    """CTEs ``name`` (by, n, norm, c): unit mean vectors of a relation with a vector v."""
    b = ", ".join(by)
    return f"""{name}_m as (select {b}, i, avg(v[i]) as y, count(*) as n from {source}, range(1, 65) r(i) group by {b}, i),
{name}_n as (select {b}, sqrt(sum(y * y)) as norm, max(n) as n from {name}_m group by {b}),
{name} as (select {b}, n, norm, c from {name}_n join (select {b}, list(y order by i) as l from {name}_m group by {b}) using ({b}) , lateral (select [x / norm for x in l] as c))"""


GAP = f"""{DOCS},
rs as (select * from docs where corpus = 0), {unit_means('rs', 'assigned', name='rc')},
ps as (select * from asg where corpus = 1),
pk as (select * from (select *, row_number() over (partition by assigned, doc order by md5(concat_ws(':', '42', vec_id)), vec_id) as pos from ps) where pos <= {{cap}}),
{unit_means('pk', 'assigned', name='pc')},
pn as (select assigned, count(*) as n_segments, count(distinct doc) as n_docs from ps group by 1),
gap as (select k as class_id, coalesce(rc.n, 0) as n_research, coalesce(n_segments, 0) as n_segments, coalesce(n_docs, 0) as n_docs, coalesce(pc.n, 0) as n_capped,
  rc.norm as r_norm, pc.norm as p_norm, 1 - list_dot_product(rc.c, pc.c) as gap,
  case when rc.c is null or pc.c is null then 'empty' when coalesce(rc.n, 0) < 10 or coalesce(pc.n, 0) < 10 then 'few rows' when rc.norm < 0.5 or pc.norm < 0.5 then 'weak centroid' end as reason
  from (select distinct class_id as k from seg) left join rc on rc.assigned = k left join pc on pc.assigned = k left join pn on pn.assigned = k)"""


class Base:
    """The common steps on one set of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.seg = segments(spark, sf_dir)
        self.centroids = G.centroids(self.seg, "class_id")
        self.classes = G.Classes.of(self.centroids)
        self.assigned = G.assigned(self.seg, self.classes)

    @property
    def ids(self) -> list[int]:
        return self.classes.ids

    def documents(self, *by: str) -> DataFrame:
        return G.documents(self.assigned, "corpus", *by, classes=self.classes)

    def gap(self, cap: int | None = G.CAP) -> DataFrame:
        return G.semantic_gap(self.documents().where("corpus = 0"), self.assigned.where("corpus = 1"), self.ids, draw(42, "vec_id"), cap=cap)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# vectors


@query("vec_01_dot", f"with {CEN} select vec_id, round(list_dot_product(v, c), 6) as cosine, round(1 - list_dot_product(v, c), 6) as gap from seg join cen on class_id = k")
def vec_01(spark, sf_dir):
    """VEC-01: cosine to the own class's centroid."""
    b = Base(spark, sf_dir)
    both = b.seg.join(F.broadcast(b.centroids), "class_id")
    d = V.dot(F.col("v"), F.col("centroid"))
    return both.select("vec_id", F.round(d, 6).alias("cosine"), F.round(1 - d, 6).alias("gap"))


_HALF = "[case when vec_id % 50 = 0 then 0.0 else x * 2 end for x in v]"


@query("vec_02_normalise", f"with {SEG}, a as (select vec_id, {_HALF} as v from seg), n as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from a) select vec_id, case when n >= 1e-8 then round(v[1] / n, 6) end as first, round(n, 6) as norm from n")
def vec_02(spark, sf_dir):
    """VEC-02: length one; a zero vector is null."""
    v = F.transform("v", lambda x: F.when(F.col("vec_id") % 50 == 0, 0.0).otherwise(x * 2))
    s = segments(spark, sf_dir).select("vec_id", v.alias("v"))
    return s.select("vec_id", F.round(V.unit(F.col("v"))[0], 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query("vec_03_norm_audit", f"with {SEG}, n as (select sqrt(list_dot_product(v, v)) as n from seg) select round(min(n), 5) as least, round(max(n), 5) as most, cast(count(*) filter (abs(n - 1) > 1e-4) as bigint) as off from n")
def vec_03(spark, sf_dir):
    """VEC-03: norms of all rows, and how many are off by more than 1e-4."""
    n = segments(spark, sf_dir).select(V.norm(F.col("v")).alias("n"))
    return n.agg(F.round(F.min("n"), 5).alias("least"), F.round(F.max("n"), 5).alias("most"), F.count_if(F.abs(F.col("n") - 1) > 1e-4).alias("off"))


@query("vec_04_document_units", f"with {DOCS} select doc, cast(assigned as int) as assigned, round(top, 6) as top, round(v[1], 6) as first from docs")
def vec_04(spark, sf_dir):
    """VEC-04: documents as unit mean vectors, with the class of their mean scores."""
    d = Base(spark, sf_dir).documents()
    return d.select("doc", "assigned", F.round("top", 6).alias("top"), F.round(F.col("v")[0], 6).alias("first"))


@query("vec_05_centroid_cohesion", f"with {CEN} select k as class_id, cast(any_value(cen.n) as bigint) as n, round(any_value(norm), 6) as norm, round(avg(list_dot_product(v, c)), 6) as cohesion, any_value(norm) < 0.5 as spread from cen join seg on class_id = k group by 1")
def vec_05(spark, sf_dir):
    """VEC-05 and AGG-06: centroids, their norms and cohesion; a norm under one half marks a spread class."""
    b = Base(spark, sf_dir)
    both = b.seg.join(F.broadcast(b.centroids), "class_id")
    g = both.groupBy("class_id").agg(F.max("n").alias("n"), F.max("norm").alias("norm"), F.avg(V.dot(F.col("v"), F.col("centroid"))).alias("cohesion"))
    return rounded(g.withColumn("spread", F.col("norm") < 0.5), "norm", "cohesion")


@query("vec_06_sub_centroids", f"with {SEG}, {unit_means('seg', 'class_id', 'family', name='u')} select class_id, family, cast(n as bigint) as n, round(norm, 6) as norm, round(c[1], 6) as first from u")
def vec_06(spark, sf_dir):
    """VEC-06: centroids of chosen rows, here of each class and family."""
    c = G.centroids(segments(spark, sf_dir), "class_id", "family")
    return c.select("class_id", "family", "n", F.round("norm", 6).alias("norm"), F.round(F.col("centroid")[0], 6).alias("first"))


@query("vec_07_centroid_similarity", f"with {CEN} select a.k as a, b.k as b, round(list_dot_product(a.c, b.c), 6) as cosine from cen a, cen b")
def vec_07(spark, sf_dir):
    """VEC-07: class by class cosines of centroids."""
    c = Base(spark, sf_dir).centroids
    pair = c.select(F.col("class_id").alias("a"), F.col("centroid").alias("x")).crossJoin(F.broadcast(c.select(F.col("class_id").alias("b"), F.col("centroid").alias("y"))))
    return pair.select("a", "b", F.round(V.dot(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("vec_08_nearest_consistency", f"with {SCORED} select class_id, cast(count(*) as bigint) as n, cast(count(*) filter (assigned = class_id) as bigint) as matched from asg group by 1")
def vec_08(spark, sf_dir):
    """VEC-08: how many rows of a class are nearest to its centroid."""
    a = Base(spark, sf_dir).assigned
    return a.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("assigned") == F.col("class_id")).alias("matched"))


# the first two coordinate axes stand for removed directions
_AXES = "[case when i <= 2 then 0.0 else v[i] end for i in range(1, 65)]"


def _axes(n: int = 2, d: int = 64):
    import numpy as np

    return np.eye(d)[:n]


_REMOVED = f"p as (select *, {_AXES} as w from seg), q as (select *, sqrt(list_dot_product(w, w)) as n from p)"


@query("vec_09_subspace_removal", f"with {SEG}, {_REMOVED} select vec_id, round(w[3] / n, 6) as third, round(w[64] / n, 6) as last from q")
def vec_09(spark, sf_dir):
    """VEC-09: rows without their part in a span, at length one again."""
    v = V.without(F.col("v"), _axes())
    return segments(spark, sf_dir).select("vec_id", v.alias("w")).select("vec_id", F.round(F.col("w")[2], 6).alias("third"), F.round(F.col("w")[63], 6).alias("last"))


@query("vec_10_sequential_removal", f"with {SEG}, {_REMOVED} select vec_id, round(w[3] / n, 6) as third, round(w[64] / n, 6) as last from q")
def vec_10(spark, sf_dir):
    """VEC-10: the same, a direction at a time."""
    v = V.without_each(F.col("v"), _axes())
    return segments(spark, sf_dir).select("vec_id", v.alias("w")).select("vec_id", F.round(F.col("w")[2], 6).alias("third"), F.round(F.col("w")[63], 6).alias("last"))


@query("vec_15_rms_within", f"with {CEN} select k as class_id, round(sqrt(greatest(2 - 2 * norm * norm, 0)), 6) as rms from cen")
def vec_15(spark, sf_dir):
    """VEC-15: root mean square distance within a class of unit vectors."""
    c = Base(spark, sf_dir).centroids
    return c.select("class_id", F.round(F.sqrt(F.greatest(2 - 2 * F.col("norm") * F.col("norm"), F.lit(0.0))), 6).alias("rms"))


@query("vec_17_own_other", f"""
with {SEG}, {unit_means('seg', 'class_id', 'corpus', name='u')}
select vec_id, round(1 - list_dot_product(v, a.c), 6) as own, round(1 - list_dot_product(v, b.c), 6) as other
from seg join u a on a.class_id = seg.class_id and a.corpus = seg.corpus join u b on b.class_id = seg.class_id and b.corpus = 1 - seg.corpus where a.n >= 2 and b.n >= 2""")
def vec_17(spark, sf_dir):
    """VEC-17: distances to the class's centroid in the own and in the other corpus."""
    s = segments(spark, sf_dir)
    c = G.centroids(s, "class_id", "corpus").where("n >= 2").select("class_id", "corpus", "centroid")
    own = s.join(F.broadcast(c.withColumnRenamed("centroid", "a")), ["class_id", "corpus"])
    other = c.select("class_id", (1 - F.col("corpus")).alias("corpus"), F.col("centroid").alias("b"))
    both = own.join(F.broadcast(other), ["class_id", "corpus"])
    return both.select("vec_id", F.round(1 - V.dot(F.col("v"), F.col("a")), 6).alias("own"), F.round(1 - V.dot(F.col("v"), F.col("b")), 6).alias("other"))


@query("jon_09_scores", f"with {SCORED} select vec_id, k as class_id, round(s, 6) as score from sc")
def jon_09(spark, sf_dir):
    """JON-09: every vector against every centroid; the centroids are as many as classes."""
    b = Base(spark, sf_dir)
    s = b.assigned.select("vec_id", F.posexplode("scores").alias("at", "score"))
    return s.select("vec_id", b.classes.id_of(F.col("at")).alias("class_id"), F.round("score", 6).alias("score"))


@query("mlc_07_zero_shot", f"with {SCORED} select assigned as class_id, cast(count(*) as bigint) as n, round(avg(top), 6) as mean_top, round(min(top), 6) as least from asg group by 1")
def mlc_07(spark, sf_dir):
    """MLC-07: assignment to the nearest reference centroid."""
    a = Base(spark, sf_dir).assigned
    return a.groupBy(F.col("assigned").alias("class_id")).agg(F.count("*").alias("n"), F.round(F.avg("top"), 6).alias("mean_top"), F.round(F.min("top"), 6).alias("least"))


# profiles and gaps

_SHARES = f"""{DOCS},
ct as (select corpus, count(*) as total from docs group by 1),
sh as (select ct.corpus as corpus, k as class_id, (select count(*) from docs d where d.corpus = ct.corpus and d.assigned = k) as n, (select count(*) from docs d where d.corpus = ct.corpus and d.assigned = k) / total as share from ct, cen)"""


@query("gap_01_profile", f"with {_SHARES}, m as (select corpus, k as class_id, avg(s) as soft from ds group by 1, 2) select corpus, class_id, cast(n as bigint) as n, round(share, 6) as share, round(soft, 6) as soft from sh join m using (corpus, class_id)")
def gap_01(spark, sf_dir):
    """GAP-01: hard and soft class shares of documents."""
    b = Base(spark, sf_dir)
    d = b.documents()
    both = G.profile(d, b.ids, "corpus").join(F.broadcast(G.soft_profile(d, b.ids, "corpus")), ["corpus", "class_id"])
    return both.select("corpus", "class_id", "n", F.round("share", 6).alias("share"), F.round("mean_score", 6).alias("soft"))


@query("gap_02_document_weighted", f"with {_SHARES} select class_id, cast(n as bigint) as n, round(share, 6) as share from sh where corpus = 1")
def gap_02(spark, sf_dir):
    """GAP-02: each document has one vote."""
    b = Base(spark, sf_dir)
    return rounded(G.profile(b.documents().where("corpus = 1"), b.ids), "share")


_COVERAGE = f"{_SHARES}, cov as (select class_id, max(share) filter (corpus = 0) as research, max(share) filter (corpus = 1) as policy from sh group by 1)"


@query("gap_03_coverage", f"with {_COVERAGE} select class_id, round(research, 6) as research, round(policy, 6) as policy, round(abs(research - policy), 6) as gap, round(research - policy, 6) as dominance from cov")
def gap_03(spark, sf_dir):
    """GAP-03: coverage gap of each class."""
    b = Base(spark, sf_dir)
    return rounded(G.coverage_gap(G.profile(b.documents(), b.ids, "corpus")), "research", "policy", "gap", "dominance")


@query("gap_04_calibration", f"with {DOCS} select assigned as class_id, round(avg(top) filter (corpus = 1) - avg(top) filter (corpus = 0), 6) as difference, round(min(top), 6) as least, round(max(top), 6) as most, round(stddev_pop(top), 6) as sd from docs group by 1")
def gap_04(spark, sf_dir):
    """GAP-04: difference of mean top scores."""
    d = Base(spark, sf_dir).documents()
    side = lambda c: F.avg(F.when(F.col("corpus") == c, F.col("top")))
    return d.groupBy(F.col("assigned").alias("class_id")).agg(F.round(side(1) - side(0), 6).alias("difference"), F.round(F.min("top"), 6).alias("least"), F.round(F.max("top"), 6).alias("most"), F.round(F.stddev_pop("top"), 6).alias("sd"))


_GAP_COLUMNS = "class_id, cast(n_research as bigint) as n_research, cast(n_segments as bigint) as n_segments, cast(n_docs as bigint) as n_docs, cast(n_capped as bigint) as n_capped, round(r_norm, 6) as r_norm, round(p_norm, 6) as p_norm, round(gap, 6) as gap, reason is not null as unreliable, reason"


@query("gap_semantic", f"with {GAP.format(cap=50)} select {_GAP_COLUMNS} from gap")
def gap_05(spark, sf_dir):
    """GAP-05: the semantic gap of each class between research documents and capped policy segments."""
    return rounded(Base(spark, sf_dir).gap(), "r_norm", "p_norm", "gap")


@query("gap_06_cap_sensitivity", " union all ".join(f"(with {GAP.format(cap=c)} select cast({c} as int) as cap, class_id, cast(n_capped as bigint) as n_capped, round(gap, 6) as gap, cast(row_number() over (order by gap desc nulls last, class_id) as int) as rank from gap)" for c in (1, 2, 50)))
def gap_06(spark, sf_dir):
    """GAP-06: gaps and ranks under several caps."""
    b = Base(spark, sf_dir)
    out = None
    for cap in (1, 2, 50):
        rank = F.row_number().over(Window.orderBy(F.col("gap").desc_nulls_last(), "class_id"))
        g = b.gap(cap).select(F.lit(cap).alias("cap"), "class_id", "n_capped", F.round("gap", 6).alias("gap"), rank.alias("rank"))
        out = g if out is None else out.unionByName(g)
    return out


def _projected(cte: str) -> str:
    """The segment table without its first two axes, for the SQL of adjusted gaps."""
    w = "[case when i <= 2 then 0.0 else v[i] / sqrt(list_dot_product(v[3:], v[3:])) end for i in range(1, 65)]"
    return cte.replace("rs as (select * from docs where corpus = 0)", f"rs as (select corpus, doc, assigned, {w} as v from docs where corpus = 0)").replace("ps as (select * from asg where corpus = 1)", f"ps as (select vec_id, doc, assigned, {w} as v from asg where corpus = 1)")


@query("gap_07_adjusted", f"with {_projected(GAP.format(cap=50))} select {_GAP_COLUMNS} from gap")
def gap_07(spark, sf_dir):
    """GAP-07: the gap of vectors without removed directions, under the assignments of the raw ones."""
    b = Base(spark, sf_dir)
    research = b.documents().where("corpus = 0").withColumn("v", V.without(F.col("v"), _axes()))
    policy = b.assigned.where("corpus = 1").withColumn("v", V.without(F.col("v"), _axes()))
    return rounded(G.semantic_gap(research, policy, b.ids, draw(42, "vec_id")), "r_norm", "p_norm", "gap")


@query("gap_08_decomposition", f"""
with raw as (with {GAP.format(cap=50)} select class_id, gap from gap), adj as (with {_projected(GAP.format(cap=50))} select class_id, gap from gap)
select class_id, round(raw.gap, 6) as raw, round(adj.gap, 6) as adjusted, round(raw.gap - adj.gap, 6) as removed, round((raw.gap - adj.gap) / raw.gap, 6) as share from raw join adj using (class_id)""")
def gap_08(spark, sf_dir):
    """GAP-08: raw less adjusted gap of each class."""
    b = Base(spark, sf_dir)
    research = b.documents().where("corpus = 0").withColumn("v", V.without(F.col("v"), _axes()))
    policy = b.assigned.where("corpus = 1").withColumn("v", V.without(F.col("v"), _axes()))
    adj = G.semantic_gap(research, policy, b.ids, draw(42, "vec_id")).select("class_id", F.col("gap").alias("adjusted"))
    raw = b.gap().select("class_id", F.col("gap").alias("raw"))
    both = raw.join(F.broadcast(adj), "class_id").withColumn("removed", F.col("raw") - F.col("adjusted"))
    return rounded(both.withColumn("share", F.try_divide("removed", F.col("raw"))), "raw", "adjusted", "removed", "share")


@query("gap_10_family_coverage", f"with {DOCS} select family, assigned as class_id, cast(count(*) as bigint) as n, round(count(*) / sum(count(*)) over (partition by family), 6) as share from docs where corpus = 1 group by 1, 2")
def gap_10(spark, sf_dir):
    """GAP-10: coverage of each source family."""
    d = Base(spark, sf_dir).documents("family").where("corpus = 1")
    n = d.groupBy("family", F.col("assigned").alias("class_id")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("family")), 6))


_LADDER = f"""{DOCS}, t as (select tier, draw from (select unnest([20, 40]) as tier), range(0, 5) r(draw)),
rk as (select tier, draw, docs.*, row_number() over (partition by tier, draw order by md5(concat_ws(':', 42 + draw, doc)), doc) as pos from docs, t where corpus = 0),
dr as (select * from rk where pos <= tier),
pr as (select tier, draw, assigned, count(*) / tier as share from dr group by 1, 2, 3)"""


@query("gap_11_sample_stability", f"""
with {_LADDER}, full_ as (select assigned, count(*) / (select count(*) from docs where corpus = 0) as share from docs where corpus = 0 group by 1),
g as (select tier, draw, sum(abs(coalesce(pr.share, 0) - full_.share)) as gap from (select distinct tier, draw from t) cross join full_ left join pr using (tier, draw, assigned) group by 1, 2),
pk as (select * from (select *, row_number() over (partition by assigned, doc order by md5(concat_ws(':', '42', vec_id)), vec_id) as pos from asg where corpus = 1) where pos <= 50),
{unit_means('pk', 'assigned', name='pc')}, {unit_means('dr', 'tier', 'draw', 'assigned', name='rc')},
s as (select tier, draw, rc.c as r, pc.c as p, list_concat([0.0], rc.c[2:]) as ra, list_concat([0.0], pc.c[2:]) as pa from rc join pc using (assigned)),
v as (select tier, draw, avg(1 - list_dot_product(r, p)) as raw, avg(1 - list_dot_product(ra, pa) / sqrt(list_dot_product(ra, ra) * list_dot_product(pa, pa))) as adjusted from s group by 1, 2)
select tier, round(avg(gap), 6) as mean, round(stddev_pop(gap), 6) as sd, round(avg(raw), 6) as raw_mean, round(stddev_pop(raw), 6) as raw_sd, round(avg(adjusted), 6) as adjusted_mean, round(stddev_pop(adjusted), 6) as adjusted_sd
from g left join v using (tier, draw) group by 1""")
def gap_11(spark, sf_dir):
    """GAP-11: by sample size, the distance of sampled profiles to the full one, and the mean gap of sampled centroids to those of the policy side, as they
    are and without the part along a direction, here the first axis."""
    b = Base(spark, sf_dir)
    d = b.documents().where("corpus = 0").select("doc", "assigned", "v")
    full = G.profile(d, b.ids).where("n > 0").select(F.col("class_id").alias("assigned"), F.col("share").alias("whole"))
    s = cut(R.ladder(d, [20, 40], 5, 42, "doc"))
    n = s.groupBy("tier", "draw", "assigned").agg((F.count("*") / F.first("tier")).alias("share"))
    grid = n.select("tier", "draw").distinct().crossJoin(F.broadcast(full))
    g = grid.join(n, ["tier", "draw", "assigned"], "left").groupBy("tier", "draw").agg(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.col("whole"))).alias("gap"))
    policy = R.capped(b.assigned.where("corpus = 1"), ["assigned", "doc"], G.CAP, draw(42, "vec_id"), "vec_id")
    p = G.centroids(policy, "assigned").select("assigned", F.col("centroid").alias("p"))
    c = G.centroids(s, "tier", "draw", "assigned").select("tier", "draw", "assigned", F.col("centroid").alias("r")).join(F.broadcast(p), "assigned")
    less = lambda x: V.unit(F.transform(x, lambda y, i: F.when(i == 0, 0.0).otherwise(y)))
    v = c.select("tier", "draw", (1 - V.dot(F.col("r"), F.col("p"))).alias("raw"), (1 - V.dot(less("r"), less("p"))).alias("adjusted")).groupBy("tier", "draw").agg(F.avg("raw").alias("raw"), F.avg("adjusted").alias("adjusted"))
    both = g.join(v, ["tier", "draw"], "left")
    return both.groupBy("tier").agg(*(F.round(f(x), 6).alias(f"{n}{e}") for x, n in (("gap", ""), ("raw", "raw_"), ("adjusted", "adjusted_")) for f, e in ((F.avg, "mean"), (F.stddev_pop, "sd"))))


@query("gap_13_method_agreement", f"with {SCORED} select corpus, cast(count(*) as bigint) as n, round(avg(cast(assigned = class_id as int)), 6) as agreement from asg group by 1")
def gap_13(spark, sf_dir):
    """GAP-13: agreement of two assignments."""
    a = Base(spark, sf_dir).assigned
    return a.groupBy("corpus").agg(F.count("*").alias("n"), F.round(F.avg((F.col("assigned") == F.col("class_id")).cast("int")), 6).alias("agreement"))


@query("gap_14_lexical_audit", r"""
with a as (select case when quality = 1 then 'good' else 'bad' end as subset, regexp_matches(lower(text), '\b(?:the|and)\b') as m, regexp_matches(lower(text), '\b(?:der|die)\b') as e from documents join labels using (doc_id))
select subset, cast(count(*) as bigint) as n, cast(count(*) filter (m and not e) as bigint) as first_only, cast(count(*) filter (e and not m) as bigint) as second_only, cast(count(*) filter (m and e) as bigint) as both, cast(count(*) filter (not m and not e) as bigint) as neither from a group by 1""")
def gap_14(spark, sf_dir):
    """GAP-14: lexical categories of subsets; a missing text has none."""
    from corpweave.functions.text import lexical_category

    category = lexical_category(F.col("text"), ["the", "and"], ["der", "die"], ("first_only", "second_only"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), category).alias("c"))
    both = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("subset"), "c")
    names = {"first_only": "first_only", "second_only": "second_only", "both": "both", "neither": "neither_unclear"}
    return both.groupBy("subset").agg(F.count("*").alias("n"), *(F.count_if(F.col("c") == v).alias(k) for k, v in names.items()))


@query("gap_16_cross_sensitivity", f"with {', '.join(f'g{c} as (with {GAP.format(cap=c)} select class_id, cast(row_number() over (order by gap desc nulls last, class_id) as int) as r from gap)' for c in (1, 50))} select class_id, g1.r as cap_1, g50.r as cap_50, g1.r - g50.r as moved from g1 join g50 using (class_id)")
def gap_16(spark, sf_dir):
    """GAP-16: ranks of classes across configurations."""
    b = Base(spark, sf_dir)
    rank = F.row_number().over(Window.orderBy(F.col("gap").desc_nulls_last(), "class_id"))
    long = b.gap(1).select("class_id", rank.alias("r"), F.lit("cap_1").alias("c")).unionByName(b.gap(50).select("class_id", rank.alias("r"), F.lit("cap_50").alias("c")))
    wide = long.groupBy("class_id").pivot("c", ["cap_1", "cap_50"]).agg(F.max("r"))
    return wide.withColumn("moved", F.col("cap_1") - F.col("cap_50"))


@query("gap_17_provenance", "select source, cast(count(*) as bigint) as raw, cast(count(distinct trim(text)) as bigint) as distinct_texts, cast(count(quality) as bigint) as labelled from documents left join labels using (doc_id) group by 1")
def gap_17(spark, sf_dir):
    """GAP-17: raw, distinct and labelled counts of each source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.trim("text"), 256).alias("t"))
    both = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("raw"), F.countDistinct("t").alias("distinct_texts"), F.count("quality").alias("labelled"))


@query("gap_18_search_log", "select o_custkey as config, o_orderkey as entry, round(o_totalprice, 2) as score, cast(row_number() over (order by o_totalprice desc, o_orderkey) as int) as place from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) where k = 1 order by o_totalprice desc, o_orderkey limit 20")
def gap_18(spark, sf_dir):
    """GAP-18: the first logged entry of each configuration, ranked by score."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("config")).agg(F.min(F.struct("o_orderkey", "o_totalprice")).alias("m"))
    top = o.select("config", F.col("m.o_orderkey").alias("entry"), F.col("m.o_totalprice").alias("s")).orderBy(F.desc("s"), "entry").limit(20)
    return top.select("config", "entry", F.round("s", 2).alias("score"), F.row_number().over(Window.orderBy(F.desc("s"), "entry")).alias("place"))


@query("gap_19_metric_export", "select o_orderpriority, round(min(o_totalprice), 2) as least, round(max(o_totalprice), 2) as most, round(max_by(o_totalprice, o_orderkey), 2) as final from orders group by 1")
def gap_19(spark, sf_dir):
    """GAP-19: least, greatest and final value of each series."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority")
    return o.agg(F.round(F.min("o_totalprice"), 2).alias("least"), F.round(F.max("o_totalprice"), 2).alias("most"), F.round(F.max_by("o_totalprice", "o_orderkey"), 2).alias("final"))


@query("gap_21_exclusion", f"with {SCORED}, n as (select doc from seg group by doc having count(*) > 3) select cast(count(*) as bigint) as n, round(avg(cast(assigned = class_id as int)), 6) as accuracy from asg where doc not in (select doc from n)")
def gap_21(spark, sf_dir):
    """GAP-21: the metric without rows of repeated parents."""
    a = Base(spark, sf_dir).assigned
    many = a.groupBy("doc").count().where("count > 3")
    return a.join(many, "doc", "left_anti").agg(F.count("*").alias("n"), F.round(F.avg((F.col("assigned") == F.col("class_id")).cast("int")), 6).alias("accuracy"))


@query("gap_22_family_summary", f"""
with {DOCS}, c as (select family, assigned, count(*) as n from docs where corpus = 1 group by 1, 2), r as (select *, row_number() over (partition by family order by n desc, assigned) as k from c)
select family, cast(sum(n) as bigint) as documents, string_agg(cast(assigned as varchar), ',' order by k) filter (k <= 3) as top from r group by 1""")
def gap_22(spark, sf_dir):
    """GAP-22: documents and top three classes of each family."""
    d = Base(spark, sf_dir).documents("family").where("corpus = 1")
    n = d.groupBy("family", "assigned").agg(F.count("*").alias("n"))
    r = n.withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "assigned")))
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", F.col("assigned").cast("string").alias("a")))))
    return r.groupBy("family").agg(F.sum("n").alias("documents"), F.array_join(F.transform(top, lambda x: x["a"]), ",").alias("top"))


@query("gap_23_means", f"with {GAP.format(cap=50)} select round(avg(gap), 6) as mean_gap, round(avg(r_norm), 6) as research_cohesion, round(avg(p_norm), 6) as policy_cohesion from gap")
def gap_23(spark, sf_dir):
    """GAP-23: means over classes of the gap and both cohesions."""
    g = Base(spark, sf_dir).gap()
    return g.agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.avg("r_norm"), 6).alias("research_cohesion"), F.round(F.avg("p_norm"), 6).alias("policy_cohesion"))
