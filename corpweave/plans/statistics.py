"""Statistics queries: associations, intervals and regressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpweave.functions import stats as S
from corpweave.operators import kendall
from corpweave.operators import regression as Reg
from corpweave.operators import relational as R
from corpweave.plans.base import SEG, segments, table
from corpweave.registry import query


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey")


@query("sta_01_pearson", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1")
def sta_01(spark, sf_dir):
    """STA-01: Pearson correlation by group."""
    return _items(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


def rank_sql(column: str, by: str, name: str) -> str:
    return f"rank() over (partition by {by} order by {column}) + (count(*) over (partition by {by}, {column}) - 1) / 2.0 as {name}"


_RANKED = f"select l_returnflag as g, {rank_sql('l_quantity', 'l_returnflag', 'x')}, {rank_sql('l_discount', 'l_returnflag', 'y')}, {rank_sql('l_tax', 'l_returnflag', 'z')} from lineitem"


def _ranked(spark, sf_dir) -> DataFrame:
    d = _items(spark, sf_dir).select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"))
    for column, name in (("a", "x"), ("b", "y"), ("c", "z")):
        d = R.average_rank(d, column, name, ["g"])
    return d


@query("sta_02_spearman", f"select g, round(corr(x, y), 6) as rho from ({_RANKED}) group by 1")
def sta_02(spark, sf_dir):
    """STA-02: Spearman correlation over average ranks."""
    return _ranked(spark, sf_dir).groupBy("g").agg(F.round(F.corr("x", "y"), 6).alias("rho"))


def _nations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("y"))
    return c.join(s, "k")


_NATIONS = "select k, x, y from (select c_nationkey as k, avg(c_acctbal) as x from customer group by 1) join (select s_nationkey as k, avg(s_acctbal) as y from supplier group by 1) using (k)"


@query("sta_03_permutation")
def sta_03(spark, sf_dir):
    """STA-03: permutation p-values of both correlations over a table of classes."""
    rows = _nations(spark, sf_dir).orderBy("k").collect()  # a row for each class
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    out = [(name, *S.permutation_p(x, y, rank=rank)) for name, rank in (("pearson", False), ("spearman", True))]
    return spark.createDataFrame(out, "kind string, r double, p double")


@query("sta_04_partial_spearman", f"""
with r as ({_RANKED}), c as (select g, corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz from r group by 1)
select g, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) as rho from c""")
def sta_04(spark, sf_dir):
    """STA-04: Spearman correlation of what a third rank leaves over; residuals need no second pass."""
    c = _ranked(spark, sf_dir).groupBy("g").agg(F.corr("x", "y").alias("xy"), F.corr("x", "z").alias("xz"), F.corr("y", "z").alias("yz"))
    return c.select("g", F.round((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)), 6).alias("rho"))


@query("sta_05_kendall", f"""
with n as ({_NATIONS}), p as (select sign(a.x - b.x) as sx, sign(a.y - b.y) as sy from n a join n b on a.k < b.k)
select round(sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))), 6) as tau from p""")
def sta_05(spark, sf_dir):
    """STA-05: Kendall's tau-b over a table of classes."""
    n = _nations(spark, sf_dir)
    a, b = n.toDF("k", "x", "y"), F.broadcast(n.toDF("l", "u", "v"))  # a row for each class
    p = a.join(b, F.col("k") < F.col("l")).select(F.signum(F.col("x") - F.col("u")).alias("sx"), F.signum(F.col("y") - F.col("v")).alias("sy"))
    return p.agg(F.round(F.sum(F.col("sx") * F.col("sy")) / F.sqrt(F.sum(F.abs("sx")) * F.sum(F.abs("sy"))), 6).alias("tau"))


@query("sta_05_kendall_orders", """
with o as (select o_orderkey as k, floor(o_totalprice / 1000) as x, o_custkey % 50 as y from orders),
p as (select sum(sign(a.x - b.x) * sign(a.y - b.y)) as s, sum(abs(sign(a.x - b.x))) as nx, sum(abs(sign(a.y - b.y))) as ny from o a join o b on a.k < b.k)
select round(s / sqrt(nx * ny), 6) as tau from p""")
def sta_05_orders(spark, sf_dir):
    """STA-05: Kendall's tau-b over all orders, with ties, by blocks of both orders instead of all pairs."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 50).alias("y"))
    tau = kendall.tau_b(o, "x", "y", "o_orderkey")
    return spark.createDataFrame([(None if tau is None else round(tau, 6),)], "tau double")


@query("sta_06_fisher", """
with r as (select l_linenumber, corr(l_quantity, l_tax) as r, count(*) as n from lineitem group by 1), z as (select *, atanh(greatest(-0.999, least(0.999, r))) as z from r)
select l_linenumber, round(tanh(z - 1.96 / sqrt(n - 3)), 6) as low, round(tanh(z + 1.96 / sqrt(n - 3)), 6) as high from z where n >= 4""")
def sta_06(spark, sf_dir):
    """STA-06: Fisher's interval of a correlation."""
    r = _items(spark, sf_dir).groupBy("l_linenumber").agg(F.corr("l_quantity", "l_tax").alias("r"), F.count("*").alias("n"))
    low, high = S.fisher_low_high(F.col("r"), F.col("n"))
    return r.where("n >= 4").select("l_linenumber", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("sta_07_wilson", """
with c as (select lang, count(*) as n, count(*) filter (n_chars > 1000) as k from documents group by 1), p as (select *, k / n as p, 1.96 * 1.96 / n as w from c)
select lang, round(((p + w / 2) - 1.96 * sqrt(p * (1 - p) / n + w / (4 * n))) / (1 + w), 6) as low, round(((p + w / 2) + 1.96 * sqrt(p * (1 - p) / n + w / (4 * n))) / (1 + w), 6) as high from p""")
def sta_07(spark, sf_dir):
    """STA-07: score interval of a share."""
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("k"))
    low, high = S.wilson_low_high(F.col("k"), F.col("n"))
    return c.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("sta_08_binomial", """
with c as (select lang, count(*) as n, count(*) filter (n_chars > 1000) as k from documents group by 1), i as (select lang, k, n, unnest(range(k, n + 1)) as i from c)
select lang, cast(any_value(k) as bigint) as k, cast(any_value(n) as bigint) as n, round(least(1, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)))), 8) as p from i group by 1""")
def sta_08(spark, sf_dir):
    """STA-08: exact one-sided binomial test of each language's share of long texts against one half."""
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("k")).orderBy("lang").collect()
    return spark.createDataFrame([(r.lang, r.k, r.n, round(S.binomial_tail(r.k, r.n), 8)) for r in c], "lang string, k long, n long, p double")


_PREDICTORS = ["l_discount", "l_tax", "l_linenumber", "l_quantity"]


@query("sta_09_four_predictors", " union all ".join(f"select '{c}' as predictor, round(corr({c}, l_extendedprice), 6) as r from lineitem" for c in _PREDICTORS))
def sta_09(spark, sf_dir):
    """STA-09: four predictors of one outcome, in one pass."""
    one = _items(spark, sf_dir).agg(*(F.round(F.corr(c, "l_extendedprice"), 6).alias(c) for c in _PREDICTORS))
    return one.unpivot([], _PREDICTORS, "predictor", "r")


@query("sta_10_configurations", " union all ".join(f"select l_returnflag as config, '{c}' as predictor, round(corr({c}, l_extendedprice), 6) as r from lineitem group by 1" for c in _PREDICTORS))
def sta_10(spark, sf_dir):
    """STA-10: predictors by configuration."""
    one = _items(spark, sf_dir).groupBy(F.col("l_returnflag").alias("config")).agg(*(F.round(F.corr(c, "l_extendedprice"), 6).alias(c) for c in _PREDICTORS))
    return one.unpivot(["config"], _PREDICTORS, "predictor", "r")


@query("sta_11_verdict", "with r as (select l_linenumber, corr(l_quantity, l_extendedprice) - 0.5 * (l_linenumber - 2) as r from lineitem group by 1) select l_linenumber, case when r > 0.3 then 'positive' when r < -0.3 then 'negative' else 'weak' end as verdict from r")
def sta_11(spark, sf_dir):
    """STA-11: verdict by threshold."""
    r = _items(spark, sf_dir).groupBy("l_linenumber").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))
    return r.select("l_linenumber", S.verdict(F.col("r") - 0.5 * (F.col("l_linenumber") - 2)).alias("verdict"))


@query("sta_12_ols", """
with s as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, regr_r2(l_extendedprice, l_quantity) as r2 from lineitem)
select 'const' as term, round(a, 3) as beta, round(r2, 6) as r2 from s union all select 'l_quantity', round(b, 3), round(r2, 6) from s""")
def sta_12(spark, sf_dir):
    """STA-12: least squares with cluster-robust errors; the oracle knows the coefficients, a test the errors."""
    fit = Reg.least_squares(_items(spark, sf_dir), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return Reg.as_table(spark, fit).select("term", F.round("beta", 3).alias("beta"), F.round("r2", 6).alias("r2"))


@query("sta_13_wls", """
with s as (select sum(w) as w, sum(w * x) as x, sum(w * y) as y, sum(w * x * x) as xx, sum(w * x * y) as xy from (select l_linenumber as w, l_quantity as x, l_extendedprice as y from lineitem)),
b as (select (w * xy - x * y) / (w * xx - x * x) as b, x, y, w from s)
select 'const' as term, round((y - b * x) / w, 3) as beta from b union all select 'l_quantity', round(b, 3) from b""")
def sta_13(spark, sf_dir):
    """STA-13: weighted least squares."""
    fit = Reg.least_squares(_items(spark, sf_dir), "l_extendedprice", ["l_quantity"], "l_suppkey", "l_linenumber")
    return Reg.as_table(spark, fit).select("term", F.round("beta", 3).alias("beta"))


@query("sta_14_design_matrix", "select l_orderkey, l_linenumber, cast(l_returnflag = 'N' as double) as flag_n, cast(l_returnflag = 'R' as double) as flag_r, l_quantity * cast(l_returnflag = 'N' as double) as q_n, round(sign(l_extendedprice - 1000) * ln(1 + abs(l_extendedprice - 1000)), 6) as y from lineitem")
def sta_14(spark, sf_dir):
    """STA-14: dummies, an interaction and a signed-log outcome; constant columns are dropped."""
    d, names = Reg.dummies(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0)), "l_returnflag", ["A", "N", "R"], "flag_")
    d = d.withColumn("q_n", F.col("l_quantity") * F.col("flag_N"))
    x = F.col("l_extendedprice") - 1000
    kept = Reg.varied(d, ["one", *names, "q_n"])
    return d.select("l_orderkey", "l_linenumber", *(F.col(c).alias(c.lower()) for c in kept), F.round(F.signum(x) * F.log1p(F.abs(x)), 6).alias("y"))


@query("sta_15_specifications")
def sta_15(spark, sf_dir):
    """STA-15: a grid of specifications, each a least-squares fit."""
    d, names = Reg.dummies(_items(spark, sf_dir), "l_returnflag", ["A", "N", "R"], "flag_")
    specs = {f"{p}{' fe' if fe else ''}{' w' if w else ''}": (p, fe, w) for p in _PREDICTORS for fe in (False, True) for w in (None, "l_quantity") if not (w and p == "l_quantity")}
    d = d.cache()
    try:
        rows = []
        for label, (p, fe, w) in specs.items():
            f = Reg.least_squares(d, "l_extendedprice", [p, *(names if fe else [])], "l_suppkey", w)
            rows.append((label, p, float(f.beta[1]), float(f.error[1]), float(f.p[1]), float(f.r2), f.n))
    finally:
        d.unpersist()
    return spark.createDataFrame(rows, "spec string, predictor string, beta double, error double, p double, r2 double, n long")


def _number(*parts: str) -> str:
    """A number below 2^32 from the MD5 of the parts, in Spark's SQL."""
    return f"cast(conv(substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8), 16, 10) as bigint)"


def _number_sql(*parts: str) -> str:
    """The same in DuckDB's SQL."""
    return f"cast('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) as bigint)"


@query("smp_10_cluster_bootstrap", f"""
with s as (select l_suppkey, row_number() over (order by l_suppkey) - 1 as place, count(*) as n, sum(l_quantity) as x, sum(l_extendedprice) as y, sum(l_quantity * l_quantity) as xx, sum(l_quantity * l_extendedprice) as xy from lineitem group by 1),
t as (select draw, {_number_sql("'42'", "draw", "slot")} % (select count(*) from s) as place from range(0, 500) a(draw), range(0, (select count(*) from s)) b(slot)),
m as (select draw, place, count(*) as k from t group by 1, 2), d as (select draw, sum(k * n) as n, sum(k * x) as x, sum(k * y) as y, sum(k * xx) as xx, sum(k * xy) as xy from m join s using (place) group by 1),
b as (select (n * xy - x * y) / (n * xx - x * x) as b from d)
select round(avg(b), 3) as mean, round(stddev_pop(b), 3) as sd, round(quantile_cont(b, 0.025), 3) as low, round(quantile_cont(b, 0.975), 3) as high from b""")
def smp_10(spark, sf_dir):
    """SMP-10: slopes over 500 draws of suppliers with replacement. Sums for each supplier are taken once; a draw is a sum
    of its suppliers' sums, each as often as a hash of draw and slot names it."""
    from corpweave.operators.ranges import global_index

    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    s = _items(spark, sf_dir).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    s = global_index(s, "l_suppkey", "at").drop("l_suppkey")
    size = s.count()
    slots = spark.range(500 * size).selectExpr(f"id div {max(size, 1)} as draw", f"id % {max(size, 1)} as slot")
    times = slots.select("draw", (F.expr(_number("'42'", "draw", "slot")) % max(size, 1)).alias("at")).groupBy("draw", "at").agg(F.count("*").alias("k"))
    d = times.join(s, "at").groupBy("draw").agg(*(F.sum(F.col("k") * F.col(c)).alias(c) for c in ("n", "x", "y", "xx", "xy")))
    b = d.select(((F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("n") * F.col("xx") - F.col("x") * F.col("x"))).alias("b"))
    return b.agg(F.round(F.avg("b"), 3).alias("mean"), F.round(F.stddev_pop("b"), 3).alias("sd"), *(F.round(F.percentile("b", F.lit(p)), 3).alias(n) for n, p in (("low", 0.025), ("high", 0.975))))


#: Limits of a Poisson count of mean one: how many lie below a uniform number from zero to one is the count.
_POISSON = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(8)])


@query("smp_11_pooled_bootstrap", f"""
with h as (select event_id % 2 as side, value, part, md5(concat_ws(':', '7', event_id, part)) as h from events, range(0, 63) p(part)),
u as (select part * 8 + place as draw, side, value, cast('0x' || substr(h, cast(4 * place + 1 as int), 4) as int) / 65536.0 as u from h, range(0, 8) a(place)),
k as (select draw, side, value, {' + '.join(f'cast(u > {float(c)!r} as int)' for c in _POISSON)} as k from u where draw < 500),
m as (select draw, sum(k * value) filter (side = 0) / sum(k) filter (side = 0) - sum(k * value) filter (side = 1) / sum(k) filter (side = 1) as d from k group by 1)
select round(avg(d), 6) as mean, round(quantile_cont(d, 0.025), 6) as low, round(quantile_cont(d, 0.975), 6) as high, round(avg(cast(d > 0 as int)), 6) as share_above from m""")
def smp_11(spark, sf_dir):
    """SMP-11: 500 resamples of a difference of means, by Poisson counts that each row draws from hashes of its own key, eight
    to a hash. A task adds up what its rows give to each draw; rows are not multiplied."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("value"), (F.col("event_id") % 2).alias("side")).where("side in (0, 1)")
    counts = (np.arange(1 << 16)[:, None] / 65536.0 > _POISSON).sum(axis=1).astype(float)

    def drawn(batches):
        total = np.zeros((63 * 8, 6))
        for batch in batches:
            ids, value, side = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy()
            there = np.asarray(value.is_valid()).astype(float)
            value = value.fill_null(0.0).to_numpy()
            of = np.stack([x for k in (0, 1) for x in ((side == k) * value, (side == k) * 1.0, (side == k) * there)], axis=1)
            for part in range(63):
                tail = b":%d" % part
                h = np.frombuffer(b"".join([hashlib.md5(b"7:%d" % i + tail).digest() for i in ids]), ">u2").reshape(-1, 8)
                total[8 * part : 8 * part + 8] += counts[h].T @ of
        yield pa.RecordBatch.from_arrays([pa.array(range(500)), *(pa.array(x) for x in total[:500].T)], names=["draw", "s0", "k0", "n0", "s1", "k1", "n1"])

    names = ["s0", "k0", "n0", "s1", "k1", "n1"]
    parts = e.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(drawn, "draw long, " + ", ".join(f"{c} double" for c in names))
    d = parts.groupBy("draw").agg(*(F.sum(c).alias(c) for c in names))
    m = d.select(*(F.when(F.col(f"n{k}") > 0, F.try_divide(f"s{k}", f"k{k}")).alias(f"m{k}") for k in (0, 1)))
    g = m.select((F.col("m0") - F.col("m1")).alias("d"))
    return g.agg(F.round(F.avg("d"), 6).alias("mean"), *(F.round(F.percentile("d", F.lit(p)), 6).alias(n) for n, p in (("low", 0.025), ("high", 0.975))), F.round(F.avg((F.col("d") > 0).cast("int")), 6).alias("share_above"))


@query("sta_16_register_score")
def sta_16(spark, sf_dir):
    """STA-16: first principal component of standardised text features, its sign so that it rises with sentence length."""
    from corpweave.functions.text import linguistic_rates

    names = ["hedge_rate", "deontic_rate", "passive_proxy_rate", "first_person_rate", "nominal_rate", "mean_sentence_length"]
    f = table(spark, sf_dir, "documents").select("doc_id", linguistic_rates(F.col("text")).alias("r")).select("doc_id", *(F.coalesce(f"r.{c}", F.lit(0.0)).alias(c) for c in names))
    m = f.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names))).first()
    sd = np.array([m[f"s{i}"] or 0.0 for i in range(len(names))])
    inv = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    corr = np.array([[m[f"c{i}_{j}"] for j in range(len(names))] for i in range(len(names))]) * inv[:, None] * inv[None]
    w = np.linalg.eigh(corr)[1][:, -1]
    w = w if (corr @ w)[-1] >= 0 else -w
    score = sum(((F.col(c) - float(m[f"m{i}"])) * float(inv[i] * w[i]) for i, c in enumerate(names)), F.lit(0.0))
    return f.select("doc_id", score.alias("score"))


@query("sta_17_density", """
with b as (select lang, n_chars as x, count(*) as n from documents group by 1, 2), t as (select lang, count(*) as total, 1.06 * stddev_samp(n_chars) * pow(count(*), -0.2) as h from documents group by 1), g as (select cast(50 * i as double) as at_x from range(0, 100) r(i))
select lang, at_x, round(sum(n * exp(-0.5 * pow((at_x - x) / h, 2))) / any_value(total * h) / sqrt(2 * pi()), 9) as density from g, b join t using (lang) group by lang, at_x""")
def sta_17(spark, sf_dir):
    """STA-17: Gaussian density of lengths on a grid, from counts of each length."""
    d = table(spark, sf_dir, "documents")
    b = d.groupBy("lang", F.col("n_chars").alias("x")).agg(F.count("*").alias("n"))
    t = d.groupBy("lang").agg(F.count("*").alias("total"), (1.06 * F.stddev_samp("n_chars") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"))
    grid = F.broadcast(spark.range(100).select((50.0 * F.col("id")).alias("at_x")))
    k = b.join(F.broadcast(t), "lang").crossJoin(grid).withColumn("k", F.col("n") * F.exp(-0.5 * F.pow((F.col("at_x") - F.col("x")) / F.col("h"), 2)))
    return k.groupBy("lang", "at_x").agg(F.round(F.sum("k") / F.max(F.col("total") * F.col("h")) / F.sqrt(2 * F.pi()), 9).alias("density"))


_WITHIN = f"select {{by}} as g, {rank_sql('l_quantity', '{by}', 'x')}, {rank_sql('l_tax', '{by}', 'y')} from lineitem"


@query("sta_18_within_class", f"with r as ({_WITHIN.format(by='l_linenumber')}), c as (select g, count(*) as n, corr(x, y) as rho from r group by 1 having count(*) >= 4) select cast(count(*) as bigint) as classes, cast(count(*) filter (rho > 0) as bigint) as positive, cast(count(*) filter (rho < 0) as bigint) as negative, cast(count(*) filter (abs(rho) * sqrt(n - 1) > 1.96) as bigint) as significant from c")
def sta_18(spark, sf_dir):
    """STA-18: associations within each class, and how many have each sign."""
    d = _items(spark, sf_dir).select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"))
    d = R.average_rank(R.average_rank(d, "a", "x", ["g"]), "b", "y", ["g"])
    c = d.groupBy("g").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho")).where("n >= 4")
    return c.agg(F.count("*").alias("classes"), F.count_if(F.col("rho") > 0).alias("positive"), F.count_if(F.col("rho") < 0).alias("negative"), F.count_if(F.abs("rho") * F.sqrt(F.col("n") - 1) > 1.96).alias("significant"))


@query("sta_19_score_distance", f"""
with {SEG}, d as (select corpus, v[64] as score, sqrt(v[1] * v[1] + v[2] * v[2]) as removed from seg), a as (select -1 as corpus, score, removed from d union all select * from d),
r as (select corpus, {rank_sql('score', 'corpus', 'x')}, {rank_sql('removed', 'corpus', 'y')} from a)
select corpus, round(corr(x, y), 6) as rho from r group by 1""")
def sta_19(spark, sf_dir):
    """STA-19: a score against the length of what was removed, pooled and within corpora."""
    s = segments(spark, sf_dir).select("corpus", F.col("v")[63].alias("score"), F.sqrt(F.col("v")[0] ** 2 + F.col("v")[1] ** 2).alias("removed"))
    a = s.unionByName(s.withColumn("corpus", F.lit(-1).cast("long")))
    r = R.average_rank(R.average_rank(a, "score", "x", ["corpus"]), "removed", "y", ["corpus"])
    return r.groupBy("corpus").agg(F.round(F.corr("x", "y"), 6).alias("rho"))


@query("gap_12_rank_stability", f"""
with {SEG}, full_ as (select class_id, count(*) as whole from seg group by 1), t as (select tier, draw from (select unnest([100, 300]) as tier), range(0, 5) r(draw)),
k as (select tier, draw, class_id, row_number() over (partition by tier, draw order by md5(concat_ws(':', 42 + draw, vec_id)), vec_id) as pos from seg, t),
n as (select tier, draw, class_id, count(*) as n from k where pos <= tier group by 1, 2, 3), b as (select concat(tier, '_', draw) as g, tier, n, whole from n join full_ using (class_id)),
r as (select g, tier, {rank_sql('n', 'g', 'x')}, {rank_sql('whole', 'g', 'y')} from b), c as (select tier, corr(x, y) as rho from r group by tier, g)
select tier, round(avg(rho), 6) as mean, round(stddev_pop(rho), 6) as sd, round(min(rho), 6) as least, round(max(rho), 6) as most from c group by 1""")
def gap_12(spark, sf_dir):
    """GAP-12: rank correlation of each draw's class shares with the full table's."""
    s = segments(spark, sf_dir).select("vec_id", "class_id")
    full = s.groupBy("class_id").agg(F.count("*").alias("whole"))
    draws = R.ladder(s, [100, 300], 5, 42, "vec_id").groupBy("tier", "draw", "class_id").agg(F.count("*").alias("n"))
    both = draws.join(F.broadcast(full), "class_id")
    r = R.average_rank(R.average_rank(both, "n", "x", ["tier", "draw"]), "whole", "y", ["tier", "draw"])
    rho = r.groupBy("tier", "draw").agg(F.corr("x", "y").alias("rho"))
    return rho.groupBy("tier").agg(*(F.round(f("rho"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"), (F.min, "least"), (F.max, "most"))))
