"""Joins, aggregates, windows, top-k, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpweave.operators import relational as R
from corpweave.plans.base import SEG, draw, segments, table
from corpweave.operators.quantiles import quantiles
from corpweave.registry import query


def _t(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


_orders, _items, _docs, _labels, _events = map(_t, ("orders", "lineitem", "documents", "labels", "events"))


# joins


@query("jon_01_keyed_zip", "select d.doc_id, quality, n_chars from documents d join labels l on d.doc_id = l.doc_id")
def jon_01(spark, sf_dir):
    """JON-01: what the reference zips by position is a join by key."""
    return _docs(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id").select("doc_id", "quality", "n_chars")


@query("jon_02_join_or_fail", "select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey")
def jon_02(spark, sf_dir):
    """JON-02: inner join that fails on a key without a match."""
    orders = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return R.join_or_fail(_items(spark, sf_dir).select("l_orderkey", "l_linenumber"), orders, "l_orderkey", "o_custkey")


@query("jon_03_left_fallback", "select d.doc_id, coalesce(cast(quality as varchar), 'own_' || d.doc_id) as key from documents d left join labels l on d.doc_id = l.doc_id")
def jon_03(spark, sf_dir):
    """JON-03: left join; a missing key gets one of its own."""
    both = _docs(spark, sf_dir).select("doc_id").join(_labels(spark, sf_dir).select("doc_id", "quality"), "doc_id", "left")
    return both.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.concat(F.lit("own_"), "doc_id")).alias("key"))


_BY = "select {0} as k, round(avg(l_extendedprice), 6) as m from lineitem group by 1"


@query("jon_04_three_way_classes", """
with a as (select c_nationkey as k, count(*) as n from customer group by 1), b as (select s_nationkey as k, count(*) as n from supplier group by 1)
select a.k as k, n_name, cast(a.n as bigint) as customers, cast(b.n as bigint) as suppliers from a join b on a.k = b.k join nation on a.k = n_nationkey""")
def jon_04(spark, sf_dir):
    """JON-04: classes common to three results."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return a.join(b, "k").join(n, "k")


@query("jon_05_class_dimension", "with n as (select label, count(*) as c from embeddings group by 1) select cast(k as bigint) as k, n.c as n from range(0, 17) r(k) left join n on n.label = k")
def jon_05(spark, sf_dir):
    """JON-05: all classes stay; one without rows has no count."""
    n = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("k")).agg(F.count("*").alias("n"))
    return spark.range(17).withColumnRenamed("id", "k").join(n, "k", "left")


@query("jon_06_copartition", "select e.user_id, cast(count(*) as bigint) as n, cast(count(distinct o_orderkey) as bigint) as n_orders from events e join orders on user_id = o_custkey group by 1")
def jon_06(spark, sf_dir):
    """JON-06: two large sides joined on one key; the aggregate reuses the join's partitioning."""
    e = _events(spark, sf_dir).select("user_id")
    o = _orders(spark, sf_dir).select(F.col("o_custkey").cast("long").alias("user_id"), "o_orderkey")
    return e.join(o, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("jon_07_semi_join", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def jon_07(spark, sf_dir):
    """JON-07: rows whose key is in a chosen set."""
    chosen = _orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'")
    return _items(spark, sf_dir).join(chosen, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("jon_08_anti_join", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def jon_08(spark, sf_dir):
    """JON-08: work whose key is not done yet."""
    return _docs(spark, sf_dir).select("doc_id").join(_labels(spark, sf_dir), "doc_id", "left_anti")


@query("jon_11_functional_dependency", f"with {SEG} select doc, cast(count(distinct family) as bigint) as families from seg group by doc having count(distinct family) > 1")
def jon_11(spark, sf_dir):
    """JON-11: documents of more than one family; there must be none."""
    return R.dependency_violations(segments(spark, sf_dir), "doc", "family", "families")


@query("jon_12_bin_lookup", """
with s as (select c_custkey as k, sum(n) over (order by c_custkey) - n as lo, sum(n) over (order by c_custkey) as hi from (select c_custkey, count(o_orderkey) as n from customer join orders on c_custkey = o_custkey group by 1)),
r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders)
select o_orderkey, k from r join s on pos >= lo and pos < hi""")
def jon_12(spark, sf_dir):
    """JON-12: owner of a global row by start offsets; the range lookup goes through equal buckets."""
    from corpweave.operators.ranges import bin_lookup, global_index, running_offsets

    counts = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    rows = global_index(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", "at")
    return bin_lookup(rows, "at", running_offsets(counts, "k", "n"), "lo", "hi").select("o_orderkey", "k")


# aggregates


@query("agg_01_hash_counts", """
with n as (select label, count(*) as c from embeddings group by 1)
select cast(k as bigint) as k, coalesce(c, 0) as n, round(coalesce(c, 0) / sum(c) over (), 6) as share from range(0, 17) r(k) left join n on label = k""")
def agg_01(spark, sf_dir):
    """AGG-01: counts and shares with all classes present."""
    return R.class_shares(table(spark, sf_dir, "embeddings"), "label", range(17))


@query("agg_02_weighted_counts", "select l_suppkey, round(sum(l_extendedprice), 4) as total, round(avg(l_extendedprice), 6) as mean from lineitem group by 1")
def agg_02(spark, sf_dir):
    """AGG-02: sum and mean of a weight by class."""
    return _items(spark, sf_dir).groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 4).alias("total"), F.round(F.avg("l_extendedprice"), 6).alias("mean"))


@query("agg_03_column_means", f"with {SEG}, x as (select i, v[i] as y from seg, range(1, 65) r(i)) select cast(i - 1 as int) as pos, round(avg(y), 6) as mean from x group by i")
def agg_03(spark, sf_dir):
    """AGG-03: means of a matrix's columns."""
    m = R.vector_mean(segments(spark, sf_dir), "v").select(F.posexplode("mean").alias("pos", "mean"))
    return m.select("pos", F.round("mean", 6).alias("mean"))


@query("agg_04_document_means", f"with {SEG}, x as (select doc, i, avg(v[i]) as y, count(*) as n from seg, range(1, 65) r(i) group by doc, i) select doc, max(n) as n, round(sum(y * y), 6) as squared from x group by doc")
def agg_04(spark, sf_dir):
    """AGG-04: mean vector and number of segments of every document."""
    m = R.vector_mean(segments(spark, sf_dir), "v", "doc")
    return m.select("doc", "n", F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


@query("agg_05_partial_final", "select l_linestatus, l_returnflag, cast(count(*) as bigint) as n, round(sum(l_quantity), 2) as quantity from lineitem group by 1, 2")
def agg_05(spark, sf_dir):
    """AGG-05: partial sums on each task before the shuffle."""
    return _items(spark, sf_dir).groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("agg_07_distinct", "select source, cast(count(distinct text) as bigint) as n_texts, cast(count(distinct lang) as bigint) as n_langs from documents group by 1")
def agg_07(spark, sf_dir):
    """AGG-07: exact distinct counts; texts are counted by their digests."""
    d = _docs(spark, sf_dir).select("source", F.sha2("text", 256).alias("t"), "lang")
    return d.groupBy("source").agg(F.countDistinct("t").alias("n_texts"), F.countDistinct("lang").alias("n_langs"))


@query("agg_08_counts_unknown", "select coalesce(case when doc_id % 7 > 0 then source end, 'unknown') as source, cast(count(*) as bigint) as n from documents group by 1")
def agg_08(spark, sf_dir):
    """AGG-08: rows by key, missing ones as unknown."""
    k = F.coalesce(F.when(F.col("doc_id") % 7 > 0, F.col("source")), F.lit("unknown"))
    return _docs(spark, sf_dir).groupBy(k.alias("source")).agg(F.count("*").alias("n"))


@query("agg_09_conditional_counts", "select source, cast(count(*) filter (n_chars >= 500) as bigint) as long_texts, cast(count(*) filter (lang = 'en' and n_chars < 500) as bigint) as short_english from documents group by 1")
def agg_09(spark, sf_dir):
    """AGG-09: counts where a predicate holds."""
    return _docs(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("n_chars") >= 500).alias("long_texts"), F.count_if((F.col("lang") == "en") & (F.col("n_chars") < 500)).alias("short_english"))


@query("agg_10_confusion", "select quality, cast(count(*) filter (toxic = 0) as bigint) as toxic_0, cast(count(*) filter (toxic = 1) as bigint) as toxic_1 from labels group by 1")
def agg_10(spark, sf_dir):
    """AGG-10: class by class counts, zeros included."""
    p = _labels(spark, sf_dir).groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0)
    return p.select("quality", F.col("0").alias("toxic_0"), F.col("1").alias("toxic_1"))


@query("agg_11_collect_set", "select l_suppkey, string_agg(distinct l_linestatus, ',' order by l_linestatus) as modes from lineitem group by 1")
def agg_11(spark, sf_dir):
    """AGG-11: sorted set of classes of each key."""
    return _items(spark, sf_dir).groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("modes"))


@query("agg_12_moments", "select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, min(value) as least, max(value) as most from events group by 1")
def agg_12(spark, sf_dir):
    """AGG-12: mean, population deviation, least and greatest."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))


_P = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.025, 0.975]


@query("agg_13_percentiles", f"select lang, {', '.join(f'round(quantile_cont(n_chars, {p}), 6) as p{int(p * 1000)}' for p in _P)} from documents group by 1")
def agg_13(spark, sf_dir):
    """AGG-13: exact percentiles with linear interpolation, from counts of each length."""
    counts = _docs(spark, sf_dir).groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    p = counts.groupBy("lang").agg(F.expr(f"percentile(n_chars, array({', '.join(map(str, _P))}), n)").alias("p"))
    return p.select("lang", *(F.round(F.col("p")[i], 6).alias(f"p{int(x * 1000)}") for i, x in enumerate(_P)))


@query("agg_14_median", "select o_orderpriority, round(median(o_totalprice), 6) as m from orders group by 1")
def agg_14(spark, sf_dir):
    """AGG-14: exact median, by histogram selection."""
    return quantiles(_orders(spark, sf_dir), "o_orderpriority", "o_totalprice", {"m": 0.5}).withColumn("m", F.round("m", 6))


@query("agg_17_corpus_summary", f"""
with {SEG}, d as (select corpus, doc, count(*) as n from seg group by 1, 2)
select corpus, cast(count(*) as bigint) as documents, cast(sum(n) as bigint) as segments, cast(count(*) filter (n > 1) as bigint) as multi, cast(max(n) as bigint) as most from d group by 1""")
def agg_17(spark, sf_dir):
    """AGG-17: documents, segments, documents of many segments."""
    d = segments(spark, sf_dir).groupBy("corpus", "doc").agg(F.count("*").alias("n"))
    return d.groupBy("corpus").agg(F.count("*").alias("documents"), F.sum("n").alias("segments"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("most"))


@query("agg_18_grouping_sets", f"with {SEG} select case when grouping(family) = 1 then -1 else family end as family, class_id, cast(count(*) as bigint) as n from seg group by grouping sets ((family, class_id), (class_id))")
def agg_18(spark, sf_dir):
    """AGG-18: the same metric for every family and for all of them, in one pass."""
    segments(spark, sf_dir).createOrReplaceTempView("corpweave_segments")
    return spark.sql("select if(grouping(family) = 1, -1, family) as family, class_id, count(*) as n from corpweave_segments group by grouping sets ((family, class_id), (class_id))")


@query("agg_19_truncation_share", """
with a as (select n_chars, case when n_chars > 2000 then 1.0 else 0.0 end as over from documents),
s as (select k * 10 as k, (select avg(case when n_chars <= k * 10 then 1.0 else 0.0 end) from documents) as share from range(0, 100000) r(k))
select round(avg(over), 6) as share_over, (select cast(min(k) as bigint) from s where share >= 0.99) as keeps from a""")
def agg_19(spark, sf_dir):
    """AGG-19: share over a limit, and the smallest multiple of ten that keeps 99 %."""
    steps = _docs(spark, sf_dir).groupBy((F.ceil(F.col("n_chars") / 10) * 10).alias("k")).agg(F.count("*").alias("n"), F.sum((F.col("n_chars") > 2000).cast("long")).alias("over"))
    w = Window.orderBy("k")
    upto = steps.select("k", "n", "over", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return upto.agg(F.round(F.sum("over") / F.max("total"), 6).alias("share_over"), F.min(F.when(F.col("upto") >= 0.99 * F.col("total"), F.col("k"))).alias("keeps"))


_PRED = "case when (doc_id * 7) % 10 < 8 then quality else 1 - quality end"


@query("agg_20_f1", f"""
with p as (select quality as truth, {_PRED} as pred from labels),
c as (select k, count(*) filter (truth = k and pred = k) as tp, count(*) filter (truth <> k and pred = k) as fp, count(*) filter (truth = k and pred <> k) as fn from p, range(0, 2) r(k) group by k),
f as (select *, case when 2 * tp + fp + fn = 0 then 0 else 2.0 * tp / (2 * tp + fp + fn) end as f1 from c)
select round(avg(f1), 6) as macro_f1, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1, round(min(f1), 6) as worst from f""")
def agg_20(spark, sf_dir):
    """AGG-20: F1 of each class, macro and micro."""
    p = _labels(spark, sf_dir).select(F.col("quality").alias("truth"), F.expr(_PRED).alias("pred"))
    f = R.one_vs_rest(p, "truth", "pred", range(2))
    return f.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(2.0 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), 6).alias("micro_f1"), F.round(F.min("f1"), 6).alias("worst"))


@query("agg_21_two_by_two", f"""
with p as (select quality as truth, {_PRED} as pred from labels)
select cast(k as int) as class_id, cast(count(*) filter (truth = k and pred = k) as bigint) as tp, cast(count(*) filter (truth <> k and pred = k) as bigint) as fp,
  cast(count(*) filter (truth = k and pred <> k) as bigint) as fn, cast(count(*) filter (truth <> k and pred <> k) as bigint) as tn,
  round(count(*) filter (truth = k and pred = k) / greatest(count(*) filter (pred = k), 1), 6) as precision, round(count(*) filter (truth = k and pred = k) / greatest(count(*) filter (truth = k), 1), 6) as recall
from p, range(0, 2) r(k) group by k""")
def agg_21(spark, sf_dir):
    """AGG-21: two by two counts of each class, precision and recall, zero where undefined."""
    p = _labels(spark, sf_dir).select(F.col("quality").alias("truth"), F.expr(_PRED).alias("pred"))
    return R.one_vs_rest(p, "truth", "pred", range(2)).select("class_id", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("agg_22_repeated_parents", "select l_orderkey, cast(count(*) as bigint) as n, cast(count(distinct l_linestatus) as bigint) as modes from lineitem group by 1 having count(*) > 1")
def agg_22(spark, sf_dir):
    """AGG-22: parents of more than one row."""
    g = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linestatus").alias("modes"))
    return g.where("n > 1")


# windows


@query("win_01_first_by_priority", """
with a as (select doc_id, source, trim(text) as t, case source when 'src3' then 0 when 'src7' then 1 else 2 end as pr from documents)
select doc_id, source from (select *, row_number() over (partition by t order by pr, doc_id) as k from a) where k = 1""")
def win_01(spark, sf_dir):
    """WIN-01: of equal texts the first by priority of its source stays. Aggregated by digest, so that a text with very
    many copies is reduced on each task before the shuffle."""
    pr = F.when(F.col("source") == "src3", 0).when(F.col("source") == "src7", 1).otherwise(2)
    return R.first_of_equal(_docs(spark, sf_dir), F.sha2(F.trim("text"), 256), [pr, F.col("doc_id")], ["doc_id", "source"])


@query("win_02_run_starts", "with a as (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select event_id, coalesce(p <> event_type, true) as starts, cast(sum(cast(coalesce(p <> event_type, true) as int)) over (partition by user_id order by ts2, event_id) as bigint) as run from (select a.*, ts as ts2 from a join events using (event_id))")
def win_02(spark, sf_dir):
    """WIN-02: a run starts where the value differs from the row before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumn("starts", F.coalesce(F.lag("event_type").over(w) != F.col("event_type"), F.lit(True)))
    return e.select("event_id", "starts", F.sum(F.col("starts").cast("int")).over(w).alias("run"))


@query("win_03_running_index", f"with {SEG} select vec_id, cast(row_number() over (partition by doc order by vec_id) - 1 as int) as at from seg")
def win_03(spark, sf_dir):
    """WIN-03: place of a segment in its document."""
    return segments(spark, sf_dir).select("vec_id", (F.row_number().over(Window.partitionBy("doc").orderBy("vec_id")) - 1).alias("at"))


@query("win_04_first_seen_ordinal", "with a as (select user_id, min(event_id) as f from events group by 1) select user_id, cast(row_number() over (order by f) as bigint) as ordinal from a")
def win_04(spark, sf_dir):
    """WIN-04: ordinal of each key by its first row, without a single-task sort."""
    from corpweave.operators.ranges import global_index

    first = _events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("f"))
    return global_index(first, "f", "at").select("user_id", (F.col("at") + 1).alias("ordinal"))


_NATION = "select c_nationkey as k, round(sum(c_acctbal), 2) as y from customer group by 1"


def _by_nation(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("y"))


@query("win_05_rank_largest", f"select k, cast(row_number() over (order by y desc, k) as int) as rank from ({_NATION})")
def win_05(spark, sf_dir):
    """WIN-05: ordinal rank of classes, the largest first, ties to the lower class."""
    return _by_nation(spark, sf_dir).select("k", F.row_number().over(Window.orderBy(F.desc("y"), "k")).alias("rank"))


@query("win_06_average_rank", "select o_orderkey, round(rank() over (partition by o_orderpriority order by year(o_orderdate)) + (count(*) over (partition by o_orderpriority, year(o_orderdate)) - 1) / 2.0, 1) as rank from orders")
def win_06(spark, sf_dir):
    """WIN-06: average ranks of ties, from counts of each value."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return R.average_rank(o, "y", "rank", ["o_orderpriority"]).select("o_orderkey", F.round("rank", 1).alias("rank"))


@query("win_07_ordinal_rank", f"select k, cast(row_number() over (order by y, k) as int) as rank from ({_NATION})")
def win_07(spark, sf_dir):
    """WIN-07: ordinal rank that is blind to ties."""
    return _by_nation(spark, sf_dir).select("k", F.row_number().over(Window.orderBy("y", "k")).alias("rank"))


@query("win_08_cap_per_document", f"with {SEG} select vec_id from (select vec_id, row_number() over (partition by class_id, doc order by md5(concat_ws(':', '42', vec_id)), vec_id) as k from seg) where k <= 2")
def win_08(spark, sf_dir):
    """WIN-08: at most two random rows of each document in a class."""
    return R.capped(segments(spark, sf_dir), ["class_id", "doc"], 2, draw(42, "vec_id"), "vec_id").select("vec_id")


@query("win_09_share_of_total", f"select k, round(y / sum(y) over (), 6) as share from ({_NATION})")
def win_09(spark, sf_dir):
    """WIN-09: share of the total."""
    n = _by_nation(spark, sf_dir)
    return n.crossJoin(F.broadcast(n.agg(F.sum("y").alias("total")))).select("k", F.round(F.col("y") / F.col("total"), 6).alias("share"))


@query("win_10_plateau", f"""
with a as (select k, y, avg(y) over (order by k rows between 4 preceding and current row) as p, first_value(y) over (order by k) as f from ({_NATION}))
select k, round(p, 6) as plateau, round(100 * (f - y) / f, 6) as reduction from a""")
def win_10(spark, sf_dir):
    """WIN-10: mean of the last five rows, and the reduction since the first."""
    w = Window.orderBy("k")
    n = _by_nation(spark, sf_dir).withColumn("f", F.first("y").over(w))
    return n.select("k", F.round(F.avg("y").over(w.rowsBetween(-4, 0)), 6).alias("plateau"), F.round(100 * (F.col("f") - F.col("y")) / F.col("f"), 6).alias("reduction"))


@query("win_11_running_best", f"""
with a as (select k, y, max(y) over (order by k rows between unbounded preceding and 1 preceding) as b from ({_NATION})),
g as (select *, coalesce(y > b, true) as better, sum(cast(coalesce(y > b, true) as int)) over (order by k) as r from a)
select k, greatest(y, coalesce(b, y)) as best, cast(row_number() over (partition by r order by k) - 1 as int) as waited from g""")
def win_11(spark, sf_dir):
    """WIN-11: best value so far, and how many rows it has stood."""
    w = Window.orderBy("k")
    b = F.max("y").over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = _by_nation(spark, sf_dir).withColumn("b", b).withColumn("r", F.sum(F.coalesce(F.col("y") > F.col("b"), F.lit(True)).cast("int")).over(w))
    return n.select("k", F.greatest("y", F.coalesce("b", "y")).alias("best"), (F.row_number().over(Window.partitionBy("r").orderBy("k")) - 1).alias("waited"))


# sort and top-k


@query("srt_01_argmax", f"with {SEG} select vec_id, cast(list_position(v, list_max(v)) - 1 as bigint) as best, round(list_max(v), 6) as top from seg")
def srt_01(spark, sf_dir):
    """SRT-01: place of the greatest score, the lowest one of ties, and the score."""
    s = segments(spark, sf_dir)
    return s.select("vec_id", (F.array_position("v", F.array_max("v")) - 1).alias("best"), F.round(F.array_max("v"), 6).alias("top"))


@query("srt_02_top_k", "select o_orderkey, o_totalprice from orders where o_totalprice > 0 order by o_totalprice desc, o_orderkey limit 5")
def srt_02(spark, sf_dir):
    """SRT-02: the five greatest."""
    return _orders(spark, sf_dir).where("o_totalprice > 0").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("srt_03_top_k_per_group", "select l_linestatus, l_orderkey, l_linenumber, rank from (select *, cast(row_number() over (partition by l_linestatus order by l_extendedprice desc, l_orderkey, l_linenumber) as int) as rank from lineitem) where rank <= 3")
def srt_03(spark, sf_dir):
    """SRT-03: the three greatest of each group; a task keeps three of each group before the shuffle."""
    return R.top_of_groups(_items(spark, sf_dir), "l_linestatus", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 3).select("l_linestatus", "l_orderkey", "l_linenumber", "rank")


@query("srt_04_greedy_terms")
def srt_04(spark, sf_dir):
    """SRT-04: terms by score; one that holds a chosen term, or is held by one, is skipped; ten at most."""
    from corpweave.operators.terms import greedy_terms

    w = _docs(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("term"))
    return greedy_terms(w.groupBy("lang", "term").agg(F.count("*").cast("double").alias("score")), "lang", 10)


@query("srt_05_multi_key_sort", "select o_orderkey, cast(row_number() over (order by o_orderstatus, o_orderdate desc, o_orderkey) as bigint) as at from orders")
def srt_05(spark, sf_dir):
    """SRT-05: global order by several keys, with the place of each row."""
    from corpweave.operators.ranges import global_index

    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderdate")
    return global_index(o, ["o_orderstatus", F.desc("o_orderdate"), "o_orderkey"], "at").select("o_orderkey", (F.col("at") + 1).alias("at"))


# samples


@query("smp_01_sample", "select doc_id from documents order by md5(concat_ws(':', '42', doc_id)), doc_id limit 100")
def smp_01(spark, sf_dir):
    """SMP-01: a hundred rows without replacement, whatever the partitions."""
    return R.sampled(_docs(spark, sf_dir).select("doc_id"), 100, draw(42, "doc_id"), "doc_id")


@query("smp_02_cluster_sample", f"with {SEG}, d as (select doc from (select distinct doc from seg) order by md5(concat_ws(':', '42', doc)), doc limit 20) select vec_id, doc from seg where doc in (select doc from d)")
def smp_02(spark, sf_dir):
    """SMP-02: whole documents are drawn, all their segments stay."""
    s = segments(spark, sf_dir).select("vec_id", "doc")
    return s.join(R.sampled(s.select("doc").distinct(), 20, draw(42, "doc"), "doc"), "doc", "left_semi")


@query("smp_03_balanced_sample", f"""
with {SEG}, n as (select min(c) as least from (select count(*) as c from seg group by class_id, corpus)),
r as (select vec_id, class_id, corpus, row_number() over (partition by class_id, corpus order by md5(concat_ws(':', '42', vec_id)), vec_id) as k from seg)
select vec_id, class_id, corpus from r where k <= (select least from n)""")
def smp_03(spark, sf_dir):
    """SMP-03: as many rows of each class and corpus as the smallest of them has."""
    return R.balanced(segments(spark, sf_dir), ["class_id", "corpus"], draw(42, "vec_id"), "vec_id").select("vec_id", "class_id", "corpus")


@query("smp_04_matched_sample", "select vec_id from (select vec_id, row_number() over (order by md5(concat_ws(':', '42', vec_id)), vec_id) as k from embeddings where label <> 4) where k <= (select count(*) from embeddings where label = 4)")
def smp_04(spark, sf_dir):
    """SMP-04: as many other rows as the class has."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = e.where("label = 4").count()
    return R.sampled(e.where("label <> 4").select("vec_id"), n, draw(42, "vec_id"), "vec_id")


@query("smp_05_per_class", f"with {SEG} select vec_id, class_id from (select *, row_number() over (partition by class_id order by md5(concat_ws(':', '42', vec_id)), vec_id) as k from seg) where k <= 10")
def smp_05(spark, sf_dir):
    """SMP-05: ten random rows of each class."""
    return R.capped(segments(spark, sf_dir), ["class_id"], 10, draw(42, "vec_id"), "vec_id").select("vec_id", "class_id")


@query("smp_06_distinct_parents", f"""
with {SEG}, a as (select *, row_number() over (partition by class_id, doc order by md5(concat_ws(':', '42', vec_id)), vec_id) as k from seg),
b as (select vec_id, class_id, row_number() over (partition by class_id order by md5(concat_ws(':', '42', vec_id)), vec_id) as m from a where k = 1)
select vec_id, class_id from b where m <= 5""")
def smp_06(spark, sf_dir):
    """SMP-06: five rows of each class, no document twice in it."""
    one = R.capped(segments(spark, sf_dir), ["class_id", "doc"], 1, draw(42, "vec_id"), "vec_id")
    return R.capped(one, ["class_id"], 5, draw(42, "vec_id"), "vec_id").select("vec_id", "class_id")


_DRAWS = f"""
with {SEG}, t as (select tier, draw from (select unnest([50, 100, 200]) as tier), range(0, 4) r(draw)),
r as (select tier, draw, class_id, corpus, row_number() over (partition by tier, draw order by md5(concat_ws(':', 42 + draw, vec_id)), vec_id) as k from seg, t)
select tier, cast(draw as int) as draw, class_id, cast(count(*) as bigint) as n from r where k <= tier group by 1, 2, 3"""


@query("smp_07_draw_ladder", _DRAWS)
def smp_07(spark, sf_dir):
    """SMP-07: several sizes and seeds of samples, counted by class in one pass."""
    s = R.ladder(segments(spark, sf_dir).select("vec_id", "class_id"), [50, 100, 200], 4, 42, "vec_id")
    return s.groupBy("tier", "draw", "class_id").agg(F.count("*").alias("n"))


@query("smp_08_grouped_split", f"""
with {SEG}, d as (select doc, corpus, arg_min(class_id, vec_id) as c from seg group by 1, 2),
r as (select *, row_number() over (partition by corpus, c order by md5(concat_ws(':', '42', doc)), doc) as k, count(*) over (partition by corpus, c) as n from d)
select vec_id, k > ceil(n * 0.85) as test from seg join r using (doc)""")
def smp_08(spark, sf_dir):
    """SMP-08: documents, not rows, are split 85 to 15 within corpus and class."""
    return R.grouped_split(segments(spark, sf_dir), "doc", ["corpus"], "class_id", "vec_id", draw(42, "doc"), 0.85).select("vec_id", "test")


@query("smp_09_group_folds", f"with {SEG} select vec_id, cast(('0x' || substr(md5(concat_ws(':', '42', doc)), 1, 8)) as bigint) % 5 as fold from seg")
def smp_09(spark, sf_dir):
    """SMP-09: five folds that no document crosses."""
    return segments(spark, sf_dir).select("vec_id", (F.conv(F.substring(draw(42, "doc"), 1, 8), 16, 10).cast("long") % 5).alias("fold"))


@query("smp_12_cap_per_source", "select doc_id, source from (select *, row_number() over (partition by source order by md5(concat_ws(':', '42', doc_id)), doc_id) as k from documents) where k <= 30")
def smp_12(spark, sf_dir):
    """SMP-12: at most thirty texts of each source."""
    return R.capped(_docs(spark, sf_dir).select("doc_id", "source"), ["source"], 30, draw(42, "doc_id"), "doc_id").select("doc_id", "source")


@query("smp_13_whole_table_sample", "select event_id from events order by md5(concat_ws(':', '7', event_id)), event_id limit 50")
def smp_13(spark, sf_dir):
    """SMP-13: the first shards are not a sample; rows are drawn out of all of them."""
    return R.sampled(_events(spark, sf_dir).select("event_id"), 50, draw(7, "event_id"), "event_id")


@query("smp_14_fresh_draws", f"""
with {SEG}, t as (select unnest([43, 44, 45]) as seed), r as (select seed, corpus, v[1] as x, row_number() over (partition by seed order by md5(concat_ws(':', seed, vec_id)), vec_id) as k from seg, t)
select seed, round(avg(x) filter (corpus = 0) - avg(x) filter (corpus = 1), 6) as difference from r where k <= 200 group by 1""")
def smp_14(spark, sf_dir):
    """SMP-14: the same statistic from samples of three seeds."""
    s = R.ladder(segments(spark, sf_dir).select("vec_id", "corpus", F.col("v")[0].alias("x")), [200], 3, 43, "vec_id")
    return s.groupBy((F.col("draw") + 43).alias("seed")).agg(F.round(F.avg(F.when(F.col("corpus") == 0, F.col("x"))) - F.avg(F.when(F.col("corpus") == 1, F.col("x"))), 6).alias("difference"))


# sets


@query("set_01_union_all", "select 'd' as origin, doc_id as id, length(text) as n from documents union all select 'b', item_id, length(text) from benchmark union all select 'p', page_id, length(html) from pages")
def set_01(spark, sf_dir):
    """SET-01: sources put together in one schema."""
    d = _docs(spark, sf_dir).select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("b").alias("origin"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
    p = table(spark, sf_dir, "pages").select(F.lit("p").alias("origin"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("n"))
    return d.unionByName(b).unionByName(p)


@query("set_02_first_by_key", "select user_id, min(event_id) as event_id from events group by 1")
def set_02(spark, sf_dir):
    """SET-02: the first row of each key wins."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("set_03_distinct_texts", "with k as (select min(doc_id) as i from documents where trim(text) <> '' group by trim(text)) select source, cast(count(*) as bigint) as n, cast(count(*) - count(i) as bigint) as removed from documents left join k on doc_id = i group by 1")
def set_03(spark, sf_dir):
    """SET-03: distinct trimmed texts, and how many each source loses."""
    d = _docs(spark, sf_dir).where(F.trim("text") != "")
    kept = R.first_of_equal(d, F.sha2(F.trim("text"), 256), [F.col("doc_id")], ["doc_id"]).select("doc_id", F.lit(1).alias("kept"))
    return _docs(spark, sf_dir).select("doc_id", "source").join(kept, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), (F.count("*") - F.count("kept")).alias("removed"))


@query("set_04_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_04(spark, sf_dir):
    """SET-04: common keys."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("set_05_except", "select doc_id from documents except select doc_id from labels")
def set_05(spark, sf_dir):
    """SET-05: keys that only the first side has."""
    return _docs(spark, sf_dir).select("doc_id").subtract(_labels(spark, sf_dir).select("doc_id"))


@query("set_06_top3_overlap", """
with a as (select lang, source, count(*) as n from documents group by 1, 2), r as (select lang, source, row_number() over (partition by lang order by n desc, source) as k from a),
g as (select source from documents group by 1 order by count(*) desc, source limit 3)
select lang, cast(count(*) filter (source in (select source from g)) as int) as overlap from r where k <= 3 group by 1""")
def set_06(spark, sf_dir):
    """SET-06: how many of a group's top three are among the top three overall."""
    n = _docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    top = R.top_of_groups(n, "lang", [F.desc("n"), "source"], 3).groupBy("lang").agg(F.collect_set("source").alias("own"))
    all_ = n.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(3).agg(F.collect_set("source").alias("general"))
    return top.crossJoin(F.broadcast(all_)).select("lang", F.size(F.array_intersect("own", "general")).alias("overlap"))
