"""Model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpweave.functions import vectors as V
from corpweave.operators import distances as D
from corpweave.operators import gaps as G
from corpweave.operators import models as M
from corpweave.operators import networks as N
from corpweave.operators import relational as R
from corpweave.operators import search as SEARCH
from corpweave.operators import segmentation, sentences, terms
from corpweave.operators.quantiles import quantiles
from corpweave.plans import distances as _metrics  # noqa: F401  registers the queries that METRICS names
from corpweave.plans.base import SEG, draw, segments, table
from corpweave.plans.gaps import SCORED, Base
from corpweave.plans.sources import folder
from corpweave.registry import query
from corpweave.session import cut

DIM = 64
#: Configurations of the grid search.
GRID = [{"c": c, "iterations": i} for c in (0.01, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0) for i in (5, 15)]
#: The most frequent terms of a contrast.
VOCABULARY = 20_000


def folded(df: DataFrame, n: int = 5) -> DataFrame:
    """Adds a fold that no document crosses."""
    return df.withColumn("fold", F.conv(F.substring(draw(42, "doc"), 1, 8), 16, 10).cast("long") % n)


_order = draw


@query("mlc_01_segments")
def mlc_01(spark, sf_dir):
    """MLC-01: pieces of whole sentences within a token budget, of all documents."""
    s = segmentation.segmented(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "segment_index", "segment_id", "word_count", F.md5("text").alias("digest"))


@query("mlc_01_sentences")
def mlc_01_sentences(spark, sf_dir):
    """MLC-01: pieces of whole sentences within a token budget, of all documents; abbreviations, starters and collocations are learned
    from the documents themselves."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = sentences.learn(d)
    pieces = d.select("doc_id", F.posexplode(segmentation.segments(F.col("text"), sentences=sentences.sentences(F.col("text"), learned))).alias("segment_index", "text"))
    return pieces.select("doc_id", "segment_index", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_count"), F.md5("text").alias("digest"))


@query("mlc_03_logistic")
def mlc_03(spark, sf_dir):
    """MLC-03, MLC-06 and SRC-22: a multinomial model is fitted, stored, loaded with a check of its width, and scores all rows."""
    from pyspark.ml.classification import LogisticRegressionModel

    rows = M.featured(segments(spark, sf_dir))
    at = folder(spark)
    M.logistic(rows, family="multinomial").write().save(at)
    model = M.checked(LogisticRegressionModel.load(at), DIM)
    return M.scored(model, rows).select("vec_id", "class_id", "assigned", "top")


@query("mlc_04_grid")
def mlc_04(spark, sf_dir):
    """MLC-04: grid search over sixteen configurations with grouped folds and macro-F1; what a log has is not done again."""
    b = segments(spark, sf_dir)
    rows = folded(M.featured(b), 3).cache()
    classes = [r[0] for r in b.select("class_id").distinct().orderBy("class_id").collect()]
    at = folder(spark)
    M.searched(spark, rows, GRID[:2], classes, lambda train, p: M.logistic(train, p["c"], p["iterations"]), at)  # as if it had been stopped here
    out = M.searched(spark, rows, GRID, classes, lambda train, p: M.logistic(train, p["c"], p["iterations"]), at)
    rows.unpersist()
    return out


@query("mlc_05_perceptron")
def mlc_05(spark, sf_dir):
    """MLC-05: a feed-forward classifier in the place of a multi-label network, with early stopping on one fold of documents and a
    last fit on all rows."""
    rows = folded(M.featured(segments(spark, sf_dir)), 5).withColumn("held", F.col("fold") == 0).cache()
    classes = [int(r[0]) for r in rows.select("class_id").distinct().orderBy("class_id").collect()]
    model, _ = M.stopped_perceptron(rows, [DIM, 16, max(classes, default=0) + 1], classes, "held")
    return M.scored(model, rows).select("vec_id", "class_id", "assigned", "top")


def labelled(b: Base, near: float = 0.05) -> DataFrame:
    """Segments with several labels: all classes whose centroids are nearly as similar as the most similar one; with their fold, and
    whether early stopping holds their document out."""
    top = F.array_max("scores")
    every = F.filter(F.transform("scores", lambda x, i: F.when(x >= top - near, i.cast("int"))), lambda i: i.isNotNull())
    rows = b.seg.withColumn("scores", V.products(F.col("v"), b.classes.rows)).select("vec_id", "doc", "v", every.alias("labels"))
    at = F.conv(F.substring(draw(42, "doc"), 1, 8), 16, 10).cast("long")
    return rows.withColumn("fold", at % 5).withColumn("inner", F.shiftright(at, 8) % 10 == 0)


@query("mlc_05_network")
def mlc_05_network(spark, sf_dir):
    """MLC-05: a network with batch normalisation, dropout and a sigmoid for each label, by AdamW over mini-batches of blocks, with
    early stopping on a tenth of the documents and a last fit on all rows; a probability for each label of all rows."""
    b = Base(spark, sf_dir)
    rows = labelled(b)
    found = N.refitted(rows, N.Setting(layers=2, hidden=DIM // 2, lr=3e-3), DIM, len(b.ids), inner="inner")
    p = rows.select("vec_id", F.array_size("labels").alias("n_labels"), N.probabilities(F.col("v"), found.network).alias("p"))
    return p.select("vec_id", "n_labels", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("assigned"), F.size(F.filter("p", lambda x: x >= 0.5)).alias("n_assigned"), F.array_max("p").alias("top"), F.lit(found.epochs).alias("epochs"), F.lit(found.held).alias("held"))


@query("mlc_04_search")
def mlc_04_search(spark, sf_dir):
    """MLC-04 and STR-06: sixteen logistic models and sixteen networks over five grouped folds, all settings and folds in the same
    scans; what the log has under the same data and settings is not fitted again."""
    b = Base(spark, sf_dir)
    rows, at = labelled(b), folder(spark)
    config = {"rows": rows.count(), "d": DIM, "seed": 42, "folds": SEARCH.FOLDS}
    first = SEARCH.grid(SEARCH.LOGISTIC)[:2]
    SEARCH.searched(rows, len(b.ids), DIM, at, config, first, [], fold="fold", inner="inner")  # as if it had been stopped here
    return SEARCH.searched(rows, len(b.ids), DIM, at, config, epochs=40, fold="fold", inner="inner").select("model", "config", "mean", "sd", "per_fold", "per_class")


def shifted(spark, sf_dir) -> DataFrame:
    """Segments whose second corpus lies a little farther along the first axis, so that a classifier can tell the two apart."""
    v = V.unit(F.transform("v", lambda x, i: F.when(i == 0, x + 0.25 * F.col("corpus")).otherwise(x)))
    return segments(spark, sf_dir).withColumn("v", v)


def _projection(spark, sf_dir) -> M.Projection:
    return M.separating_directions(shifted(spark, sf_dir), _order)


@query("mlc_08_directions")
def mlc_08(spark, sf_dir):
    """MLC-08, VEC-11, SRC-23 and STR-05: separating directions until the hold-out accuracy is one half or less, stored and
    loaded, with these accuracies."""
    p = _projection(spark, sf_dir)
    at = folder(spark)
    M.stored(spark, p, at)
    q = M.loaded(spark, at, len(p.directions))
    rows = [(k, g.tolist(), q.accuracy[k] if k < len(q.accuracy) else None) for k, g in enumerate(q.directions)]
    return spark.createDataFrame(rows, "k int, direction array<double>, accuracy double")


@query("mlc_09_two_sample")
def mlc_09(spark, sf_dir):
    """MLC-09: area under the curve of a classifier between the corpora."""
    return spark.createDataFrame([M.two_sample_auc(folded(segments(spark, sf_dir), 3))], "mean double, sd double")


@query("mlc_10_pooled_accuracy")
def mlc_10(spark, sf_dir):
    """MLC-10: accuracy pooled over folds, its interval and an exact test against one half."""
    from corpweave.functions import stats as S

    rows = folded(M.featured(segments(spark, sf_dir), label="corpus"), 3).cache()
    hits = None
    for k in range(3):
        s = M.scored(M.logistic(rows.where(F.col("fold") != k), iterations=10), rows.where(F.col("fold") == k)).select("label", "assigned")
        hits = s if hits is None else hits.unionByName(s)
    k, n = hits.agg(F.count_if(F.col("label") == F.col("assigned")), F.count("*")).first()
    rows.unpersist()
    low, high = S.wilson_low_high(F.col("k"), F.col("n"))
    return spark.createDataFrame([(k, n, S.binomial_tail(k, n))], "k long, n long, p double").select("k", "n", "p", low.alias("low"), high.alias("high"))


@query("mlc_11_knn", f"""
with {SEG}, s as (select q.vec_id as vec_id, q.class_id as truth, b.class_id as k, row_number() over (partition by q.vec_id order by round(list_dot_product(q.v, b.v), 9) desc, b.vec_id) as pos from seg q join seg b on q.vec_id <> b.vec_id),
n as (select vec_id, truth, k, count(*) as n from s where pos <= 5 group by 1, 2, 3), v as (select *, row_number() over (partition by vec_id order by n desc, k) as r from n)
select vec_id, cast(truth as int) as truth, cast(k as int) as assigned from v where r = 1""")
def mlc_11(spark, sf_dir):
    """MLC-11: vote of the five nearest, all rows against all rows in blocks; a task keeps five for each row."""
    s = segments(spark, sf_dir).withColumn("all", F.lit(0))
    pairs = D.most_similar(s, s, "all", DIM, 5)
    best = R.top_of_groups(pairs, "q", [F.desc("s"), "i"], 5)
    label = s.select(F.col("vec_id").alias("i"), F.col("class_id").alias("k"))
    n = best.join(label, "i").groupBy("q", "k").agg(F.count("*").alias("n"))
    vote = R.top_of_groups(n, "q", [F.desc("n"), "k"], 1)
    truth = s.select(F.col("vec_id").alias("q"), F.col("class_id").alias("truth"))
    return vote.join(truth, "q").select(F.col("q").alias("vec_id"), F.col("truth").cast("int").alias("truth"), F.col("k").cast("int").alias("assigned"))


@query("mlc_12_leave_one_out")
def mlc_12(spark, sf_dir):
    """MLC-12: a classifier between the corpora learns without one class and is tested on it."""
    rows = M.featured(segments(spark, sf_dir), label="corpus").cache()
    out = []
    for k in [r[0] for r in rows.select("class_id").distinct().orderBy("class_id").collect()]:
        s = M.scored(M.logistic(rows.where(F.col("class_id") != k), iterations=10), rows.where(F.col("class_id") == k))
        out.append((int(k), float(s.agg(F.avg((F.col("assigned") == F.col("label")).cast("double"))).first()[0])))
    rows.unpersist()
    return spark.createDataFrame(out, "class_id int, accuracy double")


@query("mlc_13_tfidf_contrast", r"""
with d as (select doc_id, case when lang = 'en' then 'en' else 'rest' end as side, regexp_extract_all(lower(text), '[a-z]{3,}') as w from documents),
t as (select doc_id, side, unnest(list_concat(w, [concat(x[1], ' ', x[2]) for x in list_zip(w[:-2], w[2:])])) as term from d),
tf as (select doc_id, side, term, count(*) as tf from t group by 1, 2, 3),
n as (select count(*) as n from d),
df as (select term, count(*) as df from tf group by 1 having count(*) >= 3 and count(*) <= 0.65 * (select n from n) order by sum(tf) desc, term limit 20000),
x as (select doc_id, side, term, tf * (ln((1 + n) / (1 + df)) + 1) as x from tf join df using (term), n),
u as (select doc_id, side, term, x / sqrt(sum(x * x) over (partition by doc_id)) as x from x),
c as (select side, count(*) as c from d group by 1),
m as (select side, term, sum(x) / any_value(c) as m from u join c using (side) group by 1, 2),
g as (select term, coalesce(max(m) filter (side = 'en'), 0) - coalesce(max(m) filter (side = 'rest'), 0) as contrast from m group by 1)
select term, round(contrast, 6) as contrast from g order by round(contrast, 6) desc, term limit 20""")
def mlc_13(spark, sf_dir):
    """MLC-13: mean difference of normalised TF-IDF weights of words and pairs of words between English documents and all others.

    A text is counted where it stands: tasks add up terms of many documents before they send them, and weights before they sum them.
    The vocabulary has 20,000 terms at most and goes out with the tasks. Only rows that share an id are brought together."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"), F.when(F.col("lang") == "en", "en").otherwise("rest").alias("side"))
    sides = {r[0]: r[1] for r in d.groupBy("side").count().collect()}
    n = sum(sides.values())
    shared = cut(d.groupBy(F.col("doc_id").alias("of")).count().where("count > 1").select("of"))
    split, tf = not shared.isEmpty(), None
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    alone = d.join(shared, same, "left_anti") if split else d
    counts = terms.counted(alone, "text")
    if split:
        w = d.join(shared, same, "left_semi").select("doc_id", "side", F.regexp_extract_all("text", F.lit("[a-z]{3,}"), 0).alias("w"))
        two = F.expr("zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (x, y) -> concat(x, ' ', y))")
        tf = w.select("doc_id", "side", F.explode(F.concat("w", two)).alias("term")).groupBy("doc_id", "side", "term").agg(F.count("*").alias("tf"))
        more = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
        counts = counts.unionByName(more).groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all"))
    kept = counts.where((F.col("df") >= 3) & (F.col("df") <= 0.65 * n)).orderBy(F.desc("all"), "term").limit(VOCABULARY)
    idf = {r[0]: float(np.log((1.0 + n) / (1 + r[1])) + 1) for r in kept.select("term", "df").collect()}
    u = terms.weights(alone, "text", "side", idf)
    if split:
        of = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
        x = tf.join(of, "term").withColumn("x", F.col("tf") * F.col("idf"))
        u = u.unionByName(x.select("side", "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))).alias("u")))
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("u")).otherwise(0.0)) / max(sides.get(k, 0), 1)
    g = u.groupBy("term").agg(F.round(side("en") - side("rest"), 6).alias("contrast"))
    return g.orderBy(F.desc("contrast"), "term").limit(20)


@query("vec_12_pca")
def vec_12(spark, sf_dir):
    """VEC-12: two principal components of a balanced sample; all rows are centred before they are projected."""
    s = segments(spark, sf_dir)
    mean, q, share = M.principal_components(R.balanced(s, ["corpus"], draw(42, "vec_id"), "vec_id"), 2, DIM)
    shift = q @ mean
    p = V.products(F.col("v"), q)
    return s.select("vec_id", "corpus", p.alias("p")).select("vec_id", "corpus", (F.col("p")[0] - float(shift[0])).alias("x"), (F.col("p")[1] - float(shift[1])).alias("y"), F.lit(float(share[0])).alias("explained"))


@query("vec_16_alignment")
def vec_16(spark, sf_dir):
    """VEC-16 and VEC-18: a stored subspace against one found anew, from the rows and by another method: alignment and cosines of
    principal angles, of which one that is not above 0.999 fails the query."""
    p = _projection(spark, sf_dir)
    at = folder(spark)
    M.stored(spark, p, at)
    kept = M.loaded(spark, at, len(p.directions)).directions.reshape(-1, DIM)
    again = M.nullspace_directions(shifted(spark, sf_dir), _order, len(kept))
    c = M.parity(kept, again)
    return spark.createDataFrame([(k, float(x), M.alignment(g, again)) for k, (x, g) in enumerate(zip(c, kept))], "k int, cosine double, alignment double")


@query("vec_19_span_calibration")
def vec_19(spark, sf_dir):
    """VEC-19: lengths of vectors' parts in a span against those in a random span of the same size."""
    s = shifted(spark, sf_dir)
    basis = _projection(spark, sf_dir).directions
    chance = np.linalg.qr(np.random.default_rng(42).normal(size=(DIM, len(basis))))[0].T
    sizes = {"span": len(basis), "random": len(chance)}
    both = V.products(F.col("v"), np.vstack([basis, chance]))
    parts = s.select(both.alias("p")).select(F.explode(F.array(*(F.struct(F.lit(name).alias("basis"), V.norm(F.slice("p", at + 1, n)).alias("n")) for name, at, n in (("span", 0, len(basis)), ("random", len(basis), len(chance)))))).alias("e"))
    n = cut(parts.select("e.basis", "e.n"))  # quantiles read it several times
    q = quantiles(n, "basis", "n", {"p99": 0.99, "median": 0.5})
    g = n.groupBy("basis").agg(F.max("n").alias("most"), F.avg("n").alias("mean")).join(F.broadcast(q), "basis")  # two rows
    expected = F.element_at(F.create_map(*(F.lit(x) for name, k in sizes.items() for x in (name, float(np.sqrt(k / DIM))))), F.col("basis"))
    return g.select("basis", "most", "p99", "mean", "median", expected.alias("expected"))


@query("vec_20_direction_probe")
def vec_20(spark, sf_dir):
    """VEC-20: mean cosine of groups with each direction."""
    s = shifted(spark, sf_dir)
    p = _projection(spark, sf_dir).directions
    x = s.select("family", F.posexplode(V.products(F.col("v"), p)).alias("k", "c"))
    g = x.groupBy("k", "family").agg(F.count("*").alias("n"), F.avg("c").alias("mean"))
    return g


@query("gap_09_convergence")
def gap_09(spark, sf_dir):
    """GAP-09: the mean gap after each removed direction, and its correlation over classes with the raw one."""
    b = Base(spark, sf_dir)
    g = _projection(spark, sf_dir).directions
    research, policy = b.documents().where("corpus = 0").cache(), b.assigned.where("corpus = 1").cache()
    raw, rows = None, []
    research.count(), policy.count()  # filled first, so that a task has one Python worker below
    for k in range(len(g) + 1):
        less = lambda df: df.withColumn("v", V.without(F.col("v"), g[:k])).persist() if k else df  # noqa: E731,B023  kept, or filters compute it again
        sides = less(research), less(policy)
        gaps = {r.class_id: r.gap for r in G.semantic_gap(*sides, b.ids, draw(42, "vec_id")).collect() if r.gap is not None}
        for side in sides if k else ():
            side.unpersist()
        raw = raw or gaps
        common = sorted(set(raw) & set(gaps))
        x, y = np.array([raw[c] for c in common]), np.array([gaps[c] for c in common])
        rows.append((k, float(y.mean()) if len(y) else None, float(np.corrcoef(x, y)[0, 1]) if len(y) > 2 else None))
    research.unpersist()
    policy.unpersist()
    return spark.createDataFrame(rows, "k int, mean_gap double, correlation double")


@query("gap_15_examples", f"with {SCORED}, r as (select assigned, corpus, vec_id, top, row_number() over (partition by assigned, corpus order by round(top, 9) desc, vec_id) as k from asg) select assigned, corpus, cast(k as int) as rank, vec_id, round(top, 6) as similarity from r where k <= 3")
def gap_15(spark, sf_dir):
    """GAP-15: the three rows of each class and corpus nearest to the class's centroid."""
    b = Base(spark, sf_dir)
    top = b.assigned.withColumn("g", F.concat_ws("_", "assigned", "corpus"))
    return R.top_of_groups(top, "g", [F.desc(F.round("top", 9)), "vec_id"], 3).select("assigned", "corpus", "rank", "vec_id", F.round("top", 6).alias("similarity"))


@query("udf_06_predict", f"with {SCORED}, m as (select vec_id, max(s) as most, min(k) as low from sc group by 1) select sc.vec_id as vec_id, round(sum(exp(10 * (s - most))) filter (k = low) / sum(exp(10 * (s - most))), 6) as first, cast(any_value(asg.assigned) as int) as assigned from sc join m using (vec_id) join asg on asg.vec_id = sc.vec_id group by 1")
def udf_06(spark, sf_dir):
    """UDF-06: a model's predictions over Arrow batches; weights travel with the tasks once."""
    b = Base(spark, sf_dir)
    s = b.seg.withColumn("scores", V.products(F.col("v"), b.classes.rows))
    top = F.array_max("scores")
    e = F.transform("scores", lambda x: F.exp(10 * (x - top)))
    return s.select("vec_id", F.round(e[0] / F.aggregate(e, F.lit(0.0), lambda a, y: a + y), 6).alias("first"), b.classes.id_of(V.best(F.col("scores"))).alias("assigned"))


#: UDF-07: metrics by name: (query, column of the result).
METRICS = {
    "mmd": ("dis_05_linear_mmd", "mmd"), "rbf": ("dis_09_rbf_mmd", "mmd"), "bandwidth": ("dis_09_rbf_mmd", "bandwidth"), "energy": ("dis_08_energy", "energy"),
    "chamfer": ("dis_02_chamfer_hausdorff", "chamfer"), "modified": ("dis_02_chamfer_hausdorff", "modified"), "hausdorff": ("dis_02_chamfer_hausdorff", "hausdorff"),
    "forward": ("dis_02_chamfer_hausdorff", "forward"), "back": ("dis_02_chamfer_hausdorff", "back"), "sliced": ("dis_01_sliced_wasserstein", "mean"),
    "sliced_error": ("dis_01_sliced_wasserstein", "error"), "sampled_gap": ("dis_10_sampled_gap", "gap"), "recomputed": ("dis_12_gates", "difference"),
}


def _metrics_sql() -> str:
    from corpweave import registry

    return " union all ".join(f"select '{name}' as metric, cast(class_id as int) as class_id, cast({column} as double) as value from ({registry._oracles[q]})" for name, (q, column) in METRICS.items())


@query("udf_07_metrics", _metrics_sql())
def udf_07(spark, sf_dir):
    """UDF-07: all metrics of the registry in one long table; a query that gives several is run once."""
    from corpweave import registry

    out = None
    for q in dict.fromkeys(q for q, _ in METRICS.values()):
        names = [(name, column) for name, (of, column) in METRICS.items() if of == q]
        m = registry._queries[q](spark, sf_dir).select("class_id", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in names))).alias("m"))
        m = m.select("m.metric", F.col("class_id").cast("int").alias("class_id"), "m.value")
        out = m if out is None else out.unionByName(m)
    return out


def class_auc(spark, sf_dir) -> DataFrame:
    """(class_id, value): area under the curve of a classifier between the corpora within each class, over folds of documents; all
    classes and folds are fitted in the same scans."""
    rows = folded(segments(spark, sf_dir), 3).cache()
    ids = [int(r[0]) for r in rows.select("class_id").distinct().orderBy("class_id").collect()]
    weights = {}
    of = {k: N.packed(rows.where(F.col("class_id") == k).select("vec_id", "v", F.array(F.col("corpus").cast("int")).alias("labels"), "fold"), 2, fold="fold")[0] for k in ids}
    for k in ids:
        for fold, w in enumerate(N.logistic_models(of[k], [N.Logistic(3.0, False, f) for f in range(3)], DIM, 2, most=30)):
            weights[k, fold] = w[:, 1] - w[:, 0]
    table_ = spark.createDataFrame([(k, f, w.tolist()) for (k, f), w in weights.items()], "class_id int, fold int, w array<double>")  # one for each class and fold
    score = F.round(V.dot(F.col("v"), F.slice("w", 1, DIM)) + F.element_at("w", DIM + 1), 9)
    scored = rows.withColumn("fold", F.col("fold").cast("int")).join(F.broadcast(table_), ["class_id", "fold"]).select("class_id", "fold", "corpus", score.alias("score"))
    out = R.area_under_curve(scored, ["class_id", "fold"], "score", "corpus")
    rows.unpersist()
    return out.groupBy("class_id").agg(F.avg("auc").alias("value"))


#: UDF-07: metrics that SQL can't say, by what gives them: a query that gives several is run once.
MORE = [
    (_metrics.dis_03, {"gaussian_w2": "sqrt(mean_term + cov_term)", "gaussian_shape_share": "try_divide(cov_term, mean_term + cov_term)"}),
    (_metrics.dis_04, {"grassmann": "distance"}), (_metrics.dis_06, {"emd": "emd", "sinkhorn": "sinkhorn"}), (class_auc, {"two_sample_auc": "value"}),
]


@query("udf_07_all_metrics")
def udf_07_all(spark, sf_dir):
    """UDF-07: the metrics of the registry that SQL can't say, in one long table: Gaussian and its share of shape, subspaces, exact and
    entropic transport, and a two-sample classifier."""
    out = None
    for of, values in MORE:
        each = F.array(*(F.struct(F.lit(name).alias("metric"), F.expr(x).cast("double").alias("value")) for name, x in values.items()))
        m = of(spark, sf_dir).select(F.col("class_id").cast("int").alias("class_id"), F.explode(each).alias("m")).select("m.metric", "class_id", "m.value")
        out = m if out is None else out.unionByName(m)
    return out
