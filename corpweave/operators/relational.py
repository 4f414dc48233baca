"""Relational building blocks: joins that check, shares, ranks, caps and samples.

Samples order rows by a hash of seed and key, so that they do not depend on partitions and a retried task draws the
same rows. Tops and caps of groups keep a few rows on each task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpweave.operators.ranges import among_first, running
from corpweave.session import cut


def join_or_fail(left: DataFrame, right: DataFrame, key: str, proof: str) -> DataFrame:
    """Inner join by key that raises where ``left`` has a key that ``right`` has not; ``proof`` is never null in ``right``."""
    both = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no match for {key} "), F.col(key).cast("string")))
    return both.withColumn(proof, F.when(F.col("__there"), F.col(proof)).otherwise(missing)).drop("__there")


def dependency_violations(df: DataFrame, key: str, value: str, name: str = "n") -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias(name)).where(F.col(name) > 1)


def class_shares(df: DataFrame, class_col: str, classes: Iterable[int]) -> DataFrame:
    """(k, n, share) for all of ``classes``, zeros included."""
    counts = df.groupBy(F.col(class_col).cast("long").alias("k")).agg(F.count("*").alias("c"))
    ids = list(classes)
    all_ = df.sparkSession.range(min(ids), max(ids) + 1).withColumnRenamed("id", "k")
    full = all_.join(F.broadcast(counts), "k", "left").withColumn("n", F.coalesce("c", F.lit(0)))
    return full.withColumn("total", F.sum("n").over(Window.partitionBy())).select("k", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def vector_mean(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, n, mean) of an array column, summed on each task first."""
    stats = Summarizer.metrics("mean", "count").summary(array_to_vector(vector))
    out = df.groupBy(*keys).agg(stats.alias("s"))
    return out.select(*keys, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"))


def one_vs_rest(df: DataFrame, truth: str, pred: str, classes: Iterable[int]) -> DataFrame:
    """(class_id, tp, fp, fn, tn, precision, recall, f1) from a table of counts; zero where a ratio is undefined."""
    cells = df.groupBy(truth, pred).agg(F.count("*").alias("n"))
    each = cells.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(k,) for k in classes], "class_id int")))
    t, p = F.col(truth) == F.col("class_id"), F.col(pred) == F.col("class_id")

    def total(where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(0)).alias(name)

    c = each.groupBy("class_id").agg(total(t & p, "tp"), total(~t & p, "fp"), total(t & ~p, "fn"), total(~t & ~p, "tn"))
    return c.select("*", (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"), F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def first_of_equal(df: DataFrame, key: Column, order: list[Column], kept: list[str]) -> DataFrame:
    """Of rows with an equal key the first by ``order``: a minimum, so copies are reduced before the shuffle."""
    named = F.struct(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("at"), F.struct(*kept).alias("row"))
    return df.groupBy(key.alias("__key")).agg(F.min(named).alias("m")).select("m.row.*")


#: Up to so many distinct values, one window ranks a group; beyond, the values are ranked in ranges.
ONE_WINDOW = 1_000_000


def average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None, most: int = ONE_WINDOW) -> DataFrame:
    """Rank from one, ties by their average; ranked over counts of distinct values and joined back."""
    by = by or []
    counts = cut(df.groupBy(*by, value).agg(F.count("*").alias("__n")))
    if counts.count() > most:
        below = running(counts, by, value, ["__n"])
    else:
        smaller = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        below = counts.withColumn("__n_before", F.coalesce(F.sum("__n").over(smaller), F.lit(0)))
    ranks = below.withColumn(name, F.col("__n_before") + (F.col("__n") + 1) / 2.0).drop("__n", "__n_before")
    return df.join(ranks, [*by, value])


def capped(df: DataFrame, by: list[str], most: int, order: Column, tie: str) -> DataFrame:
    """At most ``most`` rows of each group, the first by ``order``; Spark keeps as many on each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(order, tie)
    return df.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= most).drop("__at")


def top_of_groups(df: DataFrame, by: str, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark keeps ``k`` on each task before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def sampled(df: DataFrame, n: int, order: Column, tie: str) -> DataFrame:
    """``n`` rows without replacement: the first by a hash."""
    return df.orderBy(order, tie).limit(n)


def smallest(df: DataFrame, by: list[str]) -> int:
    """The number of rows of the smallest group."""
    return df.groupBy(*by).count().agg(F.min("count")).first()[0] or 0


def balanced(df: DataFrame, by: list[str], order: Column, tie: str, least: int | None = None) -> DataFrame:
    """As many rows of each group as the smallest group has (``least``, if it is known), the first by ``order``, an MD5."""
    least = smallest(df, by) if least is None else least
    return among_first(df, by, order, tie, F.lit(least), "__first").where("__first").drop("__first")


def ladder(df: DataFrame, tiers: list[int], draws: int, seed: int, key: str) -> DataFrame:
    """Samples of several sizes and seeds, (tier, draw) added. One hash for each draw serves all its tiers."""
    spark = df.sparkSession
    which = F.broadcast(spark.createDataFrame([(d,) for d in range(draws)], "draw int"))
    at = F.md5(F.concat_ws(":", (F.col("draw") + seed).cast("string"), F.col(key).cast("string")))
    w = Window.partitionBy("draw").orderBy(at, key)
    ranked = df.crossJoin(which).withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= max(tiers))
    fits = F.filter(F.array(*map(F.lit, tiers)), lambda t: F.col("__at") <= t)
    return ranked.select(*df.columns, "draw", F.explode(fits).alias("tier"))


def grouped_split(df: DataFrame, group: str, by: list[str], class_col: str, first: str, order: Column, share: float) -> DataFrame:
    """Adds ``test``: groups are split within ``by`` and the class of their first row, so none crosses; ``order`` is an MD5."""
    g = df.groupBy(group, *by).agg(F.min_by(class_col, first).alias("__class"))
    g = among_first(g, [*by, "__class"], order, group, F.ceil(F.col("n") * share), "__train")
    return df.join(g.select(group, (~F.col("__train")).alias("test")), group)


def area_under_curve(df: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """(by, auc): the share of pairs of a row of truth 1 and one of truth 0 that scores order rightly, ties as one half; null
    without both.

    Scores are counted by value; running counts over ranges of them mean that no task has to sort a group."""
    from corpweave.operators.ranges import running

    counts = df.groupBy(*by, score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    r = running(counts, by, score, ["neg"])
    right = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return r.groupBy(*by).agg(F.try_divide(right, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))
