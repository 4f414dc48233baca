"""Class profiles, centroids and the coverage and semantic gaps of two corpora.

Centroids and profiles have a row for each class, so collecting them is bounded by the number of classes; all row-wise
work stays distributed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpweave.functions import vectors as V
from corpweave.operators.relational import capped

CAP = 50
LEAST = 10
LEAST_NORM = 0.5


def centroids(df: DataFrame, *by: str, vector: str = "v") -> DataFrame:
    """(by, n, norm, centroid): the mean vector of each group at length one, and its length before."""
    mean = Summarizer.metrics("mean", "count").summary(array_to_vector(vector))
    m = df.where(F.col(vector).isNotNull()).groupBy(*by).agg(mean.alias("s")).select(*by, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("m"))
    return m.select(*by, "n", V.norm(F.col("m")).alias("norm"), V.unit(F.col("m")).alias("centroid"))


@dataclass
class Classes:
    """Reference centroids of all classes on the driver, in order of their ids."""

    ids: list[int]
    rows: np.ndarray

    @staticmethod
    def of(table: DataFrame, class_col: str = "class_id") -> Classes:
        found = sorted((r[0], r[1]) for r in table.where("centroid is not null").select(class_col, "centroid").collect())
        return Classes([k for k, _ in found], np.array([c for _, c in found]))

    def without(self, basis: np.ndarray) -> Classes:
        m = self.rows - (self.rows @ basis.T) @ basis
        return Classes(self.ids, m / np.linalg.norm(m, axis=1)[:, None])

    def id_of(self, place: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.ids)), place)


def assigned(df: DataFrame, classes: Classes, vector: str = "v") -> DataFrame:
    """Adds scores against all centroids, the assigned class and its score."""
    scored = df.withColumn("scores", V.products(F.col(vector), classes.rows))
    return scored.withColumn("assigned", classes.id_of(V.best(F.col("scores")))).withColumn("top", F.array_max("scores"))


def documents(df: DataFrame, *by: str, classes: Classes | None = None, doc: str = "doc") -> DataFrame:
    """(by, doc, n, v, scores, assigned, top): mean vectors of documents at length one, and the class of their mean scores."""
    m = Summarizer.metrics("mean", "count")
    g = df.groupBy(*by, doc).agg(m.summary(array_to_vector("v")).alias("a"), m.summary(array_to_vector("scores")).alias("b"))
    out = g.select(*by, doc, F.col("a.count").alias("n"), V.unit(vector_to_array("a.mean")).alias("v"), vector_to_array("b.mean").alias("scores"))
    place = V.best(F.col("scores"))
    return out.withColumn("assigned", classes.id_of(place) if classes else place).withColumn("top", F.array_max("scores"))


def profile(df: DataFrame, classes: list[int], *by: str) -> DataFrame:
    """(by, class_id, n, share): how many rows are assigned to each class, all classes present."""
    spark = df.sparkSession
    n = df.groupBy(*by, F.col("assigned").alias("class_id")).agg(F.count("*").alias("n"))
    all_ = F.broadcast(spark.createDataFrame([(k,) for k in classes], "class_id int"))
    groups = n.groupBy(*by).agg(F.sum("n").alias("total"))
    full = groups.crossJoin(all_).join(n, [*by, "class_id"], "left")
    return full.select(*by, "class_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def soft_profile(df: DataFrame, classes: list[int], *by: str) -> DataFrame:
    """(by, class_id, mean_score): mean score of each class over all rows."""
    m = Summarizer.metrics("mean").summary(array_to_vector("scores"))
    g = df.groupBy(*by).agg(m.alias("s")).select(*by, F.posexplode(vector_to_array("s.mean")).alias("at", "mean_score"))
    return g.select(*by, F.get(F.array(*map(F.lit, classes)), F.col("at")).alias("class_id"), "mean_score")


def coverage_gap(shares: DataFrame) -> DataFrame:
    """(class_id, research, policy, gap, dominance) from shares of corpora 0 and 1."""
    p = shares.groupBy("class_id").agg(F.max(F.when(F.col("corpus") == 0, F.col("share"))).alias("research"), F.max(F.when(F.col("corpus") == 1, F.col("share"))).alias("policy"))
    r, q = F.coalesce("research", F.lit(0.0)), F.coalesce("policy", F.lit(0.0))
    return p.select("class_id", r.alias("research"), q.alias("policy"), F.abs(r - q).alias("gap"), (r - q).alias("dominance"))


def semantic_gap(research: DataFrame, policy: DataFrame, classes: list[int], order: Column, tie: str = "vec_id", cap: int | None = CAP, least: int = LEAST) -> DataFrame:
    """One row for each class: 1 - cosine of the research and policy centroids, counts, and whether it is reliable.

    ``research`` has a vector and an assigned class for each document, ``policy`` for each segment; of a document's
    segments in a class at most ``cap`` take part."""
    spark = research.sparkSession
    kept = capped(policy, ["assigned", "doc"], cap, order, tie) if cap else policy
    r = centroids(research, "assigned").select(F.col("assigned").alias("class_id"), F.col("n").alias("n_research"), F.col("norm").alias("r_norm"), F.col("centroid").alias("r"))
    p = centroids(kept, "assigned").select(F.col("assigned").alias("class_id"), F.col("n").alias("n_capped"), F.col("norm").alias("p_norm"), F.col("centroid").alias("p"))
    n = policy.groupBy(F.col("assigned").alias("class_id")).agg(F.count("*").alias("n_segments"), F.countDistinct("doc").alias("n_docs"))
    out = F.broadcast(spark.createDataFrame([(k,) for k in classes], "class_id int"))
    for side in (r, p, n):
        out = out.join(F.broadcast(side), "class_id", "left")  # a row for each class
    few = (F.coalesce("n_research", F.lit(0)) < least) | (F.coalesce("n_capped", F.lit(0)) < least)
    weak = (F.coalesce("r_norm", F.lit(0.0)) < LEAST_NORM) | (F.coalesce("p_norm", F.lit(0.0)) < LEAST_NORM)
    reason = F.when(F.col("r").isNull() | F.col("p").isNull(), "empty").when(few, "few rows").when(weak, "weak centroid")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_research", "n_segments", "n_docs", "n_capped")]
    return out.select("class_id", *counts, "r_norm", "p_norm", (1 - V.dot(F.col("r"), F.col("p"))).alias("gap"), reason.isNotNull().alias("unreliable"), reason.alias("reason"))
