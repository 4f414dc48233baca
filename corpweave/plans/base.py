"""Common inputs of the registered queries: test tables and the segment table built from embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of the segment table, in step with ``segments``.
SEG = """seg as (
  select vec_id, vec_id % 2 as corpus, concat(vec_id % 2, '_', vec_id // 8) as doc, (vec_id // 8) % 3 as family, label as class_id,
         [cast(x as double) for x in embedding] as v from embeddings)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of two corpora: (vec_id, corpus, doc, family, class_id, v)."""
    e = table(spark, sf_dir, "embeddings")
    part = F.expr("vec_id div 8")
    return e.select("vec_id", (F.col("vec_id") % 2).alias("corpus"), F.concat_ws("_", F.col("vec_id") % 2, part).alias("doc"), (part % 3).alias("family"), F.col("label").alias("class_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def draw(seed: int | Column, *key: str) -> Column:
    """A hash that orders rows at random, the same in Spark and DuckDB."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), *(F.col(k).cast("string") for k in key)))
