"""Sinks and provenance: sharded tables, their manifests, checksums and status rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpweave.session import removed

SHARD = 100_000


def shards(df: DataFrame, path: str, rows: int = SHARD, form: str = "parquet") -> None:
    """Files of at most ``rows`` rows. Spark's committer publishes all of them or none."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).format(form).save(path)


def manifest(spark: SparkSession, path: str, form: str = "parquet", by: str | None = None) -> DataFrame:
    """(shard, rows) of every file, or rows by a column."""
    df = spark.read.format(form).load(path)
    if by:
        return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias(by)).agg(F.count("*").alias("rows"))
    return df.groupBy(F.col("_metadata.file_name").alias("shard")).agg(F.count("*").alias("rows"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(spark: SparkSession, path: str, salt: str = "") -> str:
    """A digest of the files' names, sizes and times; the same while nothing has changed."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    one = f.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.lit(salt), "path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return f"{one['n']}:{one['h']}"


def unchanged(spark: SparkSession, path: str, before: str | None, salt: str = "") -> bool:
    return before is not None and before == fingerprint(spark, path, salt)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, parameters: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, if it was written whole and for these parameters; else it is computed and written there."""
    mark = json.dumps(parameters, sort_keys=True)
    if exists(spark, f"{path}/made") and spark.read.text(f"{path}/made").first()[0] == mark:
        return spark.read.parquet(f"{path}/rows")
    removed(spark, path)
    compute().write.parquet(f"{path}/rows")
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{path}/made")  # last, so that it vouches for the rows
    return spark.read.parquet(f"{path}/rows")


def csv(df: DataFrame, path: str, places: int = 6) -> None:
    """A CSV file with a header; doubles with fixed places, nulls as nothing."""
    out = [F.format_string(f"%.{places}f", F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    nulls = [F.when(F.col(f"`{c}`").isNotNull(), e).alias(c) for c, e in zip(df.columns, out)]
    df.select(*nulls).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def status(spark: SparkSession, stage: str, state: str, **counters: int) -> DataFrame:
    """One status row of a stage."""
    if state not in ("pending", "running", "completed", "failed"):
        raise ValueError(f"no state {state}")
    return spark.createDataFrame([(stage, state, dict(counters))], "stage string, state string, counters map<string,long>").withColumn("at", F.current_timestamp())
