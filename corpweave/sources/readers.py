"""Sources. A missing path is an error, not an empty table; schemas are declared, not guessed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingSource(FileNotFoundError):
    pass


def present(spark: SparkSession, path: str) -> str:
    """``path``, if any file of Spark's file system matches it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise MissingSource(path)
    return path


def json_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """One object on each line; blank lines are skipped, compressed files are read as they are."""
    try:
        present(spark, path)
    except MissingSource:
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise
    return spark.read.schema(schema).json(path)


def json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One array of objects, if the first character is a bracket, else one object on each line."""
    head = spark.read.text(present(spark, path)).where(F.trim("value") != "").limit(1).collect()
    many = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", many).json(path)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", breaks: bool = False) -> DataFrame:
    """A table with a header; with ``breaks``, quotes may hold line breaks, and then a file can't be split."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("multiLine", breaks).option("escape", '"').csv(present(spark, path))


def one_hot(spark: SparkSession, path: str, prefix: str) -> tuple[DataFrame, dict[int, Column]]:
    """A wide table, and its label columns by class id: those whose names start with ``prefix`` and end with the id."""
    df = spark.read.option("header", True).csv(present(spark, path))
    return df, {int(c.removeprefix(prefix)): F.col(f"`{c}`").cast("int") for c in df.columns if c.startswith(prefix)}


def zipped_classes(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, classes) from archives of CSV files, one file for each class with the class id in its name."""
    return unzipped(spark.read.format("binaryFile").load(present(spark, path)).select("content"), key)


def unzipped(archives: DataFrame, key: str) -> DataFrame:
    """The same from a table of archives (content); keys are trimmed and lower-cased. Members are unpacked on the
    executors, some rows at a time."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import re

        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in sorted(z.namelist()):
                        if not (m := re.search(r"(\d+)\.csv$", member)):
                            continue
                        keys: list[str] = []
                        with z.open(member) as f:
                            for row in csv.DictReader(io.TextIOWrapper(f, "utf-8", errors="replace")):
                                if k := (row.get(key) or "").strip().lower():
                                    keys.append(k)
                                if len(keys) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([int(m[1])] * len(keys), pa.int32())], names=["key", "class_id"])
                                    keys = []
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([int(m[1])] * len(keys), pa.int32())], names=["key", "class_id"])

    rows = archives.select("content").mapInArrow(unpack, "key string, class_id int")
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("class_id")).alias("classes"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, path) of whole text files; the id is the name without its suffix. Null bytes and bad UTF-8 are replaced."""
    raw = spark.read.text(present(spark, path), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select(F.regexp_extract(F.url_decode("path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), F.col("value").alias("text"), "path")


def sessions(spark: SparkSession, path: str, first: int = 70, last: int = 80) -> DataFrame:
    """(id, session, year, iso, text) of files ``Session N - YYYY/ISO_N_YYYY.txt`` of sessions within limits."""
    f = text_files(spark, f"{path}/*/*.txt")
    p = F.regexp_replace(F.url_decode("path"), r"\+", " ")
    part = lambda i: F.regexp_extract(p, r"Session (\d+) - (\d{4})/([A-Z]{3})_\d+_\d{4}\.txt$", i)
    rows = f.select("id", part(1).alias("s"), part(2).alias("y"), part(3).alias("iso"), "text").where("s <> ''")
    return rows.select("id", F.col("s").cast("int").alias("session"), F.col("y").cast("int").alias("year"), "iso", "text").where(F.col("session").between(first, last))


def agreed(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Joins two manifests; raises where a shard is on one side only or its counts differ."""
    j = left.select(key, F.col(count).alias("a")).join(right.select(key, F.col(count).alias("b")), key, "full")
    ok = F.when(F.col("a") == F.col("b"), F.col("a"))
    return j.select(key, F.coalesce(ok, F.raise_error(F.concat(F.lit("manifests differ at "), F.col(key).cast("string")))).cast("long").alias(count))


def required(df: DataFrame, key: str) -> DataFrame:
    """``df``, failing on a row without a key."""
    return df.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"a row has no {key}")).cast(dict(df.dtypes)[key])))
