"""An append-only log of finished work that outlives a stop at any time.

Records are lines of JSON with their key, the digest of the configuration that they were made under, and a digest of the
line. Tasks write into a folder that no reader looks at; once all are done the driver renames it to a segment of the
log, and deletes it if one of them fails. So a segment is there whole or not at all. A line whose own digest does not fit
(a torn tail, where a store or another writer left one) and a line of another configuration count as not done; ``repair``
writes the lines that are left anew."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpweave.session import removed


def digest(config: dict) -> str:
    """The same for equal configurations, whatever the order of their names."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


class RecordLog:
    """Records of one configuration at ``path``; ``schema`` is that of a record, whose first column is its key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, config: dict):
        self.spark, self.path, self.schema, self.mark = spark, path.rstrip("/"), schema, digest(config)
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _lines(self) -> DataFrame | None:
        """(body, whole): the lines of all segments, and whether each fits its digest."""
        fs, p = self._path(f"{self.path}/segment-*")
        if not fs.globStatus(p):
            return None
        body = F.regexp_extract("value", r"(?s)^[0-9a-f]{32} (.*)$", 1)
        return self.spark.read.text(f"{self.path}/segment-*").select(body.alias("body"), (F.substring("value", 1, 32) == F.md5(body)).alias("whole"))

    def _parsed(self, lines: DataFrame) -> DataFrame:
        return lines.select("body", "whole", F.from_json("body", f"mark string, record struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in self.spark.createDataFrame([], self.schema).schema.fields)}>").alias("r"))

    def records(self) -> DataFrame:
        """Whole records of this configuration, a key once."""
        lines = self._lines()
        if lines is None:
            return self.spark.createDataFrame([], self.schema)
        mine = self._parsed(lines).where(F.col("whole") & (F.col("r.mark") == self.mark)).select("r.record.*")
        return mine.dropDuplicates([self.columns[0]])

    def left(self, df: DataFrame, key: Column | str) -> DataFrame:
        """Rows of ``df`` whose keys have no record yet."""
        done = self.records().select(F.col(self.columns[0]).alias("__done"))
        key = F.col(key) if isinstance(key, str) else key
        return df.join(done, key == F.col("__done"), "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Adds records; all of them are there afterwards, or none."""
        self._write(rows.select(F.to_json(F.struct(F.lit(self.mark).alias("mark"), F.struct(*(F.col(f"`{c}`") for c in self.columns)).alias("record"))).alias("body")))

    def _write(self, bodies: DataFrame) -> str:
        name = uuid.uuid4().hex
        making, made = f"{self.path}/making-{name}", f"{self.path}/segment-{name}"
        try:
            bodies.select(F.concat_ws(" ", F.md5("body"), "body").alias("value")).write.text(making)
            fs, p = self._path(making)
            if not fs.rename(p, self._path(made)[1]):
                raise OSError(f"{making} could not be renamed")
        except BaseException:
            removed(self.spark, making)
            raise
        return made

    def repair(self) -> tuple[int, int]:
        """Writes whole records of this configuration anew and deletes all older segments; (torn lines, stale ones)."""
        lines = self._lines()
        if lines is None:
            return 0, 0
        fs, p = self._path(f"{self.path}/segment-*")
        old = [s.getPath().toString() for s in fs.globStatus(p)]
        rows = self._parsed(lines)
        torn, stale = rows.agg(F.count_if(~F.col("whole")), F.count_if(F.col("whole") & (F.col("r.mark") != self.mark))).first()
        self._write(rows.where(F.col("whole") & (F.col("r.mark") == self.mark)).select("body"))
        for path in old:
            removed(self.spark, path)
        return torn, stale
