"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes that go to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and checkpoints that go with what they hold; ``conf`` uses ``__`` for dots."""
    b = SparkSession.builder.appName("corpweave")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``, or the one that the context has already.

    A temporary folder serves in local mode alone; on a cluster executors would not see it, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpweave-"))
    return named or sc.getCheckpointDir()


#: Up to so many rows a checkpoint is dealt anew, to files of so many rows, and so many files at least.
FEW, ROWS, FILES = 1_000_000, 20_000, 6


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts the lineage of ``df`` with a reliable checkpoint in the shared folder.

    ``rows`` says how many there are at most, if it is known, so that few rows do not become as many files as a shuffle
    has partitions."""
    shared_dir(df.sparkSession)
    few = rows is not None and rows <= FEW
    return (df.repartition(max(FILES, -(-rows // ROWS))) if few else df).checkpoint()


def named(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df`` but some, safe for any name."""
    return [F.col(f"`{c}`") for c in df.columns if c not in without]


def map_arrow(df: DataFrame, run, kept: list[str], fields: list[tuple[str, str]]) -> DataFrame:
    """``df.mapInArrow`` for columns of any name.

    ``run`` takes batches whose columns stand in the order of ``df`` and yields lists of arrays: the columns ``kept``,
    then ``fields`` (name, type)."""
    import pyarrow as pa

    at = {c: i for i, c in enumerate(df.columns)}
    plain = df.toDF(*(f"c{i}" for i in range(len(at))))
    types = dict(plain.dtypes)
    names = [f"c{at[c]}" for c in kept] + [f"f{i}" for i in range(len(fields))]
    ddl = ", ".join(f"{n} {t}" for n, t in zip(names, [*(types[f"c{at[c]}"] for c in kept), *(t for _, t in fields)]))

    def batches(it):
        for arrays in run(it):
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return plain.mapInArrow(batches, ddl).toDF(*kept, *(n for n, _ in fields))


def ship(spark: SparkSession) -> SparkSession:
    """Prepares a session for this package's Python workers.

    They import it from where the driver has it, wherever it was started; on a cluster the package comes with
    ``--py-files``, the folder is not found there and does no harm. Batches of rows go to them by size, so that long texts
    take no more memory than short ones; a size that was set by hand stays."""
    if spark.conf.get(BATCH, "64m").lower() in ("64m", "64mb", "67108864", "67108864b"):
        spark.conf.set(BATCH, "4m")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that this session wrote in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
