"""Incremental jobs. Each runs until its input is used up and can be started again from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], key: str, target: str, checkpoint: str, form: str = "json") -> None:
    """New files of ``source``, transformed, each key once for ever, appended to ``target`` exactly once.

    The keys that were seen are state without a limit, as the operation asks for; see ``clean_within`` for bounded state."""
    rows = transform(spark.readStream.schema(schema).format(form).load(source)).dropDuplicates([key])
    _run(rows, target, checkpoint)


def clean_within(spark: SparkSession, source: str, schema: str, key: str, time: str, delay: str, target: str, checkpoint: str, form: str = "json") -> None:
    """The same with duplicates caught within a delay of event time only, so that state stays bounded."""
    rows = spark.readStream.schema(schema).format(form).load(source).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    _run(rows, target, checkpoint)


def windowed(spark: SparkSession, source: str, schema: str, time: str, by: str, width: str, delay: str, target: str, checkpoint: str, slide: str | None = None, gap: str | None = None, form: str = "parquet") -> None:
    """Counts by key and tumbling, sliding or (with ``gap``) session window; late rows beyond ``delay`` are dropped."""
    rows = spark.readStream.schema(schema).format(form).load(source).withWatermark(time, delay)
    w = F.session_window(time, gap) if gap else F.window(time, width, slide) if slide else F.window(time, width)
    counts = rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"))
    _run(counts.select("w.start", "w.end", by, "n"), target, checkpoint)


def _run(rows: DataFrame, target: str, checkpoint: str) -> None:
    q = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    q.awaitTermination()
