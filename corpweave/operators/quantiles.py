"""Exact quantiles of groups of any size by histogram selection.

The range in which an order statistic lies is cut in bins, values are counted by bin, and the bin that holds it, drawn in to
the least and greatest value that is really there, is cut again, until both are the same number. A task counts its rows
before they are shuffled, so neither a task nor the driver ever holds the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpweave.session import cut

BINS = 4096


def order_statistics(df: DataFrame, by: str, value: str, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """(by, rank, x): the value at each ``rank`` (from zero, in ascending order) of ``wanted`` (by, rank), a few for each group.

    Nulls and NaN count as missing."""
    rows = df.select(F.col(f"`{by}`").alias("__by"), F.col(f"`{value}`").cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    state = rows.groupBy("__by").agg(F.min("__x").alias("lo"), F.max("__x").alias("hi")).withColumn("below", F.lit(0).cast("long"))
    asked = wanted.select(F.col(f"`{by}`").alias("__of"), F.col("rank").cast("long").alias("rank")).distinct()
    state = cut(state.join(asked, F.col("__by").eqNullSafe(F.col("__of"))).select("__of", "rank", "lo", "hi", "below"), 1)
    while not state.where("lo < hi").isEmpty():
        open_ = state.where("lo < hi")
        width = F.col("hi") - F.col("lo")
        quarter = lambda c: F.col(c) / 4  # noqa: E731  a range as wide as all doubles has a width then
        share = F.when(width < float("inf"), (F.col("__x") - F.col("lo")) / width).otherwise((quarter("__x") - quarter("lo")) / (quarter("hi") - quarter("lo")))
        place = F.least(F.floor(share * bins), F.lit(bins - 1))
        inside = rows.join(F.broadcast(open_), F.col("__by").eqNullSafe(F.col("__of")) & F.col("__x").between(F.col("lo"), F.col("hi")))  # a few rows for each group
        counts = inside.groupBy("__of", "rank", "below", place.alias("bin")).agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        w = Window.partitionBy("__of", "rank").orderBy("bin")
        counts = counts.withColumn("before", F.col("below") + F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        found = counts.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("__of", "rank", "lo", "hi", F.col("before").alias("below"))
        state = cut(found.unionByName(state.where("lo = hi")), 1)
    return state.select(F.col("__of").alias(by), "rank", F.col("lo").alias("x"))


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """(by, a column for each of ``shares``): exact quantiles with linear interpolation between neighbours."""
    n = df.where(F.col(f"`{value}`").isNotNull() & ~F.isnan(F.col(f"`{value}`").cast("double"))).groupBy(F.col(f"`{by}`").alias(by)).agg(F.count("*").alias("__n"))
    n = cut(n, 1)
    at = lambda p: F.lit(float(p)) * (F.col("__n") - 1)
    wanted = n.select(by, F.explode(F.array(*(r.cast("long") for p in shares.values() for r in (F.floor(at(p)), F.ceil(at(p)))))).alias("rank"))
    found = order_statistics(df, by, value, wanted, bins)
    held = found.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("__found")).withColumnRenamed(by, "__of")
    both = n.join(held, F.col(by).eqNullSafe(F.col("__of")))
    of = lambda r: F.element_at("__found", r.cast("long"))
    out = [(of(F.floor(at(p))) + (of(F.ceil(at(p))) - of(F.floor(at(p)))) * (at(p) - F.floor(at(p)))).alias(name) for name, p in shares.items()]
    return both.select(by, *out)
