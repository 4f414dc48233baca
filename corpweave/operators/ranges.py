"""Global row numbers and range lookups that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpweave.session import cut


def global_index(df: DataFrame, order, name: str) -> DataFrame:
    """Row numbers from zero in a global order, which must be total. Rows are range-partitioned and numbered within
    their partition; the partitions' sizes, a row each, give the offsets."""
    order = order if isinstance(order, list) else [order]
    parted = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parted.withColumn("__at", local).join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before")).select(*df.columns, name)


def running_offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, lo, hi): where each key's rows begin and end if keys are laid end to end in order."""
    parted = cut(counts.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    totals = parted.groupBy("__part").agg(F.sum(n).alias("__n"))
    before = totals.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.sum(n).over(Window.partitionBy("__part").orderBy(key))
    rows = parted.withColumn("__upto", local).join(F.broadcast(before), "__part")
    return rows.select(key, (F.col("__upto") - F.col(n) + F.col("__before")).alias("lo"), (F.col("__upto") + F.col("__before")).alias("hi"))


def running(df: DataFrame, by: list[str], order: str, sums: list[str], following: str | None = None) -> DataFrame:
    """Adds for each of ``sums`` a column ``<name>_before`` with its total over the rows before in the group, and with
    ``following`` the next value of ``order``. A group has a value of ``order`` once.

    Rows are range-partitioned by group and value, so that a large group spans many tasks; the parts' totals, a row for
    each part and group in it, give the offsets."""
    parted = cut(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    keys, own = ["__part", *by], Window.partitionBy("__part", *by).orderBy(order)
    totals = parted.groupBy(*keys).agg(*(F.sum(c).alias(f"__{c}") for c in sums), F.min(order).alias("__first"))
    parts = Window.partitionBy(*by).orderBy("__part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums), F.lead("__first").over(parts).alias("__next"))
    local = parted.select("*", *(F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__own_{c}") for c in sums), F.lead(order).over(own).alias("__own_next"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(keys)]
    rows = local.join(totals, same)
    out = [(F.col(f"__own_{c}") + F.col(f"__{c}")).alias(f"{c}_before") for c in sums]
    return rows.select(*df.columns, *out, *([F.coalesce("__own_next", "__next").alias(following)] if following else []))


def among_first(df: DataFrame, by: list[str], order: Column, tie: str, first: Column, name: str) -> DataFrame:
    """Adds ``name``: whether a row is one of the first rows of its group by ``order``, an MD5 in hexadecimal digits.

    ``first`` says how many, from the group's size, a column n. Rows are counted by the first three digits, 4,096 buckets; only
    those of the bucket in which the limit lies are ranked."""
    d = df.withColumn("__order", order).withColumn("__bucket", F.substring("__order", 1, 3))
    counts = d.groupBy(*by, "__bucket").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("c").over(whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).withColumn("n", F.sum("c").over(whole)).withColumn("first", first)
    limit = F.when(F.col("before") + F.col("c") <= F.col("first"), F.lit(None)).otherwise(F.greatest(F.col("first") - F.col("before"), F.lit(0)))
    keys = [*by, "__bucket"]
    state = counts.select(*(F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)), limit.cast("long").alias("__limit"))
    rows = d.join(state, [F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(keys)])
    open_ = rows.where("__limit > 0").withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy("__order", tie)))
    ranked = open_.select(*df.columns, (F.col("__at") <= F.col("__limit")).alias(name))
    return rows.where("__limit is null or __limit = 0").select(*df.columns, F.col("__limit").isNull().alias(name)).unionByName(ranked)


def bin_lookup(rows: DataFrame, at: str, bins: DataFrame, lo: str, hi: str, width: int = 4096) -> DataFrame:
    """Joins rows to the bin with lo <= at < hi. Bins are filed under every bucket of ``width`` that they touch, so the
    lookup is an equi-join."""
    filed = bins.where(F.col(hi) > F.col(lo)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    found = rows.withColumn("__bucket", F.floor(F.col(at) / width)).join(filed, "__bucket")
    return found.where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__bucket")
