"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.storage import write_table


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with ``name``, the row's place from 1 in the given order.

    Rows are dealt out by ranges of the order, ranked within their range, and
    moved up by the sizes of the ranges before.  Only those sizes, one per
    partition, reach the driver.
    """
    dealt = df.repartitionByRange(*order).withColumn("range__", F.spark_partition_id())
    kept = write_table(dealt, "ranges").df
    start = _starts(dict(kept.groupBy("range__").count().collect()))
    place = F.row_number().over(Window.partitionBy("range__").orderBy(*order)) + start
    return kept.withColumn(name, place.cast("long")).drop("range__")


def running_total(df: DataFrame, value: Column, *order: Column, name: str = "before") -> DataFrame:
    """``df`` with ``name``, the sum of the whole numbers ``value`` (null: 0) over all rows before in the given order, which must have no ties."""
    dealt = df.withColumn("value__", F.coalesce(value, F.lit(0)).cast("long")).repartitionByRange(*order).withColumn("range__", F.spark_partition_id())
    kept = write_table(dealt, "ranges").df
    start = _starts({k: n for k, n in kept.groupBy("range__").agg(F.sum("value__")).collect()})
    within = F.sum("value__").over(Window.partitionBy("range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("value__")
    return kept.withColumn(name, (within + start).cast("long")).drop("range__", "value__")


def latest_before(df: DataFrame, value: Column, *order: Column, name: str = "latest") -> DataFrame:
    """``df`` with ``name``, the last ``value`` that isn't null up to and with each row in the given order, which must have no ties.

    Rows are dealt out as in ``global_rank``; the last value of each partition
    reaches the driver.
    """
    dealt = df.withColumn("value__", value).repartitionByRange(*order).withColumn("range__", F.spark_partition_id())
    kept = write_table(dealt, "ranges").df
    seen = kept.where("value__ is not null").groupBy("range__").agg(F.max_by("value__", F.struct(*order)).alias("v"))
    ends = {r[0]: r[1] for r in seen.collect()}
    carried, last = [], None
    for k in range(max(ends, default=-1) + 2):
        carried.append(last)
        last = ends.get(k, last)
    kind = kept.schema["value__"].dataType
    before = F.array(*(F.lit(v).cast(kind) for v in carried))
    own = F.last("value__", ignorenulls=True).over(Window.partitionBy("range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # ranges after the last one with a value carry on that value
    start = F.element_at(before, F.least(F.col("range__") + 1, F.lit(len(carried))).cast("int"))
    return kept.withColumn(name, F.coalesce(own, start)).drop("range__", "value__")


def _starts(sizes: dict[int, int]) -> Column:
    """The sum of the sizes of the ranges before, by ``range__``."""
    starts, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    return F.element_at(F.split(F.lit(",".join(map(str, starts)) or "0"), ",").cast("array<bigint>"), F.col("range__") + 1)
