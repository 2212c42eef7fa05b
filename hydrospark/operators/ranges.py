"""Joins of points to ranges and boxes, the first row winning.

A range belongs to the level of its length, a power of two, at which it
touches two bins at most; a point looks at one bin of each level that occurs.
So both sides meet by an equi-join on level and bin, whatever lengths occur
together, and no pair is looked at that isn't near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Level of ranges of one value, and of those without an end.
POINT, ENDLESS = -5000, 5000


def _bin(v: Column, level: Column) -> Column:
    """Bin of a value at a level; at ``POINT`` the value itself, at ``ENDLESS`` one for all."""
    scaled = F.floor(v / F.pow(F.lit(2.0), level.cast("double"))).cast("double")
    return F.when(level == POINT, v.cast("double")).when(level == ENDLESS, 0.0).otherwise(scaled)


def first_range(points: DataFrame, ranges: DataFrame, dims: list[tuple[str, str, str]], new: str, order: str) -> DataFrame:
    """The distinct values of ``points`` with ``new`` of the first range, by ``order``, that holds them; others have no row.

    ``dims`` names for each dimension the column of the points and those of
    the ranges' least and greatest value, both within.  Ranges with a null
    end, or with ends the wrong way round, hold nothing, nor does a null
    value.  Many ranges over one point all look at it; equal ones are put
    together first.
    """
    values, spans = [d[0] for d in dims], [d[1:] for d in dims]
    proper = _proper(ranges, spans)
    proper = proper.groupBy(*(F.col(c).cast("double").alias(c) for s in spans for c in s)).agg(F.min_by(F.struct(order, new), order).alias("row__"))
    met = _met(points.select(*values).distinct(), proper, dims)
    return met.groupBy(*values).agg(F.min_by(f"row__.{new}", f"row__.{order}").alias(new))


def every_range(points: DataFrame, ranges: DataFrame, dims: list[tuple[str, str, str]], *new: str) -> DataFrame:
    """``points`` with the columns ``new`` of every range that holds them, a row for each; otherwise as ``first_range``."""
    ends = [c for d in dims for c in d[1:]]
    held = _proper(ranges, [d[1:] for d in dims]).select(*ends, *new)
    return _met(points, held, dims).select(*points.columns, *new)


def _proper(ranges: DataFrame, spans: list[tuple[str, str]]) -> DataFrame:
    for low, high in spans:
        ranges = ranges.where(F.col(low) <= F.col(high))
    return ranges


def _met(points: DataFrame, ranges: DataFrame, dims: list[tuple[str, str, str]]) -> DataFrame:
    """Points beside the ranges that hold them, by level and bin."""
    values, spans = [d[0] for d in dims], [d[1:] for d in dims]
    longest = F.greatest(*(F.col(high) - F.col(low) for low, high in spans), F.lit(0.0))
    level = F.when(longest == 0, POINT).when(longest < F.lit(2.0**1000), F.greatest(F.ceil(F.log2(longest)), F.lit(-1000)).cast("int")).otherwise(ENDLESS)
    held = ranges.withColumn("level__", level)
    levels = sorted(r[0] for r in held.select("level__").distinct().collect())  # some 2000 at most
    for k, (low, high) in enumerate(spans):
        one, two = _bin(F.col(low), F.col("level__")), _bin(F.col(high), F.col("level__"))
        held = held.withColumn(f"bin{k}__", F.explode(F.array_distinct(F.array(one, two))))  # a range is no longer than a bin
    asked = points.select("*", F.explode(F.array(*map(F.lit, levels or [POINT]))).alias("level__"))
    asked = asked.select("*", *(_bin(F.col(v), F.col("level__")).alias(f"bin{k}__") for k, v in enumerate(values)))
    met = asked.join(held, ["level__", *(f"bin{k}__" for k in range(len(dims)))])
    for v, low, high in dims:
        met = met.where(F.col(v).between(F.col(low), F.col(high)))
    return met


def reclass_ranges(raster: DataFrame, table: DataFrame, value: str = "v") -> DataFrame:
    """``raster`` with ``value`` from the first row of ``table`` (``pos, minimum, maximum, new``) that holds it.

    Unmatched values stay and nodata becomes 0, as in ``reclass_table``, for
    tables of any length.
    """
    found = first_range(raster.where(F.col(value).isNotNull()), table.select("pos", "minimum", "maximum", F.col("new").alias("new__")), [(value, "minimum", "maximum")], "new__", "pos")
    return raster.join(found, value, "left").withColumn(value, F.when(F.col(value).isNull(), 0).otherwise(F.coalesce("new__", value))).select(*raster.columns)


def boxes_of(points: DataFrame, boxes: DataFrame, order: str = "box") -> DataFrame:
    """``points`` (``x, y`` and more) with ``box``, the first of ``boxes`` (``box, left, right, low, high``) that holds them; null where none does."""
    named = boxes.select(F.col(order).alias("order__"), "box", "left", "right", "low", "high")
    found = first_range(points, named, [("x", "left", "right"), ("y", "low", "high")], "box", "order__")
    return points.join(found, ["x", "y"], "left").select(*points.columns, "box")
