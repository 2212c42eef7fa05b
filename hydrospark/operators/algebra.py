"""Map algebra on sparse rasters: a missing row is nodata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.functions.cells import CODE_128_TO_8, CODE_8_TO_128, SINK, code_8, signed_byte

# Reclass tables as rows of minimum, maximum, new value.
TABLE_128_TO_8 = [(k, k, v) for k, v in CODE_128_TO_8.items()] + [(-1, -1, -1), (255, 255, -1)]
TABLE_8_TO_128 = [(k, k, v) for k, v in CODE_8_TO_128.items()]
TABLE_NORMALISE = [(247, 247, 0), (-9, -9, 0), (255, 255, 0)]


def reclassify(v: Column, groups: list[list], values: list) -> Column:
    """Value of the first group that holds ``v``; other values stay."""
    out = v
    for group, value in reversed(list(zip(groups, values, strict=True))):
        out = F.when(v.isin(group), value).otherwise(out)
    return out


def reclass_table(v: Column, table: list[tuple]) -> Column:
    """Value of the first row with ``minimum <= v <= maximum``; unmatched values stay, nodata becomes 0.

    Every row becomes a part of one expression; a long table is joined by
    ``ranges.reclass_ranges`` instead.
    """
    out = v
    for low, high, new in reversed(table):
        out = F.when(v.between(low, high), new).otherwise(out)
    return F.when(v.isNull(), 0).otherwise(out)


def direction_reclass(raster: DataFrame, code: str = "dir128") -> DataFrame:
    """``x, y, dir, is_final``: 8-system directions, 0 where there is none; sinks are marked and stay 0."""
    return raster.select("x", "y", F.coalesce(code_8(F.col(code)), F.lit(0)).alias("dir"), (signed_byte(F.col(code)) == SINK).alias("is_final"))


def erase(raster: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of any layers in ``raster`` that no mask cell covers."""
    return raster.join(mask.select("x", "y"), ["x", "y"], "left_anti")


def threshold(raster: DataFrame, at: float, value: str = "acc") -> DataFrame:
    """``x, y, s``: 1 where the value reaches the threshold."""
    return raster.select("x", "y", F.when(F.col(value) >= at, 1).otherwise(0).alias("s"))


def overlay(base: DataFrame, patch: DataFrame, value: str = "v") -> DataFrame:
    """``base`` with the patch's values written over it; patch cells outside the base are not added."""
    new = patch.select("x", "y", F.col(value).alias("new__"))
    return base.join(new, ["x", "y"], "left").withColumn(value, F.coalesce("new__", value)).drop("new__")


def mosaic(layers: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """One value per cell: that of the row that comes last by ``order``.

    The greatest ``(order, value)`` struct wins, so partial results are
    combined before the shuffle and no task sorts a cell's rows.
    """
    last = F.max(F.struct(*order, value)).alias("last")
    return layers.groupBy(*key).agg(last).select(*key, F.col(f"last.{value}").alias(value))


def mosaic_window(layers: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """As ``mosaic`` for orders that a struct can't express."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return layers.withColumn("rank__", rank).where("rank__ = 1").select(*key, value)


def with_names(paths_and_layers: list[tuple[str, DataFrame]], keywords: list[str]) -> DataFrame | None:
    """Union of the layers whose file name contains a keyword, numbered in order as ``file_ord``."""
    chosen = [d for name, d in sorted(paths_and_layers, key=lambda p: p[0]) if any(k in name.rsplit("/", 1)[-1] for k in keywords)]
    numbered = [d.withColumn("file_ord", F.lit(k)) for k, d in enumerate(chosen)]
    return reduce(DataFrame.unionByName, numbered) if numbered else None
