"""An elevation grid, flow directions, lakes and rings derived from the relational test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions.cells import CODE_8_TO_128

WIDTH = 100


@dataclass(frozen=True)
class Grid:
    width: int
    height: int


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_of(spark: SparkSession, sf_dir: str) -> Grid:
    top = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return Grid(WIDTH, top // WIDTH + 1)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``x, y, z``: a tilted noisy plane."""
    key = F.col("o_orderkey")
    x, y = (key % WIDTH).cast("int"), F.floor(key / WIDTH).cast("int")
    return read(spark, sf_dir, "orders").select(x.alias("x"), y.alias("y"), (x * 1.0 + y * 2.0 + F.col("o_totalprice") / 100000.0).alias("z"))


def rectangles(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """``k, x0, y0, w, h, area``: lake rectangles."""
    k = F.expr("p_partkey div 40")
    own = read(spark, sf_dir, "part").where("p_partkey % 40 = 0")
    out = own.select(
        k.alias("k"),
        (2 + F.col("p_size") % 6).alias("w"),
        (2 + F.expr("p_size div 6") % 5).cast("int").alias("h"),
        ((k * 37) % 90 + 2).cast("int").alias("x0"),
        ((k * 53) % (grid.height - 10) + 2).cast("int").alias("y0"),
    )
    return out.withColumn("area", F.col("w") * F.col("h"))


def lake_cells(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """``x, y`` of all water cells."""
    r = rectangles(spark, sf_dir, grid)
    rows = r.select(F.explode(F.expr("sequence(x0, x0 + w - 1)")).alias("x"), "y0", "h")
    return rows.select("x", F.explode(F.expr("sequence(y0, y0 + h - 1)")).alias("y")).distinct()


def rings(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """``k, pos, x, y``: the closed four-corner ring of each rectangle, clockwise on the map."""
    r = rectangles(spark, sf_dir, grid)
    corner = lambda a, b: F.struct(F.expr(a).alias("x"), F.expr(b).alias("y"))
    corners = F.array(corner("x0", "y0"), corner("x0 + w", "y0"), corner("x0 + w", "y0 + h"), corner("x0", "y0 + h"), corner("x0", "y0"))
    return r.select("k", F.posexplode(corners).alias("pos", "p")).select("k", "pos", "p.x", "p.y")


def direction_128(d8: DataFrame, all_cells: DataFrame) -> DataFrame:
    """``x, y, dir128`` with 0 on the left and top border (ocean) and 255 in inland pits."""
    from hydrospark.functions.cells import code_128

    joined = d8 if d8 is all_cells else all_cells.select("x", "y").join(d8.select("x", "y", "dir"), ["x", "y"], "left")
    ocean = (F.col("x") == 0) | (F.col("y") == 0)
    code = F.when(ocean, 0).when(F.col("dir").isNull(), 255).otherwise(code_128(F.col("dir")))
    return joined.select("x", "y", code.alias("dir128"))


assert set(CODE_8_TO_128) == set(range(1, 9))
