"""Text records of river cells and trace points, and published layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions.cells import Geotransform, cell_at, in_grid

RIVER = "x int, y int, acc double"
POINT = "cx double, cy double"


def write_rivers(stream: DataFrame, acc: DataFrame, path: str) -> None:
    """River cells as ``x,y,acc`` lines, row by row."""
    rows = stream.where("s = 1").join(acc, ["x", "y"]).select("x", "y", "acc")
    rows.orderBy("y", "x").write.mode("overwrite").csv(path)


def read_rivers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RIVER).csv(path)


def write_points(points: DataFrame, path: str) -> None:
    points.select("cx", "cy").write.mode("overwrite").csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINT).csv(path)


def trace_cells(points: DataFrame, g: Geotransform) -> DataFrame:
    """``x, y, v``: cells at recorded coordinates, each once; points off the grid are dropped."""
    at = points.select(cell_at(F.col("cx"), F.col("cy"), g).alias("o")).select("o.x", "o.y")
    return at.where(in_grid(F.col("x"), F.col("y"), g.width, g.height)).distinct().withColumn("v", F.lit(1))


def without(raster: DataFrame, value: str, nodata) -> DataFrame:
    """The raster with one value turned into nodata, that is, dropped."""
    return raster.where(F.col(value) != nodata)


def publish(layers: dict[str, DataFrame], path: str) -> None:
    """Write each named layer below ``path``."""
    for name, layer in layers.items():
        layer.write.mode("overwrite").parquet(f"{path}/{name}")
