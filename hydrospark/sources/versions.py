"""Stored layers that can be written into: tiles are replaced, readers see one version.

A version is a manifest, a row for each tile that names the write its cells
come from.  A write stores the tiles it touches under a number of its own and
then the manifest of the next version, so tiles it doesn't touch keep their
files, older versions stay readable, and what a failed write has left behind
is in no manifest.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.operators.algebra import overlay
from hydrospark.sources.tiles import tiled

TILE = ["tile_x", "tile_y"]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/version=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(re.search(r"version=(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``tile_x, tile_y, write`` of a version, by default the latest."""
    have = versions(spark, path)
    at = version if version is not None else have[-1] if have else None
    if at not in have:
        raise ValueError(f"{path} has no version {'' if at is None else at}".rstrip())
    return spark.read.parquet(f"{path}/manifest/version={at}")


def _store(cells: DataFrame, path: str, write: int) -> None:
    cells.repartition(*TILE).sortWithinPartitions(*TILE, "y", "x").write.mode("error").partitionBy(*TILE).parquet(f"{path}/cells/write={write}")


def _commit(tiles: DataFrame, path: str, version: int) -> None:
    tiles.select(*TILE, "write").write.mode("error").parquet(f"{path}/manifest/version={version}")


def create(raster: DataFrame, path: str, size: int) -> int:
    """Store a layer as version 0."""
    _store(tiled(raster, size), path, 0)
    _commit(raster.sparkSession.read.parquet(f"{path}/cells/write=0").select(*TILE).distinct().withColumn("write", F.lit(0)), path, 0)
    return 0


def read(spark: SparkSession, path: str, version: int | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """The cells of a version, of ``tiles`` (``tile_x, tile_y``) alone if given; files of other tiles and writes are not opened."""
    wanted = manifest(spark, path, version)
    if tiles is not None:
        wanted = wanted.join(tiles.select(*TILE).distinct(), TILE, "left_semi")
    # a row for each tile; the join prunes the partitions that are read
    return spark.read.option("basePath", f"{path}/cells").parquet(f"{path}/cells/write=*").join(wanted, [*TILE, "write"], "left_semi").drop("write", *TILE)


def write_cells(patch: DataFrame, path: str, size: int, value: str = "v") -> int:
    """Write the patch's values over the stored ones and tell the new version; patch cells that the layer lacks are not added.

    Only tiles with a patch cell are read and written.  Of several rows of one
    cell the greatest value counts.  Of two writers that start from the same
    version the later one fails and has to start again.
    """
    spark = patch.sparkSession
    base = versions(spark, path)[-1]
    have = manifest(spark, path, base)
    new = patch.groupBy("x", "y").agg(F.max(value).alias(value))
    touched = tiled(new, size).select(*TILE).distinct().join(have, TILE, "left_semi")
    _store(tiled(overlay(read(spark, path, base, touched), new, value), size), path, base + 1)
    mine = spark.read.parquet(f"{path}/cells/write={base + 1}").select(*TILE).distinct().withColumn("mine", F.lit(base + 1)) if touched.take(1) else None
    rows = have if mine is None else have.join(mine, TILE, "left").select(*TILE, F.coalesce("mine", "write").alias("write"))
    _commit(rows, path, base + 1)
    return base + 1
