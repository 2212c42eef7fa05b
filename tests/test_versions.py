"""Writing into stored layers, and the conic projection against published figures."""

from __future__ import annotations

import math
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hydrospark.functions.projections import EPSG_5243, Conic
from hydrospark.operators import vector
from hydrospark.sources import versions


def test_only_touched_tiles_are_written(spark, tmp_path):
    path, where = f"file://{tmp_path}/layer", Path(tmp_path, "layer")
    grid = spark.range(1600).select((F.col("id") % 40).cast("int").alias("x"), (F.col("id") / 40).cast("int").alias("y"), F.lit(1.0).alias("v"))
    versions.create(grid.where("x <> 5"), path, 10)
    before = {f for f in where.rglob("*.parquet") if "cells" in f.parts}
    assert len(before) == 16
    patch = spark.createDataFrame([(12, 3, 7.0), (12, 3, 6.0), (13, 3, 8.0), (5, 5, 9.0), (99, 99, 9.0)], "x int, y int, v double")
    assert versions.write_cells(patch, path, 10) == 1
    after = {f for f in where.rglob("*.parquet") if "cells" in f.parts}
    assert before < after and {(f.parts[-3], f.parts[-2]) for f in after - before} == {("tile_x=1", "tile_y=0"), ("tile_x=0", "tile_y=0")}
    assert {r.write: r["count"] for r in versions.manifest(spark, path).groupBy("write").count().collect()} == {0: 14, 1: 2}
    now = {(r.x, r.y): r.v for r in versions.read(spark, path).collect()}
    assert len(now) == 1560 and {k: v for k, v in now.items() if v != 1.0} == {(12, 3): 7.0, (13, 3): 8.0}
    assert versions.read(spark, path, 0).where("v <> 1").count() == 0
    # a write that never got its manifest is seen by nobody and can't be overtaken unnoticed
    patch.write.parquet(f"{path}/cells/write=2/tile_x=0/tile_y=0")
    assert versions.versions(spark, path) == [0, 1] and versions.read(spark, path).count() == 1560
    with pytest.raises(AnalysisException):
        versions.write_cells(patch, path, 10)
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, path, 7)


def test_a_patch_beside_the_layer_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/layer"
    versions.create(spark.createDataFrame([(1, 1, 2.0)], "x int, y int, v double"), path, 4)
    assert versions.write_cells(spark.createDataFrame([(50, 50, 3.0)], "x int, y int, v double"), path, 4) == 1
    assert [tuple(r) for r in versions.read(spark, path).collect()] == [(1, 1, 2.0)]


def test_conic_has_the_published_figures(spark):
    # the worked example in Snyder's Map Projections: Clarke 1866, parallels 33 and 45
    clarke = Conic(6378206.4, 1 - (1 - 0.00676866) ** 0.5, (-96.0, 23.0), (33.0, 45.0))
    one = spark.range(1).select(clarke.forward(F.lit(-75.0), F.lit(35.0)).alias("p")).select("p.x", "p.y", clarke.inverse(F.col("p.x"), F.col("p.y")).alias("b")).first()
    assert abs(one.x - 1894410.9) < 0.1 and abs(one.y - 1564649.5) < 0.1
    assert abs(one.b.x + 75) < 1e-9 and abs(one.b.y - 35) < 1e-9
    far = spark.createDataFrame([(5.0, 47.0), (15.5, 55.2), (10.5, 51.0)], "lon double, lat double")
    back = far.select("*", EPSG_5243.forward(F.col("lon"), F.col("lat")).alias("p")).select("*", EPSG_5243.inverse(F.col("p.x"), F.col("p.y")).alias("b")).collect()
    assert all(abs(r.b.x - r.lon) < 1e-9 and abs(r.b.y - r.lat) < 1e-9 for r in back)
    assert abs(back[2].p.x) < 1e-6 and abs(back[2].p.y) < 1e-6
    # on a standard parallel lengths are true: a square of a hundredth of a degree has its area on the ellipsoid
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 48.66), (10.01, 48.66), (10.01, 48.67), (10.0, 48.67), (10.0, 48.66))))
    area = spark.range(1).select(vector.projected_area(F.array(ring)).alias("a")).first().a
    # lengths of arcs by the radii of curvature of the ellipsoid
    e2, lat, step = 0.00669438002290, math.radians(48.665), math.radians(0.01)
    w = math.sqrt(1 - e2 * math.sin(lat) ** 2)
    true = 6378137.0 / w * math.cos(lat) * step * 6378137.0 * (1 - e2) / w**3 * step
    assert abs(area / true - 1) < 1e-4
