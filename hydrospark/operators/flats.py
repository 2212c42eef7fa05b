"""Flow directions on flats.

A cell without a lower neighbour lies on a flat.  Flats drain towards their
low edge, the cells of the same level that have a way down or lie at the rim
of the raster, and on the way there away from higher ground.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.cells import STEPS
from hydrospark.operators import stencil
from hydrospark.operators.blocks import NONE, SIDE, around, distances, each_block, within
from hydrospark.storage import write_table


def flat_directions(dem: DataFrame, d8: DataFrame, z: str = "z", side: int = SIDE) -> DataFrame:
    """``x, y, dir`` for the cells of flats that have a low edge.

    ``d8`` holds the cells with a way down.  A cell with fewer than 8
    neighbours drains off the raster and needs no direction.  A cell beside
    the low edge flows there, by the lowest direction code.  Any other flows
    to the neighbour on the flat with the least ``2 * towards - away``: the
    distance to the low edge, twice, less the distance from higher ground (0
    where there is none).  Between neighbours either distance differs by one
    at most, so this falls along every step and no flow runs in a circle.  A
    flat without a low edge, as in a pit that isn't filled, gets none.
    """
    ground = dem.select("x", "y", F.col(z).cast("double").alias("z")).join(d8.select("x", "y", F.lit(True).alias("falls")), ["x", "y"], "left")
    return _flats(ground.withColumn("falls", F.coalesce("falls", F.lit(False))), side)


def _kinds(there: np.ndarray, left: int, top: int, z: np.ndarray, falls: np.ndarray) -> dict[str, np.ndarray]:
    """Level cells inside the rim: whether higher ground is beside them, and the first direction to the low edge; squares have a margin of two cells."""
    falls, there = falls == 1, there & ~np.isnan(z)
    n = sum(around(there, s, False).astype(np.int8) for s in STEPS.values())
    low = there & (falls | (n < 8))
    below, code = np.zeros(z.shape, bool), np.full(z.shape, NONE)
    for d in sorted(STEPS, reverse=True):
        near = around(z, STEPS[d], np.nan)
        below |= near > z
        code[(near == z) & around(low, STEPS[d], False)] = d
    y, x = np.nonzero(within(there & ~falls & (n == 8), 2))
    return {"x": x + left, "y": y + top, "level": z[y, x], "below": below[y, x], "low_dir": code[y, x]}


def _gentlest(there: np.ndarray, left: int, top: int, level: np.ndarray, low_dir: np.ndarray, grade: np.ndarray) -> dict[str, np.ndarray]:
    """The direction of the least grade on the flat, for cells that aren't beside the low edge."""
    best, code = np.full(grade.shape, np.iinfo(np.int64).max), np.full(grade.shape, NONE)
    for d, step in STEPS.items():
        near = around(grade, step, NONE)
        less = (around(level, step, np.nan) == level) & (near != NONE) & (near < best)
        best[less], code[less] = near[less], d
    y, x = np.nonzero(within(there & (low_dir == NONE) & (code != NONE)))
    return {"x": x + left, "y": y + top, "dir": code[y, x]}


def _flats(ground: DataFrame, side: int) -> DataFrame:
    """``flat_directions`` of ``x, y, z, falls``."""
    kinds = ", ".join(f"{c} {ground.schema[c].dataType.simpleString()}" for c in "xy")
    # cells without any neighbour are part of the rim; to know a neighbour's own neighbours takes two cells of margin
    flat = write_table(each_block(ground, _kinds, f"{kinds}, level double, below boolean, low_dir int", 2, side), "flats").df
    far = distances(flat, {"towards": F.when(F.col("low_dir").isNotNull(), 1), "away": F.when(F.col("below"), 1)}, side)
    grade = write_table(far.where("towards is not null").select("x", "y", (2 * F.col("towards") - F.coalesce("away", F.lit(0))).alias("grade")), "grades").df
    best = each_block(flat.select("x", "y", "level", "low_dir").join(grade, ["x", "y"], "left"), _gentlest, f"{kinds}, dir int", 1, side)
    return best.unionByName(flat.where("low_dir is not null").select("x", "y", F.col("low_dir").cast("int").alias("dir")))


def all_directions(dem: DataFrame, z: str = "z", side: int = SIDE) -> DataFrame:
    """``x, y, z, dir, slope`` of every cell: ``drain_directions``, null where there is none."""
    steep = write_table(stencil.steepest(dem, z), "d8").df
    gentle = write_table(_flats(steep.select("x", "y", "z", F.col("dir").isNotNull().alias("falls")), side), "flat-directions").df
    level = steep.where("dir is null").select("x", "y", "z").join(gentle, ["x", "y"], "left").withColumn("slope", F.when(F.col("dir").isNotNull(), F.lit(0.0)))
    return steep.where("dir is not null").unionByName(level)


def drain_directions(dem: DataFrame, z: str = "z", side: int = SIDE) -> DataFrame:
    """``x, y, dir, slope``: steepest descent, and on flats with a low edge the way there at slope 0.

    On a filled surface every cell inside the rim gets a direction, and every
    path leaves the raster.
    """
    return all_directions(dem, z, side).where("dir is not null").select("x", "y", "dir", "slope")
