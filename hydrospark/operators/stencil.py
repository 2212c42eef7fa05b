"""Operators on the 8 neighbours of a cell.

Steepest descent is told block by block.  In the others a cell sends its value
to its neighbours and each cell sums up what it got; sums are combined before
the shuffle, so rasters stored in tiles send little more than their cells once.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.cells import STEPS, direction_between, downstream, downstream_128, in_grid, neighbours, signed_byte
from hydrospark.operators.blocks import SIDE, around, each_block, within


def sent(raster: DataFrame, *carry: str) -> DataFrame:
    """A row for each neighbour of each cell: its ``x, y``, ``dir`` from it back to the sender, ``ord``, and what is carried."""
    n = neighbours(F.col("x"), F.col("y"))
    rows = raster.select(*carry, F.explode(n).alias("n"))
    back = (F.col("n.dir") + 3) % 8 + 1  # the opposite direction
    return rows.select(F.col("n.x").alias("x"), F.col("n.y").alias("y"), back.alias("dir"), F.col("n.ord").alias("ord"), *carry)


def steepest(dem: DataFrame, z: str = "z", side: int = SIDE) -> DataFrame:
    """``x, y, z, dir, slope`` for every cell: steepest descent, null in ``dir, slope`` without a lower neighbour.

    Equal slopes go to the lower direction code.  A cell without a height, null
    or NaN, has no direction and is no neighbour.
    """
    kinds = [f"{c} {dem.schema[c].dataType.simpleString()}" for c in "xy"]

    def compute(there: np.ndarray, left: int, top: int, z: np.ndarray) -> dict[str, np.ndarray]:
        best, code = np.zeros(z.shape), np.zeros(z.shape, np.int64)
        for d, step in STEPS.items():
            slope = (z - around(z, step, np.nan)) / (1.0 if d % 2 else sqrt(2.0))
            more = slope > best  # never for nan, so the first of equal ones stays
            best[more], code[more] = slope[more], d
        y, x = np.nonzero(within(there))
        falls = code[y, x] > 0
        return {"x": x + left, "y": y + top, "z": z[y, x], "dir": np.where(falls, code[y, x], np.iinfo(np.int64).min), "slope": np.where(falls, best[y, x], np.nan)}

    return each_block(dem.select("x", "y", F.col(z).cast("double").alias("z")), compute, ", ".join([*kinds, "z double", "dir int", "slope double"]), side=side)


def d8(dem: DataFrame, z: str = "z") -> DataFrame:
    """``x, y, dir, slope``: steepest descent as ``steepest`` tells it; cells without a lower neighbour have no row."""
    return steepest(dem, z).where("dir is not null").select("x", "y", "dir", "slope")


def boundary_cells(raster: DataFrame) -> DataFrame:
    """Cells on the edge of the raster or next to nodata: those with fewer than 8 neighbours."""
    own = raster.select("x", "y", F.lit(1).alias("own"), F.lit(0).alias("got"))
    got = sent(raster.select("x", "y")).select("x", "y", F.lit(0).alias("own"), F.lit(1).alias("got"))
    sums = own.unionByName(got).groupBy("x", "y").agg(F.max("own").alias("own"), F.sum("got").alias("got"))
    return sums.where("own = 1 and got < 8").select("x", "y")


def no_inflow_cells(grid_cells: DataFrame, directions: DataFrame) -> DataFrame:
    """Cells of the grid that no cell flows into; cells without a direction qualify too."""
    to = directions.select(downstream(F.col("x"), F.col("y"), F.col("dir")).alias("t")).where("t is not null").select("t.x", "t.y").distinct()
    return grid_cells.select("x", "y").join(to, ["x", "y"], "left_anti")


def trace_starts(directions: DataFrame, code: str = "dir128") -> DataFrame:
    """Starts of drainage traces: ``x, y, kind, to_x, to_y``.

    ``seaside``: a cell that flows into a coast cell (code 0), with that coast
    cell; ``final``: an inland terminal (code -1 or 255), with itself.
    """
    coast = directions.where(F.col(code) == 0).select(F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    t = downstream_128(F.col("x"), F.col("y"), F.col(code))
    flows = directions.select("x", "y", t.alias("t")).where("t is not null").select("x", "y", F.col("t.x").alias("to_x"), F.col("t.y").alias("to_y"))
    seaside = flows.join(coast, ["to_x", "to_y"], "left_semi").select("x", "y", F.lit("seaside").alias("kind"), "to_x", "to_y")
    final = directions.where(signed_byte(F.col(code)) == -1).select("x", "y", F.lit("final").alias("kind"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    return seaside.unionByName(final)


def link_terminals(finals: DataFrame, acc: DataFrame, river_th: float | None = None) -> DataFrame:
    """Terminals that join the river: ``x, y, dir, min_acc``.

    The least accumulation among a terminal and its neighbours decides; the
    first in reading order wins ties, the terminal itself before all.  Without
    a threshold every terminal gets direction 1; with one, only those whose
    least accumulation is below it, pointing there (direction 1 where that is
    the terminal itself).
    """
    self_row = finals.select("x", "y", F.col("x").alias("nx"), F.col("y").alias("ny"), F.lit(-1).alias("ord"))
    near = finals.select("x", "y", F.explode(neighbours(F.col("x"), F.col("y"))).alias("n")).select("x", "y", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("n.ord").alias("ord"))
    at = self_row.unionByName(near).join(acc.select(F.col("x").alias("nx"), F.col("y").alias("ny"), "acc"), ["nx", "ny"])
    least = at.groupBy("x", "y").agg(F.min(F.struct("acc", "ord", "nx", "ny")).alias("m"))
    if river_th is None:
        return least.select("x", "y", F.lit(1).alias("dir"), F.col("m.acc").alias("min_acc"))
    towards = direction_between(F.col("x"), F.col("y"), F.col("m.nx"), F.col("m.ny"))
    return least.where(F.col("m.acc") < river_th).select("x", "y", F.coalesce(towards, F.lit(1)).alias("dir"), F.col("m.acc").alias("min_acc"))


def lake_buffer(lakes: DataFrame, width: int, height: int) -> DataFrame:
    """``lake, x, y``: cells beside each lake that aren't water; a cell may belong to several lakes."""
    near = sent(lakes.select("x", "y", "lake"), "lake").where(in_grid(F.col("x"), F.col("y"), width, height))
    return near.select("lake", "x", "y").distinct().join(lakes.select("x", "y"), ["x", "y"], "left_anti").select("lake", "x", "y")

