"""Lake-side slope surfaces: labelled lakes, their inflow points, painted surfaces and flow routes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.cells import STEPS, cell_key, in_grid
from hydrospark.operators.blocks import SIDE
from hydrospark.operators.components import HALF, connected_components, label_blocks, least_linked
from hydrospark.operators.dry_land import DryLand
from hydrospark.operators.packed_flow import PackedFlow
from hydrospark.operators.ranking import global_rank
from hydrospark.operators.spans import look_up
from hydrospark.operators.stencil import lake_buffer
from hydrospark.storage import write_table


def label_cells(cells: DataFrame, width: int, eight: bool = True, by: list[str] | None = None) -> DataFrame:
    """``x, y, label, *by``: connected components of equal ``by``, block by block; label = least packed cell."""
    made = label_blocks(cells, width, HALF if eight else (1, 3), by or [])
    return made.select("x", "y", "label", *(by or []))


def label_lakes(water: DataFrame, width: int) -> DataFrame:
    """``x, y, lake``: 8-connected lakes."""
    return label_cells(water.select("x", "y").distinct(), width).withColumnRenamed("label", "lake")


def lake_order(buffers: DataFrame, acc: DataFrame) -> DataFrame:
    """``lake, max_acc, start, ord``: lakes by the greatest accumulation beside them, ascending; ties by lake.

    ``start`` is the buffer cell of that accumulation, the least one on ties.
    Cells without accumulation don't count.
    """
    at = buffers.join(acc, "cell").groupBy("lake").agg(F.max(F.struct("acc", (-F.col("cell")).alias("minus"))).alias("m"))
    at = at.select("lake", F.col("m.acc").alias("max_acc"), (-F.col("m.minus")).alias("start"))
    return global_rank(at, F.col("max_acc"), F.col("lake"), name="ord")


def inflow_points(buffers: DataFrame, flow: DataFrame, water: DataFrame, acc: DataFrame, river_th: float, land: DryLand | None = None) -> DataFrame:
    """``lake, cell``: buffer cells by which slopes, not rivers, enter a lake.

    A buffer cell counts if its path leaves dry land at a buffer cell of the
    same lake whose accumulation is below the threshold.
    """
    land = land or DryLand(flow, water, acc, river_th)
    left = buffers.join(land.gates(buffers.select("cell")), "cell")
    return left.join(buffers.select("lake", F.col("cell").alias("root")), ["lake", "root"], "left_semi").select("lake", "cell")


def inflow_groups(points: DataFrame, acc: DataFrame, width: int, river_th: float, diagonal: bool = True, side: int = SIDE) -> DataFrame:
    """``lake, cell, grp``: inflow points of a lake that touch; grp = least cell.

    Diagonal neighbours touch only if neither corner between them is a river
    cell; with ``diagonal=False`` they never do.  Points are grouped within
    blocks, and only groups that meet at a border between blocks are joined in
    rounds.
    """
    rivers = acc.where(F.col("acc") >= river_th).select("cell")
    none = F.lit(None).cast(points.schema["lake"].dataType)
    rows = points.select("lake", "cell").unionByName(rivers.select(none.alias("lake"), F.col("cell").cast(points.schema["cell"].dataType).alias("cell")))
    x, y = (F.col("cell") % width).cast("int"), F.floor(F.col("cell") / width).cast("int")
    directions = HALF if diagonal else [d for d in HALF if d % 2]

    def local(key, t):
        left, top = (k.as_py() * side for k in key)
        lake, cell = t.column("lake").combine_chunks(), np.asarray(t.column("cell")).astype(np.int64)
        own = np.asarray(lake.is_valid())
        river = np.zeros((side, side), bool)
        river[cell[~own] // width - top, cell[~own] % width - left] = True
        points = np.unique(np.stack([np.asarray(lake.fill_null(0)).astype(np.int64)[own], cell[own]]), axis=1)
        lakes, cell = points
        x, y, n = cell % width - left, cell // width - top, len(cell)
        code = np.unique(lakes, return_inverse=True)[1].reshape(-1) * side * side
        key_of = code + y * side + x
        order = np.argsort(key_of)
        keys, a, b = key_of[order], [], []
        for d in directions:
            dx, dy = STEPS[d]
            here = np.nonzero((x + dx >= 0) & (x + dx < side) & (y + dy >= 0) & (y + dy < side))[0]
            if d % 2 == 0:
                here = here[~river[y[here], x[here] + dx] & ~river[y[here] + dy, x[here]]]
            at, there = look_up(keys, key_of[here] + dy * side + dx)
            a.append(here[there])
            b.append(order[at[there]])
        # points go by cell within a lake, so the least place is the least cell
        least = least_linked(n, np.concatenate(a), np.concatenate(b))
        rim = (x == 0) | (y == 0) | (x == side - 1) | (y == side - 1)
        return pa.table({"lake": lakes, "cell": cell, "local": cell[least], "rim": rim})

    blocks = rows.withColumns({"x__": F.floor(x / side).cast("int"), "y__": F.floor(y / side).cast("int")})
    found = write_table(blocks.groupBy("x__", "y__").applyInArrow(local, "lake bigint, cell bigint, local bigint, rim boolean"), "block-groups").df
    rim = found.where("rim").withColumns({"x": x, "y": y})
    steps = F.array(*(F.struct(F.lit(d).alias("dir"), (F.col("x") + STEPS[d][0]).alias("nx"), (F.col("y") + STEPS[d][1]).alias("ny")) for d in directions))
    ahead = rim.select("lake", "x", "y", "cell", F.col("local").alias("a"), F.explode(steps).alias("s"))
    other = lambda c: F.floor(F.col(c) / side) != F.floor(F.col(f"s.n{c}") / side)
    ahead = ahead.where((other("x") | other("y")) & F.col("s.nx").between(0, width - 1))
    ahead = ahead.select("lake", cell_key(F.col("s.nx"), F.col("s.ny"), width).alias("cell"), "a", (F.col("s.dir") % 2 == 0).alias("slant"), cell_key(F.col("s.nx"), F.col("y"), width).alias("c1"), cell_key(F.col("x"), F.col("s.ny"), width).alias("c2"))
    met = ahead.join(rim.select("lake", "cell", F.col("local").alias("b")), ["lake", "cell"])
    if diagonal:
        slant = met.where("slant")
        for c in ("c1", "c2"):
            slant = slant.join(rivers.withColumnRenamed("cell", c), c, "left_anti")
        met = met.where("not slant").unionByName(slant.select(met.columns))
    node = lambda c: F.struct("lake", F.col(c).alias("cell"))
    joined = connected_components(met.select(node("a").alias("a"), node("b").alias("b")).distinct(), "a", "b").select("node.lake", F.col("node.cell").alias("local"), F.col("label.cell").alias("grp"))
    made = found.join(joined, ["lake", "local"], "left").select("lake", "cell", F.coalesce("grp", "local").alias("grp"))
    return made.select(*(F.col(c).cast(points.schema[p].dataType).alias(c) for c, p in (("lake", "lake"), ("cell", "cell"), ("grp", "cell"))))


def surface_ids(groups: DataFrame, order: DataFrame, mode: str = "group") -> DataFrame:
    """``lake, cell, slope_id``: ids from 1 in order of (lake order, group); one id per group or per lake.

    Only lakes that have inflow points take an id in mode ``lake``.
    """
    keys = ["ord", "grp"] if mode == "group" else ["ord"]
    own = groups.join(order.select("lake", "ord"), "lake")
    ids = global_rank(own.select(*keys).distinct(), *map(F.col, keys), name="slope_id")
    return own.join(ids, keys).select("lake", "cell", "slope_id")


def paint(flow: DataFrame, water: DataFrame, ids: DataFrame, land: DryLand | None = None) -> DataFrame:
    """``cell, slope_id`` of all dry cells above an inflow point; the greatest id on a cell's dry path wins.

    Ids grow in the order of painting, so the greatest is the one painted last.
    """
    return (land or DryLand(flow, water)).painted(ids, "slope_id")


def routes(flow: DataFrame, water: DataFrame, acc: DataFrame, starts: DataFrame, river_th: float, land: DryLand | None = None) -> DataFrame:
    """``cell``: from each start downstream over dry cells below the threshold.

    A cell lies on a route if a start lies at or above it with nothing but
    such cells between.
    """
    return (land or DryLand(flow, water, acc, river_th)).reached(starts)


@dataclass
class SlopeSurfaces:
    """Lakes, their order and inflow points; ids of slopes, surfaces and routes are made when first asked for."""

    lakes: DataFrame
    order: DataFrame
    points: DataFrame
    make_ids: Callable[[], DataFrame]
    make_surfaces: Callable[[DataFrame], DataFrame]
    make_route: Callable[[], DataFrame]

    @cached_property
    def ids(self) -> DataFrame:
        return write_table(self.make_ids(), "slope-ids").df

    @cached_property
    def surfaces(self) -> DataFrame:
        return self.make_surfaces(self.ids)

    @cached_property
    def route(self) -> DataFrame:
        return self.make_route()


def slope_surfaces(
    water: DataFrame, flow: DataFrame | PackedFlow, acc: DataFrame | None, width: int, height: int, river_th: float, mode: str = "group", diagonal: bool = True
) -> SlopeSurfaces:
    """All steps from water cells (``x, y``), flow graph and accumulation (``cell, acc``) to surfaces and routes.

    A packed graph brings its own accumulation; its cells aren't dealt out again.
    """
    lakes = write_table(label_lakes(water, width), "lakes").df
    wet = lakes.select(cell_key(F.col("x"), F.col("y"), width).alias("cell"), "lake")
    around = lake_buffer(lakes, width, height).where(in_grid(F.col("x"), F.col("y"), width, height))
    buffers = write_table(around.select("lake", cell_key(F.col("x"), F.col("y"), width).alias("cell")), "buffers").df
    packed = isinstance(flow, PackedFlow)
    order = write_table(lake_order(buffers, flow.at(buffers.select("cell").distinct(), "acc") if packed else acc), "lake-order").df
    land = DryLand(flow, wet, acc, river_th)
    points = write_table(inflow_points(buffers, flow, wet, acc, river_th, land), "inflow").df

    def ids() -> DataFrame:
        if mode == "lake":  # all points of a lake have one id, whatever they touch
            return surface_ids(points, order, mode)
        sizes = flow.rows("acc") if packed else acc
        return surface_ids(inflow_groups(points, sizes, width, river_th, diagonal), order, mode)

    def surfaces(ids: DataFrame) -> DataFrame:
        return paint(flow, wet, ids, land)

    def route() -> DataFrame:
        return routes(flow, wet, acc, order.select(F.col("start").alias("cell")), river_th, land)

    return SlopeSurfaces(lakes, order, points, ids, surfaces, route)
