"""Whole workflows from source layers to published results."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hydrospark.functions.cells import WATER, cell_key, code_8, in_grid, step
from hydrospark.operators import algebra, flats, flow, slope, stencil, vector
from hydrospark.operators.packed_flow import PackedFlow
from hydrospark.storage import materialize


def to_xy(cells: DataFrame, width: int) -> DataFrame:
    rest = [c for c in cells.columns if c != "cell"]
    return cells.select((F.col("cell") % width).cast("int").alias("x"), F.floor(F.col("cell") / width).cast("int").alias("y"), *rest)


def keyed(cells: DataFrame, width: int, *rest: str) -> DataFrame:
    return cells.select(cell_key(F.col("x"), F.col("y"), width).alias("cell"), *rest)


@dataclass
class Drainage:
    starts: DataFrame
    rivers: DataFrame
    reach: DataFrame
    tree: DataFrame
    watershed: DataFrame


def drainage(cells: DataFrame, dir128: DataFrame, acc: DataFrame, width: int, height: int, river_th: float | None = None) -> Drainage:
    """Directions, trace starts, terminals joined to the river, and watersheds of the reaches.

    Starts of traces (cells at the sea and inland terminals) are the river;
    terminals are added whatever their surroundings, or by ``river_th``.
    """
    starts = materialize(stencil.trace_starts(dir128), "starts")
    finals = starts.where("kind = 'final'").select("x", "y")
    linked = stencil.link_terminals(finals, acc, river_th).select("x", "y", F.col("dir").alias("dir_new"))
    rivers = keyed(starts.where("kind = 'seaside'").select("x", "y").union(linked.select("x", "y")).distinct(), width)
    rivers = materialize(rivers, "river-cells")
    # a terminal ends its basin: its direction is only a mark that it belongs to the river
    directions = dir128.select("x", "y", code_8(F.col("dir128")).alias("dir")).where("dir is not null")
    graph = materialize(flow.flow_graph(cells, directions, width, height), "graph")
    reach = materialize(flow.reaches(graph, rivers), "reach")
    return Drainage(starts, rivers, reach, flow.reach_tree(graph, reach), flow.watersheds(graph, reach))


def lake_upstream(dem: DataFrame | None, water: DataFrame, graph: DataFrame | PackedFlow, acc: DataFrame | None, width: int, height: int) -> DataFrame:
    """``lake, cell, z, nxt, acc``: for every lake in one pass, the land that drains into it and its layers.

    Slope surfaces with an unbounded river threshold, one per lake: every
    buffer cell that flows into the lake opens its whole upstream area.  A
    packed graph with heights brings all layers itself.
    """
    made = slope.slope_surfaces(water, graph, acc, width, height, float("inf"), mode="lake")
    by_lake = made.ids.select("lake", "slope_id").distinct()
    if isinstance(graph, PackedFlow):
        land = graph.at(made.surfaces.select("cell", "slope_id"), "z", "nxt", "acc").join(by_lake, "slope_id")
    else:
        land = made.surfaces.join(by_lake, "slope_id").join(keyed(dem, width, "z").join(graph, "cell").join(acc, "cell"), "cell")
    return land.select("lake", "cell", F.round("z", 8).alias("z"), "nxt", "acc")


class Layers(Mapping):
    """Layers by name, each made when first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def from_layers(dem: DataFrame, graph: DataFrame, acc: DataFrame | None, water: DataFrame, width: int, height: int, river_th: float, mode: str = "group") -> Layers:
    """Rivers, revised lakes, slope surfaces, routes and watersheds from elevation, flow graph and accumulation.

    ``acc`` has ``cell, acc``, or is left out if ``graph`` has a whole ``acc``
    for each cell; ``water`` has ``x, y``; ``dem`` has ``x, y`` and any layers
    to be cut for the watershed step.  Revised lakes are told at once, all
    other layers when first asked for.
    """
    given = graph if acc is None else None
    acc = acc if given is None else given.select("cell", "acc")
    graph = graph.select("cell", "nxt")
    rivers = materialize(acc.where(F.col("acc") >= river_th), "rivers")
    links = graph.join(rivers.select("cell"), "cell") if given is None else given.where(F.col("acc") >= river_th).select("cell", "nxt")
    revised = flow.revise_lakes(links, keyed(water, width), width)
    revised_xy = to_xy(revised, width)
    made = slope.slope_surfaces(revised_xy, graph if given is None else PackedFlow.given(given), acc if given is None else None, width, height, river_th, mode)
    surfaces = cache(lambda: materialize(made.surfaces, "surfaces"))
    wet = cache(lambda: surfaces().select("cell").unionByName(revised.select("cell")).distinct())
    # watersheds stop at lakes and slopes: those cells are erased from all layers
    left = cache(lambda: graph.join(wet(), "cell", "left_anti"))
    reach = cache(lambda: materialize(flow.reaches(left(), rivers.join(wet(), "cell", "left_anti")), "reach"))
    slopes = lambda: surfaces().select("cell", F.col("slope_id").cast("int").alias("v"))
    return Layers({
        "river": lambda: to_xy(rivers, width),
        "water_revised": lambda: revised_xy,
        "water_slope": lambda: to_xy(slopes().unionByName(revised.select("cell", F.lit(WATER).alias("v"))), width),
        "slope_route": lambda: to_xy(made.route, width),
        "watershed": lambda: to_xy(flow.watersheds(left(), reach()), width),
        "reach_tree": lambda: flow.reach_tree(left(), reach()),
        "layers": lambda: algebra.erase(dem, to_xy(wet(), width)),
    })


def flagship(
    dem: DataFrame, dir128: DataFrame, acc: DataFrame, boundary: DataFrame, lakes: DataFrame, width: int, height: int, least_area: float = 1, river_th: float = 5, mode: str = "group"
) -> Layers:
    """Layers of a catalog cut to a polygon, then ``from_layers``.

    ``boundary`` and ``lakes`` are ring points; lakes have ``Lake_area`` as
    text and only those above ``least_area`` take part.  Terminals are joined
    to the river by the threshold.
    """
    wide = vector.within_touched(dem, boundary).join(dir128, ["x", "y"]).join(acc, ["x", "y"])
    wide = materialize(wide, "layers")
    big = vector.large_lakes(lakes, least_area).select("fid", "pos", F.col("x").cast("double"), F.col("y").cast("double"))
    water = vector.within_touched(vector.rasterize(big).select("x", "y").distinct(), boundary)
    finals = stencil.trace_starts(wide.select("x", "y", "dir128")).where("kind = 'final'").select("x", "y")
    linked = stencil.link_terminals(finals, wide.select("x", "y", "acc"), river_th).select("x", "y", F.lit(True).alias("linked"))
    # linked terminals count as river cells, whatever they collect
    sizes = F.when(F.col("linked"), F.greatest("acc", F.lit(river_th))).otherwise(F.col("acc")).alias("acc")
    nx, ny = (F.col(c) + step(code_8(F.col("dir128")), k) for k, c in enumerate("xy"))
    nxt = F.when(in_grid(nx, ny, width, height), cell_key(nx, ny, width)).alias("nxt")
    graph = materialize(keyed(wide.join(linked, ["x", "y"], "left").select("x", "y", nxt, sizes), width, "nxt", "acc"), "graph")
    if isinstance(graph.schema["acc"].dataType, IntegralType):
        return from_layers(wide.select("x", "y", "dem"), graph, None, water, width, height, river_th, mode)
    return from_layers(wide.select("x", "y", "dem"), graph.select("cell", "nxt"), graph.select("cell", "acc"), water, width, height, river_th, mode)


def from_elevation(dem: DataFrame, water: DataFrame, width: int, height: int, river_th: float, mode: str = "group", fill: bool = True) -> Layers:
    """From a raw elevation grid (``x, y, z``): pits filled, directions down and over flats, accumulation, then ``from_layers``."""
    if fill:
        raw = materialize(stencil.steepest(dem), "d8-raw")
        dem = materialize(flow.fill_pits(raw, raw, width, height).select("x", "y", F.col("filled").alias("z")), "filled")
    d8 = flats.all_directions(dem)
    graph = materialize(flow.flow_graph(d8, d8, width, height), "graph")
    acc = materialize(flow.accumulation(graph), "acc")
    return from_layers(dem, graph, acc, water, width, height, river_th, mode)
