"""Polygons as point tables or arrays, and their exchange with rasters.

A ring is ``array<struct<x double, y double>>`` and closed: its last point
repeats the first.  Long tables of ring points have ``fid, part, ring, pos, x, y``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.functions.cells import orientation
from hydrospark.functions.projections import EPSG_5243, Conic
from hydrospark.operators.blocks import SIDE
from hydrospark.operators.components import connected_components
from hydrospark.operators.flow import plus, pull
from hydrospark.operators.ranking import global_rank
from hydrospark.operators.slope import label_cells
from hydrospark.operators.spans import look_up
from hydrospark.storage import write_table

RING = "array<struct<x:double,y:double>>"
EARTH_RADIUS = 6371007.2


def let(value, body):
    return F.transform(F.array(value), body)[0]


def snapped_extent(left: Column, right: Column, bottom: Column, top: Column, x0: float, y0: float, size: float) -> Column:
    """A vector extent grown to whole cells of the grid, and its cell counts.

    A left or bottom border that lies on a grid line moves out by one more
    cell, and each count has one cell to spare.
    """
    cs = F.lit(float(size))
    l_ = left - (cs - F.pmod(x0 - left, cs))
    r_ = right + F.pmod(x0 - right, cs)
    b_ = bottom - (cs - F.pmod(y0 - bottom, cs))
    t_ = top + F.pmod(y0 - top, cs)
    count = lambda d: (F.abs(d / cs).cast("int") + 1)
    return F.struct(l_.alias("left"), r_.alias("right"), b_.alias("bottom"), t_.alias("top"), count(r_ - l_).alias("nx"), count(t_ - b_).alias("ny"))


def edges(points: DataFrame, *carry: str) -> DataFrame:
    """Edges ``x, y, x2, y2`` of rings given as points; ``carry`` names the columns that identify a ring."""
    w = Window.partitionBy(*carry).orderBy("pos")
    ahead = points.select(*carry, "pos", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return ahead.where("x2 is not null")


def rasterize(points: DataFrame, *carry: str) -> DataFrame:
    """``fid, x, y``: cells whose centre lies inside the polygons of a feature, by the even-odd rule.

    Points are in cell units.  Each edge meets the centre lines of the rows it
    spans; between the 1st and 2nd, 3rd and 4th, ... crossing of a row lies
    the inside.
    """
    found = _inside_rows(points, *carry).select("fid", "row", F.explode(F.sequence("a", "b")).alias("column"))
    return found.select("fid", F.col("column").cast("int").alias("x"), F.col("row").cast("int").alias("y")).distinct()


def _inside_rows(points: DataFrame, *carry: str) -> DataFrame:
    """``fid, row, a, b``: runs of cells, from ``a`` to ``b``, whose centre lies inside."""
    e = edges(points, "fid", *carry)
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    rows = F.when(F.ceil(high - 0.5) > F.ceil(low - 0.5), F.sequence(F.ceil(low - 0.5), F.ceil(high - 0.5) - 1))
    met = e.where("y <> y2").select("fid", "x", "y", "x2", "y2", F.explode(rows).alias("row"))
    at = F.col("x") + (F.col("row") + 0.5 - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    xs = met.groupBy("fid", "row").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.ceil(F.get("xs", (2 * i).cast("int")) - 0.5).alias("a"), (F.ceil(F.get("xs", (2 * i + 1).cast("int")) - 0.5) - 1).alias("b")))
    return xs.select("fid", "row", F.explode(spans).alias("s")).where("s.a <= s.b").select("fid", "row", "s.a", "s.b")


def touched(points: DataFrame, *carry: str) -> DataFrame:
    """``fid, x, y``: cells inside or touched by the border: the inside, and all cells that an edge passes."""
    border = _border_rows(points, *carry).select("fid", "row", F.explode(F.sequence("a", "b")).alias("column"))
    return border.select("fid", F.col("column").cast("int").alias("x"), F.col("row").cast("int").alias("y")).union(rasterize(points, *carry)).distinct()


def within_touched(raster: DataFrame, points: DataFrame, *carry: str) -> DataFrame:
    """Rows of ``raster`` whose cell ``touched`` tells; runs of cells are met by row, so a large polygon's cells are never listed."""
    runs = _border_rows(points, *carry).select("row", "a", "b").union(_inside_rows(points, *carry).select("row", "a", "b"))
    return raster.join(runs, (F.col("y").cast("long") == F.col("row")) & F.col("x").between(F.col("a"), F.col("b")), "left_semi")


def _border_rows(points: DataFrame, *carry: str) -> DataFrame:
    """``fid, row, a, b``: runs of cells, from ``a`` to ``b``, that an edge passes."""
    e = edges(points, "fid", *carry)
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    rows = e.select("fid", "x", "y", "x2", "y2", F.explode(F.sequence(F.floor(low), F.greatest(F.floor(low), F.ceil(high) - 1))).alias("row"))
    along = lambda yy: F.when(F.col("y") == F.col("y2"), None).otherwise(F.col("x") + (yy - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y")))
    a, b = along(F.greatest(low, F.col("row").cast("double"))), along(F.least(high, F.col("row") + 1.0))
    left, right = F.coalesce(F.least(a, b), F.least("x", "x2")), F.coalesce(F.greatest(a, b), F.greatest("x", "x2"))
    return rows.select("fid", "row", F.floor(left).alias("a"), F.greatest(F.floor(left), F.ceil(right) - 1).alias("b"))


def clip(raster: DataFrame, points: DataFrame, *carry: str, all_touched: bool = True) -> DataFrame:
    """Cells of the raster under the polygons, by touch or by cell centre."""
    cover = touched(points, *carry) if all_touched else rasterize(points, *carry)
    return raster.join(cover.select("x", "y").distinct(), ["x", "y"], "left_semi")


def large_lakes(lakes: DataFrame, least: float, area: str = "Lake_area") -> DataFrame:
    """Features whose area attribute, stored as text, is above a bound; unreadable areas are dropped."""
    return lakes.where(F.expr(f"try_cast({area} as double)") > least)


def _clip_half(ring: Column, inside, cross) -> Column:
    """One half-plane of Sutherland-Hodgman on an open ring."""
    point = lambda p, q: F.when(inside(p), F.when(inside(q), F.array(p)).otherwise(F.array(cross(q, p), p))).when(inside(q), F.array(cross(q, p)))
    step = lambda r: F.flatten(F.filter(F.transform(r, lambda p, i: point(p, F.get(r, F.pmod(i - 1, F.size(r))))), lambda a: a.isNotNull()))
    return let(ring, step)


def clip_ring(ring: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A closed ring cut to the rectangle ``left..right`` by ``top..bottom`` (top <= bottom); empty if nothing is left."""
    at_x = lambda v: (lambda a, b: F.struct(v.cast("double").alias("x"), (a["y"] + (v - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])).alias("y")))
    at_y = lambda v: (lambda a, b: F.struct((a["x"] + (v - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])).alias("x"), v.cast("double").alias("y")))
    r = F.slice(ring, 1, F.size(ring) - 1)
    r = _clip_half(r, lambda p: p["x"] >= left, at_x(left))
    r = _clip_half(r, lambda p: p["x"] <= right, at_x(right))
    r = _clip_half(r, lambda p: p["y"] >= top, at_y(top))
    r = _clip_half(r, lambda p: p["y"] <= bottom, at_y(bottom))
    return let(r, lambda x: F.when(F.size(x) > 2, F.concat(x, F.slice(x, 1, 1))).otherwise(F.slice(x, 1, 0)))


def shoelace(ring: Column) -> Column:
    """Signed area of a closed ring: positive if its points run anticlockwise where y points up."""
    terms = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.get(r, i)["x"] * F.get(r, i + 1)["y"] - F.get(r, i + 1)["x"] * F.get(r, i)["y"])
    total = F.aggregate(let(ring, terms), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(ring) > 2, total / 2).otherwise(0.0)


def geographic_area(rings: Column, signed: bool = False) -> Column:
    """Square metres of a polygon in degrees, holes taken off: equal-area cylindrical coordinates on a sphere.

    ``signed`` gives the area the sign of the outer ring's in that plane, as ``shoelace`` does.
    """
    flat = lambda r: F.transform(r, lambda p: F.struct((F.radians(p["x"]) * EARTH_RADIUS).alias("x"), (F.sin(F.radians(p["y"])) * EARTH_RADIUS).alias("y")))
    own = F.transform(rings, lambda r: shoelace(flat(r)))
    turn = lambda a: F.signum(F.get(a, 0)) if signed else F.lit(1.0)
    return let(own, lambda a: F.aggregate(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.abs(F.get(a, 0)), lambda s, v: s - F.abs(v)) * turn(a))


def projected_area(rings: Column, conic: Conic = EPSG_5243) -> Column:
    """Square metres of a polygon in degrees, holes taken off, in the plane of a conic projection."""
    areas = F.transform(rings, lambda r: F.abs(shoelace(F.transform(r, lambda p: conic.forward(p["x"], p["y"])))))
    return let(areas, lambda a: F.aggregate(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.get(a, 0), lambda s, v: s - v))


def is_clockwise(ring: Column) -> Column:
    """1 if the points run clockwise where y points up, or the ring has no area; else 0."""
    return F.when(shoelace(ring) > 0, 0).otherwise(1)


def main_ring(polygons: DataFrame) -> DataFrame:
    """``fid, part, ring, points, has_holes``: the ring of most points of each feature, the first on ties.

    ``polygons`` has ``fid, rings`` with ``rings`` an array of polygons of rings.
    """
    rows = polygons.select("fid", F.posexplode("rings").alias("part", "poly")).select("fid", "part", "poly", F.posexplode("poly").alias("ring", "points"))
    best = F.max_by(F.struct("part", "ring", "points", (F.size("poly") > 1).alias("has_holes")), F.struct(F.size("points").alias("n"), (-F.col("part")).alias("p"), (-F.col("ring")).alias("r")))
    return rows.groupBy("fid").agg(best.alias("b")).select("fid", "b.*")


def _from(array: Column, at: Column) -> Column:
    """The array from a place on, counted from 1; empty beyond its end."""
    return F.slice(array, at, F.greatest(F.size(array) - at + 1, F.lit(0)))


def splice_holes(rings: Column) -> Column:
    """The outer ring with every hole that touches it at a point spliced in behind that point.

    The hole's last point on the ring counts; its other points follow in their
    order.  Holes that don't touch stay out.
    """

    def add(ring, hole):
        def insert(on):
            first = F.array_position(hole, on).cast("int")
            rest = F.concat(F.slice(hole, F.lit(1), first - 1), _from(hole, first + 1))
            at = F.array_position(ring, on).cast("int")
            return F.concat(F.slice(ring, F.lit(1), at), rest, _from(ring, at + 1))

        met = F.filter(hole, lambda p: F.array_contains(ring, p))
        return F.when(F.size(met) == 0, ring).otherwise(let(F.element_at(met, -1), insert))

    return F.aggregate(_from(rings, F.lit(2)), F.get(rings, 0), add)


def splice_outer_cells(boundary: Column, others: Column) -> Column:
    """Grid points of the main boundary with single-cell polygons that touch it spliced in.

    ``others`` holds the outer rings of the other polygons.  Rings of other
    than 5 points are left out.  Gives ``struct<points, joints>`` with the
    points at which polygons meet.
    """

    def add(state, other):
        line, joints = state["points"], state["joints"]

        def insert(k):
            point = F.get(other, k - 1)
            at = F.array_position(line, point).cast("int")
            turned = F.concat(F.slice(other, k, 5 - k), F.slice(other, F.lit(1), k - 1))
            points = F.concat(F.slice(line, F.lit(1), at - 1), turned, _from(line, at))
            return F.struct(points.alias("points"), F.concat(joints, F.array(point)).alias("joints"))

        corners = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.size(other) == 5) & F.array_contains(line, F.get(other, k - 1)))
        return F.when(F.size(corners) == 0, state).otherwise(let(F.get(corners, 0), insert))

    start = F.struct(boundary.alias("points"), F.slice(boundary, 1, 0).alias("joints"))
    return F.aggregate(F.coalesce(others, F.slice(F.array(boundary), 1, 0)), start, add)


def densify(points: DataFrame, *carry: str) -> DataFrame:
    """``*carry, pos, x, y``: all grid points on axis-parallel edges of integer rings, in order; slanted edges keep their ends."""
    w = Window.partitionBy(*carry).orderBy("pos")
    ahead = points.select(*carry, "pos", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    level, upright = F.col("y") == F.col("y2"), F.col("x") == F.col("x2")
    n = F.when(level, F.abs(F.col("x2") - F.col("x"))).when(upright, F.abs(F.col("y2") - F.col("y"))).otherwise(1)
    n = F.greatest(n.cast("int"), F.lit(1))
    sx, sy = F.when(level, F.signum(F.col("x2") - F.col("x"))).otherwise(0), F.when(level, 0).otherwise(F.when(upright, F.signum(F.col("y2") - F.col("y"))).otherwise(0))
    steps = F.when(F.col("x2").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # points on earlier edges
    rows = ahead.withColumn("n", n).withColumn("sx", sx).withColumn("sy", sy).withColumn("before", before)
    rows = rows.select(*carry, "x", "y", "sx", "sy", "before", F.explode(steps).alias("k"))
    x, y = F.col("x") + F.coalesce("sx", F.lit(0)) * F.col("k"), F.col("y") + F.coalesce("sy", F.lit(0)) * F.col("k")
    return rows.select(*carry, (F.col("before") + F.col("k")).cast("int").alias("pos"), x.cast("int").alias("x"), y.cast("int").alias("y"))


# Turn (orientation in, orientation out) -> inner cells as (step x, step y, dropped at joints).
UP, RIGHT, DOWN, LEFT = 3, 1, 7, 5
INNER_CELLS = {
    (UP, UP): ((0, -1, False),),
    (UP, LEFT): ((0, -1, True), (-1, -1, False)),
    (RIGHT, UP): ((0, 0, True), (0, -1, False)),
    (RIGHT, RIGHT): ((0, 0, False),),
    (DOWN, RIGHT): ((-1, 0, True), (0, 0, False)),
    (DOWN, DOWN): ((-1, 0, False),),
    (LEFT, DOWN): ((-1, -1, True), (-1, 0, False)),
    (LEFT, LEFT): ((-1, -1, False),),
}


def beside(points: DataFrame, *carry: str) -> DataFrame:
    """``points`` (``*carry, pos, x, y``, places without gaps) with the point before, ``ax, ay``, and after, ``bx, by``; null at the ends.

    Points meet by place, so no task holds a whole ring.
    """
    near = lambda step, name: points.select(*carry, (F.col("pos") + step).alias("pos"), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"))
    return points.join(near(1, "a"), [*carry, "pos"], "left").join(near(-1, "b"), [*carry, "pos"], "left")


def inner_boundary(points: DataFrame, *carry: str, joints: DataFrame | None = None) -> DataFrame:
    """``*carry, pos, x, y``: cells just inside a clockwise boundary of adjacent grid points, in walking order.

    The first point of the ring comes last.  ``joints`` (``*carry, x, y``) are
    points where polygons meet.
    """
    rows = beside(points.select(*carry, "pos", "x", "y"), *carry)
    # the closing point stands for the first one: its neighbours are the one before it and the ring's second point
    second = points.where("pos = 1").select(*carry, F.col("x").alias("sx"), F.col("y").alias("sy"))
    rows = rows.where("pos > 0").join(second, list(carry))
    bx, by = F.coalesce("bx", "sx"), F.coalesce("by", "sy")
    turn_in, turn_out = orientation(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")), orientation(F.col("x"), F.col("y"), bx, by)
    rows = rows.select(*carry, "pos", "x", "y", turn_in.alias("i"), turn_out.alias("o"))
    if joints is not None:
        rows = rows.join(joints.select(*carry, "x", "y").distinct().withColumn("joint", F.lit(True)), [*carry, "x", "y"], "left")
    joint = F.coalesce("joint", F.lit(False)) if joints is not None else F.lit(False)
    cell = lambda c: F.when(joint & F.lit(c[2]), None).otherwise(F.struct((F.col("x") + c[0]).alias("x"), (F.col("y") + c[1]).alias("y")))
    cells = F.array().cast("array<struct<x:int,y:int>>")
    for (i, o), found in INNER_CELLS.items():
        cells = F.when((F.col("i") == i) & (F.col("o") == o), F.array(*(cell(c) for c in found))).otherwise(cells)
    out = rows.select(*carry, "pos", F.posexplode(F.filter(cells, lambda c: c.isNotNull())).alias("k", "c"))
    out = out.select(*carry, "pos", "k", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    ranked = write_table(global_rank(out, *map(F.col, carry), F.col("pos"), F.col("k"), name="place"), "inner").df
    first = write_table(ranked.groupBy(*carry).agg(F.min("place").alias("least")), "first").df
    return ranked.join(first, list(carry)).select(*carry, (F.col("place") - F.col("least")).cast("int").alias("pos"), "x", "y")


def polygonize(raster: DataFrame, width: int, value: str = "v") -> DataFrame:
    """``dn, label, ring, pos, x, y``: border rings of 4-connected areas of equal value, as corner points in cell units.

    Every cell side towards another area is an edge with the area on its
    right, so outer rings run clockwise as seen on the map (y down) and holes
    the other way.  Edges link head to tail; where two start at a point the
    sharper right turn is taken, so areas that meet at a corner stay apart.
    Rings are named by their least edge and ordered by doubling; no task holds
    a ring.
    """
    cells = raster.select("x", "y", F.col(value).alias("dn"))
    area = write_table(label_cells(cells, width, eight=False, by=["dn"]), "areas").df
    sides = write_table(_border_sides(area, width), "border").df
    # rings over several blocks: the pieces of a ring, named by their last sides, are joined in rounds
    ends = sides.where("out is not null").select(F.col("cell").alias("end"), F.col("out").alias("cell"), F.col("ring").alias("least"))
    met = ends.join(sides.where("head").select("cell", F.col("end").alias("next_end")), "cell")
    piece = write_table(connected_components(met.select("end", "next_end"), "end", "next_end").select(F.col("node").alias("end"), F.col("label").alias("whole")), "pieces").df
    least = piece.join(ends.select("end", "least"), "end").groupBy("whole").agg(F.min("least").alias("whole_ring"))
    pieces = write_table(piece.join(least, "whole").select("end", "whole_ring"), "pieces").df
    links = sides.join(pieces, "end", "left").select("cell", "label", "dn", "a", "nxt", F.coalesce("whole_ring", "ring").alias("ring"))
    out = _places(links).select("dn", "label", "ring", "pos", "a", "n")
    close = out.where("pos = 0").select("dn", "label", "ring", F.col("n").alias("pos"), "a", "n")
    return out.unionByName(close).select("dn", "label", "ring", "pos", (F.col("a") % (width + 1)).cast("int").alias("x"), F.floor(F.col("a") / (width + 1)).cast("int").alias("y"))


#: For each side of a cell, by direction of travel with the cell on the right: the step to the other cell, and where the side starts.
ACROSS = np.array([(0, -1), (1, 0), (0, 1), (-1, 0)])
START = np.array([(0, 0), (1, 0), (1, 1), (0, 1)])


def _border_sides(area: DataFrame, width: int, side: int = SIDE) -> DataFrame:
    """``cell, label, dn, a, nxt, ring, end, out, head``: cell sides towards other areas and the side that follows each.

    ``cell`` names a side by its start ``a`` and its direction.  Blocks get
    the cells around them, so a side's next one is told within its block.
    ``ring`` is the least side of the ring within the block; where the ring
    leaves the block, ``end`` is the last side of the piece, whose next one is
    ``out``, and ``head`` marks the first.
    """
    block = lambda c, d: F.floor((F.col(c) + d) / side).cast("int")
    homes = F.array_distinct(F.array(*(F.struct(block("x", dx).alias("bx"), block("y", dy).alias("by")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    dealt = area.select("x", "y", "label", "dn", F.explode(homes).alias("b")).select("x", "y", "label", "dn", F.col("b.bx").alias("bx"), F.col("b.by").alias("by"))

    def run(key, t):
        left, top = (k.as_py() * side for k in key)
        x, y = np.asarray(t.column("x")).astype(np.int64) - left + 1, np.asarray(t.column("y")).astype(np.int64) - top + 1
        labels = np.full((side + 4, side + 4), -1, np.int64)
        labels[y, x] = np.asarray(t.column("label"))
        own = np.nonzero((x > 0) & (y > 0) & (x <= side) & (y <= side))[0]
        point = lambda px, py: (py + top - 1) * (width + 1) + px + left - 1
        parts = []
        for d in range(4):
            (ox, oy), (tx, ty) = ACROSS[d], ACROSS[(d + 1) % 4]
            rows = own[labels[y[own] + oy, x[own] + ox] != labels[y[own], x[own]]]
            cx, cy = x[rows], y[rows]
            here = labels[cy, cx]
            right = labels[cy + ty, cx + tx] != here
            straight = ~right & (labels[cy + ty + oy, cx + tx + ox] != here)
            turned = np.where(right, (d + 1) % 4, np.where(straight, d, (d + 3) % 4))
            a, b = point(cx + START[d][0], cy + START[d][1]), point(cx + START[(d + 1) % 4][0], cy + START[(d + 1) % 4][1])
            parts.append((rows, a, a * 4 + d, b * 4 + turned))
        rows, a, cell, nxt = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(cell)
        rows, a, cell, nxt = rows[order], a[order], cell[order], nxt[order]
        n = len(cell)
        at, inside = look_up(cell, nxt)
        ahead = np.append(np.where(inside, at, n), n)
        head = np.ones(n + 1, bool)
        head[ahead] = False
        least, end = np.append(cell, np.iinfo(np.int64).max), np.arange(n + 1)
        back = np.full(n + 1, n)
        back[ahead[:n]] = np.arange(n)
        back[n] = n
        behind = back
        for _ in range(n.bit_length() + 1):
            end = np.where(ahead < n, end[ahead], end)
            least = np.minimum(least, np.minimum(least[ahead], least[behind]))
            ahead, behind = ahead[ahead], behind[behind]
        closed = ahead[:n] < n
        ring, end = least[:n], np.append(cell, 0)[end[:n]]
        column = lambda v, null: pa.array(v, pa.int64(), mask=null)
        none = np.zeros(n, bool)
        return pa.table({
            "cell": column(cell, none), "label": t.column("label").take(pa.array(rows)), "dn": t.column("dn").take(pa.array(rows)), "a": column(a, none), "nxt": column(nxt, none),
            "ring": column(ring, none), "end": column(end, closed), "out": column(nxt, inside), "head": pa.array(head[:n] & ~closed),
        })

    kind = area.schema["dn"].dataType.simpleString()
    schema = f"cell bigint, label bigint, dn {kind}, a bigint, nxt bigint, ring bigint, `end` bigint, out bigint, head boolean"
    return dealt.groupBy("bx", "by").applyInArrow(run, schema)


def ring_order(links: DataFrame) -> DataFrame:
    """``links`` (``cell, nxt`` and more) with ``ring``, the least cell of each circle, ``pos`` from it on, and ``n``, the circle's length at its first cell."""
    ring = connected_components(links.select("cell", "nxt"), "cell", "nxt").select(F.col("node").alias("cell"), F.col("label").alias("ring"))
    return _places(links.join(ring, "cell"))


def _places(links: DataFrame) -> DataFrame:
    """``ring_order`` of links whose ``ring`` is known."""
    open_ = write_table(links.withColumn("nxt", F.when(F.col("nxt") != F.col("ring"), F.col("nxt"))), "rings").df
    count = pull(open_, {"n": F.lit(1)}, plus)
    size = open_.groupBy("ring").agg(F.count(F.lit(1)).cast("int").alias("size__"))
    return open_.join(count, "cell").join(size, "ring").withColumn("pos", F.col("size__") - F.col("n")).drop("size__")
