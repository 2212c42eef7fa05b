"""Column functions on cell indexes, coordinates and flow directions.

``x`` grows to the right and ``y`` downwards from the top-left cell.  The
8-system numbers directions anticlockwise from east; the 128-system doubles
clockwise from east.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction code in the 8-system -> (step in x, step in y).
STEPS = {1: (1, 0), 2: (1, -1), 3: (0, -1), 4: (-1, -1), 5: (-1, 0), 6: (-1, 1), 7: (0, 1), 8: (1, 1)}
# Direction code in the 128-system -> code in the 8-system.
CODE_128_TO_8 = {1: 1, 2: 8, 4: 7, 8: 6, 16: 5, 32: 4, 64: 3, 128: 2}
CODE_8_TO_128 = {v: k for k, v in CODE_128_TO_8.items()}
# Neighbours in reading order, as directions: NW, N, NE, W, E, SW, S, SE.
READING_ORDER = (4, 3, 2, 5, 1, 6, 7, 8)
COAST, SINK, UNDEFINED = 0, -1, -9
WATER = -99


@dataclass(frozen=True)
class Geotransform:
    """Affine map from cell index to the coordinate of the cell's upper-left corner, and the layer's metadata."""

    x0: float
    dx: float
    rx: float
    y0: float
    ry: float
    dy: float
    width: int
    height: int
    nodata: float | None = None
    crs: str = ""
    dtype: str = "double"


def cell_key(x: Column, y: Column, width: int) -> Column:
    """Packed index of a cell in a grid of the given width."""
    return y.cast("long") * width + x


def in_grid(x: Column, y: Column, width: int, height: int) -> Column:
    return x.between(0, width - 1) & y.between(0, height - 1)


def _lookup(code: Column, table: dict) -> Column:
    out = F.lit(None).cast("int")
    for key, value in table.items():
        out = F.when(code == key, value).otherwise(out)
    return out


def step(code: Column, axis: int) -> Column:
    """Step along one axis (0: x, 1: y); null for any code that isn't a direction."""
    return _lookup(code, {d: s[axis] for d, s in STEPS.items()})


def downstream(x: Column, y: Column, code: Column) -> Column:
    """The cell that a direction of the 8-system points to, as ``struct<x, y>``; null if there is none."""
    return F.when(code.between(1, 8), F.struct((x + step(code, 0)).alias("x"), (y + step(code, 1)).alias("y")))


def code_8(code128: Column) -> Column:
    """128-system to 8-system; anything else, sinks included, gives null."""
    return _lookup(code128, CODE_128_TO_8)


def code_128(code: Column) -> Column:
    return _lookup(code, CODE_8_TO_128)


def downstream_128(x: Column, y: Column, code128: Column) -> Column:
    """As ``downstream`` for the 128-system.  Sinks (-1, also read as 255) have no downstream cell."""
    return downstream(x, y, code_8(code128))


def signed_byte(v: Column) -> Column:
    return F.when(v > 127, v - 256).otherwise(v)


def unsigned_byte(v: Column) -> Column:
    return F.when(v < 0, v + 256).otherwise(v)


def neighbours(x: Column, y: Column) -> Column:
    """The 8 surrounding cells in reading order as ``array<struct<ord, dir, x, y>>``; cells outside the grid too."""
    rows = [
        F.struct(F.lit(k).alias("ord"), F.lit(d).alias("dir"), (x + STEPS[d][0]).alias("x"), (y + STEPS[d][1]).alias("y"))
        for k, d in enumerate(READING_ORDER)
    ]
    return F.array(*rows)


def neighbour_coordinates(cx: Column, cy: Column, size_x: float, size_y: float) -> Column:
    """As ``neighbours`` in map units; rows go down the map, so a row further down adds ``size_y``."""
    rows = [
        F.struct(F.lit(k).alias("ord"), (cx + STEPS[d][0] * size_x).alias("x"), (cy + STEPS[d][1] * size_y).alias("y"))
        for k, d in enumerate(READING_ORDER)
    ]
    return F.array(*rows)


def coordinate(x: Column, y: Column, g: Geotransform) -> Column:
    """Coordinate of a cell's upper-left corner as ``struct<cx, cy>``."""
    return F.struct((g.x0 + x * g.dx + y * g.rx).alias("cx"), (g.y0 + x * g.ry + y * g.dy).alias("cy"))


def cell_at(cx: Column, cy: Column, g: Geotransform, truncate: bool = False) -> Column:
    """Cell whose corner is nearest to a coordinate, as ``struct<x, y>``; rotation is ignored.

    ``truncate`` cuts towards zero, by which a point one cell left of the grid
    falls into column 0; by default it falls into column -1.
    """
    cut = (lambda v: v.cast("int")) if truncate else (lambda v: F.floor(v).cast("int"))
    return F.struct(cut((cx - g.x0) / g.dx + 0.5).alias("x"), cut((cy - g.y0) / g.dy + 0.5).alias("y"))


def regrid(x: Column, y: Column, old: Geotransform, new: Geotransform, truncate: bool = False) -> Column:
    """Index of a cell of one grid in another grid."""
    at = coordinate(x, y, old)
    return cell_at(at["cx"], at["cy"], new, truncate)


def direction_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Direction from a cell to an adjacent one; null if it isn't adjacent."""
    out = F.lit(None).cast("int")
    for d, (sx, sy) in STEPS.items():
        out = F.when((bx - ax == sx) & (by - ay == sy), d).otherwise(out)
    return out


def orientation(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Sector 1..8 in which b lies as seen from a, at any distance; 0 for the same cell."""
    out = F.lit(0)
    for d, (sx, sy) in STEPS.items():
        out = F.when((F.signum(bx - ax) == sx) & (F.signum(by - ay) == sy), d).otherwise(out)
    return out


def in_scale(cx: Column, cy: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Inside a map rectangle, borders included."""
    return cx.between(left, right) & cy.between(bottom, top)


def on_edge(cx: Column, cy: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return (cx == left) | (cx == right) | (cy == top) | (cy == bottom)


def nodata_or_zero(nodata: Column) -> Column:
    return F.coalesce(nodata, F.lit(0))


def colour(key: Column, seed: int = 0) -> Column:
    """A ``#RRGGBB`` colour without zero digits that depends on the key and the seed alone: the first such digits of their MD5 sum."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.concat(F.lit("#"), F.upper(F.substring(F.replace(digest, F.lit("0"), F.lit("")), 1, 6)))
