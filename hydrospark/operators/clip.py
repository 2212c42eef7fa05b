"""Polygons cut to polygons of any form.

Edges of both sides that may meet are found by an equi-join on the grid cells
they pass, and cut where they meet.  Pieces of one side that lie within the
other make up the result; they are linked head to tail and put in order by
doubling, so no task holds a ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.operators.vector import ring_order
from hydrospark.storage import write_table

#: Coordinates are rounded to so many decimals, so that both sides see one point where they meet.
DIGITS = 9
#: An edge reaches past its ends by this share of its length when crossings are looked for.
REACH = 1e-11
RING_KEYS = ["part", "ring"]
ENDS = ["ax", "ay", "bx", "by"]


def _snap(v: Column) -> Column:
    return F.round(v, DIGITS) + F.lit(0.0)  # no negative zero


def directed(points: DataFrame, *keys: str) -> DataFrame:
    """``*keys, part, ring, pos, ax, ay, bx, by``: edges of closed rings with the polygon on their left; ring 0 of a part is the outer one."""
    own = [*keys, *RING_KEYS]
    rows = points.select(*own, "pos", _snap(F.col("x").cast("double")).alias("ax"), _snap(F.col("y").cast("double")).alias("ay"))
    ahead = rows.select(*own, (F.col("pos") - 1).alias("pos"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    made = rows.join(ahead, [*own, "pos"]).where("ax <> bx or ay <> by")
    area = made.groupBy(*own).agg(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("area"))
    back = (F.col("area") > 0) != (F.col("ring") == 0)
    turned = [F.when(back, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(ENDS, ("bx", "by", "ax", "ay"), strict=True)]
    return made.join(area, own).select(*own, "pos", *turned)


def _passed(edges: DataFrame, size: float, *carry: str) -> DataFrame:
    """A row for each grid cell ``cx, cy`` that an edge passes."""
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    cell = lambda v: F.floor(v / size)
    rows = edges.select(*carry, *ENDS, F.explode(F.sequence(cell(left), cell(right))).alias("cx"))
    at = lambda x: F.col("ay") + (x - F.col("ax")) * (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    one, two = F.greatest(left, F.col("cx") * size), F.least(right, (F.col("cx") + 1) * size)
    upright = F.col("ax") == F.col("bx")
    low = F.when(upright, F.least("ay", "by")).otherwise(F.least(at(one), at(two))) - size * 1e-6
    high = F.when(upright, F.greatest("ay", "by")).otherwise(F.greatest(at(one), at(two))) + size * 1e-6
    return rows.select(*carry, *ENDS, "cx", F.explode(F.sequence(cell(low), cell(high))).alias("cy"))


def crossings(subject: DataFrame, extent: DataFrame, size: float) -> DataFrame:
    """``fid, se, ce, t, u, x, y``: where an edge of a polygon and one of the extent meet, with the places on both."""
    clip = _passed(extent, size, "ce").select("ce", "cx", "cy", *(F.col(c).alias(f"c{c}") for c in ENDS))
    pairs = _passed(subject, size, "fid", "se").join(clip, ["cx", "cy"]).drop("cx", "cy").distinct()
    c = F.col
    rx, ry, sx, sy = c("bx") - c("ax"), c("by") - c("ay"), c("cbx") - c("cax"), c("cby") - c("cay")
    dx, dy = c("cax") - c("ax"), c("cay") - c("ay")
    den = rx * sy - ry * sx
    t, u = (dx * sy - dy * sx) / den, (dx * ry - dy * rx) / den
    near = lambda v: v.between(-REACH, 1 + REACH)
    scale = F.sqrt(rx * rx + ry * ry) * F.sqrt(sx * sx + sy * sy)
    parallel = F.abs(den) <= scale * 1e-14
    point = lambda t_, u_, x, y: F.struct(t_.alias("t"), u_.alias("u"), _snap(x).alias("x"), _snap(y).alias("y"))
    met = F.when(near(t) & near(u), F.array(point(t, u, c("ax") + t * rx, c("ay") + t * ry)))
    # parallel edges on one line meet in those ends of one that lie on the other
    on = lambda x, y, ox, oy, vx, vy: ((x - ox) * vx + (y - oy) * vy) / (vx * vx + vy * vy)
    apart = F.abs(dx * ry - dy * rx) / F.sqrt(rx * rx + ry * ry)
    ends = [("ax", "ay"), ("bx", "by"), ("cax", "cay"), ("cbx", "cby")]
    along = F.array(*(point(on(c(x), c(y), c("ax"), c("ay"), rx, ry), on(c(x), c(y), c("cax"), c("cay"), sx, sy), c(x), c(y)) for x, y in ends))
    overlap = F.filter(along, lambda p: near(p["t"]) & near(p["u"]))
    found = F.when(~parallel, met).when(apart <= 10.0**-DIGITS, overlap)
    return pairs.select("fid", "se", "ce", F.explode(found).alias("p")).select("fid", "se", "ce", "p.*")


def pieces(edges: DataFrame, cuts: DataFrame, *key: str) -> DataFrame:
    """``edges`` cut at ``key, at, x, y``; pieces without length are left out."""
    rest = [c for c in edges.columns if c not in (*key, *ENDS)]
    touched = cuts.select(*key).distinct()
    whole = edges.join(touched, list(key), "left_anti").select(*key, *rest, *ENDS)
    cut = edges.join(touched, list(key), "left_semi")
    ends = [cut.select(*key, *rest, F.lit(at).alias("at"), F.col(x).alias("x"), F.col(y).alias("y")) for at, x, y in ((-1.0, "ax", "ay"), (2.0, "bx", "by"))]
    inner = cuts.join(cut.select(*key, *rest), list(key)).select(*key, *rest, "at", "x", "y")
    w = Window.partitionBy(*key).orderBy("at", "x", "y")  # the cuts of one edge
    rows = ends[0].unionByName(ends[1]).unionByName(inner).select(*key, *rest, F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    return whole.unionByName(rows.where("bx is not null and (ax <> bx or ay <> by)"))


def inside(points: DataFrame, edges: DataFrame, size: float, *keys: str) -> DataFrame:
    """``point`` of the ``points`` (``point, *keys, x, y``) that lie within the polygons of ``edges`` with the same keys: an odd number of edges to the right."""
    row = lambda v: F.floor(v / size)
    spans = edges.where("ay <> by").select(*keys, *ENDS, F.explode(F.sequence(row(F.least("ay", "by")), row(F.greatest("ay", "by")))).alias("row"))
    met = points.withColumn("row", row(F.col("y"))).join(spans, [*keys, "row"])
    across = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    right = F.col("x") < F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    return met.where(across & right).groupBy("point").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("point")


def clip_polygons(polygons: DataFrame, extent: DataFrame) -> DataFrame:
    """``fid, ring, outer, pos, x, y``: the parts of polygons that lie within an extent, as closed rings.

    ``polygons`` holds ring points ``fid, part, ring, pos, x, y``, ``extent``
    the same without ``fid``; ring 0 of a part is its outer ring, the others
    are holes, rings are closed and may run either way.  Both sides may be
    concave, have holes and several parts; parts of one polygon must not
    overlap.  Outer rings come out anticlockwise where y points up and are
    their own ``outer``; holes run the other way and name the ring around
    them.  Rings that touch in a point stay apart.  Polygons outside, and those
    that only touch the extent's border, have no rows.
    """
    own = write_table(directed(polygons, "fid").withColumn("se", F.monotonically_increasing_id()), "edges").df
    frame = write_table(directed(extent).select("ax", "ay", "bx", "by").withColumn("ce", F.monotonically_increasing_id()), "extent").df
    mean = own.select(*ENDS).unionByName(frame.select(*ENDS)).agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0]
    size = 2 * (mean or 1.0)
    cuts = write_table(crossings(own, frame, size), "crossings").df
    ring = ["fid", *RING_KEYS]

    # pieces of the polygons; a ring that nothing cuts is asked about once
    mine = pieces(own, cuts.select("se", F.col("t").alias("at"), "x", "y").distinct(), "se").withColumn("point", F.monotonically_increasing_id())
    mine = write_table(mine, "pieces").df
    middle = [((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y")]
    cut_rings = own.join(cuts.select("se").distinct(), "se", "left_semi").select(*ring).distinct()
    cut_rings = write_table(cut_rings, "cut-rings").df
    in_cut = mine.join(cut_rings, ring, "left_semi")
    one = mine.join(cut_rings, ring, "left_anti").groupBy(*ring).agg(F.min_by(F.struct("point", *ENDS), "point").alias("p"))
    asked = in_cut.select("point", *middle).unionByName(one.select("p.*").select("point", *middle))
    within = write_table(inside(asked, frame, size), "within").df
    whole_rings = one.select(*ring, F.col("p.point").alias("point")).join(within, "point", "left_semi").select(*ring)

    # pieces of the extent, cut by each polygon that they may lie in
    box = own.groupBy("fid").agg(*(f(F.least(a, b) if f is F.min else F.greatest(a, b)).alias(n) for n, f, a, b in (("x0", F.min, "ax", "bx"), ("x1", F.max, "ax", "bx"), ("y0", F.min, "ay", "by"), ("y1", F.max, "ay", "by"))))
    rows = lambda low, high: F.explode(F.sequence(F.floor(low / size), F.floor(high / size))).alias("row")
    boxes = box.select("*", rows(F.col("y0"), F.col("y1")))
    sides = frame.select("*", rows(F.least("ay", "by"), F.greatest("ay", "by")))
    beside = (F.greatest("ax", "bx") >= F.col("x0")) & (F.least("ax", "bx") <= F.col("x1")) & (F.greatest("ay", "by") >= F.col("y0")) & (F.least("ay", "by") <= F.col("y1"))
    near = sides.join(boxes, "row").where(beside).select("fid", "ce", *ENDS).distinct()
    theirs = pieces(near, cuts.select("fid", "ce", F.col("u").alias("at"), "x", "y").distinct(), "fid", "ce").withColumn("point", F.monotonically_increasing_id())
    theirs = write_table(theirs, "extent-pieces").df
    covered = inside(theirs.select("point", "fid", *middle), own, size, "fid")

    # where borders run together, the polygon's piece stays if both lie on the same side
    same = theirs.select("fid", *ENDS, F.lit(True).alias("same")).distinct()
    turned = theirs.select("fid", *(F.col(b).alias(a) for a, b in zip(ENDS, ("bx", "by", "ax", "ay"), strict=True)), F.lit(True).alias("against")).distinct()
    shared = in_cut.join(same, ["fid", *ENDS], "left").join(turned, ["fid", *ENDS], "left").join(within.withColumn("in", F.lit(True)), "point", "left")
    kept_mine = shared.where("same or (against is null and in)").select("fid", *ENDS)
    borders = in_cut.select("fid", *ENDS)
    borders = borders.unionByName(in_cut.select("fid", *(F.col(b).alias(a) for a, b in zip(ENDS, ("bx", "by", "ax", "ay"), strict=True))))
    kept_theirs = theirs.join(covered, "point", "left_semi").join(borders, ["fid", *ENDS], "left_anti").select("fid", *ENDS)
    untouched = mine.join(whole_rings, ring, "left_semi").select("fid", *ENDS)
    kept = write_table(kept_mine.unionByName(untouched).unionByName(kept_theirs).distinct().withColumn("cell", F.monotonically_increasing_id()), "kept").df

    # at a point where several edges start, the sharpest turn to the left keeps areas apart
    ahead = kept.select("fid", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("nx"), F.col("by").alias("ny"), F.col("cell").alias("nxt"))
    vx, vy, wx, wy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("nx") - F.col("bx"), F.col("ny") - F.col("by")
    turn = F.atan2(vx * wy - vy * wx, vx * wx + vy * wy)
    turn = F.when((F.col("nx") == F.col("ax")) & (F.col("ny") == F.col("ay")), -4.0).otherwise(turn)
    links = kept.join(ahead, ["fid", "bx", "by"]).groupBy("cell", "fid", "ax", "ay").agg(F.max_by("nxt", F.struct(turn, -F.col("nxt"))).alias("nxt"))
    placed = write_table(ring_order(write_table(links, "links").df), "rings").df
    close = placed.where("pos = 0").withColumn("pos", F.col("n"))
    points = placed.unionByName(close).select("fid", "ring", "pos", F.col("ax").alias("x"), F.col("ay").alias("y"))
    return with_outer(write_table(points, "points").df, size)


def with_outer(points: DataFrame, size: float) -> DataFrame:
    """``points`` with ``outer``: of a hole, the least ring around it, by area and then number."""
    made = points.select("fid", "ring", "pos", "x", "y")
    ahead = made.select("fid", "ring", (F.col("pos") - 1).alias("pos"), F.col("x").alias("bx"), F.col("y").alias("by"))
    edges = write_table(made.join(ahead, ["fid", "ring", "pos"]).select("fid", "ring", "pos", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by"), "ring-edges").df
    area = edges.groupBy("fid", "ring").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))
    area = write_table(area, "areas").df
    # the middle of a hole's first edge lies on no other ring's border
    first = edges.where("pos = 0").join(area.where("area < 0").select("ring"), "ring", "left_semi")
    asked = first.select(F.col("ring").alias("hole"), "fid", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    outers = area.where("area >= 0").select("fid", F.col("ring").alias("outer"), "area")
    pairs = asked.join(outers, "fid").withColumn("point", F.struct("hole", "outer"))
    around = edges.withColumnRenamed("ring", "outer")
    found = inside(pairs.select("point", "fid", "outer", "x", "y"), around, size, "fid", "outer").select("point.hole", "point.outer")
    best = found.join(area.select(F.col("ring").alias("outer"), "area"), "outer").groupBy(F.col("hole").alias("ring")).agg(F.min_by("outer", F.struct("area", "outer")).alias("outer"))
    return points.join(best, "ring", "left").select("fid", "ring", F.coalesce("outer", "ring").alias("outer"), "pos", "x", "y")
