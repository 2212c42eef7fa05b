"""Division of basins: thresholds, Pfafstetter codes, coastal groups and spill points of closed basins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydrospark.functions.cells import downstream, orientation
from hydrospark.operators.flow import basin_labels, roots
from hydrospark.operators.ranking import global_rank
from hydrospark.operators.vector import DOWN, LEFT, RIGHT, UP, beside
from hydrospark.storage import write_table

PARTS, MULTIPLE = 9, 3

# Turn between inner boundary cells -> direction in which the middle one spills.
SPILL = {
    (UP, UP): 5, (UP, RIGHT): 4, (UP, LEFT): 6, (RIGHT, UP): 4, (RIGHT, RIGHT): 3, (RIGHT, DOWN): 2,
    (DOWN, RIGHT): 2, (DOWN, DOWN): 1, (DOWN, LEFT): 8, (LEFT, UP): 6, (LEFT, DOWN): 8, (LEFT, LEFT): 7,
}


def ranked_areas(areas: DataFrame) -> DataFrame:
    """``basin_id, area, rank``: the largest first, ties by the greater id."""
    return global_rank(areas.select("basin_id", "area"), F.col("area").desc(), F.col("basin_id").desc())


def division_step(ranked: DataFrame, n: int, parts: int = PARTS, multiple: int = MULTIPLE) -> DataFrame:
    """One row: count, mean and population variance of areas once the n largest are split into equal parts, and whether the mean is below its ``multiple``-th part."""
    total = ranked.agg(F.sum("area").alias("t"), F.count(F.lit(1)).alias("c"))
    cut = F.col("rank") <= n
    part = F.when(cut, F.col("area") / parts).otherwise(F.col("area"))
    times = F.when(cut, parts).otherwise(1)
    sums = ranked.agg(F.sum(times).alias("n_new"), F.sum(part * times).alias("s"), F.sum(part * part * times).alias("q"))
    mean = F.col("s") / F.col("n_new")
    return sums.crossJoin(total).select(
        F.lit(n).alias("n"), "n_new", mean.alias("mean"), (F.col("q") / F.col("n_new") - mean * mean).alias("variance"), (F.col("n_new") > multiple * F.col("c")).alias("enough")
    )


def basins_to_divide(areas: DataFrame, parts: int = PARTS, multiple: int = MULTIPLE) -> DataFrame:
    """``basin_id, area, rank`` of the basins to divide.

    Their number is the least n under the count N with ``N + n (parts - 1) >
    multiple N``, or 1 if there is none; integers keep equality exact.
    """
    ranked = ranked_areas(areas)
    count = ranked.count()
    n = (multiple - 1) * count // (parts - 1) + 1
    return ranked.where(F.col("rank") <= (n if n < count else 1))


def _inside_basins(cells: DataFrame, *more: str) -> DataFrame:
    """``basin, cell, acc, nxt`` and ``more``, with ``nxt`` null where the next cell is of another basin or none."""
    same = cells.select(F.col("cell").alias("nxt"), F.col("basin").alias("next_basin"))
    return cells.join(same, "nxt", "left").select("basin", "cell", "acc", F.when(F.col("next_basin") == F.col("basin"), F.col("nxt")).alias("nxt"), *more)


def pfafstetter(cells: DataFrame, stream_th: float) -> DataFrame:
    """``basin, cell, digit`` for all cells of all basins that can be divided, in one pass.

    ``cells`` has ``basin, cell, nxt, acc``.  The outlet of a basin is its cell
    of greatest accumulation.  The main stem goes from there to the inflow of
    greatest accumulation again and again, down to ``stream_th``.  The four
    largest tributaries get 2, 4, 6, 8 in upstream order; the stem with all
    that drains to it directly gets 1, 3, 5, 7, 9 between them.  Ties go to the
    lesser cell.  A basin without a tributary has no rows.
    """
    flow = write_table(_inside_basins(cells), "basin-flow").df
    outlet = flow.groupBy("basin").agg(F.max(F.struct("acc", (-F.col("cell")).alias("m"))).alias("o")).select("basin", (-F.col("o.m")).alias("outlet"))
    river = flow.where(F.col("acc") >= stream_th)
    main = river.where("nxt is not null").groupBy("nxt").agg(F.max(F.struct("acc", (-F.col("cell")).alias("m"))).alias("o")).select((-F.col("o.m")).alias("cell"), F.lit(True).alias("is_main"))
    marked = write_table(river.join(main, "cell", "left"), "rivers").df
    stem = roots(marked.select("cell", F.when(F.col("is_main"), F.col("nxt")).alias("nxt")))
    stem = stem.join(outlet.select("basin", F.col("outlet").alias("root")), "root").select("basin", "cell")
    stem = write_table(stem.join(flow.select("cell", "acc"), "cell"), "stem").df
    joins = marked.where("is_main is null and nxt is not null").select("basin", F.col("cell").alias("trib"), F.col("acc").alias("trib_acc"), F.col("nxt").alias("cell"))
    joins = joins.join(stem.select("cell", F.col("acc").alias("stem_acc")), "cell")
    largest = Window.partitionBy("basin").orderBy(F.desc("trib_acc"), "trib")
    upstream = Window.partitionBy("basin").orderBy(F.desc("stem_acc"), "trib")
    four = joins.withColumn("r", F.row_number().over(largest)).where("r <= 4").withColumn("k", F.row_number().over(upstream))
    four = write_table(four.select("basin", "trib", "stem_acc", "k"), "tributaries").df
    # at most four values a basin, so the stem's cells meet one row each
    heights = write_table(four.groupBy("basin").agg(F.collect_list("stem_acc").alias("heights")), "heights").df
    passed = F.size(F.filter("heights", lambda h: h > F.col("acc")))
    odd = stem.join(heights, "basin").select("basin", "cell", (2 * passed + 1).alias("label"))
    even = four.select("basin", F.col("trib").alias("cell"), (2 * F.col("k")).alias("label"))
    ends = odd.unionByName(even)
    digits = basin_labels(flow.select("cell", "nxt"), ends.select("cell", F.col("label").cast("int").alias("label")))
    return digits.join(flow.select("cell", "basin"), "cell").select("basin", "cell", F.col("label").alias("digit"))


def divide_level(cells: DataFrame, areas: DataFrame, stream_th: float, parts: int = PARTS, multiple: int = MULTIPLE) -> DataFrame:
    """``cell, pfaf`` of the next level: chosen basins get their digits, others and those that can't be divided a 1."""
    chosen = basins_to_divide(areas, parts, multiple).select(F.col("basin_id").alias("basin"))
    digits = pfafstetter(cells.join(chosen, "basin", "left_semi"), stream_th)
    out = cells.select("basin", "cell").join(digits.select("cell", "digit"), "cell", "left")
    return out.select("cell", F.concat("basin", F.coalesce(F.col("digit").cast("string"), F.lit("1"))).alias("pfaf"))


def contract(cells: DataFrame, stream_th: float, area: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells of basins put together to pieces that no division with ``stream_th`` or more cuts: the tree of pieces, and each cell's piece.

    The tree has ``basin, cell, nxt, acc, area``: the last cell of a piece, that
    of the piece below (null at the end of a basin), accumulation at the last
    cell, and the summed ``area`` of its cells (by default their number).  The
    members are ``cell, piece``.  A piece is a stretch of river from below a
    confluence up to the next one, which is its upper end, with all that drains
    to it off the river; where a basin's end is no river, it is all that drains
    there.  Codes change at the inflows of confluences alone, and accumulation
    at the lower end of a piece orders tributaries as that at its upper end
    does, so ``pfafstetter`` and ``divide_level`` give for the tree what they
    give for the cells.  ``acc`` must grow downstream within a basin.
    """
    size = (F.lit(1.0) if area is None else area).cast("double")
    flow = write_table(_inside_basins(cells.withColumn("area__", size), "area__"), "basin-flow").df
    river = F.col("acc") >= stream_th
    inflows = flow.where(river & F.col("nxt").isNotNull()).groupBy(F.col("nxt").alias("at")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = flow.join(inflows, F.col("nxt") == F.col("at"), "left").select("cell", F.when(~river | F.col("at").isNull(), F.col("nxt")).alias("nxt"))
    members = write_table(roots(cut).withColumnRenamed("root", "piece"), "pieces").df
    areas = members.join(flow.select("cell", "area__"), "cell").groupBy(F.col("piece").alias("cell")).agg(F.sum("area__").alias("area"))
    ends = flow.join(areas, "cell").select("basin", "cell", F.col("nxt").alias("at"), "acc", "area")
    below = members.select(F.col("cell").alias("at"), F.col("piece").alias("nxt"))
    return write_table(ends.join(below, "at", "left").select("basin", "cell", "nxt", "acc", "area"), "piece-tree").df, members


def divide_levels(cells: DataFrame, stream_ths: Sequence[float], area: Column | None = None, parts: int = PARTS, multiple: int = MULTIPLE) -> DataFrame:
    """``cell, pfaf`` after one level of division for each of ``stream_ths``, which name the levels' river thresholds.

    What ``divide_level`` gives when it is called for one level after the
    other, with each level's basins measured by ``area``.  Cells are contracted
    once by the least threshold, all levels divide the tree of pieces, and
    cells get their codes in one join at the end, so work on cells doesn't grow
    with the levels.  Without a level codes are the basins; an empty table
    gives no rows.  ``acc`` must grow downstream within a basin.
    """
    if not stream_ths:
        return cells.select("cell", F.col("basin").alias("pfaf"))
    tree, members = contract(cells, min(stream_ths), area)
    for th in stream_ths:
        areas = tree.groupBy(F.col("basin").alias("basin_id")).agg(F.sum("area").alias("area"))
        codes = divide_level(tree.drop("area"), areas, th, parts, multiple)
        tree = write_table(tree.drop("basin").join(codes.withColumnRenamed("pfaf", "basin"), "cell"), "piece-tree").df
    return members.join(tree.select(F.col("cell").alias("piece"), F.col("basin").alias("pfaf")), "piece").select("cell", "pfaf")


def outlet_order(outlets: DataFrame, ring_cells: int, *by: str) -> DataFrame:
    """``*by, pos, gap, ord``: outlets along a boundary walk, beginning after the widest gap.

    ``pos`` counts cells of the walk from 0.  The gap of an outlet is its
    distance from the one before; the first takes the rest of the walk.  The
    first of equal gaps wins.  Outlets are ranked by range and meet the one
    before by rank, so no task orders a whole boundary.
    """
    own = write_table(global_rank(outlets.select(*by, "pos"), *map(F.col, by), F.col("pos"), name="place"), "outlets").df
    before = own.select(*by, (F.col("place") + 1).alias("place"), F.col("pos").alias("before"))
    rows = _with_totals(own.join(before, [*by, "place"], "left"), own, by, F.min("place").alias("least"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
    gap = F.when(F.col("before").isNull(), F.col("pos") + 1 + (ring_cells - 1 - F.col("last"))).otherwise(F.col("pos") - F.col("before"))
    rows = write_table(rows.select(*by, "pos", gap.alias("gap"), (F.col("place") - F.col("least")).alias("k"), "n"), "gaps").df
    rows = _with_totals(rows, rows, by, F.max(F.struct("gap", (-F.col("k")).alias("m"))).alias("first"))
    return rows.select(*by, "pos", "gap", F.pmod(F.col("k") + F.col("first.m"), F.col("n")).cast("int").alias("ord"))


def _with_totals(rows: DataFrame, of: DataFrame, by: tuple[str, ...], *totals: Column) -> DataFrame:
    """``rows`` with aggregates over ``of`` by group, or over all of it where there are no groups."""
    if by:
        return rows.join(write_table(of.groupBy(*by).agg(*totals), "totals").df, list(by))
    one = of.agg(*totals)
    values = one.collect()[0]
    return rows.withColumns({c: _literal(values[c], one.schema[c].dataType) for c in one.columns})


def _literal(value, kind) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*(_literal(value[f.name] if value else None, f.dataType).alias(f.name) for f in kind))
    return F.lit(value).cast(kind)


def outlet_groups(outlets: DataFrame, *by: str) -> DataFrame:
    """``*by, pos, grp`` for ordered outlets (``ord, acc``): the four largest are 2, 4, 6, 8, those between 1, 3, 5, 7, 9.

    Equal accumulations go by order; with fewer outlets there are fewer groups.
    Each outlet meets the places of the four largest, so nothing is sorted but
    those.
    """
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("acc"), "ord"))
        top = outlets.withColumn("r", rank).where("r <= 4").groupBy(*by).agg(F.collect_list("ord").alias("top"))
        rows = outlets.join(write_table(top, "largest").df, list(by))
    else:
        rows = outlets.withColumn("top", F.array(*(F.lit(r.ord) for r in outlets.orderBy(F.desc("acc"), "ord").limit(4).collect())))
    s = F.size(F.filter("top", lambda t: t <= F.col("ord")))
    return rows.select(*by, "pos", F.when(F.array_contains("top", F.col("ord")), 2 * s).otherwise(2 * s + 1).cast("int").alias("grp"))


def coastal_division(inner: DataFrame, outlets: DataFrame, flow: DataFrame, width: int) -> DataFrame:
    """``cell, grp``: cells of a coastal basin by the group of the outlet they drain to.

    ``inner`` is the basin's inner boundary (``pos, x, y``), ``outlets`` has
    ``cell, acc``.  A boundary cell that is passed twice counts at its first
    place.
    """
    ring = inner.groupBy((F.col("y").cast("long") * width + F.col("x")).alias("cell")).agg(F.min("pos").alias("pos"))
    n = inner.count()
    at = write_table(ring.join(outlets.select("cell", "acc"), "cell"), "outlets").df
    order = outlet_order(at, n).select("pos", "ord")
    groups = outlet_groups(at.join(order, "pos")).join(at.select("pos", "cell"), "pos")
    return basin_labels(flow, groups.select("cell", F.col("grp").alias("label"))).withColumnRenamed("label", "grp")


def spill_points(inner: DataFrame, dem: DataFrame, *by: str) -> DataFrame:
    """``*by, x, y, dir, to_x, to_y``: the lowest inner boundary cell of each closed basin, where and whither it spills.

    The first of equally low cells wins.  The direction follows from the turn
    at the cell; on any other turn it points as the next cell sees it.
    """
    heights = dem.select("x", "y", "z")
    ends = inner.groupBy(*by).agg(F.min(F.struct("pos", "x", "y")).alias("f"), F.max(F.struct("pos", "x", "y")).alias("l"))
    rows = beside(inner.select(*by, "pos", "x", "y"), *by).join(heights, ["x", "y"], "left").join(write_table(ends, "ends").df, list(by))
    cell = F.struct("x", "y", F.coalesce("ax", "l.x").alias("ax"), F.coalesce("ay", "l.y").alias("ay"), F.coalesce("bx", "f.x").alias("bx"), F.coalesce("by", "f.y").alias("by"))
    low = rows.where("z is not null").withColumn("c", cell).groupBy(*by).agg(F.min_by("c", F.struct("z", "pos")).alias("c")).select(*by, "c.*")
    turn_in, turn_out = orientation(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")), orientation(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    code = orientation(F.col("bx"), F.col("by"), F.col("x"), F.col("y"))
    for (i, o), d in SPILL.items():
        code = F.when((turn_in == i) & (turn_out == o), d).otherwise(code)
    out = low.select(*by, "x", "y", code.alias("dir"))
    return out.select(*by, "x", "y", "dir", downstream(F.col("x"), F.col("y"), F.col("dir")).alias("t")).select(*by, "x", "y", "dir", F.col("t.x").alias("to_x"), F.col("t.y").alias("to_y"))
