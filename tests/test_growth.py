"""Work that must grow no faster than the input: tasks, folders, rounds and what reaches the driver, on small input."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hydrospark import storage
from hydrospark.functions.cells import STEPS
from hydrospark.operators import blocks, dry_land, flow, slope, spans, stencil, upstream, vector
from hydrospark.operators.packed_flow import PackedFlow
from hydrospark.plans import catalogue, pipelines
from hydrospark.plans.pipelines import keyed
from hydrospark.sources import shapefile, tiles

DATA = Path("/root/testdata/sf0.001")


def test_a_folder_of_documents_is_one_folder(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    before = storage.written()
    rows = catalogue.queries()["a13_folder_batch"](spark, str(DATA)).collect()
    (folder,) = (Path(p.removeprefix("file:")) for p in storage.written() - before if "/folder-" in p)
    assert sorted(p.name for p in folder.iterdir()) == sorted(f"{r.file}.geojson" for r in rows)
    assert all(r.n == 1 and r.dn == str(int(r.file) % 7) for r in rows) and rows


def test_small_shapefiles_share_a_task(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    for k in range(30):
        for kind, data in zip(("shp", "shx", "dbf"), shapefile.encode([[ring]] * 2, [{"k": str(k)}, {"k": "b"}]), strict=True):
            (tmp_path / f"s{k:02}.{kind}").write_bytes(data)
    (tmp_path / "s07.dbf").unlink()
    (tmp_path / "s08.shx").unlink()
    found = shapefile.read(spark, f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() == 1
    got = {(r.file[-3:], r.fid): (r.properties, [[tuple(p) for p in x] for x in r.rings]) for r in found.collect()}
    assert got == {(f"s{k:02}", n): (None if k == 7 else {"k": [str(k), "b"][n]}, [ring]) for k in range(30) for n in (0, 1)}


def test_inflow_points_over_blocks(spark, monkeypatch):
    """Points of lakes that share cells, with rivers between, grouped in blocks of 4 x 4 cells, against plain Python; only borders take part in rounds."""
    seen = []
    made = slope.connected_components
    monkeypatch.setattr(slope, "connected_components", lambda edges, *rest: seen.append(edges.count()) or made(edges, *rest))
    draw, w, h = random.Random(9), 11, 19
    points = {(k, x, y) for k in (3, 8) for x in range(w) for y in range(h) if draw.random() < 0.5}
    river = {(x, y) for x in range(w) for y in range(h) if draw.random() < 0.4}
    acc = spark.createDataFrame([(y * w + x, 9 if (x, y) in river else 1) for x in range(w) for y in range(h)], "cell long, acc long")
    rows = spark.createDataFrame([(k, y * w + x) for k, x, y in points], "lake long, cell long")
    for diagonal in (True, False):
        want = {}
        for k, y, x in sorted((k, y, x) for k, x, y in points):
            todo = [(k, x, y)]
            while todo:
                p = todo.pop()
                if p in want:
                    continue
                want[p] = want.get((k, x, y), y * w + x)
                for dx, dy in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
                    q = (k, p[1] + dx, p[2] + dy)
                    open_ = not (dx and dy) or diagonal and not {(q[1], p[2]), (p[1], q[2])} & river
                    if q in points and open_:
                        todo.append(q)
        got = slope.inflow_groups(rows, acc, w, 5, diagonal, side=4)
        assert {(r.lake, r.cell): r.grp for r in got.collect()} == {(k, y * w + x): g for (k, x, y), g in want.items()}
        slope.inflow_groups(rows, acc, w, 5, diagonal, side=32).count()
        assert seen[-2] > 0 and seen[-1] == 0


def test_steepest_descent_moves_cells_once(spark):
    """A raster is dealt out with its margins, not eight times; heights that are missing and cells apart are kept."""
    draw, w, h = random.Random(2), 23, 37
    z = {(x - 5, y - 5): draw.choice([None, *range(9)]) for x in range(w) for y in range(h) if draw.random() < 0.9}
    dem = spark.createDataFrame([(x, y, None if v is None else float(v)) for (x, y), v in z.items()], "x int, y int, z double")
    want = {}
    for (x, y), v in z.items():
        falls = [((v - u) / (1 if d % 2 else 2**0.5), -d) for d, (dx, dy) in STEPS.items() if v is not None and (u := z.get((x + dx, y + dy))) is not None and u < v]
        want[x, y] = -max(falls)[1] if falls else None
    made = stencil.steepest(dem, side=8)
    assert {(r.x, r.y): r.dir for r in made.collect()} == want
    assert blocks._margins(dem, 1, 128).count() < 1.4 * len(z)


def test_passes_are_told_by_block(spark, monkeypatch):
    """Pits of one basin each: a block tells a pass between two basins once, not for every cell along it."""
    seen = []
    made = flow.pass_levels
    monkeypatch.setattr(flow, "pass_levels", lambda near, out: seen.append((near.count(), out.count())) or made(near, out))
    dem = spark.range(1800).select((F.col("id") % 60).cast("int").alias("x"), (F.col("id") / 60).cast("int").alias("y"), F.abs(F.col("id") % 60 % 20 - 10).cast("double").alias("z"))
    steep = stencil.steepest(dem)
    levels = {(r.x, r.y): r.filled for r in flow.fill_pits(steep, steep, 60, 30).collect()}
    plain = {(r.x, r.y): r.filled for r in flow.fill_pits(dem, stencil.d8(dem), 60, 30).collect()}
    assert levels == plain and len(levels) == 1800 and seen[0] == seen[1]


def test_a_layer_is_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    """A layer with a folder for each of 70 tiles; a task for each folder would be 70."""
    monkeypatch.setattr(tiles, "LISTING", (tiles.LISTING[0], "8"))
    raster = spark.createDataFrame([(0, y, y) for y in range(70)], "x int, y int, v int")
    tiles.write_layer(raster, f"file://{tmp_path}/layer", 1)
    before = spark.conf.get(tiles.LISTING[0])
    spark.sparkContext.setJobGroup("listing", "listing")
    found = tiles.read_layer(spark, f"file://{tmp_path}/layer")
    spark.sparkContext.setJobGroup("other", "other")
    state = spark.sparkContext.statusTracker()
    stages = [s for j in state.getJobIdsForGroup("listing") for s in state.getJobInfo(j).stageIds]
    assert 0 < max(state.getStageInfo(s).numTasks for s in stages) <= 8
    assert spark.conf.get(tiles.LISTING[0]) == before
    assert {tuple(r) for r in found.select("x", "y", "v").collect()} == {(0, y, y) for y in range(70)}
    assert tiles.extent(tiles.read_metadata(spark, f"file://{tmp_path}/layer")).first().asDict() == {"x_min": 0, "x_max": 0, "y_min": 0, "y_max": 69, "n_tiles": 70, "n_cells": 70}


def test_lake_revision_sends_no_water_to_all_tasks(spark, monkeypatch):
    plans = []
    made = flow.write_table
    monkeypatch.setattr(flow, "write_table", lambda df, name, watch=None: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or made(df, name, watch))
    rivers = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "cell long, nxt long")
    water = spark.createDataFrame([(2,), (11,), (12,)], "cell long")
    assert {r[0] for r in flow.revise_lakes(rivers, water, 10).collect()} == {1, 2, 11, 12}
    fresh = [p for name, p in plans if name == "fresh"]
    assert fresh and all(p.count("SortMergeJoin") >= 3 for p in fresh)


def test_slopes_follow_packed_paths(spark, monkeypatch):
    """Gates, slopes and routes over many spans, against plain Python; no table of the steps has a row for each cell."""
    monkeypatch.setattr(spans, "SPAN", 16)
    draw, w, h, th = random.Random(5), 13, 17, 4
    dem = spark.createDataFrame([(x, y, x + 2 * y + draw.random() * 9) for x in range(w) for y in range(h)], "x int, y int, z double")
    steep = storage.materialize(stencil.steepest(dem))
    graph = storage.materialize(flow.flow_graph(steep, steep, w, h))
    acc = flow.accumulation(graph)
    wet = {(x + i, y + j) for x, y in ((2, 2), (7, 5), (3, 9), (10, 1), (8, 12)) for i in range(3) for j in range(2)}
    water = spark.createDataFrame(sorted(wet), "x int, y int")
    sizes = []
    made = storage.write_table
    for module in (flow, slope, dry_land):
        monkeypatch.setattr(module, "write_table", lambda df, name="table", watch=None: sizes.append((name, made(df, name).df.count())) or made(df, name, watch))
    got = slope.slope_surfaces(water, graph, acc, w, h, th, "lake")
    nxt, size = {r.cell: r.nxt for r in graph.collect()}, {r.cell: r.acc for r in acc.collect()}
    lake = {r.y * w + r.x: r.lake for r in got.lakes.collect()}
    order = {r.lake: r for r in got.order.collect()}

    def way(c, ok):
        out = []
        while c is not None and ok(c):
            out.append(c)
            c = nxt[c]
        return out, c

    near = lambda c: {(c // w + j) * w + c % w + i for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= c % w + i < w and 0 <= c // w + j < h}
    buffers = {(v, n) for c, v in lake.items() for n in near(c) if n not in lake}
    points = set()
    for v, c in buffers:
        dry, to = way(c, lambda c: c not in lake)
        if to in lake and size[dry[-1]] < th and (v, dry[-1]) in buffers:
            points.add((v, c))
    assert {tuple(r) for r in got.points.select("lake", "cell").collect()} == points and points
    rank = {v: k + 1 for k, v in enumerate(sorted({v for v, _ in points}, key=lambda v: order[v].ord))}
    own = {c: max(rank[v] for v, d in points if d == c) for _, c in points}
    painted = {c: max((own[d] for d in way(c, lambda c: c not in lake)[0] if d in own), default=None) for c in nxt if c not in lake}
    assert {r.cell: r.slope_id for r in got.surfaces.collect()} == {c: v for c, v in painted.items() if v}
    slow = lambda c: c not in lake and size[c] < th
    starts = {r.start for r in order.values()} | {c for c in nxt if slow(c) and c % 5 == 0}
    begun = spark.createDataFrame([(c,) for c in sorted(starts)], "cell long")
    routes = slope.routes(graph, keyed(water, w), acc, begun, th)
    assert {r.cell for r in routes.collect()} == {d for c in starts for d in way(c, slow)[0]}
    assert max(n for name, n in sizes) < len(painted)


def test_index_joins_no_cells(spark, monkeypatch):
    """Numbers of a graph over many spans are told without a table of its sizes or a join of all cells, ends that lie outside included."""
    monkeypatch.setattr(spans, "SPAN", 16)
    draw, names, made = random.Random(4), [], storage.write_table
    for module in (flow, upstream):
        monkeypatch.setattr(module, "write_table", lambda df, name="table", watch=None: names.append(name) or made(df, name, watch))
    nxt = {c: draw.choice([None, 999, *range(max(c - 40, 0), c)]) for c in range(0, 300, 2)}
    nxt = {c: n if n is None or n == 999 or n % 2 == 0 else n - 1 for c, n in nxt.items()}
    found = upstream.number(spark.createDataFrame(sorted(nxt.items()), "cell long, nxt long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {r.cell: (r.place, r.last) for r in found.collect()}
    above = {c: {c} for c in nxt}
    for c in sorted(nxt, reverse=True):
        if nxt[c] in above:
            above[nxt[c]] |= above[c]
    place = {c: p for c, (p, _) in got.items()}
    assert sorted(place.values()) == list(range(min(place.values()), min(place.values()) + len(nxt)))
    assert all({d for d, p in place.items() if got[c][0] <= p <= got[c][1]} == above[c] for c in nxt)
    assert "sizes" not in names and "Join" not in plan


@pytest.mark.parametrize("w", [5, 13, 40])
def test_heights_are_packed_once(spark, monkeypatch, w):
    """Directions and sizes told by spans equal those by blocks, on grids narrower and wider than a span; missing cells and heights are kept."""
    monkeypatch.setattr(spans, "SPAN", 16)
    draw, h = random.Random(w), 400 // w
    z = {(x, y): draw.choice([None, math.nan, -0.0, *range(9)]) for x in range(w) for y in range(h) if draw.random() < 0.9}
    dem = spark.createDataFrame([(x, y, None if v is None else float(v)) for (x, y), v in z.items()], "x int, y int, z double")
    steep = storage.materialize(stencil.steepest(dem))
    graph = storage.materialize(flow.flow_graph(steep, steep, w, h))
    acc = flow.accumulation(graph)
    want = {r.cell: (r.nxt, r.acc) for r in graph.join(acc, "cell").collect()}
    packed = PackedFlow.from_heights(dem, w, h, heights=True)
    assert {r.cell: (r.nxt, r.acc) for r in packed.rows("nxt", "acc").collect()} == want and len(want) == len(z)
    assert {r.cell: repr(r.z) for r in packed.rows("z").collect()} == {y * w + x: repr(None if v is None else float(v) + 0.0) for (x, y), v in z.items()}
    assert {r.cell: (r.nxt, r.acc) for r in PackedFlow.sized(graph).rows("nxt", "acc").collect()} == want
    asked = spark.createDataFrame([(c, k) for k in (1, 2) for c in (-3, 0, 17, 18, 399, 5000)], "cell long, k int")
    assert sorted(map(tuple, packed.at(asked, "acc").collect())) == sorted((c, k, want[c][1]) for k in (1, 2) for c in (0, 17, 18, 399) if c in want)
    if w != 13:
        return
    wet = {(draw.randrange(w), draw.randrange(h)) for _ in range(25)} | {p for p in ((x, y) for x in range(w) for y in range(h)) if p not in z}
    water = spark.createDataFrame(sorted(wet), "x int, y int")
    one, two = slope.slope_surfaces(water, graph, acc, w, h, 4), slope.slope_surfaces(water, packed, None, w, h, 4)
    for name in ("order", "points", "surfaces", "route"):
        rows = sorted(map(tuple, getattr(one, name).select(sorted(getattr(one, name).columns)).collect()))
        assert sorted(map(tuple, getattr(two, name).select(sorted(getattr(one, name).columns)).collect())) == rows and rows


def test_slopes_deal_cells_out_once(spark, monkeypatch):
    """Inflow points of the test grid without a table of directions or a second packing of cells."""
    if not DATA.exists():
        pytest.skip("no test tables")
    before = storage.written()
    got = catalogue.queries()["g10_slope_inflows"](spark, str(DATA)).collect()
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage.written() - before]
    assert got and names.count("spans") == 1 and not {"steepest", "pushed"} & set(names)


def test_lakes_as_one_need_no_groups(spark, monkeypatch):
    """One id per lake doesn't ask which inflow points touch; the land above lakes is told without a join of all cells."""
    monkeypatch.setattr(slope, "inflow_groups", None)
    if not DATA.exists():
        pytest.skip("no test tables")
    land = catalogue.queries()["h10_lake_upstream"](spark, str(DATA))
    plan = land._jdf.queryExecution().executedPlan().toString()
    assert "steepest-" not in plan and "gathered-" not in plan and plan.count("Join") <= 2
    got = land.collect()
    assert got and len({r.cell for r in got}) == len(got) and all(r.nxt is not None and r.acc > 0 for r in got)


def test_rasters_meet_polygons_by_runs(spark):
    """Cells touched by polygons with odd corners, holes and overlaps, met by runs of a row: the same as listed cell by cell."""
    draw = random.Random(6)
    corners = [(fid, pos, draw.choice([draw.randrange(-3, 33), draw.random() * 30]), draw.choice([draw.randrange(-3, 33), draw.random() * 30])) for fid in range(4) for pos in range(6)]
    corners += [(fid, 6, x, y) for fid, pos, x, y in corners if pos == 0]
    points = spark.createDataFrame([(f, p, float(x), float(y)) for f, p, x, y in corners], "fid int, pos int, x double, y double")
    raster = spark.range(900).select((F.col("id") % 30).cast("int").alias("x"), F.floor(F.col("id") / 30).cast("int").alias("y"), "id")
    listed = {(r.x, r.y) for r in vector.touched(points).collect()}
    got = [(r.x, r.y) for r in vector.within_touched(raster, points).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x, y in listed if 0 <= x < 30 and 0 <= y < 30} and 0 < len(got) < 900


def test_layers_are_made_when_asked(spark, monkeypatch):
    """Rivers and lakes without the steps of watersheds, routes and slopes."""
    asked = []
    monkeypatch.setattr(slope, "slope_surfaces", lambda *rest: asked.append(rest))
    monkeypatch.setattr(flow, "reaches", None)
    graph = spark.createDataFrame([(0, 1, 1), (1, 2, 5), (2, None, 9)], "cell long, nxt long, acc long")
    water = spark.createDataFrame([(2, 0), (1, 1), (2, 1)], "x int, y int")
    dem = graph.select(F.col("cell").cast("int").alias("x"), F.lit(0).alias("y"))
    for layers in (pipelines.from_layers(dem, graph, None, water, 10, 10, 5), pipelines.from_layers(dem, graph.select("cell", "nxt"), graph.select("cell", "acc"), water, 10, 10, 5)):
        assert {tuple(r) for r in layers["water_revised"].collect()} == {(1, 0), (2, 0), (1, 1), (2, 1)}
        assert {(r.x, r.acc) for r in layers["river"].collect()} == {(1, 5), (2, 9)}
        assert set(layers) == {"river", "water_revised", "water_slope", "slope_route", "watershed", "reach_tree", "layers"}
    packed, plain = asked
    assert isinstance(packed[1], PackedFlow) and packed[2] is None and plain[2] is not None
    assert {tuple(r) for r in packed[1].rows("nxt", "acc").collect()} == {tuple(r) for r in graph.collect()}
