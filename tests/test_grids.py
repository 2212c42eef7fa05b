"""Hand-drawn grids and random grids against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hydrospark.functions import cells as C
from hydrospark.operators import algebra, basins, flow, slope, stencil, vector
from hydrospark.operators.components import connected_components
from hydrospark.operators.ranking import global_rank
from hydrospark.sources import geojson, records, tiles

STEPS = C.STEPS


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_scene(seed, w=9, h=8):
    r = random.Random(seed)
    z = {(x, y): x + 2 * y + r.random() * 6 for x in range(w) for y in range(h)}
    down = {}
    for (x, y), v in z.items():
        best = None
        for d, (sx, sy) in STEPS.items():
            n = z.get((x + sx, y + sy))
            if n is not None and v > n:
                s = (v - n) / (2**0.5 if d % 2 == 0 else 1.0)
                if best is None or s > best[0]:
                    best = (s, d)
        if best:
            down[x, y] = best[1]
    return w, h, z, down


def nxt(cell, down):
    d = down.get(cell)
    return (cell[0] + STEPS[d][0], cell[1] + STEPS[d][1]) if d else None


def path(cell, down):
    while cell:
        yield cell
        cell = nxt(cell, down)


def spark_scene(spark, seed):
    w, h, z, down = random_scene(seed)
    dem = frame(spark, [(x, y, v) for (x, y), v in z.items()], "x int, y int, z double")
    d8 = stencil.d8(dem)
    return w, h, z, down, dem, d8, flow.flow_graph(dem, d8, w, h)


def key(cell, w):
    return cell[1] * w + cell[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_directions_and_accumulation(spark, seed):
    w, h, z, down, dem, d8, graph = spark_scene(spark, seed)
    assert {(r.x, r.y): r.dir for r in d8.collect()} == down
    acc = Counter(p for c in z for p in path(c, down))
    got = {r.cell: r.acc for r in flow.accumulation(graph).collect()}
    assert got == {key(c, w): acc[c] for c in z}
    assert sum(got[key(c, w)] for c in z if c not in down) == len(z)  # all cells end in a sink
    root = {r.cell: r.root for r in flow.roots(graph).collect()}
    assert root == {key(c, w): key(list(path(c, down))[-1], w) for c in z}


def test_lengths_and_orders(spark):
    w, h, z, down, dem, d8, graph = spark_scene(spark, 3)
    step = lambda c: 0.0 if c not in down else (1.0 if down[c] % 2 else 2**0.5)
    longest, total = defaultdict(float), defaultdict(float)
    for c in z:
        d = 0.0
        for p in path(c, down):
            longest[p] = max(longest[p], d)
            if p != c:
                total[p] += step(c)
            d += step(p)
    for r in flow.upstream_lengths(graph, w).collect():
        c = (r.cell % w, r.cell // w)
        assert abs(r.longest - longest[c]) < 1e-9 and abs(r.total - total[c]) < 1e-9
    up = defaultdict(list)
    for c in z:
        if nxt(c, down):
            up[nxt(c, down)].append(c)

    def order(c):
        own = sorted((order(u) for u in up[c]), reverse=True)
        return 1 if not own else own[0] + (len(own) > 1 and own[0] == own[1])

    assert {r.cell: r.strahler for r in flow.strahler(graph).collect()} == {key(c, w): order(c) for c in z}


def test_pit_filling(spark):
    w, h, z, down, dem, d8, _ = spark_scene(spark, 4)
    level = {c: (v if c[0] in (0, w - 1) or c[1] in (0, h - 1) else float("inf")) for c, v in z.items()}
    for _ in range(len(z)):
        for (x, y), v in z.items():
            near = [level[x + sx, y + sy] for sx, sy in STEPS.values() if (x + sx, y + sy) in z]
            level[x, y] = min(level[x, y], max(v, min(near)))
    got = {(r.x, r.y): r.filled for r in flow.fill_pits(dem, d8, w, h).collect()}
    assert got == level


def test_repair_equals_whole_grid(spark):
    w, h, z, down, dem, d8, graph = spark_scene(spark, 5)
    acc = {r.cell: r.acc for r in flow.accumulation(graph).collect()}
    rows = [(r.cell, r.nxt, True, None if r.cell % w in (2, 3, 6) else acc[r.cell], r.cell % w in (0, w - 1)) for r in graph.collect()]
    made = flow.repair_accumulation(frame(spark, rows, "cell long, nxt long, has_dir boolean, acc long, on_edge boolean"), w)
    assert {r.cell: r.acc for r in made.collect()} == {c: a for c, a in acc.items() if c % w in (2, 3, 6)}
    # an unusable value upstream leaves everything below it open; edge contamination opens headwaters on the edge
    line = frame(spark, [(0, 1, True, 0, True), (1, 2, True, None, False), (2, None, True, None, False), (5, 6, True, None, True), (6, None, True, None, False)], "cell long, nxt long, has_dir boolean, acc long, on_edge boolean")
    assert {r.cell: r.acc for r in flow.repair_accumulation(line, 10).collect()} == {5: 1, 6: 2}
    assert flow.repair_accumulation(line, 10, edge_contamination=True).count() == 0


def test_cycle_is_reported(spark):
    with pytest.raises(ValueError, match="cycle"):
        flow.accumulation(frame(spark, [(1, 2), (2, 1)], "cell long, nxt long"))


def test_flow_off_the_raster_ends(spark):
    one = frame(spark, [(0, 0, 1)], "x int, y int, dir int")
    assert flow.flow_graph(one, one, 1, 1).first().nxt is None


def test_reaches_of_a_confluence(spark):
    # two arms of 2 cells meet in 10, then 11 flows out
    links = [(1, 2), (2, 10), (4, 5), (5, 10), (10, 11), (11, None), (20, 1), (21, 99), (99, None)]
    graph = frame(spark, links, "cell long, nxt long")
    rivers = frame(spark, [(c,) for c in (1, 2, 4, 5, 10, 11)], "cell long")
    reach = flow.reaches(graph, rivers)
    assert {r.cell: r.reach for r in reach.collect()} == {1: 2, 2: 2, 4: 5, 5: 5, 10: 11, 11: 11}
    assert {(r.reach, r.n_cells, r.down_reach, r.n_up) for r in flow.reach_tree(graph, reach).collect()} == {(2, 2, 11, 0), (5, 2, 11, 0), (11, 2, None, 2)}
    assert {r.cell: r.watershed for r in flow.watersheds(graph, reach).collect()} == {1: 2, 2: 2, 4: 5, 5: 5, 10: 11, 11: 11, 20: 2}


def test_lake_revision_moves(spark):
    w = 10
    # straight down with water beside, level with water beside, diagonal with a wet corner, and one that stays dry
    rivers = frame(spark, [(5, 15), (42, 43), (71, 82), (8, 18)], "cell long, nxt long")
    water = frame(spark, [(15,), (4,), (43,), (52,), (82,), (72,), (18,)], "cell long")
    assert {r.cell for r in flow.revise_lakes(rivers, water, w).collect()} == {15, 4, 43, 52, 82, 72, 18, 5, 42, 71}
    # a chain: each new water cell wets the next one
    chain = frame(spark, [(3, 13), (13, 23), (23, 33)], "cell long, nxt long")
    shore = frame(spark, [(33,), (24,), (12,), (4,)], "cell long")
    assert {r.cell for r in flow.revise_lakes(chain, shore, w).collect()} == {33, 24, 12, 4, 23, 13, 3}


def slow_surfaces(w, h, down, z, wet, th, by_lake):
    acc = Counter(p for c in z for p in path(c, down))
    near = lambda c: [(c[0] + sx, c[1] + sy) for sx, sy in STEPS.values() if (c[0] + sx, c[1] + sy) in z]
    label = {}
    for c in sorted(wet, key=lambda c: key(c, w)):
        if c not in label:
            todo = [c]
            label[c] = key(c, w)
            while todo:
                for n in near(todo.pop()):
                    if n in wet and n not in label:
                        label[n] = key(c, w)
                        todo.append(n)
    buffers = defaultdict(set)
    for c, lake in label.items():
        buffers[lake] |= {n for n in near(c) if n not in wet}
    up = defaultdict(list)
    for c in z:
        if nxt(c, down):
            up[nxt(c, down)].append(c)

    def above(c):
        out, todo = set(), [c]
        while todo:
            p = todo.pop()
            out.add(p)
            todo += [u for u in up[p] if u not in wet]
        return out

    order = sorted(buffers, key=lambda k: (max(acc[c] for c in buffers[k]), k))
    painted, number = {}, 0
    for lake in order:
        points = set()
        for c in buffers[lake]:
            if acc[c] < th and nxt(c, down) in wet:
                points |= above(c) & buffers[lake]
        groups, left = [], set(points)
        while left:
            todo, own = [min(left, key=lambda c: key(c, w))], set()
            while todo:
                p = todo.pop()
                own.add(p)
                for n in near(p):
                    if n in points and n not in own and (n[0] == p[0] or n[1] == p[1] or all(acc[q] < th for q in ((p[0], n[1]), (n[0], p[1])))):
                        todo.append(n)
            groups.append(own)
            left -= own
        groups.sort(key=lambda g: min(key(c, w) for c in g))
        if by_lake and groups:
            groups = [set().union(*groups)]
        for g in groups:
            number += 1
            for c in g:
                for p in above(c):
                    painted[key(p, w)] = number
    return painted


@pytest.mark.parametrize(("seed", "mode"), [(6, "group"), (7, "lake"), (8, "group")])
def test_painting_matches_cell_by_cell(spark, seed, mode):
    w, h, z, down, dem, d8, graph = spark_scene(spark, seed)
    r = random.Random(seed)
    wet = {(x, y) for x0, y0 in ((1, 1), (5, 4), (2, 5)) for x in range(x0, x0 + r.randrange(1, 3)) for y in range(y0, y0 + r.randrange(1, 3))}
    water = frame(spark, sorted(wet), "x int, y int")
    acc = flow.accumulation(graph)
    made = slope.slope_surfaces(water, graph, acc, w, h, 6, mode)
    assert {r.cell: r.slope_id for r in made.surfaces.collect()} == slow_surfaces(w, h, down, z, wet, 6, mode == "lake")


def test_equal_lakes_are_all_kept(spark):
    buffers = frame(spark, [(1, 10), (2, 20)], "lake long, cell long")
    acc = frame(spark, [(10, 5), (20, 5)], "cell long, acc long")
    assert [(r.lake, r.ord) for r in slope.lake_order(buffers, acc).orderBy("ord").collect()] == [(1, 1), (2, 2)]


def test_diagonal_inflows_and_river_corners(spark):
    points = frame(spark, [(1, 11), (1, 22)], "lake long, cell long")
    dry = frame(spark, [(12, 1), (21, 1)], "cell long, acc long")
    river = frame(spark, [(12, 50), (21, 1)], "cell long, acc long")
    groups = lambda acc, **k: len({r.grp for r in slope.inflow_groups(points, acc, 10, 20, **k).collect()})
    assert (groups(dry), groups(river), groups(dry, diagonal=False)) == (1, 2, 2)


def test_recode_keeps_the_longest_chain(spark):
    # one watershed with a main river 1-2-3-4 and a side arm 7-3; the arm gets a new id with what drains to it
    graph = frame(spark, [(1, 2), (2, 3), (3, 4), (4, None), (7, 3), (8, 7), (9, 1)], "cell long, nxt long")
    rivers = frame(spark, [(1, 2), (2, 3), (3, 6), (4, 7), (7, 2)], "cell long, acc long")
    ws = frame(spark, [(c, 5) for c in (1, 2, 3, 4, 7, 8, 9)], "cell long, watershed long")
    got = {r.cell: r.watershed for r in flow.recode_watersheds(graph, rivers, ws).collect()}
    assert got == {1: 5, 2: 5, 3: 5, 4: 5, 9: 5, 7: 6, 8: 6}


def test_direction_codes(spark):
    rows = frame(spark, [(3, 3, c) for c in (1, 2, 4, 8, 16, 32, 64, 128, 0, 255, -1, 247, -9)], "x int, y int, dir128 int")
    got = [(r.dir128, r.dir, r.is_final) for r in algebra.direction_reclass(rows).join(rows, ["x", "y"]).select("dir128", "dir", "is_final").limit(0).collect()]
    assert got == []
    made = rows.select("dir128", C.code_8(F.col("dir128")).alias("d"), C.downstream_128(F.col("x"), F.col("y"), F.col("dir128")).alias("t")).collect()
    assert {r.dir128: r.d for r in made} == C.CODE_128_TO_8 | dict.fromkeys((0, 255, -1, 247, -9))
    assert all((r.t is None) == (r.d is None) for r in made)
    back = rows.select("dir128", C.code_128(C.code_8(F.col("dir128"))).alias("b")).where("b is not null").collect()
    assert all(r.b == r.dir128 for r in back) and len(back) == 8


def test_point_left_of_the_grid(spark):
    g = C.Geotransform(0.0, 1.0, 0.0, 0.0, 0.0, -1.0, 5, 5)
    row = spark.range(1).select(C.cell_at(F.lit(-1.0), F.lit(0.0), g).alias("a"), C.cell_at(F.lit(-1.0), F.lit(0.0), g, truncate=True).alias("b"), C.cell_at(F.lit(-0.6), F.lit(0.0), g, truncate=True).alias("c")).first()
    assert (row.a.x, row.b.x, row.c.x) == (-1, 0, 0)
    kept = records.trace_cells(frame(spark, [(-1.0, 0.0), (2.0, -3.0), (2.0, -3.0), (9.0, 0.0)], "cx double, cy double"), g).collect()
    assert [(r.x, r.y) for r in kept] == [(2, 3)]


def square(x, y, n=1):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y))]


def test_splicing_rings(spark):
    schema = f"rings array<{vector.RING}>, others array<{vector.RING}>"
    hole = [{"x": 2.0, "y": 0.0}, {"x": 3.0, "y": 1.0}, {"x": 2.0, "y": 2.0}, {"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 0.0}]
    outer = [{"x": float(a), "y": float(b)} for a, b in ((0, 0), (2, 0), (4, 0), (4, 4), (0, 4), (0, 0))]
    far = square(2.5, 2.5)
    df = frame(spark, [([outer, hole, far], [square(4, 4), square(9, 9, 3)])], schema)
    got = df.select(vector.splice_holes(F.col("rings")).alias("r"), vector.splice_outer_cells(F.col("rings")[0], F.col("others")).alias("o")).first()
    assert [(p.x, p.y) for p in got.r] == [(0, 0), (2, 0), (3, 1), (2, 2), (1, 1), (2, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert [(p.x, p.y) for p in got.o.points] == [(0, 0), (2, 0), (4, 0), (4, 4), (5, 4), (5, 5), (4, 5), (4, 4), (0, 4), (0, 0)]
    assert [(p.x, p.y) for p in got.o.joints] == [(4, 4)]


def test_polygonized_rings_enclose_their_cells(spark):
    r = random.Random(2)
    w = 8
    values = {(x, y): r.randrange(3) for x in range(w) for y in range(7) if r.random() < 0.9}
    raster = frame(spark, [(x, y, v) for (x, y), v in values.items()], "x int, y int, v int")
    rings = vector.polygonize(raster, w).collect()
    by = defaultdict(list)
    for p in rings:
        by[p.dn, p.label, p.ring].append((p.pos, p.x, p.y))
    area = Counter()
    for (_, label, _), points in by.items():
        points.sort()
        assert [p for p, *_ in points] == list(range(len(points))) and points[0][1:] == points[-1][1:]
        for (_, ax, ay), (_, bx, by_) in zip(points, points[1:], strict=False):
            assert abs(ax - bx) + abs(ay - by_) == 1
            area[label] += (ax * by_ - bx * ay) / 2
    labels = {(r.x, r.y): r.label for r in slope.label_cells(raster.select("x", "y", "v"), w, eight=False, by=["v"]).collect()}
    assert area == Counter(labels.values())


def test_rasterizing_odd_polygons(spark):
    triangle = [(0, 0.2, 0.1), (1, 7.3, 2.2), (2, 1.4, 6.8), (3, 0.2, 0.1)]
    points = frame(spark, [(1, *p) for p in triangle], "fid int, pos int, x double, y double")

    def inside(px, py):
        out = False
        for (_, ax, ay), (_, bx, by) in zip(triangle, triangle[1:], strict=False):
            if (ay <= py < by or by <= py < ay) and px < ax + (py - ay) * (bx - ax) / (by - ay):
                out = not out
        return out

    got = {(r.x, r.y) for r in vector.rasterize(points).collect()}
    assert got == {(x, y) for x in range(9) for y in range(9) if inside(x + 0.5, y + 0.5)}
    touch = {(r.x, r.y) for r in vector.touched(points).collect()}
    samples = {(int(ax + (bx - ax) * t / 997), int(ay + (by - ay) * t / 997)) for (_, ax, ay), (_, bx, by) in zip(triangle, triangle[1:], strict=False) for t in range(998)}
    assert samples | got <= touch and len(touch) <= len(samples | got) + 2


def test_clip_ring_to_rectangle(spark):
    ring = [{"x": float(a), "y": float(b)} for a, b in ((0, 0), (10, 0), (5, 10), (0, 0))]
    df = frame(spark, [(ring,)], f"ring {vector.RING}")
    lit = F.lit
    area = lambda *box: df.select(F.abs(vector.shoelace(vector.clip_ring(F.col("ring"), *map(lit, box))))).first()[0]
    assert area(0, 0, 10, 10) == 50 and area(0, 0, 10, 5) == 37.5 and area(20, 0, 30, 5) == 0


def test_coastal_groups_with_few_outlets(spark):
    few = frame(spark, [(3, 5.0, 0), (9, 7.0, 1)], "pos int, acc double, ord int")
    assert [(r.pos, r.grp) for r in basins.outlet_groups(few).orderBy("pos").collect()] == [(3, 2), (9, 4)]
    order = basins.outlet_order(few.select("pos"), 30).orderBy("ord").collect()
    assert [(r.pos, r.gap) for r in order] == [(3, 24), (9, 6)]


def test_number_of_basins_to_divide(spark):
    for n in (1, 2, 3, 4, 7, 8, 13):
        areas = frame(spark, [(f"b{i:02}", float(i % 5)) for i in range(n)], "basin_id string, area double")
        got = {r.basin_id for r in basins.basins_to_divide(areas).collect()}
        k = next((k for k in range(1, n) if n + k * 8 > 3 * n), 1)
        assert got == set(sorted((f"b{i:02}" for i in range(n)), key=lambda b: (float(int(b[1:]) % 5), b), reverse=True)[:k])


def test_pfafstetter_with_four_tributaries(spark):
    # stem 0 <- 1 <- ... <- 9 <- head; tributaries of different size join at 2, 4, 6, 8 and a small one at 5
    links = [(i, i - 1 if i else None, 100 - 5 * i) for i in range(10)] + [(20, 2, 12), (40, 4, 14), (60, 6, 11), (80, 8, 13), (50, 5, 10), (21, 20, 1), (7000, 7, 1)]
    cells = frame(spark, [("4", c, n, a) for c, n, a in links], "basin string, cell long, nxt long, acc long")
    got = {r.cell: r.digit for r in basins.pfafstetter(cells, 10).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 20: 2, 21: 2, 40: 4, 60: 6, 80: 8, 50: 5, 7000: 7}
    plain = frame(spark, [("4", 0, None, 5), ("4", 1, 0, 4)], "basin string, cell long, nxt long, acc long")
    assert basins.pfafstetter(plain, 1).count() == 0


def test_geojson_documents(spark):
    one = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"DN":3,"a":"x"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}},{"type":"Feature","properties":{},"geometry":null}]}'
    docs = frame(spark, [("n", one)], "name string, doc string")
    f = geojson.first_feature(F.col("doc"))
    row = docs.select(geojson.polygons(f).alias("p"), geojson.properties(f).alias("m"), F.size(geojson.features(F.col("doc"))).alias("n")).first()
    assert row.n == 2 and row.m == {"DN": "3", "a": "x"} and [len(p) for p in row.p] == [1, 1] and (row.p[1][0][2].x, row.p[1][0][2].y) == (6, 6)
    made = geojson.update_properties(docs, F.create_map(F.lit("DN"), F.lit("9"), F.lit("b"), F.lit("y")))
    again = made.select(geojson.properties(geojson.first_feature(F.col("doc"))).alias("m"), geojson.polygons(geojson.first_feature(F.col("doc"))).alias("p")).first()
    assert again.m == {"a": "x", "DN": "9", "b": "y"} and again.p == row.p
    merged = geojson.merge(docs.union(docs)).select(F.size(geojson.features(F.col("doc")))).first()[0]
    assert merged == 2


def test_tiles_and_records_on_disk(spark, tmp_path):
    raster = frame(spark, [(x, y, x * 10 + y) for x in range(40) for y in range(25)], "x int, y int, v int")
    where = f"file://{tmp_path}/layer"
    tiles.write_layer(raster, where, 16)
    layer = tiles.read_layer(spark, where)
    part = tiles.query(layer, 16, 10, 3, 20, 8)
    assert part.count() == 11 * 6 and "tile_x" in part._jdf.queryExecution().toString()
    top = tiles.pyramid(raster, 2).where("level = 2").collect()
    assert {(r.x, r.y): r.v for r in top}[(9, 6)] == 39 * 10 + 24
    stream, acc = raster.select("x", "y", (F.col("v") % 2).alias("s")), raster.select("x", "y", F.col("v").alias("acc"))
    records.write_rivers(stream, acc, f"file://{tmp_path}/rivers")
    assert records.read_rivers(spark, f"file://{tmp_path}/rivers").count() == stream.where("s = 1").count()
    assert tiles.export(raster, 16, 1).agg(F.sum("n")).first()[0] == 40 * 25 + 20 * 13


def test_mosaic_takes_the_last_file(spark):
    a = frame(spark, [(1, 1, 5), (2, 2, 6)], "x int, y int, v int")
    b = frame(spark, [(1, 1, 4)], "x int, y int, v int")
    layers = algebra.with_names([("/d/n10_b.tif", b), ("/d/n10_a.tif", a), ("/d/zzz.tif", b.withColumn("v", F.lit(0)))], ["n10"])
    assert {(r.x, r.y): r.v for r in algebra.mosaic(layers, ["x", "y"], ["file_ord"], "v").collect()} == {(1, 1): 4, (2, 2): 6}


def test_components_and_ranks(spark):
    line = frame(spark, [(i, i + 1) for i in range(200) if i % 50 != 49], "src long, dst long")
    got = connected_components(line).collect()
    assert {r.node: r.label for r in got} == {i: i // 50 * 50 for i in range(200)}
    assert connected_components(line.limit(0)).count() == 0
    ranked = global_rank(spark.range(1000).repartition(7), F.col("id").desc()).collect()
    assert all(r.rank == 1000 - r.id for r in ranked)


def test_web_mercator_query_takes_every_row_of_cells(spark, tmp_path):
    from math import ceil, cos, log, pi, radians, tan

    import __spark_entry__

    keys = [y * 100 + x for y in (149, 150, 151, 1499, 2640, 2641, 2642, 2650) for x in range(3)]
    spark.createDataFrame([(k, 0.0) for k in keys], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.x, r.y): r.v for r in __spark_entry__.queries()["a9_web_mercator"](spark, str(tmp_path)).collect()}
    n, limit, want = 256 * 2**6, 85.05112878, {}
    column = lambda lon: ceil((lon + 180) / 360 * n - 0.5)
    row = lambda lat: ceil((1 - log(tan(radians(lat)) + 1 / cos(radians(lat))) / pi) / 2 * n - 0.5)
    held = lambda lat: max(-limit, min(limit, lat))
    for k in keys:
        x, y = k % 100, k // 100
        lon, lat = 5 + x * 0.05, 47 - y * 0.05
        for a in range(column(lon), column(lon + 0.05)):
            for b in range(row(held(lat)), row(held(lat - 0.05))):
                want[a, b] = x + 2.0 * y
    assert got == want
    assert {149, 150, 151, 1499, 2640} <= {int(v // 2) for v in got.values()}
