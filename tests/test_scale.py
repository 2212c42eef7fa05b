"""What a larger input must not change: rows touched in a round, tiles opened by a query, levels, orders along boundaries."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pytest

from hydrospark import storage
from hydrospark.operators import basins, flow
from hydrospark.sources import tiles


def test_rounds_touch_moving_cells_alone(spark, monkeypatch):
    """A long chain and many short ones: later rounds hold the long one only."""
    nxt = {k: k + 1 for k in range(200)} | {200: None}
    nxt |= {k: k + 1 if k % 2 else None for k in range(1001, 5001)}
    graph = spark.createDataFrame(list(nxt.items()), "cell long, nxt long")
    written = defaultdict(int)
    plain = storage.write_table

    def counted(df, name="table", watch=None):
        out = plain(df, name, watch)
        written[name] += out.df.count()
        return out

    monkeypatch.setattr(flow, "write_table", counted)
    acc = {r.cell: r.acc for r in flow.accumulation(graph).collect()}
    assert acc == {k: k + 1 if k <= 200 else 2 if k % 2 == 0 and k > 1001 else 1 for k in nxt}
    assert written["gather"] < 2 * len(nxt) + 200 * 10
    roots = {r.cell: r.root for r in flow.roots(graph).collect()}
    assert roots == {k: 200 if k <= 200 else k + k % 2 for k in nxt}
    assert written["pull"] < 2 * len(nxt) + 200 * 10


def test_what_flows_to_cells_outside_the_graph_is_dropped(spark):
    graph = spark.createDataFrame([(1, 2), (2, 9), (3, 9), (4, None)], "cell long, nxt long")
    assert {tuple(r) for r in flow.accumulation(graph).collect()} == {(1, 1), (2, 2), (3, 1), (4, 1)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lowest_passes(spark, seed):
    r = random.Random(seed)
    n = 60
    heights = {}
    for _ in range(110):
        a, b = r.sample(range(n), 2)
        heights[a, b] = heights[b, a] = float(r.randrange(12))  # many ties
    out = {a: float(r.randrange(12)) for a in r.sample(range(n), 4)}
    heights[n, n + 1] = heights[n + 1, n] = 1.0  # two basins without a way out
    best, queue = {}, [(h, a) for a, h in out.items()]
    heapq.heapify(queue)
    while queue:
        h, a = heapq.heappop(queue)
        if a not in best:
            best[a] = h
            for (b, c), via in heights.items():
                if b == a:
                    heapq.heappush(queue, (max(h, via), c))
    known = {a for a, _ in heights} | out.keys()
    passes = spark.createDataFrame([(a, b, h) for (a, b), h in heights.items()], "root long, other long, height double")
    found = {x.root: x.level for x in flow.pass_levels(passes, spark.createDataFrame(list(out.items()), "root long, height double")).collect()}
    assert found == {a: best.get(a) for a in known}


def test_polygon_query_opens_its_tiles_alone(spark, tmp_path):
    raster = spark.createDataFrame([(x, y, x * 100 + y) for x in range(40) for y in range(30)], "x int, y int, v int")
    where = [f"file://{tmp_path}/{n}" for n in "ab"]
    tiles.write_layer(raster, where[0], 8)
    tiles.write_layer(raster.where("x % 2 = 0").withColumnRenamed("v", "w"), where[1], 8)
    layers = {p: tiles.read_layer(spark, p) for p in where}
    corners = [(9.25, 9.25), (14.75, 10.0), (11.0, 15.0), (9.25, 9.25)]
    ring = spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate(corners)], "fid int, pos int, x double, y double")
    found = tiles.query_polygon(layers, 8, ring)
    assert {tuple(r) for r in found.select("x", "y", "v", "w").collect()} == {(x, y, x * 100 + y, x * 100 + y if x % 2 == 0 else None) for x in range(9, 15) for y in range(9, 15)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(tile_x") == 2
    one = tiles.query(layers[where[0]], 8, 9, 9, 14, 14)
    assert {r[0] for r in one.selectExpr("input_file_name()").distinct().collect()} == {f for f in one.inputFiles() if "tile_x=1/tile_y=1/" in f}

    def inside(x, y):
        p = (x + 0.5, y + 0.5)
        return all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0 for a, b in zip(corners, corners[1:], strict=False))

    masked = tiles.query_polygon(layers, 8, ring, mask=True)
    assert {(r.x, r.y) for r in masked.collect()} == {(x, y) for x in range(9, 15) for y in range(9, 15) if inside(x, y)}
    assert tiles.extent(tiles.read_metadata(spark, where[0])).first().asDict() == {"x_min": 0, "x_max": 39, "y_min": 0, "y_max": 29, "n_tiles": 20, "n_cells": 1200}


def test_outlets_of_several_boundaries(spark):
    r = random.Random(4)
    rows = [(f"b{b}", p, float(r.randrange(9))) for b in range(3) for p in r.sample(range(100), (1, 3, 12)[b])]
    at = spark.createDataFrame(rows, "b string, pos long, acc double")
    order = {(x.b, x.pos): (x.gap, x.ord) for x in basins.outlet_order(at, 100, "b").collect()}
    want, groups = {}, {}
    for b in {x[0] for x in rows}:
        own = sorted(p for c, p, _ in rows if c == b)
        gap = [own[0] + 1 + 99 - own[-1]] + [q - p for p, q in zip(own, own[1:], strict=False)]
        first = gap.index(max(gap))
        want |= {(b, p): (gap[k], (k - first) % len(own)) for k, p in enumerate(own)}
        largest = sorted((-a, want[b, p][1]) for c, p, a in rows if c == b)[:4]
        top = sorted(o for _, o in largest)
        for p in own:
            o = want[b, p][1]
            s = sum(t <= o for t in top)
            groups[b, p] = 2 * s if o in top else 2 * s + 1
    assert order == want
    ordered = at.join(spark.createDataFrame([(b, p, o) for (b, p), (_, o) in want.items()], "b string, pos long, ord int"), ["b", "pos"])
    assert {(x.b, x.pos): x.grp for x in basins.outlet_groups(ordered, "b").collect()} == groups


def test_only_a_local_session_may_leave_the_folder_unnamed(spark):
    class Unnamed:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

        def __init__(self, master):
            conf = type("K", (), {"get": staticmethod(lambda key: None)})
            self.sparkContext = type("S", (), {"getConf": staticmethod(lambda: conf), "master": master})

    assert storage.shared_dir(Unnamed("local[4]")) == storage.LOCAL_DIR
    with pytest.raises(ValueError):
        storage.shared_dir(Unnamed("spark://head:7077"))
    assert storage.shared_dir(spark) != storage.LOCAL_DIR
