"""Directions on flats and orders of streams against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict, deque
from functools import reduce

import pytest
from pyspark.sql import functions as F

from hydrospark.functions.cells import STEPS
from hydrospark.operators import blocks, flats, flow, stencil
from hydrospark.plans import pipelines


def d8_of(z):
    out = {}
    for (x, y), h in z.items():
        falls = [((h - z[x + a, y + b]) / (1 if d % 2 else 2**0.5), -d) for d, (a, b) in STEPS.items() if (x + a, y + b) in z]
        slope, d = max(falls, default=(0, 0))
        if slope > 0:
            out[x, y] = -d
    return out


def flat_of(z):
    """Breadth first from the low edges and from higher ground."""
    d8 = d8_of(z)
    around = lambda c: [(d, (c[0] + a, c[1] + b)) for d, (a, b) in STEPS.items() if (c[0] + a, c[1] + b) in z]
    level = [c for c in z if c not in d8]
    rim = {c for c in level if len(around(c)) < 8}
    flat = {c for c in level if c not in rim}
    low = {c: min(ds) for c in flat if (ds := [d for d, n in around(c) if z[n] == z[c] and (n in d8 or n in rim)])}

    def far(starts):
        found, queue = {c: 1 for c in starts}, deque(starts)
        while queue:
            c = queue.popleft()
            for _, n in around(c):
                if n in flat and n not in found and z[n] == z[c]:
                    found[n] = found[c] + 1
                    queue.append(n)
        return found

    towards, away = far(list(low)), far([c for c in flat if any(z[n] > z[c] for _, n in around(c))])
    grade = {c: 2 * t - away.get(c, 0) for c, t in towards.items()}
    out = dict(low)
    for c in towards:
        if c not in low:
            out[c] = min((grade[n], d) for d, n in around(c) if n in grade and z[n] == z[c])[1]
    return d8, out


def frame(spark, z):
    return spark.createDataFrame([(x, y, float(h)) for (x, y), h in z.items()], "x int, y int, z double")


def grids():
    r = random.Random(2)
    yield "steps", {(x, y): r.randrange(3) for x in range(24) for y in range(17)}
    yield "plateau", {(x, y): 5.0 if 3 <= x <= 30 and 3 <= y <= 20 else 9.0 if y < 3 else 5.0 if y == 21 else 1.0 for x in range(34) for y in range(24)}
    # one way that winds through walls, much longer than a block is wide
    wind = {(x, y): 2.0 if y % 2 == 1 and 0 < x < 40 or y % 4 == 2 and x == 39 or y % 4 == 0 and x == 1 else 7.0 for x in range(41) for y in range(22)}
    yield "winding", wind | {(39, 21): 1.0}
    holes = {c: h for c, h in wind.items() if c[0] != 20}
    yield "nodata", holes
    yield "level", {(x, y): 1.0 for x in range(9) for y in range(9)}
    yield "single", {(0, 0): 1.0}


@pytest.mark.parametrize("name,z", list(grids()), ids=[n for n, _ in grids()])
def test_flats_drain_as_breadth_first_search_says(spark, name, z):
    d8, want = flat_of(z)
    dem = frame(spark, z)
    got = {(r.x, r.y): r.dir for r in flats.flat_directions(dem, stencil.d8(dem), side=8).collect()}
    assert got == want
    if name in ("plateau", "winding"):
        assert len(got) > 60


def test_no_flats_and_no_cells(spark):
    none = spark.createDataFrame([], "x int, y int, z double")
    assert flats.drain_directions(none).count() == 0
    assert flats.drain_directions(frame(spark, {(x, 0): x for x in range(4)})).count() == 3


def test_rounds_are_blocks_crossed(spark, monkeypatch):
    """A way of 400 cells through a corridor, in blocks of 50: some ten rounds."""
    written = []
    plain = blocks.write_table
    monkeypatch.setattr(blocks, "write_table", lambda df, name="table", watch=None: written.append(name) or plain(df, name, watch))
    row = spark.range(400).select(F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(1.0).alias("level"))
    got = {r.x: r.d for r in blocks.distances(row, {"d": F.when(F.col("x") == 0, 0)}, side=50).collect()}
    assert got == {x: x for x in range(400)}
    assert len(written) <= 11


def test_filled_terrain_drains_off_the_grid(spark):
    r = random.Random(9)
    w, h = 40, 30
    z = {(x, y): float(r.randrange(6)) for x in range(w) for y in range(h)}
    dem = frame(spark, z)
    filled = flow.fill_pits(dem, stencil.d8(dem), w, h).select("x", "y", F.col("filled").alias("z")).cache()
    directions = flats.drain_directions(filled, side=16)
    graph = flow.flow_graph(filled, directions, w, h).cache()
    ends = {r.root for r in flow.roots(graph).select("root").distinct().collect()}
    assert graph.count() == w * h
    assert all(c % w in (0, w - 1) or c // w in (0, h - 1) for c in ends)
    # without the flats most of it stops inside
    plain = flow.flow_graph(filled, stencil.d8(filled), w, h)
    inner = plain.where(f"nxt is null and cell % {w} between 1 and {w - 2} and cell div {w} between 1 and {h - 2}").count()
    assert inner > 100


def test_pit_to_the_rim(spark):
    """A pit filled to the brim hands its water on."""
    z = {(x, y): 14.0 if 2 <= x <= 6 and 2 <= y <= 6 else 20.0 for x in range(9) for y in range(9)} | {(4, 4): 3.0, (7, 4): 14.0, (8, 4): 10.0}
    layers = pipelines.from_elevation(frame(spark, z), spark.createDataFrame([], "x int, y int"), 9, 9, river_th=10)
    assert {(r.x, r.y) for r in layers["river"].collect()} >= {(7, 4), (8, 4)}


def plain_orders(to):
    above = defaultdict(list)
    for c, n in to.items():
        above[n].append(c)
    left = {c: len(above[c]) for c in to}
    ready, order = [c for c, n in left.items() if not n], {}
    while ready:
        c = ready.pop()
        got = sorted((order[u] for u in above[c]), reverse=True)
        order[c] = 1 if not got else got[0] + (got[1:2] == got[:1])
        if to[c] in left:
            left[to[c]] -= 1
            if not left[to[c]]:
                ready.append(to[c])
    return order


@pytest.mark.parametrize("seed", [0, 1])
def test_orders_of_random_trees(spark, seed):
    r = random.Random(seed)
    to = {0: None}
    for c in range(1, 700):
        to[c] = None if r.random() < 0.01 else r.randrange(max(0, c - 5), c) if seed % 2 else r.randrange(c)
    names = r.sample(range(10_000), len(to))
    to = {names[c]: None if n is None else names[n] for c, n in to.items()}
    to[10_001] = 20_000  # flows to a cell that isn't there
    got = {x.cell: x.strahler for x in flow.strahler(spark.createDataFrame(list(to.items()), "cell long, nxt long")).collect()}
    assert got == plain_orders(to)


def test_orders_compose():
    """The composed function of two cells in a row is the one function after the other, for all small parameters."""

    def one(lo, q, x):
        return q if x < lo else q + 1 if x <= q else x

    def after(lo, q, lo_up, q_up):  # as ``_composed`` says, in Python
        if q < q_up:
            return lo_up, q_up
        if q == q_up:
            return (q + 2, q + 1) if lo <= q else (lo_up, q)
        return (q + 2, q + 1) if q_up >= lo else (lo_up, q) if q_up + 1 == lo else (lo, q)

    every = [(lo, q) for q in range(6) for lo in range(q + 2)]
    for f in every:
        for g in every:
            made = after(*f, *g)
            assert all(one(*made, x) == one(*f, one(*g, x)) for x in range(1, 12)), (f, g)


def test_a_long_chain_takes_few_rounds_of_one_size(spark, monkeypatch):
    n, leaves = 100_000, []
    plain = flow.write_table

    def counted(df, name="table", watch=None):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return plain(df, name, watch)

    monkeypatch.setattr(flow, "write_table", counted)
    # a river of 10^5 cells with a brook of order 2 half way
    chain = spark.range(n).select(F.col("id").alias("cell"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("nxt"))
    brook = reduce(lambda a, b: a.unionByName(b), [spark.createDataFrame([(n, n // 2), (n + 1, n), (n + 2, n)], "cell long, nxt long"), chain])
    got = {r.strahler: r["count"] for r in flow.strahler(brook).groupBy("strahler").count().collect()}
    assert got == {1: n // 2 + 2, 2: n // 2 + 1}
    assert len(leaves) <= 24 and len(set(leaves[1:])) == 1  # the plan of a round doesn't grow
