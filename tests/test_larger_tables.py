"""What showed on larger tables alone, on small input: places beyond the pole, areas over several blocks, tall grids."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import components, flow, slope, spans, vector
from hydrospark.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """The test grid moved down so far that its last rows lie beyond the pole in degrees, whether a row is a tenth or a hundredth."""
    if not DATA.exists():
        pytest.skip("no test tables")
    where = tmp_path_factory.mktemp("tall")
    orders = spark.read.parquet(f"{DATA}/orders.parquet").withColumn("at", F.col("o_orderkey"))
    moved = orders.withColumn("o_orderkey", F.col("at") + F.when(F.col("at") < 1400, 0).otherwise(1_500_000)).drop("at")
    moved.coalesce(1).write.parquet(f"{where}/orders.parquet")
    parts = spark.read.parquet(f"{DATA}/part.parquet").where("p_partkey % 40 = 0").withColumn("p_partkey", F.col("p_partkey") * 97)
    parts.where("p_partkey % 40 = 0").coalesce(1).write.parquet(f"{where}/part.parquet")
    return str(where)


def both(spark, where, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for t in ("orders", "part"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, where)
    rel = duck.sql(catalogue.oracle_sql()[name]).select(", ".join(f'"{c}"' for c in got.columns))
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, rel.fetchall()))


@pytest.mark.parametrize("name", ["d9_ring_area", "d9_ring_area_conic"])
def test_areas_beyond_the_pole(spark, tall, name):
    got, want = both(spark, tall, name)
    assert got == want


@pytest.fixture
def short_spans(monkeypatch):
    """Spans of 16 cells, so that small graphs have many."""
    monkeypatch.setattr(spans, "SPAN", 16)


def random_tree(n: int, seed: int) -> dict[int, int | None]:
    """Next cells: most are near, some far, some ends, some cells that the graph doesn't have."""
    draw = random.Random(seed)
    cells = draw.sample(range(3 * n), n)
    order = {c: k for k, c in enumerate(cells)}
    out: dict[int, int | None] = {}
    for c in cells:
        earlier = [d for d in range(c - 9, c + 9) if order.get(d, n) < order[c]] or cells[: order[c]]
        out[c] = draw.choice(earlier) if earlier and draw.random() < 0.95 else draw.choice([None, 10 * n])
    return out


def path(tree: dict[int, int | None], cell: int) -> list[int]:
    way = []
    while cell in tree:
        way.append(cell)
        cell = tree[cell]
    return way


def test_paths_over_many_spans(spark, short_spans):
    tree = random_tree(400, 7)
    graph = spark.createDataFrame([(c, n, c % 7 if c % 3 else None) for c, n in tree.items()], "cell long, nxt long, own long")
    ways = {c: path(tree, c) for c in tree}
    assert {r.cell: r.root for r in flow.roots(graph).collect()} == {c: w[-1] for c, w in ways.items()}
    above = Counter(d for w in ways.values() for d in w)
    assert {r.cell: r.acc for r in flow.accumulation(graph).collect()} == above
    best = {c: max((d % 7 for d in w if d % 3), default=None) for c, w in ways.items()}
    assert {r.cell: r.m for r in flow.pull(graph, {"m": F.col("own")}).collect()} == best
    assert {r.cell: r.n for r in flow.pull(graph, {"n": F.lit(1)}, flow.plus).collect()} == {c: len(w) for c, w in ways.items()}


@pytest.mark.parametrize("rows", [[(1, 2), (2, 3), (3, 1)], [(1, 40), (40, 80), (80, 1)]])
def test_cycles_within_and_between_spans(spark, short_spans, rows):
    with pytest.raises(ValueError, match="cycle"):
        flow.accumulation(spark.createDataFrame(rows, "cell long, nxt long"))
    with pytest.raises(ValueError, match="cycle"):
        flow.roots(spark.createDataFrame(rows, "cell long, nxt long")).collect()
    assert flow.accumulation(spark.createDataFrame([], "cell long, nxt long")).count() == 0


def test_rounds_hold_only_what_leaves_a_span(spark, monkeypatch):
    """A river of 20,000 cells crosses one border, so the rounds get a few rows, not every cell."""
    seen = []
    before = flow._pull_rounds
    monkeypatch.setattr(flow, "_pull_rounds", lambda begun, *rest: seen.append(begun.count()) or before(begun, *rest))
    graph = spark.range(20_000).select(F.col("id").alias("cell"), F.when(F.col("id") < 19_999, F.col("id") + 1).alias("nxt"))
    assert flow.roots(graph).select("root").distinct().collect() == [(19_999,)]
    assert seen == [1]


@pytest.mark.parametrize("eight", [True, False])
def test_areas_over_blocks(spark, monkeypatch, eight):
    """Areas that wind through blocks of 4 x 4 cells, with nulls, against plain Python."""
    made = components.label_blocks
    monkeypatch.setattr(slope, "label_blocks", lambda *a: made(*a, side=4))
    draw, w, h = random.Random(3), 13, 22
    cells = {(x, y): draw.choice([0, 0, 0, 1, None]) for x in range(w) for y in range(h) if draw.random() < 0.9}
    steps = [(1, 0), (0, 1), (-1, 0), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    want = {}
    for x, y in sorted(cells, key=lambda c: c[1] * w + c[0]):
        todo = [(x, y)]
        while todo:
            c = todo.pop()
            if c in want:
                continue
            want[c] = want.get((x, y), y * w + x)
            near = [(c[0] + dx, c[1] + dy) for dx, dy in steps]
            todo += [n for n in near if n in cells and cells[n] is not None and cells[n] == cells[c]]
    rows = spark.createDataFrame([(x, y, v) for (x, y), v in cells.items()], "x int, y int, v int")
    got = slope.label_cells(rows, w, eight, by=["v"])
    assert got.columns == ["x", "y", "label", "v"]
    assert {(r.x, r.y): (r.label, r.v) for r in got.collect()} == {c: (want[c], cells[c]) for c in cells}


def test_rounds_hold_only_areas_at_borders(spark, monkeypatch):
    """Of 100 x 300 cells in one area, the rounds get the three blocks' areas."""
    seen = []
    before = components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda edges, *rest: seen.append(edges.count()) or before(edges, *rest))
    rows = spark.range(30_000).select((F.col("id") % 100).cast("int").alias("x"), (F.col("id") / 100).cast("int").alias("y"))
    assert [tuple(r) for r in slope.label_cells(rows, 100).select("label").distinct().collect()] == [(0,)]
    assert seen == [2]


def test_rings_over_blocks(spark, monkeypatch):
    """Rings and holes that cross blocks of 4 x 4 cells are the ones of a single block."""
    draw = random.Random(5)
    rows = spark.createDataFrame([(x, y, draw.choice([1, 1, 2])) for x in range(11) for y in range(14) if draw.random() < 0.9], "x int, y int, v int").cache()
    whole = sorted(map(tuple, vector.polygonize(rows, 11).collect()))
    made, called = vector._border_sides, []
    monkeypatch.setattr(vector, "_border_sides", lambda area, width: called.append(1) or made(area, width, side=4))
    assert sorted(map(tuple, vector.polygonize(rows, 11).collect())) == whole
    assert called and len({r[2] for r in whole}) > 10
