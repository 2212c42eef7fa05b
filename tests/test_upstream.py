"""The stored index of upstream areas against walks along the paths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_levels import forest

from hydrospark.operators import upstream
from hydrospark.operators.ranking import latest_before, running_total
from hydrospark.storage import scratch


def paths(nxt):
    out = {}
    for c in nxt:
        out[c], at = [], c
        while at in nxt:
            out[c].append(at)
            at = nxt[at]
    return out


@pytest.fixture(scope="module")
def stored(spark):
    nxt, _ = forest(8, 700, 9)
    nxt |= {90_000: 99_999, 90_001: 90_000}  # leaves the graph
    path = scratch(spark, "index")
    upstream.write_index(spark.createDataFrame(list(nxt.items()), "cell long, nxt long"), path, slice_cells=64)
    return nxt, upstream.UpstreamIndex(spark, path)


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_areas_and_basins(spark, stored, share):
    nxt, index = stored
    asked = random.Random(3).sample(sorted(nxt), int(share * len(nxt)))
    outlets = spark.createDataFrame([(c, "x") for c in [*asked, *asked[:3], 123_456_789, None]], "cell long, place string")
    along, wanted = paths(nxt), set(asked)
    got = sorted((r.outlet, r.cell) for r in index.upstream(outlets).collect())
    assert got == sorted((o, c) for c, way in along.items() for o in way if o in wanted)
    near = {c: next((o for o in way if o in wanted), None) for c, way in along.items()}
    rows = index.basins(outlets).collect()
    assert len(rows) == len({r.cell for r in rows}) and {r.cell: r.label for r in rows} == {c: o for c, o in near.items() if o is not None}


def test_only_slices_of_the_outlets_are_read(spark, stored):
    nxt, index = stored
    along = paths(nxt)
    size = {c: sum(c in way for way in along.values()) for c in nxt}
    outlet = next(c for c in nxt if 5 < size[c] < 40)
    rows = index._held(index.spans(spark.createDataFrame([(outlet,)], "cell long")))
    files = {r[0] for r in rows.selectExpr("input_file_name()").distinct().collect()}
    slices = {f.split("/slice=")[1].split("/")[0] for f in files}
    assert 1 <= len(slices) <= 2 and "PartitionFilters: [slice" in rows._jdf.queryExecution().executedPlan().toString().replace("isnotnull(slice#", "slice#")
    assert rows.count() <= 128 < len(nxt)


def test_empty_graph(spark):
    path = scratch(spark, "index")
    upstream.write_index(spark.createDataFrame([], "cell long, nxt long"), path)
    index = upstream.UpstreamIndex(spark, path)
    outlets = spark.createDataFrame([(1,)], "cell long")
    assert index.upstream(outlets).count() == 0 and index.basins(outlets).count() == 0


def test_running_columns(spark):
    r = random.Random(1)
    rows = [(k, r.choice([None, *range(9)])) for k in range(300)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k long, v long").repartition(5)
    got = {x.k: x.latest for x in latest_before(df, F.col("v"), F.col("k")).collect()}
    sums = {x.k: x.before for x in running_total(df, F.col("v"), F.col("k")).collect()}
    last, total = None, 0
    for k, v in rows:
        last = v if v is not None else last
        assert got[k] == last and sums[k] == total
        total += v or 0
