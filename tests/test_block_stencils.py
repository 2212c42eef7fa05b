"""Stencils on stored blocks against those on cells, and what they move."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hydrospark.operators import block_stencils, stencil


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rows_are_those_of_the_stencils_on_cells(spark):
    r = random.Random(12)
    # negative places, gaps, a block without cells, ties
    cells = [(x, y, float(r.randrange(5))) for x in range(-7, 30) for y in range(-3, 25) if r.random() < 0.9 and not (8 <= x < 16 and 8 <= y < 16)]
    dem = spark.createDataFrame(cells, "x int, y int, z double")
    blocks = block_stencils.store_blocks(dem.unionByName(spark.createDataFrame([(2, 2, None)], dem.schema)), "z", 8)
    assert rows(block_stencils.d8(blocks, 8)) == rows(stencil.d8(dem))
    assert rows(block_stencils.boundary_cells(blocks, 8).select("x", "y")) == rows(stencil.boundary_cells(dem))
    water = [(x, y, k) for k, (x0, y0) in enumerate([(0, 0), (7, 3), (14, 14), (30, 0), (16, 8)]) for x in range(x0, x0 + 3) for y in range(y0, y0 + 2)]
    lakes = spark.createDataFrame(water, "x int, y int, lake long")
    stored = block_stencils.store_blocks(lakes, "lake", 8)
    assert rows(block_stencils.lake_buffer(stored, 33, 20, 8)) == rows(stencil.lake_buffer(lakes, 33, 20))
    assert block_stencils.d8(block_stencils.store_blocks(dem.limit(0), "z", 8), 8).count() == 0


def moved(df):
    """Bytes that the exchanges of a query have written, after it ran."""
    df.collect()

    def below(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return below(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return below(node.plan())
        own = node.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(below(children.apply(k)) for k in range(children.size()))

    return below(df._jdf.queryExecution().executedPlan())


def test_margins_alone_are_moved(spark):
    dem = spark.range(384 * 384).select((F.col("id") % 384).cast("int").alias("x"), (F.col("id") / 384).cast("int").alias("y"), F.rand(3).alias("z"))
    blocks = block_stencils.store_blocks(dem, "z")
    ours, theirs = block_stencils.d8(blocks), stencil.d8(dem)
    assert ours._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the margins
    assert 0 < 10 * moved(ours) < moved(theirs)
