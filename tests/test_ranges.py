"""Range joins against a search through the whole table."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from hydrospark.operators import algebra, ranges


def test_first_row_wins_whatever_the_lengths(spark):
    r = random.Random(6)
    inf = float("inf")
    table = [(k, lo := r.choice([r.uniform(-9, 9), float(r.randrange(-9, 9)), -1e18]), r.choice([lo, lo + 10.0 ** r.randrange(-12, 19), lo - 1]), float(k)) for k in range(120)]
    table += [(200, -inf, -1e17, 200.0), (201, 5.0, inf, 201.0), (202, None, 3.0, 1.0), (203, 1.0, 2.0, 203.0), (203, 1.0, 2.0, 203.0), (204, -0.0, 0.0, 204.0)]
    r.shuffle(table)
    values = [r.uniform(-10, 10) for _ in range(300)] + [float(k) for k in range(-10, 11)] + [x[1] for x in table if x[1] is not None] + [x[2] for x in table] + [1e300, -1e300, 3.5e18, None, None]
    rows = [(k, -k, v) for k, v in enumerate(values)]
    got = ranges.reclass_ranges(spark.createDataFrame(rows, "x int, y int, v double"), spark.createDataFrame(table, "pos int, minimum double, maximum double, new double"))
    assert got.columns == ["x", "y", "v"]

    def plain(v):
        return 0.0 if v is None else next((new for _, lo, hi, new in sorted(table, key=lambda x: x[0]) if lo is not None and lo <= v <= hi), v)

    assert {x.x: x.v for x in got.collect()} == {k: plain(v) for k, v in enumerate(values)}
    short = [(0.0, 1.0, 7), (1.0, 4.0, 8)]
    one = spark.createDataFrame(rows, "x int, y int, v double")
    both = ranges.reclass_ranges(one, spark.createDataFrame([(k, *t[:2], float(t[2])) for k, t in enumerate(short)], "pos int, minimum double, maximum double, new double"))
    assert {x.x: x.v for x in both.collect()} == {x.x: x.v for x in one.select("x", algebra.reclass_table(F.col("v"), short).alias("v")).collect()}
    none = spark.createDataFrame([], "pos int, minimum double, maximum double, new double")
    assert ranges.reclass_ranges(one, none).where("v is not null").count() == len(rows)


def test_boxes(spark):
    r = random.Random(8)
    boxes = [(k, x := r.randrange(40), x + r.choice([0, 1, 5, 30]), y := r.randrange(40), y + r.choice([0, 2, 9, 60])) for k in range(60)]
    points = [(k, r.randrange(90) / 2, r.randrange(90) / 2) for k in range(400)]
    got = ranges.boxes_of(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(boxes, "box int, left int, right int, low int, high int"))
    want = {k: next((b for b, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1), None) for k, x, y in points}
    assert {p.id: p.box for p in got.collect()} == want


def test_a_million_ranges_without_a_nested_loop(spark):
    table = spark.range(1_000_000).select(F.col("id").alias("pos"), (F.col("id") / 8).alias("minimum"), ((F.col("id") + F.when(F.col("id") % 1000 == 0, 90).otherwise(1)) / 8).alias("maximum"), F.col("id").cast("double").alias("new"))
    raster = spark.range(50_000).select((F.col("id") % 500).cast("int").alias("x"), (F.col("id") / 500).cast("int").alias("y"), (F.col("id") * 2.5 + 0.01).alias("v"))
    out = ranges.reclass_ranges(raster, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    began = time.time()
    wrong = out.join(raster.withColumnRenamed("v", "was"), ["x", "y"])
    # the row before in thousands wins as far as it reaches, else the row of its own eighth
    eighth = F.floor(F.col("was") * 8)
    want = F.when(eighth % 1000 < 90, eighth - eighth % 1000).otherwise(eighth).cast("double")
    assert wrong.where(F.col("v") != want).count() == 0 and time.time() - began < 120
