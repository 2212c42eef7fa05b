from __future__ import annotations

from hydrospark.operators import flow
from hydrospark.streaming import tiles

CELLS = tiles.CELLS


def test_repair_grows_with_the_tiles(spark, tmp_path):
    where = f"file://{tmp_path}"
    one = [(0, 1, True, 4, False), (1, 2, True, None, False)]
    two = [(2, 3, True, None, False), (3, None, True, None, False), (9, 3, True, 2, False)]
    seen = {}

    def sink(df, number):
        seen[number] = {r.cell: r.acc for r in df.collect()}

    for rows in (one, two):
        spark.createDataFrame(rows, CELLS).coalesce(1).write.mode("append").parquet(f"{where}/in")
        tiles.repair_as_tiles_arrive(tiles.tile_stream(spark, f"{where}/in", CELLS), f"{where}/store", 10, sink, f"{where}/state").awaitTermination()
    assert seen[0] == {1: 5}
    assert seen[1] == {1: 5, 2: 6, 3: 9}
    whole = flow.repair_accumulation(spark.createDataFrame(one + two, CELLS), 10)
    assert {r.cell: r.acc for r in whole.collect()} == seen[1]


def test_index_of_tiles(spark, tmp_path):
    where = f"file://{tmp_path}/in"
    spark.createDataFrame([(x, 3, 1) for x in range(20)], "x int, y int, v int").write.parquet(where)
    made = tiles.index_tiles(tiles.tile_stream(spark, where, "x int, y int, v int"), 16)
    run = made.writeStream.format("memory").queryName("tile_index").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert {(r.tile_x, r.x_min, r.x_max, r.n_cells) for r in spark.table("tile_index").collect()} == {(0, 0, 15, 16), (1, 16, 19, 4)}
