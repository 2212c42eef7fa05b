"""Tiles that arrive over time: keep a layer, its extent index and its accumulation up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.operators.flow import repair_accumulation
from hydrospark.sources.tiles import tiled

CELLS = "cell long, nxt long, has_dir boolean, acc long, on_edge boolean"


def tile_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def index_tiles(stream: DataFrame, size: int) -> DataFrame:
    """Running bounds and cell count of each tile."""
    return tiled(stream, size).groupBy("tile_x", "tile_y").agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count(F.lit(1)).alias("n_cells")
    )


def repair_as_tiles_arrive(stream: DataFrame, store: str, width: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """After each batch of tiles, resolve what can be resolved over all tiles seen so far.

    Batches are appended to the Parquet folder ``store``; ``sink`` gets the
    resolved cells with the batch's number.  Repair is a least fixpoint, so the
    order of arrival doesn't change the end.  A batch that is run again after
    a failure overwrites its own part of the store.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        every = batch.sparkSession.read.schema(CELLS).parquet(f"{store}/batch=*")
        sink(repair_accumulation(every, width), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
