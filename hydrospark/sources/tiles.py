"""Tiled raster layers: cells stored in Parquet by tile, queried by polygon, and their pyramids."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions.cells import Geotransform, colour
from hydrospark.operators.vector import clip
from hydrospark.storage import write_table


def tiled(raster: DataFrame, size: int) -> DataFrame:
    """``raster`` with the tile that each cell belongs to."""
    return raster.withColumn("tile_x", F.floor(F.col("x") / size).cast("int")).withColumn("tile_y", F.floor(F.col("y") / size).cast("int"))


def write_layer(raster: DataFrame, path: str, size: int, mode: str = "overwrite") -> None:
    """Store a layer by tile; reads of an area then open its tiles' files alone.

    A table beside it holds a row of metadata for each tile: ``tile_x, tile_y,
    x_min, x_max, y_min, y_max, n_cells``.
    """
    spark = raster.sparkSession
    kept = write_table(tiled(raster, size), "layer-cells")
    # as many tasks as may be, as the time goes into opening files; tasks move theirs to their places, and the layer is whole when its metadata is there
    rows = kept.df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y", "y", "x")
    rows.write.mode(mode).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("tile_x", "tile_y").parquet(f"{path}/cells")
    stored = read_layer(spark, path) if mode == "append" else kept.df
    tile_rows(stored).write.mode("overwrite").parquet(f"{path}/tiles")
    kept.drop()


#: Tasks that list a layer's folders, of which there is one for each tile.
LISTING = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    key, most = LISTING
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(most), int(before)))
    try:
        return spark.read.parquet(f"{path}/cells")
    finally:
        spark.conf.set(key, before)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The stored row of each tile; no cell is read."""
    return spark.read.parquet(f"{path}/tiles")


def query(layer: DataFrame, size: int, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Cells of a tiled layer in a rectangle of cells, borders included; the tile bounds prune partitions."""
    tiles = F.col("tile_x").between(left // size, right // size) & F.col("tile_y").between(top // size, bottom // size)
    return layer.where(tiles & F.col("x").between(left, right) & F.col("y").between(top, bottom)).drop("tile_x", "tile_y")


def query_polygon(layers: dict[str, DataFrame], size: int, polygon: DataFrame, mask: bool = False) -> DataFrame:
    """``x, y`` and the values of several tiled layers in the tiles that the bounds of a polygon meet, stitched to one raster.

    ``polygon`` holds the points ``fid, pos, x, y`` of rings in cell units;
    its bounds, four numbers, prune the tiles.  The result is cut to the
    bounds, and with ``mask`` to cells whose centre lies inside.  Cells that a
    layer lacks are null there; cells that all layers lack have no row.
    """
    box = polygon.agg(F.floor(F.min("x")), F.floor(F.min("y")), F.ceil(F.max("x")) - 1, F.ceil(F.max("y")) - 1).first()
    if box[0] is None:
        raise ValueError("the polygon has no points")
    out = None
    for layer in layers.values():
        own = query(layer, size, *box)
        out = own if out is None else out.join(own, ["x", "y"], "full")
    return clip(out, polygon, all_touched=False) if mask else out


def tile_rows(layer: DataFrame) -> DataFrame:
    return layer.groupBy("tile_x", "tile_y").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count(F.lit(1)).alias("n_cells"))


def extent(metadata: DataFrame) -> DataFrame:
    """One row: the layer's bounds, its number of tiles and of cells, from the rows of its tiles."""
    return metadata.agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), F.count(F.lit(1)).alias("n_tiles"), F.sum("n_cells").alias("n_cells"))


def pyramid(raster: DataFrame, levels: int, combine=F.max, value: str = "v") -> DataFrame:
    """``level, x, y, v``: each level halves the one below; level 0 is the raster.

    Cells are expanded to their cell on every level and combined once, so all
    levels take one shuffle with partial results.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    rows = raster.select("x", "y", value, steps.alias("level"))
    down = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("level"))).cast("int")
    return rows.select("level", down("x").alias("x"), down("y").alias("y"), value).groupBy("level", "x", "y").agg(combine(value).alias(value))


def web_mercator(raster: DataFrame, g: Geotransform, zoom: int, size: int = 256, value: str = "v") -> DataFrame:
    """``x, y, v``: pixels of the Web Mercator pyramid at a zoom whose centre lies in a cell of a longitude/latitude raster.

    Each cell gives the pixels it covers, so there are no gaps and no pixel is
    met twice.  Cells beyond 85.05 degrees are cut off.
    """
    n = float(size * 2**zoom)
    limit = 85.05112878
    column = lambda lon: (lon + 180.0) / 360.0 * n
    row = lambda lat: (1.0 - F.log(F.tan(F.radians(lat)) + 1.0 / F.cos(F.radians(lat))) / pi) / 2.0 * n
    held = lambda lat: F.greatest(F.lit(-limit), F.least(F.lit(limit), lat))
    lon, lat = g.x0 + F.col("x") * g.dx, g.y0 + F.col("y") * g.dy
    left, right = column(F.least(lon, lon + g.dx)), column(F.greatest(lon, lon + g.dx))
    top, bottom = row(held(F.greatest(lat, lat + g.dy))), row(held(F.least(lat, lat + g.dy)))
    spans = raster.select(value, *(F.ceil(c - 0.5).alias(k) for k, c in (("a", left), ("b", right), ("c", top), ("d", bottom)))).where("a < b and c < d")
    across = spans.select(value, "c", "d", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("x"))
    return across.select(F.col("x").cast("int").alias("x"), F.explode(F.sequence(F.col("c"), F.col("d") - 1)).alias("row"), value).select("x", F.col("row").cast("int").alias("y"), value)


def export(raster: DataFrame, size: int, levels: int, seed: int = 0) -> DataFrame:
    """``z, tile_x, tile_y, n, pixels``: tiles of a pyramid with coloured pixels, as a tile server would send them.

    Zoom grows inwards: the raster itself is zoom ``levels``.
    """
    rows = tiled(pyramid(raster, levels), size).withColumn("colour", colour(F.col("v"), seed))
    listed = rows.groupBy((levels - F.col("level")).alias("z"), "tile_x", "tile_y").agg(F.sort_array(F.collect_list(F.struct("y", "x", "colour"))).alias("pixels"))
    return listed.select("z", "tile_x", "tile_y", F.size("pixels").alias("n"), "pixels")
