"""Stencils on rasters that are stored in blocks, one row each with its values as an array.

Blocks are stored in buckets by their place, so a stencil moves nothing but
the margins that neighbouring blocks need of each other: of a block of 128 by
128 cells, some three cells in a hundred.  The values of a block and its
margin are one array, on which the stencil is computed whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.cells import STEPS
from hydrospark.operators.blocks import SIDE
from hydrospark.storage import scratch

BLOCK = "bx int, by int, v binary"
TYPES = {"int": pa.int32(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}


def store_blocks(raster: DataFrame, value: str, side: int = SIDE) -> DataFrame:
    """``bx, by, v``: the raster in a bucketed table in the shared folder; ``v`` holds ``side`` rows of doubles, NaN where there is no cell.

    Cells are moved once, when they are stored.  A null or NaN value is no
    cell; of repeated cells one counts.
    """
    spark = raster.sparkSession
    at = [F.floor(F.col(c) / side).cast("int").alias(f"b{c}") for c in "xy"]
    rows = raster.where(F.col(value).isNotNull()).select(*at, "x", "y", F.col(value).cast("double").alias("v"))

    def pack(key, t):
        bx, by = (k.as_py() for k in key)
        block = np.full((side, side), np.nan)
        block[np.asarray(t.column("y")) - by * side, np.asarray(t.column("x")) - bx * side] = np.asarray(t.column("v"))
        return pa.table([pa.array([bx], pa.int32()), pa.array([by], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["bx", "by", "v"])

    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.groupBy("bx", "by").applyInArrow(pack, BLOCK).repartition(buckets, "bx", "by")
    packed.write.bucketBy(buckets, "bx", "by").sortBy("bx", "by").option("path", scratch(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def _margins(side: int):
    """The rows and columns that a block's neighbours need, as ``bx, by, dx, dy, m`` of the receiving block; ``dx, dy`` tells from where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for bx, by, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(raw, dtype="<f8").reshape(side, side)
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        part = v[{-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[dy], {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[dx]]
                        if (dx or dy) and not np.isnan(part).all():
                            out.append((bx + dx, by + dy, -dx, -dy, part.tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(),) * 4 + (pa.binary(),), strict=True)], ["bx", "by", "dx", "dy", "m"])

    return run


def stencil(blocks: DataFrame, compute: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, side: int = SIDE) -> DataFrame:
    """``x, y`` and the columns of ``schema`` for the cells that ``compute`` keeps.

    ``compute`` gets a block with a margin of one cell and returns ``keep``
    and an array for each column, all of the size of the block.
    """
    types = dict(c.split() for c in schema.split(", "))
    got = blocks.mapInArrow(_margins(side), "bx int, by int, dx int, dy int, m binary")
    got = got.groupBy("bx", "by").agg(F.collect_list(F.struct("dx", "dy", "m")).alias("got"))  # at most 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bx, by, raw, margin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.full((side + 2, side + 2), np.nan)
                v[1:-1, 1:-1] = np.frombuffer(raw, dtype="<f8").reshape(side, side)
                for m in margin or ():
                    at = ({-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}[m["dy"]], {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}[m["dx"]])
                    v[at] = np.frombuffer(m["m"], dtype="<f8").reshape(v[at].shape)
                made = compute(v)
                ys, xs = np.nonzero(made["keep"])
                columns = [pa.array((xs + bx * side).astype(np.int32)), pa.array((ys + by * side).astype(np.int32)), *(pa.array(made[n][ys, xs].tolist(), TYPES[t]) for n, t in types.items())]
                yield pa.RecordBatch.from_arrays(columns, ["x", "y", *types])

    return blocks.join(got.hint("merge"), ["bx", "by"], "left").select("bx", "by", "v", "got").mapInArrow(run, f"x int, y int, {schema}")


def _around(v: np.ndarray) -> dict[int, np.ndarray]:
    """The neighbour of every cell in each direction."""
    h, w = v.shape
    return {d: v[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for d, (dx, dy) in STEPS.items()}


def d8(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """As ``stencil.d8``, from stored blocks."""

    def compute(v: np.ndarray) -> dict[str, np.ndarray]:
        own, near = v[1:-1, 1:-1], _around(v)
        slopes = np.stack([(own - near[d]) / (1.0 if d % 2 else sqrt(2.0)) for d in range(1, 9)])
        slopes = np.where(np.isnan(slopes), -np.inf, slopes)
        best = slopes.argmax(axis=0)  # the first of equal ones
        slope = np.take_along_axis(slopes, best[None], axis=0)[0]
        return {"keep": slope > 0, "dir": (best + 1).astype(np.int32), "slope": slope}

    return stencil(blocks, compute, "dir int, slope double", side)


def boundary_cells(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """As ``stencil.boundary_cells``, with the cell's value, from stored blocks."""

    def compute(v: np.ndarray) -> dict[str, np.ndarray]:
        own = v[1:-1, 1:-1]
        n = sum((~np.isnan(x)).astype(np.int8) for x in _around(v).values())
        return {"keep": ~np.isnan(own) & (n < 8), "value": own}

    return stencil(blocks, compute, "value double", side)


def lake_buffer(blocks: DataFrame, width: int, height: int, side: int = SIDE) -> DataFrame:
    """``lake, x, y``: as ``stencil.lake_buffer``, from stored blocks of lake numbers that cover the grid's blocks with water.

    A lake that ends at a block's border has neighbours in a block of its own,
    so blocks beside water are added where they have none themselves.
    """
    empty = np.full((side, side), np.nan).tobytes()
    beside = blocks.select("bx", "by", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("s"))
    beside = beside.select((F.col("bx") + F.col("s.a")).alias("bx"), (F.col("by") + F.col("s.b")).alias("by")).distinct()
    all_ = beside.join(blocks.hint("merge"), ["bx", "by"], "left").select("bx", "by", F.coalesce("v", F.lit(empty)).alias("v"))

    def compute(v: np.ndarray) -> dict[str, np.ndarray]:
        own, near = v[1:-1, 1:-1], np.stack([*_around(v).values()])
        dry = np.isnan(own) & ~np.isnan(near).all(axis=0)
        lakes = np.empty(own.shape, dtype=object)
        for y, x in zip(*np.nonzero(dry), strict=True):
            lakes[y, x] = sorted({int(k) for k in near[:, y, x] if k == k})
        return {"keep": dry, "lakes": lakes}

    out = stencil(all_, compute, "lakes array<bigint>", side).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return out.select(F.explode("lakes").alias("lake"), "x", "y")
