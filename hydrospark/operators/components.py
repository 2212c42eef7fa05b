"""Connected components by minimum-label propagation with pointer jumping, and areas of rasters block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.cells import STEPS, cell_key
from hydrospark.operators.blocks import SIDE
from hydrospark.storage import write_table

HALF = (1, 2, 3, 4)  # one direction of each pair, so each edge is made once


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """``(node, label)`` for every endpoint of an undirected edge list; label = least node of its component.

    Each round takes the least label among neighbours and then follows the
    label's own label, so long paths shrink geometrically.  Rounds are written
    to the shared folder; nothing but one boolean reaches the driver.  Null
    endpoints are ignored, self loops give single nodes, an empty edge list
    gives an empty result.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = write_table(one.union(one.select("b", "a")).distinct(), "edges")
    state = write_table(both.df.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(max_rounds):
        labels = state.df
        near = (
            both.df.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hop = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("via"))
        step = hop.join(labels.select(F.col("node").alias("via"), F.col("label").alias("far")), "via").select(
            "node", F.least("via", "far").alias("label"), (F.least("via", "far") < F.col("was")).alias("moved")
        )
        new = write_table(step, "labels", watch="moved")
        state.drop()
        state = new
        if not new.watched:
            both.drop()
            return state.df.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _codes(t: pa.Table, by: list[str]) -> np.ndarray:
    """A number for each row, equal where all columns are; -1 where one is null, which equals nothing."""
    code, known = np.zeros(t.num_rows, np.int64), np.ones(t.num_rows, bool)
    for name in by:
        column = t.column(name).combine_chunks().dictionary_encode()
        own = np.asarray(column.indices.fill_null(-1)).astype(np.int64)
        known &= own >= 0
        code = np.unique(code * (len(column.dictionary) + 1) + own, return_inverse=True)[1].reshape(-1)
    return np.where(known, code, -1)


def _areas(codes: np.ndarray, directions: tuple[int, ...]) -> np.ndarray:
    """The least place, in reading order, of the area of each place of a square; places with code -1 are alone."""
    side = codes.shape[0]
    place = np.arange(side * side).reshape(codes.shape)
    ends = []
    for dx, dy in (STEPS[d] for d in directions):
        here = (slice(max(-dy, 0), side - max(dy, 0)), slice(max(-dx, 0), side - max(dx, 0)))
        there = (slice(max(dy, 0), side + min(dy, 0)), slice(max(dx, 0), side + min(dx, 0)))
        same = (codes[here] == codes[there]) & (codes[here] >= 0)
        ends.append((place[here][same], place[there][same]))
    return least_linked(side * side, *(np.concatenate(e) for e in zip(*ends, strict=True)))


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that links ``a`` to ``b`` join it to."""
    least = np.arange(n)
    while len(a):
        # the greater of two roots is hung below the lesser, then all hang below their root
        np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
        while ((far := least[least]) != least).any():
            least = far
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return least


def label_blocks(cells: DataFrame, width: int, directions: tuple[int, ...], by: list[str], side: int = SIDE) -> DataFrame:
    """``x, y, *by, label``: areas of cells that agree in ``by``; label = least packed cell.

    A cell has one row.  Areas are labelled within blocks, and only areas that
    meet at a border between blocks are joined in rounds.
    """
    steps = [STEPS[d] for d in directions]
    block = [F.floor(F.col(c) / side).cast("int").alias(f"{c}__") for c in "xy"]
    kept = [c for c in ("x", "y", *by)]

    def local(key, t):
        left, top = (k.as_py() * side for k in key)
        x, y = np.asarray(t.column("x")).astype(np.int64) - left, np.asarray(t.column("y")).astype(np.int64) - top
        codes = np.full((side, side), -1, np.int64)
        codes[y, x] = _codes(t, by)
        least = _areas(codes, directions)[y * side + x]
        rim = (x == 0) | (y == 0) | (x == side - 1) | (y == side - 1)
        return t.select(kept).append_column("local", pa.array((least // side + top) * width + least % side + left)).append_column("rim", pa.array(rim))

    rows = cells.select(*kept, *block)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    found = write_table(rows.groupBy("x__", "y__").applyInArrow(local, f"{schema}, local bigint, rim boolean"), "block-areas").df
    rim = found.where("rim")
    ahead = rim.select("x", "y", "local", *by, F.explode(F.array(*(F.struct((F.col("x") + dx).alias("nx"), (F.col("y") + dy).alias("ny")) for dx, dy in steps))).alias("s"))
    other = lambda c: F.floor(F.col(c) / side) != F.floor(F.col(f"s.n{c}") / side)
    ahead = ahead.where((other("x") | other("y")) & F.col("s.nx").between(0, width - 1))
    ahead = ahead.select(cell_key(F.col("s.nx"), F.col("s.ny"), width).alias("cell"), *by, F.col("local").alias("a"))
    met = ahead.join(rim.select(cell_key(F.col("x"), F.col("y"), width).alias("cell"), *by, F.col("local").alias("b")), ["cell", *by])
    joined = connected_components(met.select("a", "b").distinct(), "a", "b").select(F.col("node").alias("local"), "label")
    return found.join(joined, "local", "left").select(*kept, F.coalesce("label", "local").alias("label"))
