"""Cells in square blocks: stencils on blocks with a margin, and distances block by block.

For a stencil, cells move once, and those near a border between blocks to the
blocks beside it as well.  For distances, blocks are packed to one row each.
A round relaxes every block that got something new as far as it goes by itself
and sends on only what changed on its border, so there are as many rounds as
blocks that a shortest way crosses, not as cells that it is long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.storage import Table, write_table

#: Cells along a block's side.
SIDE = 128
FAR = np.int32(2**31 - 2)
BORDER = "array<struct<x:int,y:int,level:double,d:array<int>>>"
STATE = f"bx int, by int, at binary, level binary, d binary, sent {BORDER}"
STEPS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]

#: Of the columns that ``each_block`` takes and gives: Arrow's type, and what stands for null in an array.
NONE = np.iinfo(np.int64).min
KINDS = {"int": (pa.int32(), NONE), "bigint": (pa.int64(), NONE), "double": (pa.float64(), np.nan), "boolean": (pa.bool_(), NONE)}


def _margins(cells: DataFrame, margin: int, side: int) -> DataFrame:
    """Each cell with its block ``bx__, by__`` and, once more, with every block that it is up to ``margin`` cells away from."""
    at = lambda dx, dy: F.struct(F.floor((F.col("x") + dx * margin) / side).cast("int").alias("x"), F.floor((F.col("y") + dy * margin) / side).cast("int").alias("y"))
    place = [F.pmod(F.col(c), F.lit(side)) for c in "xy"]
    near = [(p < margin) | (p >= side - margin) for p in place]
    held = F.when(near[0] | near[1], F.array_distinct(F.array(at(0, 0), *(at(dx, dy) for dx, dy in STEPS)))).otherwise(F.array(at(0, 0)))
    return cells.select("*", F.explode(held).alias("b__")).select(F.col("b__.x").alias("bx__"), F.col("b__.y").alias("by__"), *cells.columns)


def each_block(cells: DataFrame, compute: Callable[..., dict[str, np.ndarray]], schema: str, margin: int = 1, side: int = SIDE) -> DataFrame:
    """Rows that ``compute`` makes of every block of ``cells`` (``x, y`` and numbers).

    ``compute(there, left, top, **columns)`` gets squares with a margin: which
    cells there are, and their values (null: NaN, or NONE for whole numbers);
    ``left, top`` is the cell at the square's first place.  Of rows of one
    cell those of the greatest values count.
    """
    names = [c for c in cells.columns if c not in "xy"]
    kinds = {n: KINDS[cells.schema[n].dataType.simpleString()] for n in names}
    out = dict(c.split() for c in schema.split(", "))
    n = side + 2 * margin

    def run(key, t):
        left, top = (k.as_py() * side - margin for k in key)
        place = (np.asarray(t.column("y")).astype(np.int64) - top) * n + np.asarray(t.column("x")).astype(np.int64) - left
        there = np.zeros(n * n, bool)
        there[place] = True
        inner = there.reshape(n, n)[margin:-margin, margin:-margin]
        made = {}
        if inner.any():
            once, columns = np.count_nonzero(there) == len(place), {}
            for name, (kind, none) in kinds.items():
                whole = not pa.types.is_floating(kind)
                column = t.column(name).combine_chunks().cast(pa.int64() if whole else kind)
                values = np.asarray(column.fill_null(none))
                square = np.full(n * n, none, np.int64 if whole else np.float64)
                if once:
                    square[place] = values
                else:
                    (np.maximum if whole else np.fmax).at(square, place, values)
                columns[name] = square.reshape(n, n)
            made = compute(there.reshape(n, n), left, top, **columns)
        arrays = []
        for name, kind in out.items():
            v = np.asarray(made.get(name, ()))
            if v.dtype.kind == "f":
                array = pa.array(v, pa.float64(), mask=np.isnan(v))
            else:
                array = pa.array(v, pa.bool_() if v.dtype == bool else pa.int64(), mask=None if v.dtype == bool else v == NONE)
            arrays.append(array.cast(KINDS[kind][0]))
        return pa.table(arrays, names=list(out))

    return _margins(cells, margin, side).groupBy("bx__", "by__").applyInArrow(run, schema)


def around(square: np.ndarray, step: tuple[int, int], beyond) -> np.ndarray:
    """The value of every place's neighbour, ``beyond`` where that lies outside."""
    (dx, dy), (h, w) = step, square.shape
    out = np.full_like(square, beyond)
    out[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = square[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def within(mask: np.ndarray, margin: int = 1) -> np.ndarray:
    """``mask`` without its margin."""
    out = np.zeros_like(mask)
    out[margin:-margin, margin:-margin] = mask[margin:-margin, margin:-margin]
    return out


def _relax(level: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Least steps over equal levels; both arrays have a margin of one cell."""
    inner = (slice(1, -1), slice(1, -1))
    links = []
    for dx, dy in STEPS:
        there = (slice(1 + dy, level.shape[0] - 1 + dy), slice(1 + dx, level.shape[1] - 1 + dx))
        links.append((there, level[inner] == level[there]))  # nan equals nothing
    while True:
        best = d[:, 1:-1, 1:-1].copy()
        for there, same in links:
            best = np.minimum(best, np.where(same, d[(slice(None), *there)] + 1, FAR))
        if (best == d[:, 1:-1, 1:-1]).all():
            return d
        d[:, 1:-1, 1:-1] = best


def _unpack(row: dict, fields: int, margin: list[dict], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(row["at"], dtype="<i4")
    level = np.full((side + 2, side + 2), np.nan)
    d = np.full((fields, side + 2, side + 2), FAR, dtype=np.int32)
    y, x = at // side + 1, at % side + 1
    level[y, x] = np.frombuffer(row["level"], dtype="<f8")
    d[:, y, x] = np.frombuffer(row["d"], dtype="<i4").reshape(fields, -1)
    for m in margin:
        my, mx = m["y"] - row["by"] * side + 1, m["x"] - row["bx"] * side + 1
        level[my, mx], d[:, my, mx] = m["level"], np.minimum(d[:, my, mx], m["d"])
    return at, level, d


def _step(fields: int, side: int):
    names = [f.split()[0] for f in STATE.split(", ")[:5]]
    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("level", pa.float64()), ("d", pa.list_(pa.int32()))]))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in names}
                got = batch.column("got")[k].as_py()
                sent = []
                if got is not None:
                    at, level, d = _unpack(row, fields, got, side)
                    old = np.frombuffer(row["d"], dtype="<i4").reshape(fields, -1)
                    y, x = at // side + 1, at % side + 1
                    new = _relax(level, d)[:, y, x]
                    edge = (y == 1) | (y == side) | (x == 1) | (x == side)
                    # the first time, whatever is known is news to the neighbours
                    news = edge & ((new < old).any(axis=0) | (bool(batch.column("first")[k].as_py()) & (new < FAR).any(axis=0)))
                    for i in np.nonzero(news)[0]:
                        sent.append({"x": int(x[i]) - 1 + row["bx"] * side, "y": int(y[i]) - 1 + row["by"] * side, "level": float(level[y[i], x[i]]), "d": new[:, i].tolist()})
                    row["d"] = np.ascontiguousarray(new, dtype="<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([row[n]], t) for n, t in zip(names, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)), pa.array([sent], kind)],
                    [*names, "sent"],
                )

    return run


def distances(cells: DataFrame, starts: dict[str, Column], side: int = SIDE, max_rounds: int = 100_000) -> DataFrame:
    """``x, y`` and, for each name, the least distance in steps to the 8 neighbours, over cells of the same ``level``.

    ``cells`` holds ``x, y, level`` and what ``starts`` need: a column with the
    distance that a cell has to begin with, or null.  Cells that no start
    reaches get null.
    """
    fields, names = len(starts), list(starts)
    bx, by = (F.floor(F.col(c) / side).cast("int") for c in "xy")
    at = (F.col("y") - F.col("by") * side) * side + F.col("x") - F.col("bx") * side
    rows = cells.select("x", "y", F.col("level").cast("double").alias("level"), *(c.cast("int").alias(n) for n, c in starts.items())).withColumns({"bx": bx, "by": by})
    rows = rows.select("bx", "by", at.cast("int").alias("at"), "level", *names)

    def pack(key, t):
        d = [np.where(np.asarray(t.column(n).is_valid()), np.asarray(t.column(n).fill_null(0)), FAR).astype("<i4").tobytes() for n in names]
        values = [np.asarray(t.column(c)).astype(kind).tobytes() for c, kind in (("at", "<i4"), ("level", "<f8"))]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([v], pa.binary()) for v in (*values, b"".join(d)))], names=["bx", "by", "at", "level", "d"])

    state: Table = write_table(rows.groupBy("bx", "by").applyInArrow(pack, "bx int, by int, at binary, level binary, d binary").withColumn("sent", F.lit(None).cast(BORDER)), "blocks")
    relax = _step(fields, side)
    for k in range(max_rounds):
        if k == 0:
            told = state.df.drop("sent").withColumns({"got": F.array().cast(BORDER), "first": F.lit(True)})
        else:
            news = state.df.where(F.size("sent") > 0).select("bx", "by", F.explode("sent").alias("s"))
            # a border cell is on the margin of up to three other blocks
            touches = F.array_distinct(F.flatten(F.array(*(F.array(F.struct(F.floor((F.col("s.x") + dx) / side).cast("int").alias("bx"), F.floor((F.col("s.y") + dy) / side).cast("int").alias("by"))) for dx, dy in STEPS))))
            to = news.select(F.col("bx").alias("ox"), F.col("by").alias("oy"), "s", F.explode(touches).alias("t")).where("t.bx <> ox or t.by <> oy")
            got = to.groupBy(F.col("t.bx").alias("bx"), F.col("t.by").alias("by")).agg(F.collect_list("s").alias("got"))  # at most a block's margin
            told = state.df.drop("sent").join(got, ["bx", "by"], "left").withColumn("first", F.lit(False))
        new = write_table(told.mapInArrow(relax, STATE), "blocks", watch="size(sent) > 0")
        state.drop()
        state = new
        if not state.watched:
            break

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                here = np.frombuffer(batch.column("at")[k].as_py(), dtype="<i4")
                d = np.frombuffer(batch.column("d")[k].as_py(), dtype="<i4").reshape(fields, -1)
                x, y = here % side + batch.column("bx")[k].as_py() * side, here // side + batch.column("by")[k].as_py() * side
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), *(pa.array(v, pa.int32(), mask=v >= FAR) for v in d)], ["x", "y", *names])

    return state.df.mapInArrow(unpack, f"x int, y int, {', '.join(f'{n} int' for n in names)}")
