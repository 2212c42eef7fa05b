"""A flow graph with its accumulation, packed by spans: cells move once, and steps that need few of them read the arrays.

Rows of the packed table hold the cells of a span in order, the next cell of
each, its accumulation and further values.  Heights are dealt out to spans with
the row above and below, so directions, paths and sizes within a span are told
where the cells lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.functions.cells import STEPS, cell_key, in_grid
from hydrospark.operators import flow as graphs
from hydrospark.operators import spans
from hydrospark.operators.spans import NONE, Paths, look_up
from hydrospark.storage import write_table


def _bits(column: pa.Array) -> np.ndarray:
    """Numbers as whole ones of 8 bytes, null as NONE; doubles by their bits, of which those of -0.0 stand for null."""
    if not pa.types.is_floating(column.type):
        return spans.longs(column)
    doubles = np.asarray(column.cast(pa.float64()).fill_null(np.nan)) + 0.0
    return np.where(np.asarray(column.is_valid()), doubles.view(np.int64), NONE)


def descent(cell: np.ndarray, z: np.ndarray, low: int, high: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells from ``low`` up to ``high``, their next cells by steepest descent and heights, from them and all cells beside them.

    As in ``stencil.steepest``: equal slopes go to the lower code, NaN has no
    direction and is no neighbour, of rows of one cell the greatest height counts.
    """
    shift = low - width - 1
    square, there = np.full(high - low + 2 * (width + 1), np.nan), np.zeros(high - low, bool)
    np.fmax.at(square, cell - shift, z)
    there[cell[(cell >= low) & (cell < high)] - low] = True
    own = np.nonzero(there)[0] + low
    x, y, mine = own % width, own // width, square[own - shift]
    best, nxt = np.zeros(len(own)), np.full(len(own), NONE)
    for d, (dx, dy) in STEPS.items():
        inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
        to = own + dy * width + dx
        slope = np.where(inside, (mine - square[to - shift]) / (1.0 if d % 2 else sqrt(2.0)), np.nan)
        more = slope > best
        best[more], nxt[more] = slope[more], to[more]
    return own, nxt, mine


class PackedFlow:
    """``packed``: a row for each span with ``cell, nxt, acc`` and the columns ``kept`` as arrays."""

    def __init__(self, packed: DataFrame, kinds: dict[str, object]):
        self.packed, self.kinds = packed, kinds

    @classmethod
    def sized(cls, flow: DataFrame) -> PackedFlow:
        """From ``cell, nxt``, whole numbers; the accumulation is counted."""
        begun = flow.where("cell is not null").select("cell", "nxt", F.lit(1).cast("long").alias("acc"))
        packed = graphs._packed(begun, ["acc"], lambda paths, v: paths.pushed(v, np.add, 0))
        return cls(_with_sizes(packed.df, ["acc"]), {f.name: f.dataType for f in begun.schema})

    @classmethod
    def given(cls, flow: DataFrame) -> PackedFlow:
        """From ``cell, nxt, acc``, whole numbers, as they are; cycles are left to the steps that follow paths."""
        begun = flow.where("cell is not null").select("cell", "nxt", "acc")
        rows = begun.select(graphs._span(F.col("cell")).alias("span"), *(F.col(c).cast("long").alias(c) for c in ("cell", "nxt", "acc")))

        def pack(key, t):
            order = np.argsort(spans.longs(t.column("cell").combine_chunks()), kind="stable")
            columns = {c: pa.array([spans.longs(t.column(c).combine_chunks())[order].tobytes()], pa.binary()) for c in ("cell", "nxt", "acc")}
            return pa.table({"span": pa.array([key[0].as_py()], pa.int64()), **columns})

        packed = write_table(rows.groupBy("span").applyInArrow(pack, "span bigint, cell binary, nxt binary, acc binary"), "given")
        return cls(packed.df, {f.name: f.dataType for f in begun.schema})

    @classmethod
    def from_heights(cls, dem: DataFrame, width: int, height: int, z: str = "z", heights: bool = False) -> PackedFlow:
        """From heights ``x, y, z`` by steepest descent, with accumulation; with ``heights``, ``z`` is kept. Cells outside the grid take no part."""
        own = dem.where(in_grid(F.col("x"), F.col("y"), width, height)).select(cell_key(F.col("x"), F.col("y"), width).alias("cell"), F.col(z).cast("double").alias("z"))
        # a cell goes to its span and to those that hold a cell beside it
        size = spans.SPAN
        at = lambda n: F.floor((F.col("cell") + n) / size).cast("long")
        ends = F.array_distinct(F.array(at(0), *(at(dy * width + dx) for dx, dy in STEPS.values())))
        lone = (at(-width - 1) == at(0)) & (at(width + 1) == at(0))
        dealt = own.select(F.explode(F.when(lone, F.array(at(0))).otherwise(ends)).alias("span"), "cell", "z")

        def pack(key, t):
            low = key[0].as_py() * size
            given, z = spans.longs(t.column("cell").combine_chunks()), t.column("z").combine_chunks()
            cell, nxt, mine = descent(given, np.asarray(z.fill_null(np.nan)), low, low + size, width, height)
            made = pa.table({"cell": cell, "nxt": pa.array(nxt, mask=nxt == NONE), "acc": np.ones(len(cell), np.int64)})
            packed = spans.pack(["acc"], lambda paths, v: paths.pushed(v, np.add, 0))(key, made)
            if heights:
                # a cell whose rows all have a null height, not NaN, keeps null
                kept = pa.array(mine, mask=~np.isin(cell, given[np.asarray(z.is_valid())]) if z.null_count else None)
                packed = packed.append_column("z", pa.array([_bits(kept).tobytes()], pa.binary()))
            return packed.slice(0, min(len(cell), 1))

        values = ["acc", "z"] if heights else ["acc"]
        packed = write_table(dealt.groupBy("span").applyInArrow(pack, spans.pack_schema(["acc"]) + ", z binary" * heights), "spans")
        kinds = {f.name: f.dataType for f in own.select("cell", F.col("cell").alias("nxt"), F.col("cell").alias("acc"), "z").schema}
        return cls(_with_sizes(packed.df, values), {n: kinds[n] for n in ("cell", "nxt", *values)})

    def rows(self, *names: str) -> DataFrame:
        """``cell`` and the columns named, for each cell."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    raw = {n: np.frombuffer(batch.column(n)[k].as_buffer(), dtype="<i8") for n in ("cell", *names)}
                    yield pa.RecordBatch.from_arrays([_numbers(v, n == "z") for n, v in raw.items()], list(raw))

        made = self.packed.select("cell", *names).mapInArrow(unpack, _schema(["cell", *names]))
        return made.select(*(F.col(c).cast(self.kinds[c]).alias(c) for c in ("cell", *names)))

    def at(self, rows: DataFrame, *names: str) -> DataFrame:
        """``rows`` (``cell`` and whole numbers) whose cell the graph has, with the columns named; those are looked up span by span."""
        more = rows.columns
        whole = rows.where("cell is not null").select(*(F.col(c).cast("long").alias(c) for c in more))
        listed = whole.groupBy(graphs._span(F.col("cell")).alias("span")).agg(F.collect_list(F.struct(*more)).alias("l"))
        held = self.packed.select("span", F.col("cell").alias("held__"), *names).join(listed, "span").select("held__", *names, *(F.col(f"l.{c}").alias(f"got_{c}") for c in more))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    raw = {n: np.frombuffer(batch.column(n)[k].as_buffer(), dtype="<i8") for n in ("held__", *names)}
                    got = {c: batch.column(f"got_{c}")[k].values for c in more}
                    at, there = look_up(raw["held__"], np.asarray(got["cell"]))
                    found = [*(v.filter(pa.array(there)) for v in got.values()), *(_numbers(raw[n][at[there]], n == "z") for n in names)]
                    yield pa.RecordBatch.from_arrays(found, [*more, *names])

        found = held.mapInArrow(look, _schema([*more, *names]))
        return found.select(*(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in more), *(F.col(c).cast(self.kinds[c]).alias(c) for c in names))


def _numbers(bits: np.ndarray, height: bool) -> pa.Array:
    return pa.array(bits.view("<f8") if height else bits, mask=bits == NONE)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'double' if n == 'z' else 'bigint'}" for n in names)


def _with_sizes(packed: DataFrame, names: list[str]) -> DataFrame:
    """Packed spans with what the cells above and below a span add to ``acc``, by doubling over the cells at which paths leave a span."""
    arrived = graphs._arrived(packed, ["acc"]).withColumn("span", graphs._span(F.col("entry")))
    listed = arrived.groupBy("span").agg(F.collect_list(F.struct("entry", "acc")).alias("l"))
    every = packed.select("span", "cell", "nxt", *names).join(listed, "span", "left").select("span", "cell", "nxt", *names, F.col("l.entry").alias("got_entry"), F.col("l.acc").alias("got_acc"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for k in range(batch.num_rows):
                raw = lambda n: np.frombuffer(batch.column(n)[k].as_buffer(), dtype="<i8")  # noqa: B023, E731
                paths, acc = Paths(raw("cell"), raw("nxt")), raw("acc").copy()
                if batch.column("got_entry")[k].is_valid:
                    entry, more = (np.asarray(batch.column(c)[k].values) for c in ("got_entry", "got_acc"))
                    acc[look_up(paths.cell, entry)[0]] += more
                sizes.append(paths.pushed(acc, np.add, 0)[:-1].tobytes())
            columns = ["span", "cell", "nxt", *names]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.binary()) if c == "acc" else batch.column(c) for c in columns], columns)

    schema = ", ".join(["span bigint", *(f"{n} binary" for n in ("cell", "nxt", *names))])
    return write_table(every.mapInArrow(finish, schema), "sized").df
