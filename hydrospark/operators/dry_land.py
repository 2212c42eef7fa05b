"""The dry part of a flow graph, packed by spans once for all that is asked of it.

Water cells end paths.  Gates, painted slopes and routes follow paths within
the packed spans; only the cells at which paths enter a span take part in
rounds, and only the rows that are asked for or found come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.operators import flow as graphs
from hydrospark.operators import spans
from hydrospark.operators.packed_flow import PackedFlow
from hydrospark.operators.spans import NONE, Paths, longs, look_up
from hydrospark.storage import write_table

#: Bits of a cell: it is in the graph, its accumulation is below the threshold, it is water.
OWN, SLOW, WET = 1, 2, 4


class Land:
    """The dry paths of a span; ``gate`` marks cells whose next cell is water in the same span."""

    def __init__(self, paths: Paths, bits: np.ndarray):
        self.wet, self.slow = (bits & WET) > 0, (bits & SLOW) > 0
        self.gate = np.append(self.wet, False)[paths.to[:-1]]
        paths.to[:-1][self.gate] = paths.n
        self.paths = paths

    def slow_paths(self) -> tuple[Paths, np.ndarray]:
        """Paths over dry cells below the threshold alone, and which cells those are."""
        kept, paths = self.slow & ~self.wet, self.paths
        paths.to[:-1][~(kept & np.append(kept, False)[paths.to[:-1]])] = paths.n
        paths.out[:-1][~kept] = NONE
        return paths, kept


def _packed(span: int, cell: np.ndarray, nxt: np.ndarray, bits: np.ndarray) -> pa.Table:
    order = np.argsort(cell, kind="stable")
    cell, nxt, bits = cell[order], nxt[order], bits[order]
    first = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0][: len(cell)]
    cell, nxt, bits = cell[first], np.maximum.reduceat(nxt, first), np.bitwise_or.reduceat(bits, first)
    held = (bits & (OWN | WET)) > 0
    cell, nxt, bits = cell[held], nxt[held], bits[held]
    nxt[(bits & WET) > 0] = NONE
    land = Land(Paths(cell, nxt), bits)
    out = np.unique(land.paths.out)
    made = {
        "span": pa.array([span], pa.int64()),
        **{n: pa.array([v.tobytes()], pa.binary()) for n, v in (("cell", cell), ("nxt", nxt), ("bits", bits))},
        "out": pa.array([out[out != NONE]], pa.list_(pa.int64())),
        "looped": pa.array([land.paths.looped()], pa.bool_()),
    }
    return pa.table(made).slice(0, min(len(cell), 1))


def _pack(key, t):
    return _packed(key[0].as_py(), *(longs(t.column(c).combine_chunks()) for c in ("cell", "nxt", "bits")))


def _flood(river_th: float):
    """For ``mapInArrow``: packed spans of a flow graph with its accumulation, each with the list ``wet`` of its water cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = lambda n: np.frombuffer(batch.column(n)[k].as_buffer(), dtype="<i8") if batch.column(n)[k].is_valid else np.empty(0, np.int64)  # noqa: B023, E731
                cell, nxt, acc = (raw(n) for n in ("cell", "nxt", "acc"))
                wet = np.asarray(batch.column("wet")[k].values) if batch.column("wet")[k].is_valid else np.empty(0, np.int64)
                bits = np.where((acc != NONE) & (acc < river_th), OWN | SLOW, OWN)
                cell, nxt, bits = np.append(cell, wet), np.append(nxt, np.full(len(wet), NONE)), np.append(bits, np.full(len(wet), WET))
                yield from _packed(batch.column("span")[k].as_py(), cell, nxt, bits).to_batches()

    return run


SCHEMA = "span bigint, cell binary, nxt binary, bits binary, out array<bigint>, looped boolean"


class DryLand:
    """A flow graph (``cell, nxt``) without its water (``cell``); cells of ``acc`` below the threshold are slow.

    Cells are whole numbers.  A cycle over dry cells is an error.  Of a graph
    that is packed already only the water moves; it has its own ``acc``.
    """

    def __init__(self, flow: DataFrame | PackedFlow, water: DataFrame, acc: DataFrame | None = None, river_th: float = float("inf")):
        if isinstance(flow, PackedFlow):
            self.kind = flow.kinds["cell"]
            wet = water.where("cell is not null").select(F.col("cell").cast("long").alias("cell"))
            wet = wet.groupBy(graphs._span(F.col("cell")).alias("span")).agg(F.collect_set("cell").alias("wet"))
            rows = flow.packed.select("span", "cell", "nxt", "acc").join(wet, "span", "full")
            self._keep(rows.mapInArrow(_flood(river_th), SCHEMA))
            return
        row = lambda t, nxt, bit: t.where("cell is not null").select(F.col("cell").cast("long").alias("cell"), nxt.cast("long").alias("nxt"), F.lit(bit).cast("long").alias("bits"))
        rows = row(flow, F.col("nxt"), OWN).unionByName(row(water, F.lit(None), WET))
        if acc is not None:
            rows = rows.unionByName(row(acc.where(F.col("acc") < river_th), F.lit(None), SLOW))
        self.kind = flow.schema["cell"].dataType
        self._keep(rows.groupBy(graphs._span(F.col("cell")).alias("span")).applyInArrow(_pack, SCHEMA))

    def _keep(self, rows: DataFrame) -> None:
        packed = write_table(rows, "dry-land", watch="looped")
        if packed.watched:
            packed.drop()
            raise ValueError("the flow graph has a cycle")
        self.packed = packed.df
        self.out = write_table(self.packed.select("span", F.explode("out").alias("entry")), "outs").df

    def _each(self, rows: DataFrame, made, columns: list[str]) -> DataFrame:
        """Rows of ``made(land, got)`` of each span that ``rows`` (``span`` and whole numbers) name, ``got`` being those rows."""
        names = [c for c in rows.columns if c != "span"]
        listed = rows.groupBy("span").agg(F.collect_list(F.struct(*names)).alias("l"))
        asked = self.packed.join(listed, "span").select("cell", "nxt", "bits", *(F.col(f"l.{c}").alias(f"got_{c}") for c in names))

        def run(paths, values, got):
            return made(Land(paths, values[0]), got)

        return asked.mapInArrow(spans.each_span(["bits"], run), ", ".join(f"{c} bigint" for c in columns))

    def _nodes(self, cells: DataFrame, name: str) -> DataFrame:
        """The cells at which paths enter a span and ``cells`` (``cell`` and ``name``, null for entries), one row each."""
        both = self.out.select(F.col("entry").alias("cell"), F.lit(1).cast("long").alias("entry"), F.lit(None).cast("long").alias(name))
        both = both.unionByName(cells.select(F.col("cell").cast("long").alias("cell"), F.lit(0).cast("long").alias("entry"), F.col(name).cast("long").alias(name)))
        return both.groupBy("cell").agg(F.max("entry").alias("entry"), F.max(name).alias(name)).withColumn("span", graphs._span(F.col("cell")))

    def gates(self, cells: DataFrame) -> DataFrame:
        """``cell, root``: the slow cell at which the path from each of ``cells`` enters water; other cells have no row."""

        def made(land, got):
            at, there = look_up(land.paths.cell, got["cell"])
            at = at[there]
            end, wet = land.paths.ends()[at], land.wet[at]
            dry = lambda v: np.where(wet, NONE, v)
            return {
                "cell": got["cell"][there],
                "entry": got["entry"][there],
                "asked": got["asked"][there],
                "nxt": dry(land.paths.out[end]),
                "root": dry(land.paths.cell[end]),
                "slow": dry(land.slow[end].astype(np.int64)),
                "sunk": np.where(wet | land.gate[end], 1, NONE),
            }

        values = ["root", "slow", "sunk"]
        told = write_table(self._each(self._nodes(cells.withColumn("asked", F.lit(1)), "asked"), made, ["cell", "entry", "asked", "nxt", *values]), "gates").df
        below = graphs._pull_rounds(told.where("entry = 1").select("cell", "nxt", *values), values, graphs.last)
        asked = told.where("asked = 1 and root is not null")
        # most paths end in their span
        far = asked.where("nxt is not null").join(below.select(F.col("cell").alias("nxt"), *(F.col(v).alias(f"{v}_") for v in values)), "nxt", "left")
        far = far.select("cell", *(F.coalesce(f"{v}_", v).alias(v) for v in values))
        every = asked.where("nxt is null").select("cell", *values).unionByName(far).where("slow = 1 and sunk = 1")
        return every.select(F.col("cell").cast(self.kind).alias("cell"), F.col("root").cast(self.kind).alias("root"))

    def painted(self, ids: DataFrame, name: str) -> DataFrame:
        """``cell`` and ``name``, the greatest ``name`` of ``ids`` (``cell`` and ``name``) on each dry cell's path, where there is one."""
        own = ids.select(F.col("cell").cast("long").alias("cell"), F.col(name).cast("long").alias("id")).where("id is not null")
        own = write_table(own.groupBy("cell").agg(F.max("id").alias("id")), "ids").df

        def paint(land, cell, id_):
            at, there = look_up(land.paths.cell, cell)
            values = np.full(land.paths.n, NONE)
            np.maximum.at(values, at[there], id_[there])
            values[land.wet] = NONE
            return at, there, land.paths.pulled(values, np.maximum, NONE)[:-1]

        def entries(land, got):
            at, there, values = paint(land, got["cell"], got["id"])
            kept = there & (got["entry"] == 1)
            kept[kept] = ~land.wet[at[kept]]
            return {"cell": got["cell"][kept], "nxt": land.paths.out[land.paths.ends()[at[kept]]], "id": values[at[kept]]}

        def finish(land, got):
            passed = got["passed"] == 1
            _, _, values = paint(land, got["cell"][~passed], got["id"][~passed])
            order = np.argsort(got["cell"][passed])
            at, there = look_up(got["cell"][passed][order], land.paths.out[land.paths.ends()[:-1]])
            values[there] = np.maximum(values[there], got["id"][passed][order][at[there]])
            kept = (values != NONE) & ~land.wet
            return {"cell": land.paths.cell[kept], "id": values[kept]}

        told = self._each(self._nodes(own, "id"), entries, ["cell", "nxt", "id"])
        below = write_table(graphs._pull_rounds(told, ["id"], F.greatest).where("id is not null"), "below").df
        flag = lambda k: F.lit(k).cast("long").alias("passed")
        rows = own.select(graphs._span(F.col("cell")).alias("span"), "cell", "id", flag(0))
        rows = rows.unionByName(self.out.join(below.withColumnRenamed("cell", "entry"), "entry").select("span", F.col("entry").alias("cell"), "id", flag(1)))
        final = write_table(self._each(rows, finish, ["cell", "id"]), "painted").df
        return final.select(F.col("cell").cast(self.kind).alias("cell"), F.col("id").cast(ids.schema[name].dataType).alias(name))

    def reached(self, starts: DataFrame) -> DataFrame:
        """``cell``: slow dry cells with one of ``starts`` at or above them and nothing but such cells between."""

        def entries(land, got):
            at, there = look_up(land.paths.cell, got["cell"])
            paths, slow = land.slow_paths()
            there[there] = slow[at[there]]
            return {"cell": got["cell"][there], "nxt": paths.out[paths.ends()[at[there]]], "begun": np.where(got["begun"][there] == 1, 1, 0)}

        def finish(land, got):
            paths, _ = land.slow_paths()
            at, there = look_up(paths.cell, got["cell"])
            met = np.zeros(paths.n + 1, bool)
            met[at[there]] = True
            for ahead in paths._rounds():
                met[ahead[met]] = True
            return {"cell": paths.cell[met[:-1]]}

        told = self._each(self._nodes(starts.select("cell", F.lit(1).alias("begun")), "begun"), entries, ["cell", "nxt", "begun"])
        total = graphs.gather(told, {"begun": graphs.Gather(F.col("begun"), F.col("begun"), F.max)})
        rows = total.where("begun = 1").select(graphs._span(F.col("cell")).alias("span"), "cell")
        return write_table(self._each(rows, finish, ["cell"]), "reached").df.select(F.col("cell").cast(self.kind).alias("cell"))
