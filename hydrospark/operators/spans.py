"""Paths of a flow graph within spans of neighbouring cell numbers, as arrays.

A span is a row: its cells in order and the next cell of each.  Most paths of
a raster's flow stay in one span for most of their way, so what is left
between spans are the few cells at which paths leave one and enter another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Cell numbers in a span: on a grid 100 cells wide some 160 rows of it.
SPAN = 1 << 14
#: Stands for null.
NONE = np.iinfo(np.int64).min


class Paths:
    """The in-span part of the paths of a span: ``to`` is the next cell's place or ``n``, ``out`` the next cell if it lies elsewhere."""

    def __init__(self, cell: np.ndarray, nxt: np.ndarray):
        self.cell, self.n = cell, len(cell)
        at = np.minimum(np.searchsorted(cell, nxt), max(self.n - 1, 0))
        inside = (nxt != NONE) & (cell[at] == nxt)
        self.to = np.append(np.where(inside, at, self.n), self.n)
        self.out = np.append(np.where(inside, NONE, nxt), NONE)

    def _rounds(self) -> Iterator[np.ndarray]:
        """The 2**k-th next cell of each cell, for every k at which some cell has one."""
        ahead = self.to
        for _ in range(self.n.bit_length() + 1):
            if (ahead == self.n).all():
                return
            yield ahead
            ahead = ahead[ahead]
        raise ValueError("the flow graph has a cycle")

    def looped(self) -> bool:
        try:
            return not all(True for _ in self._rounds())
        except ValueError:
            return True

    def ends(self) -> np.ndarray:
        """The place of the last cell of each path within the span."""
        end = np.arange(self.n + 1)
        for ahead in self._rounds():
            end = np.where(ahead < self.n, end[ahead], end)
        return end

    def pulled(self, values: np.ndarray, combine: np.ufunc, nothing: int) -> np.ndarray:
        """Values of each cell and all cells below it in the span, combined."""
        values = np.append(values, nothing)
        for ahead in self._rounds():
            values = combine(values, values[ahead])
        return values

    def pushed(self, values: np.ndarray, combine: np.ufunc, nothing: int) -> np.ndarray:
        """Values of each cell and all cells above it in the span, combined."""
        values = np.append(values, nothing)
        for ahead in self._rounds():
            moving = np.nonzero(ahead < self.n)[0]
            got = values.copy()
            combine.at(got, ahead[moving], values[moving])
            values = got
        return values


def longs(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(NONE))


def pack(names: list[str], sums: Callable[[Paths, np.ndarray], np.ndarray] | None) -> Callable:
    """For ``applyInArrow``: a span's cells ``span, cell, nxt, *names`` as one row.

    ``gate`` and ``out`` are the cells at which paths leave and where they go;
    ``sums``, if given, tells what each value sends there.
    """

    def run(key, t):
        cell, nxt = longs(t.column("cell").combine_chunks()), longs(t.column("nxt").combine_chunks())
        order = np.argsort(cell, kind="stable")
        cell, nxt = cell[order], nxt[order]
        values = [longs(t.column(n).combine_chunks())[order] for n in names]
        paths = Paths(cell, nxt)
        looped = paths.looped()
        gate = np.nonzero(paths.out[:-1] != NONE)[0]
        sent = [sums(paths, v)[gate] if sums and not looped else gate for v in values]
        columns = {
            "span": pa.array([key[0].as_py()], pa.int64()),
            "cell": pa.array([cell.tobytes()], pa.binary()),
            "nxt": pa.array([nxt.tobytes()], pa.binary()),
            **{n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(names, values, strict=True)},
            "gate": pa.array([cell[gate]], pa.list_(pa.int64())),
            "out": pa.array([paths.out[gate]], pa.list_(pa.int64())),
            **{f"{n}_sent": pa.array([s], pa.list_(pa.int64())) for n, s in zip(names, sent, strict=True)},
            "looped": pa.array([looped], pa.bool_()),
        }
        return pa.table(columns)

    return run


def pack_schema(names: list[str]) -> str:
    lists = ["gate", "out", *(f"{n}_sent" for n in names)]
    return ", ".join(["span bigint", "cell binary", "nxt binary", *(f"{n} binary" for n in names), *(f"{n} array<bigint>" for n in lists), "looped boolean"])


def each_span(names: list[str], made: Callable[[Paths, list[np.ndarray], dict], dict[str, np.ndarray]]) -> Callable:
    """For ``mapInArrow``: rows of ``made(paths, values, got)`` of every packed span, ``got`` being what was joined to it as lists by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [c for c in batch.schema.names if c.startswith("got_")]
            for k in range(batch.num_rows):
                raw = lambda n: np.frombuffer(batch.column(n)[k].as_buffer(), dtype="<i8")  # noqa: B023, E731
                got = {c[4:]: np.asarray(batch.column(c)[k].values.fill_null(NONE)) if batch.column(c)[k].is_valid else np.empty(0, np.int64) for c in given}
                out = made(Paths(raw("cell"), raw("nxt")), [raw(n) for n in names], got)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64(), mask=v == NONE) for v in out.values()], list(out))

    return run


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
