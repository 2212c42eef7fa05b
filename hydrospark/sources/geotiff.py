"""GeoTIFF files as cells, without native libraries.

A file of any size is read by byte ranges: the driver reads its header, and
each task the strips or tiles of a run of blocks.  From a store that only
Spark can open, files are read whole by the binary reader.  Plain, DEFLATE and
LZW compressed single-band files, classic or BigTIFF, are supported, with the
horizontal predictor for integers and the one for floating-point numbers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hydrospark.functions.cells import Geotransform
from hydrospark.sources.byte_ranges import At, list_files, open_store, reader_at

# Field types of the format with their sizes and struct codes.
FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
# Sample format and bits -> numpy type.
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, ROWS, STRIP_BYTES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, SAMPLE, PIXEL_SCALE, TIE, MATRIX, NODATA = (
    256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 34264, 42113,
)


#: Bytes of a task's run of blocks, about.
RUN_BYTES = 32 << 20
CELLS = "file string, x int, y int, v double"


def tags(at: At) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first image."""
    take = lambda code, start: struct.unpack(order + code, at(start, struct.calcsize(order + code)))
    order = {b"II": "<", b"MM": ">"}.get(at(0, 2), "")
    magic = take("H", 2)[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    where = take("Q" if big else "I", 8 if big else 4)[0]
    n = take("Q" if big else "H", where)[0]
    where += 8 if big else 2
    found = {}
    for k in range(n):
        entry = where + k * (20 if big else 12)
        tag, kind = take("HH", entry)
        count = take("Q" if big else "I", entry + 4)[0]
        if kind not in FIELDS:
            continue
        size, code = FIELDS[kind]
        value = entry + (12 if big else 8)
        if size * count > (8 if big else 4):
            value = take("Q" if big else "I", value)[0]
        raw = take(code * count, value)
        found[tag] = (b"".join(raw),) if code == "c" else raw
    return order, found


def in_type(nodata: float | None, dtype: str) -> float | None:
    """The value as samples hold it; None if they can't."""
    if nodata is None:
        return None
    kind = np.dtype(dtype)
    if kind.kind == "f":
        with np.errstate(over="ignore"):
            return float(kind.type(nodata))
    return nodata if nodata == nodata and np.iinfo(kind).min <= nodata <= np.iinfo(kind).max and nodata == int(nodata) else None


def geotransform(found: dict[int, tuple]) -> Geotransform:
    x0, dx, rx, y0, ry, dy = 0.0, 1.0, 0.0, 0.0, 0.0, 1.0
    if MATRIX in found:
        m = found[MATRIX]
        x0, dx, rx, y0, ry, dy = m[3], m[0], m[1], m[7], m[4], m[5]
    elif PIXEL_SCALE in found:
        scale, tie = found[PIXEL_SCALE], found[TIE]
        dx, dy = scale[0], -scale[1]
        x0, y0 = tie[3] - tie[0] * dx, tie[4] - tie[1] * dy
    kind = SAMPLES[found.get(SAMPLE, (1,))[0], found.get(BITS, (1,))[0]]
    nodata = found.get(NODATA)
    nodata = in_type(float(nodata[0].split(b"\0")[0]), kind) if nodata else None
    return Geotransform(x0, dx, rx, y0, ry, dy, found[WIDTH][0], found[HEIGHT][0], nodata, dtype=kind)


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bit down, one code early in growing wider."""
    out, table, width, last = bytearray(), [], 9, b""
    bits = held = 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last:
            word = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


@dataclass
class Run(InputPartition):
    """Blocks of one file from number ``first`` on; ``spans`` are their byte ranges."""

    path: str
    file: str
    g: Geotransform
    order: str
    packed: int
    predictor: int
    tiled: bool
    block: tuple[int, int]
    first: int
    spans: list[tuple[int, int]]

    def __post_init__(self):
        super().__init__(self.first)


def runs(path: str, file: str, at: At, run_bytes: int = RUN_BYTES) -> list[Run]:
    """A file's blocks in runs of about ``run_bytes``."""
    order, found = tags(at)
    g, tiled, packed = geotransform(found), TILES in found, found.get(COMPRESSION, (1,))[0]
    if packed not in (1, 5, 8, 32946):
        raise ValueError(f"compression {packed} is not supported")
    block = (found[TILE_W][0], found[TILE_H][0]) if tiled else (g.width, min(found.get(ROWS, (g.height,))[0], g.height))
    spans = list(zip(found[TILES if tiled else STRIPS], found[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    out: list[Run] = []
    for k, span in enumerate(spans):
        if not out or sum(n for _, n in out[-1].spans) + span[1] > run_bytes:
            out.append(Run(path, file, g, order, packed, found.get(PREDICTOR, (1,))[0], tiled, block, k, []))
        out[-1].spans.append(span)
    return out


def decoded(raw: bytes, run: Run, rows: int) -> np.ndarray:
    """The samples of one strip or tile."""
    width, kind = run.block[0], np.dtype(run.g.dtype)
    raw = raw if run.packed == 1 else lzw(raw) if run.packed == 5 else zlib.decompress(raw)
    size = rows * width * kind.itemsize
    if len(raw) < size:
        raise ValueError(f"a block of {run.file} holds {len(raw)} bytes instead of {size}")
    if run.predictor == 3:
        # differences of bytes, which stand in planes from the highest on
        planes = np.cumsum(np.frombuffer(raw[:size], dtype="u1").reshape(rows, -1), axis=1, dtype="u1")
        return np.ascontiguousarray(planes.reshape(rows, kind.itemsize, width).transpose(0, 2, 1)).view(kind.newbyteorder(">"))[:, :, 0].astype(kind)
    values = np.frombuffer(raw[:size], dtype=kind.newbyteorder(run.order)).reshape(rows, width).astype(kind)
    return np.cumsum(values, axis=1, dtype=values.dtype) if run.predictor == 2 else values


def cells(run: Run, at: At) -> Iterator[pa.RecordBatch]:
    """``file, x, y, v`` of a run; nodata cells have no row."""
    g, (bw, bh) = run.g, run.block
    across = -(-g.width // bw)
    for k, (start, size) in enumerate(run.spans, run.first):
        if not size:
            continue  # a block that was never written
        x, y = k % across * bw, k // across * bh
        values = decoded(at(start, size), run, bh if run.tiled else min(bh, g.height - y))[: g.height - y, : g.width - x]
        keep = np.ones(values.shape, dtype=bool) if g.nodata is None else ~np.isnan(values) if g.nodata != g.nodata else values != np.dtype(g.dtype).type(g.nodata)
        ys, xs = np.nonzero(keep)
        columns = [pa.array([run.file] * len(xs), pa.string()), pa.array((xs + x).astype(np.int32)), pa.array((ys + y).astype(np.int32)), pa.array(values[keep].astype(float))]
        yield pa.RecordBatch.from_arrays(columns, ["file", "x", "y", "v"])


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, run_bytes: int):
        self.path, self.run_bytes = path, run_bytes

    def partitions(self) -> list[Run]:
        store, _ = open_store(self.path)

        def of(file: str) -> list[Run]:
            with store.open_input_file(file) as f:
                return runs(self.path, file, reader_at(f), self.run_bytes)

        with ThreadPoolExecutor(16) as pool:
            return [r for rs in pool.map(of, list_files(self.path)) for r in rs]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        with open_store(partition.path)[0].open_input_file(partition.file) as f:
            yield from cells(partition, reader_at(f))


class GeoTiff(DataSource):
    """``spark.read.format("geotiff").load(path)``: the cells of all files, a partition for each run of blocks."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(self.options["path"], int(self.options.get("runBytes", RUN_BYTES)))


def read(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``file, x, y, v`` of a file, a folder or the files that a pattern fits; nodata cells have no row."""
    if open_store(path) is not None:
        spark.dataSource.register(GeoTiff)
        return spark.read.format("geotiff").option("runBytes", run_bytes).load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = lambda start, size, data=data: data[start : start + size]
                for run in runs(name, name, at):
                    yield from cells(run, at)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, CELLS)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row of geotransform and type for each file; of a large file only the header is read."""
    names = ("x0", "dx", "rx", "y0", "ry", "dy", "width", "height", "nodata", "dtype")
    types = [pa.float64()] * 6 + [pa.int32()] * 2 + [pa.float64(), pa.string()]
    schema = "file string, x0 double, dx double, rx double, y0 double, ry double, dy double, width int, height int, nodata double, dtype string"
    own = open_store(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, file in enumerate(batch.column(0).to_pylist()):
                if batch.num_columns > 1:
                    data = batch.column(1)[k].as_py()
                    rows.append(geotransform(tags(lambda start, size, data=data: data[start : start + size])[1]))
                else:
                    with open_store(path)[0].open_input_file(file) as f:
                        rows.append(geotransform(tags(reader_at(f))[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([getattr(g, n) for g in rows], t) for n, t in zip(names, types, strict=True))], ["file", *names])

    if own is None:
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, schema)
    return spark.createDataFrame([(f,) for f in list_files(path)], "file string").mapInArrow(decode, schema)


def encode(values: np.ndarray, g: Geotransform) -> bytes:
    """A DEFLATE compressed single-band file of 64-row strips."""
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    strips = [zlib.compress(values[at : at + 64].astype(values.dtype.newbyteorder("<")).tobytes()) for at in range(0, len(values), 64)]
    at, starts = 8, []
    for s in strips:
        starts.append(at)
        at += len(s) + len(s) % 2
    fields = [
        (WIDTH, 4, [g.width]), (HEIGHT, 4, [g.height]), (BITS, 3, [values.dtype.itemsize * 8]), (COMPRESSION, 3, [8]), (262, 3, [1]), (STRIPS, 4, starts), (277, 3, [1]),
        (ROWS, 4, [64]), (STRIP_BYTES, 4, [len(s) for s in strips]), (SAMPLE, 3, [kind]), (PIXEL_SCALE, 12, [g.dx, -g.dy, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, g.x0, g.y0, 0.0]),
    ]
    if g.nodata is not None:
        held = in_type(g.nodata, values.dtype.str[1:])
        text = repr(g.nodata if held is None else held if values.dtype.kind == "f" else int(held))
        fields.append((NODATA, 2, [bytes([c]) for c in f"{text}\0".encode()]))
    body, extra = b"", b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, field, value in fields:
        size, code = FIELDS[field]
        raw = struct.pack("<" + code * len(value), *value)
        if len(raw) > 4:
            body += struct.pack("<HHII", tag, field, len(value), after + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            body += struct.pack("<HHI", tag, field, len(value)) + raw.ljust(4, b"\0")
    image = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    return struct.pack("<2sHI", b"II", 42, at) + image + struct.pack("<H", len(fields)) + body + struct.pack("<I", 0) + extra


def tile_files(raster: DataFrame, g: Geotransform, size: int, dtype: str = "f4", value: str = "v") -> DataFrame:
    """``tile_x, tile_y, content``: a GeoTIFF of each tile of ``size`` by ``size`` cells, ready for a binary sink."""
    nodata = -9999.0 if g.nodata is None else g.nodata

    def draw(keys: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() for k in keys)
        w, h = min(size, g.width - tx * size), min(size, g.height - ty * size)
        values = np.full((h, w), nodata, dtype=dtype)
        values[part["y"].to_numpy() - ty * size, part["x"].to_numpy() - tx * size] = part["v"].to_numpy()
        own = Geotransform(g.x0 + tx * size * g.dx, g.dx, 0.0, g.y0 + ty * size * g.dy, 0.0, g.dy, w, h, nodata)
        return pa.table({"tile_x": [tx], "tile_y": [ty], "content": [encode(values, own)]}, schema=pa.schema([("tile_x", pa.int32()), ("tile_y", pa.int32()), ("content", pa.binary())]))

    rows = raster.select("x", "y", F.col(value).alias("v"), F.floor(F.col("x") / size).cast("int").alias("tile_x"), F.floor(F.col("y") / size).cast("int").alias("tile_y"))
    return rows.groupBy("tile_x", "tile_y").applyInArrow(draw, "tile_x int, tile_y int, content binary")
