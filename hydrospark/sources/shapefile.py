"""Polygon shapefiles: read to rings and attributes, and written from them.

A file of any size is read by runs of records, which the ``.shx`` file locates
in the ``.shp`` file; attributes have a fixed size, so a task reads those of
its own records.  Small files are read whole, many by one task.  From a store
that only Spark can open, every file is read whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hydrospark.sources.byte_ranges import list_sizes, open_store, reader_at

POLYGON = 5
#: Bytes of shapes in a task's run of records, about.
RUN_BYTES = 32 << 20
#: Files that one task reads at most, if they are small.
RUN_FILES = 256
#: Greatest width of an attribute, in bytes, and of its name.
WIDEST, NAME_BYTES = 254, 10
ROWS = "file string, fid long, rings array<array<struct<x:double,y:double>>>, properties map<string,string>"
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ROW_TYPES = [pa.string(), pa.int64(), pa.list_(pa.list_(POINT)), pa.map_(pa.string(), pa.string())]


def shape(data: bytes, body: int) -> list[list[tuple[float, float]]]:
    """The rings of the shape that begins at ``body``; a null shape has none."""
    if struct.unpack_from("<i", data, body)[0] % 10 != POLYGON:
        return []
    parts, points = struct.unpack_from("<ii", data, body + 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", data, body + 44 + 4 * parts)
    xy = list(zip(flat[::2], flat[1::2], strict=True))
    return [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def records(data: bytes, at: int = 100) -> list[tuple[int, int]]:
    """Start and bytes of the shapes of a ``.shp`` file, in order."""
    out = []
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at + 4)[0] * 2
        out.append((at + 8, size))
        at += 8 + size
    return out


def fields(head: bytes, encoding: str) -> tuple[int, int, int, list[tuple[str, int]]]:
    """Records, bytes of the header and of a record, and name and width of each attribute of a ``.dbf`` file."""
    count, header, size = struct.unpack_from("<IHH", head, 4)
    found, at = [], 32
    while at < header - 1 and head[at] != 0x0D:
        found.append((head[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), head[at + 16]))
        at += 32
    return count, header, size, found


def attributes(data: bytes, size: int, named: list[tuple[str, int]], encoding: str = "utf-8") -> list[dict[str, str]]:
    """Records of a ``.dbf`` file as texts; deleted ones keep their place as empty."""
    out = []
    for k in range(len(data) // size):
        row, own, pos = data[k * size : (k + 1) * size], {}, 1
        for name, width in named:
            own[name] = row[pos : pos + width].decode(encoding, "replace").strip()
            pos += width
        out.append({} if row[:1] == b"*" else own)
    return out


def batch(stem: str, first: int, shapes: list, rows: list[dict] | None) -> pa.RecordBatch:
    """Rows of the records from ``first`` on; records without a shape have none."""
    kept = [k for k, s in enumerate(shapes) if s]
    columns = [
        [stem] * len(kept),
        [first + k for k in kept],
        [[[{"x": x, "y": y} for x, y in r] for r in shapes[k]] for k in kept],
        [list(rows[k].items()) if rows is not None and k < len(rows) else None for k in kept],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW_TYPES, strict=True)], ["file", "fid", "rings", "properties"])


@dataclass
class Records(InputPartition):
    """Records of one file from ``first`` on; ``spans`` are the byte ranges of their shapes, ``table`` is the ``.dbf`` file."""

    stem: str
    shapes: str
    table: str | None
    first: int
    spans: list[tuple[int, int]]

    def __post_init__(self):
        super().__init__(self.first)


@dataclass
class Files(InputPartition):
    """Whole files that one task reads: for each its name without extension, and its ``.shp``, ``.shx`` and ``.dbf`` file."""

    files: list[tuple[str, str, str | None, str | None]]

    def __post_init__(self):
        super().__init__(len(self.files))


def spans_of(store, name: str, index: str | None) -> list[tuple[int, int]]:
    """The byte ranges of a file's shapes, from the ``.shx`` file if there is one."""
    with store.open_input_file(index or name) as f:
        raw = f.read()
    if index is None:
        return records(raw)
    raw = raw[100:]
    return [(at * 2 + 8, size * 2) for at, size in struct.iter_unpack(">2i", raw[: len(raw) // 8 * 8])]


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, encoding: str, run_bytes: int):
        self.path, self.encoding, self.run_bytes = path, encoding, run_bytes

    def partitions(self) -> list[Records | Files]:
        """Runs of records of large files, which the driver opens the index of, and runs of small files, which it opens none of."""
        store, _ = open_store(self.path)
        sizes = list_sizes(self.path)
        files = {f.lower(): f for f in sorted(sizes)}
        least = self.run_bytes / RUN_FILES
        out, run, held = [], [], 0.0
        for low in sorted(f for f in files if f.endswith(".shp")):
            name, index, table = files[low], files.get(low[:-3] + "shx"), files.get(low[:-3] + "dbf")
            size = max(sizes[name], least)
            if size <= self.run_bytes:
                if run and held + size > self.run_bytes:
                    out.append(Files(run))
                    run, held = [], 0.0
                run.append((name[:-4], name, index, table))
                held += size
                continue
            spans = spans_of(store, name, index)
            ends = list(accumulate(n for _, n in spans))
            first = 0
            for k in range(len(spans)):
                if k + 1 == len(spans) or ends[k + 1] - (ends[first - 1] if first else 0) > self.run_bytes:
                    out.append(Records(name[:-4], name, table, first, spans[first : k + 1]))
                    first = k + 1
        return [*out, *([Files(run)] if run else [])]

    def read(self, partition: Records | Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        if isinstance(partition, Records):
            yield from self._run(store, partition)
            return
        held: list[pa.RecordBatch] = []
        for stem, name, index, table in partition.files:
            held += self._run(store, Records(stem, name, table, 0, spans_of(store, name, index)))
            if sum(b.num_rows for b in held) >= 1024:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _run(self, store, partition: Records) -> Iterator[pa.RecordBatch]:
        rows = None
        if partition.table:
            with store.open_input_file(partition.table) as f:
                at = reader_at(f)
                count, header, size, named = fields(at(0, struct.unpack("<H", at(8, 2))[0]), self.encoding)
                n = min(len(partition.spans), max(0, count - partition.first))
                rows = attributes(at(header + partition.first * size, n * size), size, named, self.encoding)
        with store.open_input_file(partition.shapes) as f:
            at = reader_at(f)
            for k in range(0, len(partition.spans), 256):
                shapes = [shape(at(start, size), 0) for start, size in partition.spans[k : k + 256]]
                yield batch(partition.stem, partition.first + k, shapes, None if rows is None else rows[k : k + 256])


class Shapefile(DataSource):
    """``spark.read.format("shapefile").load(folder)``: a partition for each run of records of a large file, or of small files."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options["path"], self.options.get("encoding", "utf-8"), int(self.options.get("runBytes", RUN_BYTES)))


def read(spark: SparkSession, path: str, encoding: str = "utf-8", run_bytes: int = RUN_BYTES) -> DataFrame:
    """``file, fid, rings, properties`` of all shapefiles of a folder; records without a shape are left out.

    Names and values of attributes are in ``encoding``.  A file without a
    ``.dbf`` file has null properties.
    """
    if open_store(path) is not None:
        spark.dataSource.register(Shapefile)
        return spark.read.format("shapefile").option("encoding", encoding).option("runBytes", run_bytes).load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, data in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                stem, _, kind = name.rpartition(".")
                if kind.lower() == "shp":
                    shapes = [shape(data, at) for at, _ in records(data)]
                    columns = [[stem] * len(shapes), list(range(len(shapes))), [[[{"x": x, "y": y} for x, y in r] for r in s] or None for s in shapes], [None] * len(shapes)]
                elif kind.lower() == "dbf":
                    _, header, size, named = fields(data, encoding)
                    rows = [list(a.items()) for a in attributes(data[header:].rstrip(b"\x1a"), size, named, encoding)]
                    columns = [[stem] * len(rows), list(range(len(rows))), [None] * len(rows), rows]
                else:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW_TYPES, strict=True)], ["file", "fid", "rings", "properties"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path).select("path", "content").mapInArrow(decode, ROWS)
    return found.groupBy("file", "fid").agg(F.first("rings", ignorenulls=True).alias("rings"), F.first("properties", ignorenulls=True).alias("properties")).where("rings is not null")


def short_names(names: list[str], encoding: str) -> dict[str, bytes]:
    """A name of at most 10 bytes for each attribute; those that would be cut to the same get a number."""
    out: dict[str, bytes] = {}
    used: set[bytes] = set()
    for name in names:
        n, end = 0, b""
        while True:
            cut = name
            while len(cut.encode(encoding)) + len(end) > NAME_BYTES:
                cut = cut[:-1]
            short = cut.encode(encoding) + end
            if short.upper() not in used:
                break
            n += 1
            end = f"_{n}".encode(encoding)
        used.add(short.upper())
        out[name] = short
    return out


def encode(shapes: list[list[list[tuple[float, float]]]], rows: list[dict[str, str]], encoding: str = "utf-8") -> tuple[bytes, bytes, bytes]:
    """``.shp``, ``.shx`` and ``.dbf`` files of polygons with text attributes.

    Attribute names are cut to 10 bytes and kept apart by a number.  A value
    of over 254 bytes is an error, as the format can't hold it.
    """
    box = lambda ps: (min(x for x, _ in ps), min(y for _, y in ps), max(x for x, _ in ps), max(y for _, y in ps))
    every = box([p for s in shapes for r in s for p in r] or [(0.0, 0.0)])
    bodies, index, at = [], [], 50
    for k, own in enumerate(shapes):
        flat = [v for r in own for p in r for v in p]
        starts = [0, *accumulate(map(len, own))][:-1] if own else []
        head = struct.pack("<i4d2i", POLYGON, *box([p for r in own for p in r]), len(own), len(flat) // 2) if own else struct.pack("<i", 0)
        record = head + struct.pack(f"<{len(starts)}i{len(flat)}d", *starts, *flat)
        bodies.append(struct.pack(">2i", k + 1, len(record) // 2) + record)
        index.append(struct.pack(">2i", at, len(record) // 2))
        at += 4 + len(record) // 2
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", 1000, POLYGON, *every, 0, 0, 0, 0)
    names = list(dict.fromkeys(n for r in rows for n in r))
    short = short_names(names, encoding)
    values = [{n: (r.get(n) or "").encode(encoding) for n in names} for r in rows]
    widths = {n: max(1, *(len(v[n]) for v in values)) for n in names}
    for n, width in widths.items():
        if width > WIDEST:
            raise ValueError(f"attribute {n!r} has a value of {width} bytes; a shapefile holds {WIDEST} at most")
    table = [struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(names), 1 + sum(widths.values()))]
    table += [struct.pack("<11sc4xBB14x", short[n], b"C", widths[n], 0) for n in names] + [b"\r"]
    table += [b" " + b"".join(v[n].ljust(widths[n]) for n in names) for v in values] + [b"\x1a"]
    return head(at) + b"".join(bodies), head(50 + 4 * len(index)) + b"".join(index), b"".join(table)


def files(features: DataFrame) -> DataFrame:
    """``name, content``: the three files of each shapefile, from ``file, fid, rings, properties``; records go by ``fid``.

    A shapefile is written by one task, as its format asks for record offsets.
    """

    def draw(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        rows = sorted(part.select(["fid", "rings", "properties"]).to_pylist(), key=lambda r: r["fid"])
        shapes = [[[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in rows]
        made = encode(shapes, [dict(r["properties"] or ()) for r in rows])
        names = [f"{key[0].as_py()}.{kind}" for kind in ("shp", "shx", "dbf")]
        return pa.table({"name": names, "content": list(made)}, schema=pa.schema([("name", pa.string()), ("content", pa.binary())]))

    return features.select("file", "fid", "rings", "properties").groupBy("file").applyInArrow(draw, "name string, content binary")


def to_geojson(features: DataFrame) -> DataFrame:
    """``file, fid, doc``: each polygon feature as a GeoJSON text; a ring that runs clockwise where y points up begins a polygon, the others are its holes."""
    from hydrospark.operators.vector import is_clockwise
    from hydrospark.sources.geojson import feature_text

    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    grouped = F.aggregate(
        "rings",
        F.expr("cast(array() as array<array<array<array<double>>>>)"),
        lambda s, r: F.when((is_clockwise(r) == 1) | (F.size(s) == 0), F.concat(s, F.array(F.array(ring(r))))).otherwise(
            F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.concat(F.element_at(s, -1), F.array(ring(r)))))
        ),
    )
    text = F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(grouped), F.lit("}"))
    return features.select("file", "fid", feature_text(text, F.coalesce("properties", F.expr("cast(map() as map<string,string>)"))).alias("doc"))
