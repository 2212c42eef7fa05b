from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hydrospark.functions.cells import Geotransform
from hydrospark.sources import byte_ranges, geojson, geotiff, shapefile


def test_geotiff_round_trip(spark, tmp_path):
    g = Geotransform(10.0, 0.5, 0.0, 20.0, 0.0, -0.5, 70, 130, -99.0)
    r = np.random.default_rng(1)
    for kind in ("i2", "f4", "u1"):
        own = Geotransform(g.x0, g.dx, 0.0, g.y0, 0.0, g.dy, g.width, g.height, 7.0 if kind == "u1" else -99.0)
        values = r.integers(0, 200, (130, 70)).astype(kind)
        values[r.random((130, 70)) < 0.2] = own.nodata
        path = tmp_path / f"{kind}.tif"
        path.write_bytes(geotiff.encode(values, own))
        got = {(c.x, c.y): c.v for c in geotiff.read(spark, f"file://{path}").collect()}
        assert got == {(x, y): float(values[y, x]) for y in range(130) for x in range(70) if values[y, x] != own.nodata}
        m = geotiff.metadata(spark, f"file://{path}").first()
        assert (m.x0, m.dx, m.y0, m.dy, m.width, m.height, m.nodata, m.dtype) == (10.0, 0.5, 20.0, -0.5, 70, 130, own.nodata, kind)


def test_tiles_as_files(spark, tmp_path):
    g = Geotransform(0.0, 1.0, 0.0, 0.0, 0.0, -1.0, 20, 10, -1.0)
    raster = spark.createDataFrame([(x, y, float(x * y)) for x in range(20) for y in range(10) if (x + y) % 3], "x int, y int, v double")
    for t in geotiff.tile_files(raster, g, 8).collect():
        (tmp_path / f"{t.tile_x}_{t.tile_y}.tif").write_bytes(t.content)
    cells = geotiff.read(spark, f"file://{tmp_path}/*.tif")
    name = F.split(F.regexp_extract("file", r"(\d+_\d+)\.tif", 1), "_")
    whole = cells.select((F.col("x") + name[0].cast("int") * 8).alias("x"), (F.col("y") + name[1].cast("int") * 8).alias("y"), "v")
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in raster.collect()}


def test_shapefile_round_trip(spark, tmp_path):
    outer = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]  # clockwise
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    far = [(9.0, 9.0), (9.0, 10.0), (10.0, 10.0), (9.0, 9.0)]
    files = shapefile.encode([[outer, hole, far], [far]], [{"Lake_area": "12.5", "name": "é"}, {"Lake_area": "", "name": "b"}])
    for kind, data in zip(("shp", "shx", "dbf"), files, strict=True):
        (tmp_path / f"lakes.{kind}").write_bytes(data)
    rows = shapefile.read(spark, f"file://{tmp_path}").orderBy("fid")
    got = rows.collect()
    assert [[[tuple(p) for p in r] for r in g.rings] for g in got] == [[outer, hole, far], [far]]
    assert [g.properties for g in got] == [{"Lake_area": "12.5", "name": "é"}, {"Lake_area": "", "name": "b"}]
    docs = shapefile.to_geojson(rows)
    back = docs.select("fid", geojson.polygons(F.col("doc")).alias("p"), geojson.properties(F.col("doc")).alias("m")).orderBy("fid").collect()
    assert [[len(p) for p in b.p] for b in back] == [[2, 1], [1]] and back[0].m["name"] == "é"


@pytest.mark.parametrize("kind,nodata", [("f4", -3.4028234663852886e38), ("f8", -1.7976931348623157e308), ("f4", 0.1), ("f4", float("nan")), ("i4", -2147483648.0), ("u1", -9999.0)])
def test_nodata_is_kept_to_the_last_digit(spark, tmp_path, kind, nodata):
    g = Geotransform(0.0, 1.0, 0.0, 0.0, 0.0, -1.0, 4, 4, nodata)
    values = np.full((4, 4), 5 if kind == "u1" else nodata, dtype=kind)
    values[1, 2] = 7
    (tmp_path / "a.tif").write_bytes(geotiff.encode(values, g))
    got = [(r.x, r.y, r.v) for r in geotiff.read(spark, f"file://{tmp_path}/a.tif").collect()]
    assert len(got) == 16 if kind == "u1" else got == [(2, 1, 7.0)]


def lzw_packed(data: bytes) -> bytes:
    """A plain LZW writer as TIFF wants it."""
    codes, table, word = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
    width = lambda more=0: 9 if len(table) + 2 + more < 512 else 10 if len(table) + 2 + more < 1024 else 11 if len(table) + 2 + more < 2048 else 12
    for k in range(len(data)):
        b = data[k : k + 1]
        if word + b in table:
            word += b
            continue
        codes.append((table[word], width()))
        table[word + b] = len(table) + 2
        word = b
        if len(table) + 2 == 4094:
            codes += [(table[word], 12), (256, 12)]
            table, word = {bytes([k]): k for k in range(256)}, b""
    codes += ([(table[word], width())] if word else []) + [(257, width(1))]
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def tiff(values: np.ndarray, rows: int, packed: int, predictor: int, big: bool = False, order: str = "<") -> bytes:
    """A file of strips, written field by field."""
    kind, strips = values.dtype, []
    for at in range(0, len(values), rows):
        part = values[at : at + rows]
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=part[:, :1] * 0).astype(kind)
        raw = part.astype(kind.newbyteorder(order)).tobytes()
        if predictor == 3:
            planes = part.astype(kind.newbyteorder(">")).view("u1").reshape(len(part), -1, kind.itemsize).transpose(0, 2, 1).reshape(len(part), -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), "u1")).astype("u1").tobytes()
        strips.append(raw if packed == 1 else lzw_packed(raw) if packed == 5 else zlib.compress(raw))
    o, head = order, 16 if big else 8
    offsets = [head + sum(map(len, strips[:k])) for k in range(len(strips))]
    fields = [(256, [values.shape[1]]), (257, [len(values)]), (258, [kind.itemsize * 8]), (259, [packed]), (273, offsets), (278, [rows]), (279, list(map(len, strips))), (317, [predictor]), (339, [{"u": 1, "i": 2, "f": 3}[kind.kind]])]
    at = head + sum(map(len, strips))
    entry, extra = b"", b""
    after = at + (8 + 20 * len(fields) + 8 if big else 2 + 12 * len(fields) + 4)
    for tag, value in fields:
        raw = struct.pack(f"{o}{len(value)}{'Q' if big else 'I'}", *value)
        entry += struct.pack(f"{o}HH{'Q' if big else 'I'}", tag, 16 if big else 4, len(value))
        if len(raw) > (8 if big else 4):
            entry += struct.pack(o + ("Q" if big else "I"), after + len(extra))
            extra += raw
        else:
            entry += raw.ljust(8 if big else 4, b"\0")
    start = struct.pack(f"{o}2sHHHQ", b"II" if o == "<" else b"MM", 43, 8, 0, at) if big else struct.pack(f"{o}2sHI", b"II" if o == "<" else b"MM", 42, at)
    return start + b"".join(strips) + struct.pack(o + ("Q" if big else "H"), len(fields)) + entry + struct.pack(o + ("Q" if big else "I"), 0) + extra


@pytest.mark.parametrize("kind,packed,predictor,big,order", [("f4", 5, 3, False, "<"), ("f8", 8, 3, True, ">"), ("i2", 5, 2, False, ">"), ("u1", 5, 1, True, "<"), ("f4", 1, 1, False, ">"), ("f4", 8, 3, False, "<")])
def test_packings_and_predictors_in_several_tasks(spark, tmp_path, kind, packed, predictor, big, order):
    values = (np.random.default_rng(3).random((90, 61)) * 200).astype(kind)
    values[:40] = values[0]  # repeats for LZW
    (tmp_path / "a.tif").write_bytes(tiff(values, 7, packed, predictor, big, order))
    read = geotiff.read(spark, f"file://{tmp_path}/*.tif", run_bytes=2000)
    assert read.rdd.getNumPartitions() > 1
    assert {(r.x, r.y): r.v for r in read.collect()} == {(x, y): float(values[y, x]) for y in range(90) for x in range(61)}


def test_a_file_of_over_two_gigabytes(spark, tmp_path):
    """A sparse BigTIFF of 1-row strips, the last of them beyond 2 GB; most strips were never written."""
    far, n, width = 5 << 29, 400, 10
    spans = {0: 16, n - 1: far}
    with open(tmp_path / "big.tif", "wb") as f:
        f.truncate(far + 100_000)
        for row, at in spans.items():
            f.seek(at)
            f.write(np.arange(width, dtype="<f4").tobytes() if row else np.full(width, 3, dtype="<f4").tobytes())
        head = far + 1000
        lists = {273: [spans.get(k, 0) for k in range(n)], 279: [4 * width if k in spans else 0 for k in range(n)]}
        fields = [(256, [width]), (257, [n]), (258, [32]), (259, [1]), (273, lists[273]), (278, [1]), (279, lists[279]), (339, [3])]
        entry, at = b"", head + 8 + 20 * len(fields) + 8
        for tag, value in fields:
            entry += struct.pack("<HHQQ", tag, 16, len(value), value[0] if len(value) == 1 else at)
            if len(value) > 1:
                f.seek(at)
                f.write(struct.pack(f"<{n}Q", *value))
                at += 8 * n
        f.seek(head)
        f.write(struct.pack("<Q", len(fields)) + entry + struct.pack("<Q", 0))
        f.seek(0)
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, head))
    got = {(r.x, r.y): r.v for r in geotiff.read(spark, f"file://{tmp_path}/big.tif").collect()}
    assert got == {(x, 0): 3.0 for x in range(width)} | {(x, n - 1): float(x) for x in range(width)}
    assert geotiff.metadata(spark, f"file://{tmp_path}/big.tif").first().height == n


def test_attributes_keep_apart_and_whole(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [{"longest_path_a": "1", "longest_path_b": "2", "größe_in_metern": "ü" * 127, "empty": ""}, {"longest_path_a": "3", "longest_path_b": None, "größe_in_metern": "", "empty": ""}]
    for k in range(2):
        for kind, data in zip(("shp", "shx", "dbf"), shapefile.encode([[ring]] * 2, rows), strict=True):
            (tmp_path / f"s{k}.{kind}").write_bytes(data)
    (tmp_path / "s1.shx").unlink()  # found by reading the shapes in order
    for run in (1, 1 << 20):
        got = shapefile.read(spark, f"file://{tmp_path}", run_bytes=run).orderBy("file", "fid").collect()
        assert [r.fid for r in got] == [0, 1, 0, 1]
        for r in got:
            assert r.properties == dict(zip(("longest_pa", "longest__1", "größe_in", "empty"), (v or "" for v in rows[r.fid].values()), strict=True))
    with pytest.raises(ValueError, match="'a' has a value of 255 bytes"):
        shapefile.encode([[ring]], [{"a": "x" * 255}])
    assert shapefile.short_names(["abcdefghijk", "ABCDEFGHIJx", "abcdefghijz"], "utf-8") == {"abcdefghijk": b"abcdefghij", "ABCDEFGHIJx": b"ABCDEFGH_1", "abcdefghijz": b"abcdefgh_2"}


def test_files_are_written_by_tasks_and_appear_together(spark, tmp_path):
    rows = spark.range(20).repartition(4).select(F.concat(F.lit("f"), F.col("id"), F.lit(".txt")).alias("name"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("content"))
    assert byte_ranges.write_files(rows, f"file://{tmp_path}/out") == 20
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"f{k}.txt": "é" * k for k in range(20)}
    bad = rows.withColumn("content", F.when(F.col("name") == "f7.txt", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(PySparkException):
        byte_ranges.write_files(bad, f"file://{tmp_path}/none")
    assert [p for p in (tmp_path / "none").rglob("*") if p.is_file()] == []
    with pytest.raises(ValueError, match="can't write"):
        byte_ranges.write_files(rows, "viewfs://store/x")
