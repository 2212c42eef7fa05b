"""GeoJSON documents as text columns: reading rings, merging, updating and splitting features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRS84 = '{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}}'


def read_folder(spark: SparkSession, path: str, pattern: str = "*.*json") -> DataFrame:
    """``name, doc``: every file of a folder; the name is the file's without folder and extension."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(F.url_decode(name).alias("name"), F.col("value").alias("doc"))


def features(doc: Column) -> Column:
    """The features of a document as JSON texts; a lone Feature counts as one."""
    many = F.from_json(F.get_json_object(doc, "$.features"), "array<string>")
    return F.coalesce(many, F.array(doc))


def first_feature(doc: Column) -> Column:
    return F.get(features(doc), 0)


def polygons(feature: Column) -> Column:
    """Coordinates of a Polygon or MultiPolygon feature as ``array<array<ring>>``; null for other kinds."""
    kind = F.get_json_object(feature, "$.geometry.type")
    text = F.get_json_object(feature, "$.geometry.coordinates")
    one = F.array(F.from_json(text, "array<array<array<double>>>"))
    many = F.from_json(text, "array<array<array<array<double>>>>")
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return F.transform(rings, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y")))))


def coordinates_text(polygons_: Column) -> Column:
    """``polygons`` back as JSON coordinates."""
    return F.to_json(F.transform(polygons_, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.array(c["x"], c["y"])))))


def properties(feature: Column) -> Column:
    """Properties as ``map<string, string>``; nested values stay JSON."""
    return F.coalesce(F.from_json(F.get_json_object(feature, "$.properties"), "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def updated(old: Column, new: Column) -> Column:
    """Properties with keys overwritten or added."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def feature_text(geometry: Column, props: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(props), F.lit(',"geometry":'), geometry, F.lit("}"))


def merge(docs: DataFrame, order: str = "name") -> DataFrame:
    """One FeatureCollection (``doc``) of the first feature of each document, in order of name."""
    rows = docs.select(F.struct(order, first_feature(F.col("doc")).alias("f")).alias("s"))
    listed = rows.agg(F.sort_array(F.collect_list("s")).alias("a"))
    body = F.array_join(F.transform("a", lambda s: s["f"]), ",")
    return listed.select(F.concat(F.lit(f'{{"type":"FeatureCollection","crs":{CRS84},"features":['), body, F.lit("]}")).alias("doc"))


def collections(features_: DataFrame) -> DataFrame:
    """``name, content``: a FeatureCollection for each ``file``, of its features ``doc`` in order of ``fid``, as a file of that name."""
    listed = features_.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("fid", "doc"))).alias("a"))
    body = F.array_join(F.transform("a", lambda s: s["doc"]), ",")
    return listed.select(F.concat("file", F.lit(".geojson")).alias("name"), F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("content"))


def update_properties(docs: DataFrame, new: Column) -> DataFrame:
    """``name, doc`` with the first feature's properties updated."""
    f = first_feature(F.col("doc"))
    made = feature_text(F.get_json_object(f, "$.geometry"), updated(properties(f), new))
    return docs.select("name", F.concat(F.lit('{"type":"FeatureCollection","features":['), made, F.lit("]}")).alias("doc"))


def split_by(features_: DataFrame, key: str = "dn") -> DataFrame:
    """``key, kind, polygons``: Polygons of one key together, as a MultiPolygon if there are several.

    ``features_`` has the key and ``kind, polygons``; other kinds than Polygon
    are ignored.
    """
    rows = features_.where("kind = 'Polygon'").select(key, F.posexplode("polygons").alias("k", "p"))
    found = rows.groupBy(key).agg(F.sort_array(F.collect_list("p")).alias("polygons"))
    return found.select(key, F.when(F.size("polygons") > 1, "MultiPolygon").otherwise("Polygon").alias("kind"), "polygons")
