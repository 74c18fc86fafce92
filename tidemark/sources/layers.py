"""Map layers and road graphs from GeoJSON and GraphML files, and GeoJSON back out of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def wkt_points(wkt: Column) -> Column:
    """The points of a POINT or LINESTRING text."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.eE+-]+\s+-?[0-9.eE+-]+)"), F.lit(1))
    part = lambda p, i: F.split(p, r"\s+")[i].cast("double")
    return F.transform(pairs, lambda p: F.struct(part(p, 0).alias("x"), part(p, 1).alias("y")))


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a GraphML file: a, b and a map of their attributes by key id. The XML reader splits large files by
    the row tag."""
    schema = "_source string, _target string, data array<struct<_key:string,_VALUE:string>>"
    x = spark.read.format("xml").option("rowTag", "edge").schema(schema).load(path)
    return x.select(F.col("_source").alias("a"), F.col("_target").alias("b"), F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("attributes"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON collection: kind of geometry, coordinates as JSON text, properties as a map of strings."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return x.select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def geojson_features(df: DataFrame, geometry: str, properties: list[str], digits: int = 7) -> DataFrame:
    """A line of GeoJSON per row: points (a struct x, y list) as a LineString, or a Point if there is one; NaN
    properties become 0. One line per feature, so that any number of rows can be written in parallel."""
    r = lambda v: F.round(v, digits)
    pts = F.transform(geometry, lambda p: F.array(r(p["x"]), r(p["y"])))
    types = dict(df.dtypes)
    own = F.struct(*[(F.nanvl(F.col(c), F.lit(0.0)) if types[c] in ("double", "float") else F.col(c)).alias(c) for c in properties])
    line = F.when(F.size(geometry) == 1, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), pts[0].alias("coordinates")).alias("geometry"), own.alias("properties"))))
    return df.select(line.otherwise(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), pts.alias("coordinates")).alias("geometry"), own.alias("properties")))).alias("value"))
