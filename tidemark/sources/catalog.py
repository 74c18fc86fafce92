"""Sources of map elements, scenes, hubs, chips, manifests and caches as tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import shapes, tags
from tidemark.functions.expr import utm_project
from tidemark.session import shared_dir

#: Fixed value: no map data after this day may be used.
SNAPSHOT = "2026-07-27"
ELEMENT = "type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>"


def elements(documents: DataFrame, column: str = "json") -> DataFrame:
    """The elements of map extracts (JSON texts with a list `elements`), a row each."""
    return documents.select(F.explode(F.from_json(column, f"elements array<struct<{ELEMENT.replace(' ', ':')}>>".replace(",:", ",").replace("elements:", "elements ")).getField("elements")).alias("e")).select("e.*")


def map_layers(items: DataFrame, project=utm_project) -> dict[str, DataFrame]:
    """Roads, bridges, buildings and facilities from map elements (type, id, lat, lon, nodes, tags). Ways get the points
    of the nodes that are known, in their order, and need two; closed ways of four points are rings. A way is a road by
    its highway tag, else a building, else a place of care; a road with a bridge tag is a bridge as well."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    x, y = project(F.col("lon"), F.col("lat"))
    nodes = items.where("type = 'node'").groupBy("id").agg(F.max_by(F.struct(x.alias("x"), y.alias("y")), "lat").alias("p"))
    refs = items.where("type = 'way'").select("id", F.posexplode("nodes").alias("place", "node"))
    found = refs.join(nodes.select(F.col("id").alias("node"), "p"), "node")
    lines = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "p"))).alias("s")).select("id", F.transform("s", lambda s: s["p"]).alias("points")).where(F.size("points") >= 2)
    ways = items.where("type = 'way'").select("id", "tags").join(lines, "id").withColumn("closed", (F.size("points") >= 4) & (F.element_at("points", 1) == F.element_at("points", -1)))
    given = lambda k: F.coalesce(tag(k), F.lit("")) != ""
    care = F.coalesce(tag("amenity").isin(tags.FACILITIES), F.lit(False)) | given("healthcare")
    road, built = given("highway"), given("building")

    def envelope(grow: float) -> Column:
        end = lambda f, k: f(F.transform("points", lambda p: p[k]))
        x1, x2, y1, y2 = end(F.array_min, "x") - grow, end(F.array_max, "x") + grow, end(F.array_min, "y") - grow, end(F.array_max, "y") + grow
        box = F.array(shapes.point(x1, y1), shapes.point(x2, y1), shapes.point(x2, y2), shapes.point(x1, y2))
        return F.when(F.col("closed"), F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(box)

    name = lambda d: F.coalesce(tag("name"), F.lit(d)).alias("name")
    roads = ways.where(road).select("id", tag("highway").alias("highway"), F.coalesce(F.nullif(tag("bridge"), F.lit("")), F.lit("no")).alias("bridge"), name("Unnamed Road"), F.coalesce(tag("surface"), F.lit("unknown")).alias("surface"), "points")
    bridges = ways.where(road & given("bridge") & (tag("bridge") != "no")).select("id", name("Bridge"), "points")
    buildings = ways.where(~road & built).select("id", tag("building").alias("building"), tag("name").alias("name"), envelope(5.0).alias("ring"))
    kind = F.coalesce(F.nullif(tag("amenity"), F.lit("")), F.lit("clinic")).alias("amenity")
    around = F.array(*[shapes.point(F.col("p.x") + dx, F.col("p.y") + dy) for dx, dy in ((-15, -10), (15, -10), (15, 10), (-15, 10))])
    points = items.where("type = 'node'").where(care).select("id", "tags").join(nodes, "id").select("id", name("Medical Facility"), kind, around.alias("ring"))
    return {"roads": roads, "bridges": bridges, "buildings": buildings, "facilities": points.unionByName(ways.where(~road & ~built & care).select("id", name("Medical Facility"), kind, envelope(10.0).alias("ring")))}


def scenes(features: DataFrame, column: str = "json") -> DataFrame:
    """id, ts, relative_orbit, orbit_state, polarization of scene features (JSON texts); those without a time, an orbit
    or a direction are left out."""
    schema = "id string, properties struct<datetime:string,start_datetime:string,`sat:relative_orbit`:int,`sat:orbit_state`:string>, assets map<string,struct<href:string>>"
    f = features.select(F.from_json(column, schema).alias("f")).select("f.*")
    p = lambda k: F.col("properties").getField(k)
    keys = F.upper(F.array_join(F.array_sort(F.filter(F.map_keys("assets"), lambda k: F.lower(k).isin("vv", "vh", "hh", "hv"))), "+"))
    x = f.select("id", F.coalesce(F.nullif(p("datetime"), F.lit("")), p("start_datetime")).try_cast("timestamp").alias("ts"), p("sat:relative_orbit").alias("relative_orbit"), F.lower(p("sat:orbit_state")).alias("orbit_state"), F.coalesce(F.nullif(keys, F.lit("")), F.lit("UNKNOWN")).alias("polarization"))
    return x.where("ts IS NOT NULL AND relative_orbit IS NOT NULL AND orbit_state IN ('ascending', 'descending')")


def chip_pairs(files: DataFrame) -> DataFrame:
    """chip, image and label paths of files (path) named NAME_S1Hand.* and NAME_LabelHand.*; unmatched ones are left out."""
    name = lambda kind: F.regexp_extract("path", f"([^/]*)_{kind}[^/]*$", 1)
    one = lambda kind, out: files.withColumn("chip", name(kind)).where("chip <> ''").groupBy("chip").agg(F.min("path").alias(out))
    return one("S1Hand", "image").join(one("LabelHand", "label"), "chip")


def hubs(spark: SparkSession, path: str) -> DataFrame:
    """name, lon, lat of hubs in a JSON file: a feature collection, or a list of objects or of [lon, lat, name]."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    feature = "features array<struct<geometry:struct<coordinates:array<double>>,properties:map<string,string>>>"
    a = raw.where(F.col("t").startswith("{")).select(F.explode(F.from_json("t", feature)["features"]).alias("f")).select(F.col("f.properties").alias("m"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))
    listed = raw.where(F.col("t").startswith("[")).select(F.explode(F.from_json("t", "array<string>")).alias("e"))
    b = listed.where(F.trim("e").startswith("{")).select(F.from_json("e", "map<string,string>").alias("m"))
    number = lambda *k: F.coalesce(*[F.try_element_at("m", F.lit(x)).try_cast("double") for x in k])
    b = b.select("m", number("lon", "x", "longitude").alias("lon"), number("lat", "y", "latitude").alias("lat"))
    c = listed.where(F.trim("e").startswith("[")).select(F.from_json("e", "array<string>").alias("e")).select(F.create_map(F.lit("name"), F.get("e", F.lit(2))).alias("m"), F.get("e", F.lit(0)).try_cast("double").alias("lon"), F.get("e", F.lit(1)).try_cast("double").alias("lat"))
    name = F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in ("name", "name:en", "amenity", "type")], F.lit("Hub"))
    return a.unionByName(b).unionByName(c).where("lon IS NOT NULL AND lat IS NOT NULL").select(name.alias("name"), "lon", "lat")


def clipped(layer: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose points meet the box; all rows where none does."""
    end = lambda f, k: f(F.transform("points", lambda p: p[k]))
    inside = layer.where((end(F.array_min, "x") <= east) & (end(F.array_max, "x") >= west) & (end(F.array_min, "y") <= north) & (end(F.array_max, "y") >= south))
    return layer if inside.isEmpty() else inside


def allowed(layer: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of the snapshot day or before."""
    return layer.where(F.to_date(ts) <= F.lit(SNAPSHOT).cast("date"))


def cached(spark: SparkSession, key: list[str], make, names: list[str]) -> dict[str, DataFrame]:
    """Tables by name from the cache folder of the key; unless all are there, `make()` gives them and they are kept."""
    folder = f"{shared_dir(spark)}/cache-{hashlib.md5('|'.join(key).encode()).hexdigest()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    if not all(map(done, names)):
        for n, df in make().items():
            df.write.mode("overwrite").parquet(f"{folder}/{n}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A rescue manifest from CSV files with a header."""
    return spark.read.csv(path, header=True, schema="Rank int, Cluster_ID string, Priority_Tier string, Priority_Score double, Estimated_Population long, Trapped_Nodes int, Dist_to_Hub_km double, Nearest_Hub string, Centroid_Lat double, Centroid_Lon double, Recommended_Action string")
