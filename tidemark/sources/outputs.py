"""Sinks: GeoJSON collections, the rescue manifest, fact stores, run manifests with hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import rounded
from tidemark.operators.ranking import MANIFEST


def written_features(lines: DataFrame, path: str) -> None:
    """A GeoJSON collection as a folder of part files: each line is a feature, so any number is written in parallel."""
    lines.select("value").write.mode("overwrite").text(path)


def collection(lines: DataFrame) -> DataFrame:
    """One row with the features (value) as one collection, in the order of their texts. For layers of a report, not
    for whole networks: those are written as lines."""
    return lines.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]}")).alias("json"))


def place(ring: Column, centroid: Column, center: Column, lon_lat: Column) -> Column:
    """The geometry of a cluster as JSON: its ring, else the first of three places that is there, else 0, 0."""
    xy = lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6))
    have = lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), p)
    nowhere = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    dot = F.coalesce(have(centroid), have(center), have(lon_lat), nowhere)
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(F.concat(ring, F.slice(ring, 1, 1)), xy)).alias("coordinates")))
    return F.when(F.size(ring) >= 3, polygon).otherwise(F.to_json(F.struct(F.lit("Point").alias("type"), xy(dot).alias("coordinates"))))


def manifest_rows(ranked: DataFrame, places: DataFrame) -> DataFrame:
    """The manifest's columns of ranked clusters (rank, cluster_id, priority_tier, priority_score, population,
    trapped_nodes, distance_km, recommended_action) and places (cluster_id, hub, lat, lon)."""
    x = ranked.join(places, "cluster_id", "left")
    values = [F.col("rank").cast("int"), F.col("cluster_id").cast("string"), F.col("priority_tier"), F.col("priority_score"), F.floor(F.col("population") + 0.5).cast("long"), F.col("trapped_nodes").cast("int"), rounded(F.col("distance_km"), 2), F.coalesce("hub", F.lit("None")), F.round(F.coalesce("lat", F.lit(0.0)), 6), F.round(F.coalesce("lon", F.lit(0.0)), 6), F.col("recommended_action")]
    return x.select(*[v.alias(n) for v, n in zip(values, MANIFEST, strict=True)])


def resorted(rows: DataFrame) -> DataFrame:
    """A manifest ranked again by score, then population, then its order so far. A manifest is a report: its rows are
    the clusters of one event."""
    order = Window.orderBy(F.desc("Priority_Score"), F.desc("Estimated_Population"), "Rank")
    return rows.withColumn("_r", F.row_number().over(order)).withColumn("Rank", F.col("_r").cast("int")).drop("_r")


def fact_store(facts: DataFrame, generated: str) -> DataFrame:
    """One row with the facts (ord, fact_id, value_num, unit) as a JSON store; some dozen figures."""
    f = F.array_sort(F.collect_list(F.struct("ord", "fact_id", F.struct(F.col("value_num").alias("value"), "unit").alias("fact"))))
    entries = F.map_from_entries(F.transform(f, lambda s: F.struct(s["fact_id"], s["fact"])))
    return facts.agg(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit(generated).alias("generated_at"), F.count("*").alias("fact_count"), entries.alias("facts"))).alias("json"))


def facts_of(store: DataFrame, column: str = "json") -> DataFrame:
    """fact_id, value_num and unit of fact stores (JSON texts); an entry without a number has none."""
    s = store.select(F.from_json(column, "facts map<string,struct<value:double,unit:string>>")["facts"].alias("f"))
    return s.select(F.explode("f").alias("fact_id", "v")).select("fact_id", F.col("v.value").alias("value_num"), F.col("v.unit").alias("unit"))


def registered(facts: DataFrame, more: DataFrame) -> DataFrame:
    """The facts with others put in or over those of the same id."""
    return facts.join(more.select("fact_id"), "fact_id", "left_anti").unionByName(more.select(*facts.columns))


def directory_hash(spark: SparkSession, path: str) -> DataFrame:
    """n_files and the SHA-256 of the files' names and own hashes in the order of the names: a run's manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("hash"))
    listed = F.array_sort(F.collect_list(F.struct("name", "hash")))  # a row per file of a report
    return one.agg(F.count("*").alias("n_files"), F.sha2(F.array_join(F.transform(listed, lambda s: F.concat(s["name"], s["hash"])), ""), 256).alias("digest"))


def console_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the columns padded to their widest value, for a terminal; rows of a report."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    wide = df.agg(*[F.greatest(F.max(F.length(t)), F.lit(len(c))).alias(f"w{i}") for i, (c, t) in enumerate(zip(columns, text, strict=True))])
    padded = lambda t, i: F.concat(t, F.repeat(F.lit(" "), F.col(f"w{i}") - F.length(t)))
    rows = df.crossJoin(F.broadcast(wide)).select(F.concat_ws(" | ", *[padded(t, i) for i, t in enumerate(text)]).alias("line"), F.concat_ws(" | ", *[padded(F.lit(c), i) for i, c in enumerate(columns)]).alias("head"))  # one row of widths
    return rows.agg(F.concat(F.first("head"), F.lit("\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("table"))
