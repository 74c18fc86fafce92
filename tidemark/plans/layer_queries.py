"""Queries over sources, sinks and reports: map extracts, scenes, chips, tiles, manifests, facts, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expr import rounded, utm_project, utm_unproject, utm_zone
from tidemark.operators import facts, raster, reports
from tidemark.plans import grid_queries, ranking_queries, text_queries
from tidemark.session import table
from tidemark.sources import catalog, outputs

KINDS, BRIDGE = ["primary", "", "residential", "track", ""], ["yes", "no", "", "viaduct"]
CARE, BUILT = ["hospital", "cafe", "clinic", ""], ["house", "", "school"]


def _at(values: list[str], key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def map_extract(spark, sf):
    """Parts as nodes and customers as ways, as JSON texts of one element each."""
    p, c = table(spark, sf, "part"), table(spark, sf, "customer")
    k = F.col("p_partkey")
    nodes = p.select(F.struct(F.lit("node").alias("type"), k.alias("id"), (27 + (k % 100) / 100).alias("lat"), (85 + (k % 90) / 100).alias("lon"), F.create_map(F.lit("amenity"), _at(CARE, k), F.lit("name"), F.concat(F.lit("Place "), k.cast("string"))).alias("tags")).alias("e"))
    c = c.withColumn("k", F.col("c_custkey"))
    first = F.col("k") * 3 % 211
    refs = F.concat(F.array(first, F.col("k") * 5 % 223, F.col("k") * 7 % 227), F.when(F.col("k") % 4 == 0, F.array(first)).otherwise(F.array().cast("array<bigint>")))
    tag = F.create_map(F.lit("highway"), _at(KINDS, F.col("k")), F.lit("bridge"), _at(BRIDGE, F.col("k")), F.lit("building"), _at(BUILT, F.col("k")), F.lit("amenity"), _at(CARE, F.col("k")))
    ways = c.select(F.struct(F.lit("way").alias("type"), F.col("k").alias("id"), refs.alias("nodes"), tag.alias("tags")).alias("e"))
    text = lambda d: d.select(F.concat(F.lit('{"elements":['), F.to_json("e"), F.lit("]}")).alias("json"))
    return text(nodes).unionByName(text(ways))


def map_layers(spark, sf):
    layers = catalog.map_layers(catalog.elements(map_extract(spark, sf)), project=lambda lon, lat: (lon, lat))
    kind = {"roads": F.concat_ws("/", "highway", "bridge", "surface"), "bridges": F.col("name"), "buildings": F.col("building"), "facilities": F.concat_ws("/", "amenity", "name")}
    shape = {"roads": "points", "bridges": "points", "buildings": "ring", "facilities": "ring"}
    out = None
    for name, d in layers.items():
        one = d.select(F.lit(name).alias("layer"), "id", kind[name].alias("kind"), F.size(shape[name]).alias("n_points"), rounded(F.col(shape[name])[0]["x"], 6).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


def scene_features(spark, sf):
    """Orders as scene features in JSON, parsed."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    props = F.struct(F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("datetime"), F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("start_datetime"), F.when(k % 11 != 0, (k % 175).cast("int")).alias("sat:relative_orbit"), _at(["ascending", "DESCENDING", "other"], k).alias("sat:orbit_state"))
    assets = F.map_from_arrays(F.when(k % 2 == 0, F.array(F.lit("vv"), F.lit("thumb"), F.lit("vh"))).otherwise(F.array(F.lit("thumb"))), F.when(k % 2 == 0, F.array(*[F.struct(F.lit("x").alias("href"))] * 3)).otherwise(F.array(F.struct(F.lit("x").alias("href")))))
    return catalog.scenes(o.select(F.to_json(F.struct(F.concat(F.lit("S1_"), k.cast("string")).alias("id"), props.alias("properties"), assets.alias("assets"))).alias("json")))


def chip_pairs(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    path = lambda kind: F.concat(F.lit(f"chips/{kind}/Chip_"), k, F.lit(f"_{kind}.tif"))
    return catalog.chip_pairs(d.where("doc_id % 3 <> 0").select(path("S1Hand").alias("path")).unionByName(d.where("doc_id % 2 = 0").select(path("LabelHand").alias("path"))))


def tile_round_trip(spark, sf):
    """The image after as tiles of 7 by 7 and back."""
    p = grid_queries.pixels(spark, sf).select(F.lit("a").alias("raster_id"), F.lit(1).alias("band"), "row", "col", F.col("post").alias("v"))
    t = raster.tiles_of(p, 7)
    return raster.pixels_of(t).select("row", "col", rounded(F.col("v"), 4).alias("v"))


def population_total(spark, sf):
    """Balances as population: no-data (whole negative hundreds here), negative and missing count 0."""
    c = table(spark, sf, "customer").select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.when(F.col("c_custkey") % 9 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 10 == 0, F.lit(-99.0)).otherwise(F.col("c_acctbal")).alias("v"))
    return raster.population(c, -99.0).agg(F.count("*").alias("pixels"), rounded(F.sum(F.col("v").cast("decimal(28,2)")).cast("double"), 2).alias("people"))


def utm_round_trip(spark, sf):
    """Customers' places to UTM and back."""
    c = table(spark, sf, "customer")
    lon, lat = (F.col("c_custkey") * 7 % 3600) / 10.0 - 179.95, (F.col("c_custkey") * 11 % 1600) / 10.0 - 79.95
    x, y = utm_project(lon, lat)
    p = c.select("c_custkey", x.alias("x"), y.alias("y"), utm_zone(lon, lat).alias("zone"))
    back = utm_unproject(F.col("x"), F.col("y"), F.col("zone"))
    return p.select("c_custkey", rounded(back[0], 6).alias("lon"), rounded(back[1], 6).alias("lat"), "zone")


def rescue_manifest(spark, sf):
    """The manifest of the ranked clusters with a place by id, ranked again."""
    ranked = ranking_queries.QUERIES["rescue_priority_rank"](spark, sf)
    places = table(spark, sf, "nation").select(F.col("n_name").alias("cluster_id"), F.concat(F.lit("Hub of "), "n_name").alias("hub"), (F.col("n_nationkey") + 0.1234567).alias("lat"), (F.col("n_nationkey") * 2 + 0.5).alias("lon"))
    return outputs.resorted(outputs.manifest_rows(ranked, places))


def fact_store_round_trip(spark, sf):
    """The facts as a JSON store and back, with one put over."""
    f = text_queries.fact_table(spark, sf)
    back = outputs.facts_of(outputs.fact_store(f, "2026-08-28T00:00:00Z"))
    return outputs.registered(back, spark.createDataFrame([("N_USERS", 7.0, "users"), ("NEW", 1.5, None)], "fact_id string, value_num double, unit string"))


def sentence_split(spark, sf):
    d = text_queries._texts(spark, sf).select("doc_id", reports.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return d.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def number_verdicts(spark, sf):
    """Each number of the documents with its verdict, and the length of the sentence around a violation."""
    v = reports.verdicts(text_queries._texts(spark, sf), text_queries.fact_table(spark, sf), "doc_id", "text")
    return v.select("id", "place", "value", "verdict", F.length("sentence").alias("sentence_length"))


def situation_report(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 3).alias("n_buildings"), F.lit("reconnaissance").alias("response"))
    f = text_queries.fact_table(spark, sf)
    return reports.situation_report(f, n, "en", "0").select(F.lit("en").alias("language"), "markdown").unionByName(reports.situation_report(f, n, "ne", "0").select(F.lit("ne").alias("language"), "markdown"))


def copilot_answers(spark, sf):
    """The set questions and every document's text as a question: language, topic and grounding of the answer."""
    q = spark.createDataFrame(text_queries.QUESTIONS, "id long, query string").unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query")))
    a = reports.asked(q, text_queries.fact_table(spark, sf))
    return a.groupBy("language", "topic", "refused", "score").agg(F.count("*").alias("n"), F.min(F.length("answer")).alias("shortest"), F.sum("violations").alias("violations"))


QUERIES = {f.__name__: f for f in (map_layers, scene_features, chip_pairs, tile_round_trip, population_total, utm_round_trip, rescue_manifest, fact_store_round_trip, sentence_split, number_verdicts, situation_report, copilot_answers)}

_R = "floor(({0}) * 1e{1} + 0.5) / 1e{1}"


def _pick(values: list[str], key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({key} % {len(values)} + 1)::INTEGER]"


_MAP = f"""n AS (SELECT p_partkey AS id, 27 + (p_partkey % 100) / 100.0::DOUBLE AS lat, 85 + (p_partkey % 90) / 100.0::DOUBLE AS lon, {_pick(CARE, 'p_partkey')} AS care FROM part),
 c AS (SELECT c_custkey AS id, {_pick(KINDS, 'c_custkey')} AS highway, {_pick(BRIDGE, 'c_custkey')} AS bridge, {_pick(BUILT, 'c_custkey')} AS building, {_pick(CARE, 'c_custkey')} AS care, CASE WHEN c_custkey % 4 = 0 THEN [c_custkey * 3 % 211, c_custkey * 5 % 223, c_custkey * 7 % 227, c_custkey * 3 % 211] ELSE [c_custkey * 3 % 211, c_custkey * 5 % 223, c_custkey * 7 % 227] END AS refs FROM customer),
 r AS (SELECT id, unnest(refs) AS node, unnest(range(1, len(refs) + 1)) AS place FROM c), g AS (SELECT r.id, list(n.lon ORDER BY place) AS xs, list(n.lat ORDER BY place) AS ys FROM r JOIN n ON n.id = r.node GROUP BY 1 HAVING count(*) >= 2),
 w AS (SELECT c.*, xs, ys, len(xs) >= 4 AND xs[1] = xs[len(xs)] AND ys[1] = ys[len(ys)] AS closed FROM c JOIN g USING (id))"""
_F = {"en": ["# Situation report", "", "| Figure | Value |", "| --- | --- |", "| Flooded area (km2) | 4.12 |", "| Roads affected (km) | 6.8 |", "| Roads in all (km) | 42.5 |", "| Bridges severed | 2 |", "| Buildings flooded | 34 |", "| Settlements cut off | 3 |", "| Buildings cut off | 72 |", "", "## Settlements cut off"], "ne": ["# विपद् स्थिति प्रतिवेदन", "", "| सूचक | मान |", "| --- | --- |", "| बाढी क्षेत्र (वर्ग किमी) | 4.12 |", "| प्रभावित सडक (किमी) | 6.8 |", "| कुल सडक (किमी) | 42.5 |", "| विच्छेद पुल | 2 |", "| बाढीग्रस्त भवन | 34 |", "| अलग बस्ती | 3 |", "| अलग भवन | 72 |", "", "## अलग बस्तीहरू"]}
_REPORT = " UNION ALL ".join(f"SELECT '{k}' AS language, '" + "\n".join([*v, "| Id | Settlement | Buildings | Response |", "| --- | --- | --- | --- |"]) + "' || chr(10) || (SELECT string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_nationkey * 3 || ' | reconnaissance |', chr(10) ORDER BY n_nationkey) FROM nation) || chr(10) || chr(10) || '`0`' AS markdown" for k, v in _F.items())
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f]+', ' ', 'g')), '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
SQL = {
    "map_layers": f"""WITH {_MAP} SELECT 'roads' AS layer, id, highway || '/' || CASE WHEN bridge = '' THEN 'no' ELSE bridge END || '/unknown' AS kind, len(xs)::INTEGER AS n_points, {_R.format('xs[1]', 6)} AS x FROM w WHERE highway <> ''
 UNION ALL SELECT 'bridges', id, 'Bridge', len(xs)::INTEGER, {_R.format('xs[1]', 6)} FROM w WHERE highway <> '' AND bridge NOT IN ('', 'no') UNION ALL SELECT 'buildings', id, building, CASE WHEN closed THEN len(xs) - 1 ELSE 4 END::INTEGER, CASE WHEN closed THEN {_R.format('xs[1]', 6)} ELSE {_R.format('list_min(xs) - 5', 6)} END FROM w WHERE highway = '' AND building <> ''
 UNION ALL SELECT 'facilities', id, care || '/Medical Facility', CASE WHEN closed THEN len(xs) - 1 ELSE 4 END::INTEGER, CASE WHEN closed THEN {_R.format('xs[1]', 6)} ELSE {_R.format('list_min(xs) - 10', 6)} END FROM w WHERE highway = '' AND building = '' AND care IN ('hospital', 'clinic') UNION ALL SELECT 'facilities', id, care || '/Place ' || id, 4::INTEGER, {_R.format('lon - 15', 6)} FROM n WHERE care IN ('hospital', 'clinic')""",
    "scene_features": """SELECT 'S1_' || o_orderkey AS id, o_orderdate::TIMESTAMPTZ AS ts, (o_orderkey % 175)::INTEGER AS relative_orbit, CASE o_orderkey % 3 WHEN 0 THEN 'ascending' ELSE 'descending' END AS orbit_state, CASE WHEN o_orderkey % 2 = 0 THEN 'VH+VV' ELSE 'UNKNOWN' END AS polarization
 FROM orders WHERE (o_orderkey % 7 <> 0 OR o_orderkey % 3 = 0) AND o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 2""".replace("::TIMESTAMPTZ", ""),
    "chip_pairs": "SELECT 'Chip_' || doc_id AS chip, 'chips/S1Hand/Chip_' || doc_id || '_S1Hand.tif' AS image, 'chips/LabelHand/Chip_' || doc_id || '_LabelHand.tif' AS label FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0",
    "tile_round_trip": f"WITH {grid_queries._PX} SELECT row, col, {_R.format('post', 4)} AS v FROM px",
    "population_total": f"SELECT count(*) AS pixels, {_R.format('(sum(CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 OR c_acctbal <= 0 THEN 0 ELSE c_acctbal END::DECIMAL(28,2)))::DOUBLE', 2)} AS people FROM customer",
    "utm_round_trip": f"WITH p AS (SELECT c_custkey, (c_custkey * 7 % 3600) / 10.0::DOUBLE - 179.95::DOUBLE AS lon, (c_custkey * 11 % 1600) / 10.0::DOUBLE - 79.95::DOUBLE AS lat FROM customer) SELECT c_custkey, {_R.format('lon', 6)} AS lon, {_R.format('lat', 6)} AS lat, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6)::INTEGER + 1)::INTEGER AS zone FROM p",
    "rescue_manifest": f"""WITH q AS ({ranking_queries.SQL['rescue_priority_rank']}), x AS (SELECT rank, cluster_id AS "Cluster_ID", priority_tier AS "Priority_Tier", priority_score AS "Priority_Score", floor(population + 0.5)::BIGINT AS "Estimated_Population", floor(trapped_nodes)::INTEGER AS "Trapped_Nodes", {_R.format('distance_km', 2)} AS "Dist_to_Hub_km", coalesce('Hub of ' || n_name, 'None') AS "Nearest_Hub", coalesce(round(n_nationkey + 0.1234567, 6)::DOUBLE, 0.0::DOUBLE) AS "Centroid_Lat", coalesce(n_nationkey * 2 + 0.5::DOUBLE, 0.0::DOUBLE) AS "Centroid_Lon", recommended_action AS "Recommended_Action" FROM q LEFT JOIN nation ON cluster_id = n_name)
 SELECT (row_number() OVER (ORDER BY "Priority_Score" DESC, "Estimated_Population" DESC, rank))::INTEGER AS "Rank", * EXCLUDE (rank) FROM x""",
    "sentence_split": f"WITH t AS (SELECT doc_id, {_SENTENCES} AS s FROM (SELECT doc_id, text FROM documents UNION ALL VALUES (-1, 'About 1002 orders of 9999 and १५००० more, 12 days; see `x 77` and DEM-30 at 2,5 km'), (-2, 'क्षेत्रमा ९९९९ वटा'), (-3, 'No figures.'))) SELECT doc_id, len(s)::INTEGER AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INTEGER AS longest FROM t",
    "situation_report": _REPORT,
    "fact_store_round_trip": f"WITH {text_queries._FACTS} SELECT fact_id, CASE fact_id WHEN 'N_USERS' THEN 7.0 ELSE value_num END AS value_num, unit FROM f UNION ALL SELECT 'NEW', 1.5::DOUBLE, NULL",
    "number_verdicts": f"""WITH {text_queries._GROUND.split(", t AS")[0]}, t AS{text_queries._GROUND.split(", t AS")[1].split("n AS (")[0].rstrip().rstrip(",")}, w AS (SELECT doc_id, coalesce(text, '') AS text FROM t), p AS (SELECT doc_id, text, {text_queries._PLAIN} AS p FROM w),
 q AS (SELECT doc_id, text, regexp_extract_all(p, '({facts.NUMBER})', 1) AS found, string_split_regex(p, '{facts.NUMBER}') AS gaps FROM p), n AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM q),
 m AS (SELECT doc_id, text, (i - 1)::INTEGER AS place, try_cast(replace(found[i], ',', '') AS DOUBLE) AS value, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start, length(found[i]) AS size FROM n),
 k AS (SELECT m.*, EXISTS (SELECT 1 FROM (SELECT unnest({facts.CONSTANTS}::DOUBLE[]) AS c) WHERE abs(abs(value) - c) < 1e-4) AS known, (SELECT arg_min(fact_id, ord) FROM f WHERE (value_num = 0 AND value = 0) OR (value_num <> 0 AND abs(value - value_num) <= abs(value_num) * 0.03)) AS hit FROM m),
 x AS (SELECT *, CASE WHEN known THEN 'BASELINE_CONSTANT' ELSE coalesce(hit, 'VIOLATION') END AS verdict FROM k), y AS (SELECT *, CASE WHEN verdict = 'VIOLATION' THEN {_SENTENCES} END AS s FROM x),
 z AS (SELECT *, list_filter(range(1, len(s) + 1), lambda j: coalesce(list_sum(list_transform(s[1:j - 1], lambda v: length(v) + 1)), 0) <= start AND start < coalesce(list_sum(list_transform(s[1:j - 1], lambda v: length(v) + 1)), 0) + length(s[j]) + 10)[1] AS j FROM y)
 SELECT doc_id AS id, place, value, verdict, CASE WHEN verdict = 'VIOLATION' THEN CASE WHEN j IS NOT NULL THEN length(s[j]) ELSE length(trim(substring(text, (greatest(start - 60, 0) + 1)::BIGINT, (start + size + 60 - greatest(start - 60, 0))::BIGINT))) END END::INTEGER AS sentence_length FROM z""",
}
