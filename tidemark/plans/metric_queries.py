"""Metrics, histograms, thresholds and parameter grids over labels, documents, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions.expr import rounded
from tidemark.operators import metrics
from tidemark.session import table


def _judged(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return l.join(d.select("doc_id", "lang", "source", "n_chars"), "doc_id").withColumn("pred", F.col("n_chars") > 500)


def confusion_metrics(spark, sf):
    return metrics.scores(_judged(spark, sf).agg(*metrics.counts(F.col("pred"), F.col("quality"))))


def confusion_rollup(spark, sf):
    """Per language and pooled; the pooled row sums counts, it does not average ratios."""
    return metrics.scores(_judged(spark, sf).rollup("lang").agg(*metrics.counts(F.col("pred"), F.col("quality"))).withColumn("lang", F.coalesce("lang", F.lit("pooled"))))


def confusion_map(spark, sf):
    return _judged(spark, sf).groupBy(metrics.confusion_class(F.col("pred"), F.col("quality")).alias("class")).agg(F.count("*").alias("n"))


def macro_vs_micro_iou(spark, sf):
    per = _judged(spark, sf).groupBy("source").agg(*metrics.counts(F.col("pred"), F.col("quality")))
    ratio = lambda a, b: (a + 1e-7) / (b + 1e-7)
    return per.agg(rounded(F.avg(ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))), 6).alias("macro_iou"), rounded(ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fp") + F.col("fn"))), 6).alias("micro_iou"))


def otsu_threshold(spark, sf):
    return metrics.otsu(table(spark, sf, "events"), "value").select(rounded(F.col("threshold"), 6).alias("threshold"))


def otsu_water_mask(spark, sf):
    """Events darker than the clipped threshold."""
    e = table(spark, sf, "events")
    t = metrics.otsu(e, "value", low=20.0, high=60.0)
    return e.crossJoin(F.broadcast(t)).groupBy("event_type").agg(F.count_if(F.col("value") < F.col("threshold")).alias("water"), F.count("*").alias("pixels"))  # t: one row


def histogram_density(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), "value", 60, 0.0, 300.0)


def telemetry_percentiles(spark, sf):
    l = table(spark, sf, "lineitem")
    p = F.col("l_extendedprice")
    q = l.groupBy("l_returnflag").agg(rounded(F.sum(p.cast("decimal(18,2)")).cast("double") / F.count(p), 4).alias("mean"), *(rounded(F.percentile(p, F.lit(x)), 4).alias(n) for n, x in (("p25", 0.25), ("median", 0.5), ("p95", 0.95))), rounded(F.stddev_pop(p), 2).alias("std"), F.min(p).alias("least"))
    return q


def grid_search_thresholds(spark, sf):
    """Counts of two-threshold hits for 25 pairs in one pass: pairs are exploded from a literal."""
    e = table(spark, sf, "events").where("event_type IN ('view', 'click')")
    cell = e.groupBy(F.col("user_id"), F.to_date("ts").alias("day")).agg(F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("pre"), F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("post")).where("pre IS NOT NULL AND post IS NOT NULL")
    pairs = F.explode(F.expr("transform(sequence(0, 24), i -> struct(20.0D + 10 * (i div 5) AS water, -5.0D - 5 * (i % 5) AS drop))"))
    x = cell.select("pre", "post", pairs.alias("p"))
    return x.groupBy(F.col("p.water").alias("water"), F.col("p.drop").alias("drop")).agg(F.count_if((F.col("post") < F.col("p.water")) & (F.col("post") - F.col("pre") < F.col("p.drop"))).alias("flooded"), F.count("*").alias("cells"))


def radiometry_db(spark, sf):
    l = table(spark, sf, "lineitem")
    db = expr.to_db(F.col("l_extendedprice") / 1e7)
    return l.select("l_orderkey", "l_linenumber", rounded(db, 6).alias("db"), rounded(expr.from_db(db) * 1e7, 4).alias("linear"), rounded(expr.normalised(db), 6).alias("scaled"))


def db_autodetect(spark, sf):
    """Values whose finite median is below 0 are taken as decibels already."""
    c = table(spark, sf, "customer")
    m = c.where(expr.is_finite(F.col("c_acctbal"))).groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("m"))
    return m.select("c_mktsegment", rounded(F.col("m"), 4).alias("median"), (F.col("m") < 0).alias("is_db"))


def pixel_area(spark, sf):
    p = table(spark, sf, "part")
    lat = F.col("p_size") * 1.5 - 40
    a = expr.pixel_area_m2(F.lit(0.0001), F.lit(-0.0001), F.col("p_partkey") % 2 == 0, lat)
    return p.select("p_partkey", rounded(a, 6).alias("area_m2"))


def utm_project(spark, sf):
    c = table(spark, sf, "customer")
    lon, lat = ((F.col("c_custkey") * 37) % 3600) / 10.0 - 180, ((F.col("c_custkey") * 53) % 1600) / 10.0 - 80
    x, y = expr.utm_project(lon, lat)
    return c.select("c_custkey", expr.utm_zone(lon, lat).cast("int").alias("epsg"), rounded(x, 3).alias("easting"), rounded(y, 3).alias("northing"))


def geodesic_distance(spark, sf):
    c = table(spark, sf, "customer")
    lon, lat = ((F.col("c_custkey") * 37) % 3600) / 10.0 - 180, ((F.col("c_custkey") * 53) % 1600) / 10.0 - 80
    return expr.with_geodesic_km(c.select("c_custkey"), lon, lat, lon / 2, lat / 2, "km").select("c_custkey", rounded(F.col("km"), 3).alias("km"))


QUERIES = {f.__name__: f for f in (confusion_metrics, confusion_rollup, confusion_map, macro_vs_micro_iou, otsu_threshold, otsu_water_mask, histogram_density, telemetry_percentiles, grid_search_thresholds, radiometry_db, db_autodetect, pixel_area, utm_project, geodesic_distance)}

_R = "floor(({0}) * 1e{1} + 0.5) / 1e{1}"
_JUDGED = "j AS (SELECT l.*, lang, source, n_chars > 500 AS pred FROM labels l JOIN documents USING (doc_id))"
_COUNTS = "count(*) FILTER (WHERE quality IN (0,1) AND pred AND quality = 1) AS tp, count(*) FILTER (WHERE quality IN (0,1) AND pred AND quality = 0) AS fp, count(*) FILTER (WHERE quality IN (0,1) AND NOT pred AND quality = 1) AS fn, count(*) FILTER (WHERE quality IN (0,1) AND NOT pred AND quality = 0) AS tn"


def _scores(of: str) -> str:
    q = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0.0 END"
    n = "(tp + fp + fn + tn)"
    po, pe = q("tp + tn", n), q("(tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)", f"({n} * {n})")
    parts = {"iou": q("tp", "(tp + fp + fn)"), "f1": q("2 * tp", "(2 * tp + fp + fn)"), "precision": q("tp", "(tp + fp)"), "recall": q("tp", "(tp + fn)"), "specificity": q("tn", "(tn + fp)"), "accuracy": po, "kappa": f"CASE WHEN {n} > 0 AND 1 - ({pe}) > 0 THEN (({po}) - ({pe})) / (1 - ({pe})) ELSE 0.0 END"}
    return f"SELECT *, {', '.join(f'{_R.format(v, 4)} AS {k}' for k, v in parts.items())} FROM ({of})"


_OTSU = """e AS (SELECT value::DOUBLE AS v FROM events WHERE value IS NOT NULL), m AS (SELECT min(v) AS lo, max(v) AS hi FROM e),
b AS (SELECT least(floor((v - lo) / ((hi - lo) / 256)), 255)::INTEGER AS bin, count(*) AS c FROM e, m GROUP BY 1),
h AS (SELECT r.range::INTEGER AS bin, lo + (hi - lo) / 256 * (r.range + 0.5::DOUBLE) AS center, coalesce(c, 0)::DOUBLE AS c FROM range(256) r CROSS JOIN m LEFT JOIN b ON b.bin = r.range),
w AS (SELECT *, sum(c) OVER (ORDER BY bin) AS w1, sum(c) OVER () - sum(c) OVER (ORDER BY bin) AS w2, sum(c * center) OVER (ORDER BY bin) / (sum(c) OVER (ORDER BY bin) + 1e-9) AS m1,
  sum(c * center) OVER (ORDER BY bin DESC) / (sum(c) OVER () - sum(c) OVER (ORDER BY bin) + 1e-9) AS m2 FROM h),
x AS (SELECT bin, center, w1 * lead(w2) OVER (ORDER BY bin) * pow(m1 - lead(m2) OVER (ORDER BY bin), 2) AS var FROM w),
t AS (SELECT center AS threshold FROM x WHERE var IS NOT NULL ORDER BY var DESC, bin LIMIT 1)"""


def _utm_sql() -> str:
    e, r = repr(expr.ECCENTRICITY), repr(0.9996 * expr.RADIUS)
    series = lambda kind: " + ".join(f"{a!r}::DOUBLE * {'cos' if kind == 'x' else 'sin'}(xi * {2 * j}) * {'sinh' if kind == 'x' else 'cosh'}(eta * {2 * j})" for j, a in enumerate(expr.ALPHA, 1))
    return f"""WITH p AS (SELECT c_custkey, ((c_custkey * 37) % 3600) / 10.0::DOUBLE - 180 AS lon, ((c_custkey * 53) % 1600) / 10.0::DOUBLE - 80 AS lat FROM customer),
a AS (SELECT *, radians(lat) AS phi, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS lam FROM p),
b AS (SELECT *, sinh(atanh(sin(phi)) - {e}::DOUBLE * atanh({e}::DOUBLE * sin(phi))) AS t FROM a),
c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b)
SELECT c_custkey, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6)::INTEGER + 1)::INTEGER AS epsg,
 {_R.format(f'{r}::DOUBLE * (eta + {series("x")}) + 500000', 3)} AS easting, {_R.format(f'{r}::DOUBLE * (xi + {series("y")}) + CASE WHEN lat < 0 THEN 1e7 ELSE 0 END', 3)} AS northing FROM c"""


SQL = {
    "confusion_metrics": f"WITH {_JUDGED} " + _scores(f"SELECT {_COUNTS} FROM j"),
    "confusion_rollup": f"WITH {_JUDGED} " + _scores(f"SELECT coalesce(lang, 'pooled') AS lang, {_COUNTS} FROM j GROUP BY ROLLUP (lang)"),
    "confusion_map": f"WITH {_JUDGED} SELECT (CASE WHEN pred AND quality = 1 THEN 1 WHEN pred THEN 2 WHEN quality = 1 THEN 3 ELSE 0 END)::INTEGER AS class, count(*) AS n FROM j GROUP BY 1",
    "macro_vs_micro_iou": f"WITH {_JUDGED}, s AS (SELECT source, {_COUNTS} FROM j GROUP BY 1) SELECT {_R.format('avg((tp + 1e-7) / (tp + fp + fn + 1e-7))', 6)} AS macro_iou, {_R.format('(sum(tp) + 1e-7) / (sum(tp + fp + fn) + 1e-7)', 6)} AS micro_iou FROM s",
    "otsu_threshold": f"WITH {_OTSU} SELECT {_R.format('threshold', 6)} AS threshold FROM t",
    "otsu_water_mask": f"WITH {_OTSU} SELECT event_type, count(*) FILTER (WHERE value < least(greatest(threshold, 20.0), 60.0)) AS water, count(*) AS pixels FROM events, t GROUP BY 1",
    "histogram_density": f"WITH b AS (SELECT least(floor(value / 5.0::DOUBLE), 59)::INTEGER AS bin, count(*) AS c FROM events WHERE value >= 0 AND value <= 300 GROUP BY 1), h AS (SELECT range::INTEGER AS bin, coalesce(c, 0) AS count FROM range(60) LEFT JOIN b ON b.bin = range) SELECT bin, count, {_R.format('count / sum(count) OVER () / 5.0::DOUBLE', 8)} AS density FROM h",
    "telemetry_percentiles": f"SELECT l_returnflag, {_R.format('sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(l_extendedprice)', 4)} AS mean, " + ", ".join(f"{_R.format(f'quantile_cont(l_extendedprice, {x})', 4)} AS {n}" for n, x in (("p25", 0.25), ("median", 0.5), ("p95", 0.95))) + f", {_R.format('stddev_pop(l_extendedprice)', 2)} AS std, min(l_extendedprice) AS least FROM lineitem GROUP BY 1",
    "grid_search_thresholds": "WITH c AS (SELECT user_id, ts::DATE AS day, sum(value) FILTER (WHERE event_type = 'view') AS pre, sum(value) FILTER (WHERE event_type = 'click') AS post FROM events GROUP BY 1, 2 HAVING pre IS NOT NULL AND post IS NOT NULL) SELECT (20.0 + 10 * (range // 5))::DOUBLE AS water, (-5.0 - 5 * (range % 5))::DOUBLE AS drop, count(*) FILTER (WHERE post < 20.0 + 10 * (range // 5) AND post - pre < -5.0 - 5 * (range % 5)) AS flooded, count(*) AS cells FROM c, range(25) GROUP BY 1, 2",
    "radiometry_db": f"SELECT l_orderkey, l_linenumber, {_R.format('db', 6)} AS db, {_R.format('pow(10, db / 10) * 1e7', 4)} AS linear, {_R.format('(least(greatest(db, -30.0), 0.0) + 30) / 30', 6)} AS scaled FROM (SELECT *, log10(greatest(l_extendedprice / 1e7, 1e-6)) * 10 AS db FROM lineitem)",
    "db_autodetect": f"SELECT c_mktsegment, {_R.format('median(c_acctbal)', 4)} AS median, median(c_acctbal) < 0 AS is_db FROM customer WHERE isfinite(c_acctbal) GROUP BY 1",
    "pixel_area": f"WITH p AS (SELECT p_partkey, radians(p_size * 1.5::DOUBLE - 40) AS p FROM part) SELECT p_partkey, {_R.format('CASE WHEN p_partkey % 2 = 0 THEN abs(0.0001::DOUBLE * (111412.84 * cos(p) - 93.5 * cos(3 * p))) * abs(-0.0001::DOUBLE * (111132.92 - 559.82 * cos(2 * p) + 1.175 * cos(4 * p))) ELSE abs(0.0001::DOUBLE * -0.0001::DOUBLE) END', 6)} AS area_m2 FROM p",
    "utm_project": _utm_sql(),
}
