"""Spatial queries: balances and keys are coordinates, the events grid is the raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expr import rounded
from tidemark.operators import spatial
from tidemark.plans.grid_queries import _PX, pixels
from tidemark.session import table


def _points(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 7919) % 10000).cast("double").alias("y"))


def _hubs(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("hub"), F.col("s_acctbal").alias("x"), ((F.col("s_suppkey") * 6131) % 10000).cast("double").alias("y"))


def nearest_hub(spark, sf):
    return spatial.nearest(_points(spark, sf), _hubs(spark, sf), 400.0).select("id", "hub", rounded(F.col("dist"), 4).alias("dist"))


def nearest_within_count(spark, sf):
    """Customers within 500 of each supplier that is their nearest; suppliers without any count 0."""
    near = spatial.nearest_within(_points(spark, sf), _hubs(spark, sf), 500.0).groupBy("hub").agg(F.count("*").alias("n"))
    return _hubs(spark, sf).select("hub").join(near, "hub", "left").select("hub", F.coalesce("n", F.lit(0)).alias("n_customers"))


def _lines(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda a, b, c: ((F.col(a) * b) % c) / 10.0
    return o.select(F.col("o_orderkey").alias("id"), part("o_orderkey", 7, 230).alias("x1"), part("o_custkey", 11, 340).alias("y1"), part("o_orderkey", 13, 230).alias("x2"), part("o_custkey", 3, 340).alias("y2"))


def _wet(spark, sf):
    return pixels(spark, sf).select("row", "col", (F.coalesce("post", F.lit(99.0)) < 45.0).alias("wet"))


def line_sampling_fraction(spark, sf):
    f = spatial.sampled_fraction(_lines(spark, sf), _wet(spark, sf))
    return f.select("id", rounded(F.col("flood_frac"), 6).alias("flood_frac"), "flooded", "covered")


def segment_cell_clip(spark, sf):
    c = spatial.clipped_length(_lines(spark, sf), _wet(spark, sf).where("wet").select("row", "col"))
    return c.select("id", rounded(F.col("length"), 5).alias("length"), rounded(F.col("inside"), 5).alias("inside"))


def zonal_sum_distinct(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("zone"), (F.col("s_suppkey") % 30).cast("int").alias("row"), ((F.col("s_suppkey") * 7) % 20).cast("int").alias("col"))
    z = spatial.zonal_sum(s, pixels(spark, sf).select("row", "col", F.col("post").alias("v")), 2)
    return z.select("zone", "cells", rounded(F.col("total"), 4).alias("total"))


def bbox_overlap_join(spark, sf):
    p, o = table(spark, sf, "part"), table(spark, sf, "orders")
    a = p.select(F.col("p_partkey").alias("a"), (F.col("p_retailprice") - 2).alias("x1"), (F.col("p_retailprice") + 2).alias("x2"), (F.col("p_size") - 1.0).alias("y1"), (F.col("p_size") + 1.0).alias("y2"))
    b = o.select(F.col("o_orderkey").alias("b"), (F.col("o_totalprice") / 300).alias("x1"), (F.col("o_totalprice") / 300 + 1).alias("x2"), (F.col("o_custkey") % 50).cast("double").alias("y1"), ((F.col("o_custkey") % 50) + 0.5).alias("y2"))
    return spatial.overlap_counts(a, b, 16.0).withColumnRenamed("first", "first_order")


def convex_hulls(spark, sf):
    return spatial.hulls(table(spark, sf, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y")))


QUERIES = {f.__name__: f for f in (nearest_hub, nearest_within_count, line_sampling_fraction, segment_cell_clip, zonal_sum_distinct, bbox_overlap_join, convex_hulls)}

_R = "floor(({0}) * 1e{1} + 0.5) / 1e{1}"
_P = "p AS (SELECT c_custkey AS id, c_acctbal AS x, ((c_custkey * 7919) % 10000)::DOUBLE AS y FROM customer), h AS (SELECT s_suppkey AS hub, s_acctbal AS hx, ((s_suppkey * 6131) % 10000)::DOUBLE AS hy FROM supplier), d AS (SELECT id, hub, sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) AS dist FROM p, h), n AS (SELECT id, hub, dist FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, hub) = 1)"
_L = "l AS (SELECT o_orderkey AS id, ((o_orderkey * 7) % 230) / 10.0::DOUBLE AS x1, ((o_custkey * 11) % 340) / 10.0::DOUBLE AS y1, ((o_orderkey * 13) % 230) / 10.0::DOUBLE AS x2, ((o_custkey * 3) % 340) / 10.0::DOUBLE AS y2 FROM orders)"
_W = f"{_PX}, w AS (SELECT row, col, coalesce(post, 99.0) < 45.0 AS wet FROM px)"


def _part(p: str, d: str, cell: str) -> tuple[str, str]:
    lo = f"CASE WHEN {d} = 0 THEN CASE WHEN {p} >= {cell} AND {p} < {cell} + 1 THEN 0.0 ELSE 1.0 END ELSE least(({cell} - {p}) / nullif({d}, 0), ({cell} + 1 - {p}) / nullif({d}, 0)) END"
    hi = f"CASE WHEN {d} = 0 THEN CASE WHEN {p} >= {cell} AND {p} < {cell} + 1 THEN 1.0 ELSE 0.0 END ELSE greatest(({cell} - {p}) / nullif({d}, 0), ({cell} + 1 - {p}) / nullif({d}, 0)) END"
    return lo, hi


_Y, _X = _part("y1", "(y2 - y1)", "row"), _part("x1", "(x2 - x1)", "col")
SQL = {
    "nearest_hub": f"WITH {_P} SELECT id, hub, {_R.format('dist', 4)} AS dist FROM n",
    "nearest_within_count": f"WITH {_P} SELECT h.hub, count(n.id) AS n_customers FROM h LEFT JOIN n ON n.hub = h.hub AND n.dist <= 500 GROUP BY 1",
    "line_sampling_fraction": f"""WITH {_W}, {_L}, c AS (SELECT *, greatest(2, ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))::INTEGER + 1) AS n FROM l), s AS (SELECT id, x1, y1, x2, y2, n, unnest(range(0, n)) AS i FROM c),
 q AS (SELECT id, floor(y1 + (y2 - y1) * (i::DOUBLE / (n - 1)))::INTEGER AS row, floor(x1 + (x2 - x1) * (i::DOUBLE / (n - 1)))::INTEGER AS col FROM s), f AS (SELECT id, avg(wet::INTEGER::DOUBLE) AS v FROM q JOIN w USING (row, col) GROUP BY 1)
 SELECT l.id, {_R.format('v', 6)} AS flood_frac, coalesce(v >= 0.3, false) AS flooded, v IS NOT NULL AS covered FROM l LEFT JOIN f USING (id)""",
    "segment_cell_clip": f"""WITH {_W}, {_L}, m AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM l),
 k AS (SELECT id, greatest(0.0, least(1.0, {_X[1]}, {_Y[1]}) - greatest(0.0, {_X[0]}, {_Y[0]})) * length AS part FROM m JOIN w ON wet AND row BETWEEN floor(least(y1, y2)) AND floor(greatest(y1, y2)) AND col BETWEEN floor(least(x1, x2)) AND floor(greatest(x1, x2))),
 t AS (SELECT id, sum(part) AS inside FROM k GROUP BY 1) SELECT m.id, {_R.format('length', 5)} AS length, {_R.format('coalesce(inside, 0.0)', 5)} AS inside FROM m LEFT JOIN t USING (id)""",
    "zonal_sum_distinct": f"WITH {_PX}, o AS (SELECT r.range AS r, c.range AS c FROM range(-2, 3) r, range(-2, 3) c WHERE r.range * r.range + c.range * c.range <= 4), s AS (SELECT DISTINCT s_nationkey AS zone, s_suppkey % 30 + r AS row, (s_suppkey * 7) % 20 + c AS col FROM supplier, o) SELECT zone, count(*) AS cells, {_R.format('sum(coalesce(post, 0.0))', 4)} AS total FROM s JOIN px ON px.row = s.row AND px.col = s.col GROUP BY 1",
    "bbox_overlap_join": "SELECT p_partkey AS a, count(*) AS n, min(o_orderkey) AS first_order FROM part JOIN orders ON p_retailprice - 2 <= o_totalprice / 300 + 1 AND o_totalprice / 300 <= p_retailprice + 2 AND p_size - 1.0 <= (o_custkey % 50) + 0.5 AND (o_custkey % 50) <= p_size + 1.0 GROUP BY 1",
}
