"""Queries over a raster that grows with the data: a pixel for each order, 150 a row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import shapes
from tidemark.functions.expr import rounded
from tidemark.operators import raster
from tidemark.plans import grid_queries as g
from tidemark.session import table

W = 150


def scene(spark, sf):
    """Row, column, backscatter before and after, elevation; a few pixels have no value."""
    o = table(spark, sf, "orders")
    pre = F.when(F.col("o_custkey") % 41 != 0, -5.0 - F.pmod(F.floor("o_totalprice"), F.lit(997)) / 100.0)
    post = -5.0 - F.pmod(F.floor("o_totalprice") * 7, F.lit(1499)) / 100.0
    return o.select(F.floor(F.col("o_orderkey") / W).cast("int").alias("row"), (F.col("o_orderkey") % W).cast("int").alias("col"), pre.alias("pre"), post.alias("post"), ((F.col("o_custkey") % 100) * 1.5 + (F.col("o_orderkey") % W) * 2.0).alias("z"))


def _height(spark, sf) -> int:
    return int(scene(spark, sf).agg(F.max("row")).first()[0]) + 1


def _layers(spark, sf):
    return raster.terrain(scene(spark, sf), "z", _height(spark, sf), W, 400.0, 78.0, 39.0)


def scene_terrain(spark, sf):
    t = _layers(spark, sf)
    return t.select("row", "col", *[rounded(F.col(c), 4).alias(c) for c in ("elevation", "slope", "incidence")], F.when(F.col("slope") > 1e-9, rounded(F.col("aspect"), 3)).otherwise(0.0).alias("aspect"), "shadow", "layover", "plausible", "observable")


def _mask(spark, sf):
    return raster.mountain_mask(scene(spark, sf), _layers(spark, sf), W, 2.0, -6.0, 4)


def scene_mountain_mask(spark, sf):
    return _mask(spark, sf).select("row", "col", "mask", rounded(F.col("confidence"), 5).alias("confidence"))


def scene_statistics(spark, sf):
    s = raster.mask_statistics(_mask(spark, sf), 160000.0)
    return s.select("flooded_pixels", "valid_pixels", *[rounded(F.col(c), 3).alias(c) for c in ("area_km2", "percent", "confidence")])


def scene_median_5x5(spark, sf):
    return raster.wide_median(scene(spark, sf).select("row", "col", "post"), "post", 5, "m").select("row", "col", rounded(F.col("m"), 4).alias("median"))


OWN, OTHER = (150.0, 0.0, -150.0, 0.0), (100.0, 25.0, -100.0, -10.0)


def scene_resampled(spark, sf):
    """The image before on a grid of coarser pixels and another corner."""
    s = scene(spark, sf)
    target = s.select("row", "col").where(f"row * 3 < {2 * _height(spark, sf)} AND col < 100")
    return raster.resampled(target, s.select("row", "col", F.col("pre").alias("v")), OWN, OTHER).select("row", "col", rounded(F.col("v"), 6).alias("v"))


def rasterized_triangles(spark, sf):
    """Parts as triangles; each pixel's least part."""
    p = table(spark, sf, "part")
    x, y = (F.col("p_partkey") * 17 % 1950) / 10.0, (F.col("p_partkey") * 29 % 2950) / 10.0
    ring = F.array(shapes.point(x, y), shapes.point(x + 1.1 + F.col("p_size") % 5, y + 0.3), shapes.point(x + 0.4, y + 2.2))
    return raster.rasterized(p.select(F.col("p_partkey").alias("id"), ring.alias("ring")))


def padded_grid(spark, sf):
    return raster.padded(g.pixels(spark, sf).select("row", "col", rounded(F.coalesce("post", F.lit(0.0)), 4).alias("v")), g.H, g.W, 36)


def darker(tile: np.ndarray) -> np.ndarray:
    """A plain scorer: how much darker the second channel is, from 0 to 1."""
    return np.clip((tile[0] - tile[1]) / 10 + 0.5, 0, 1)


def tile_inference(spark, sf):
    p = raster.predicted(scene(spark, sf), ["pre", "post"], _height(spark, sf), W, 8, 6, darker)
    return p.select("row", "col", rounded(F.col("p"), 5).alias("p"), "mask")


QUERIES = {f.__name__: f for f in (scene_terrain, scene_mountain_mask, scene_statistics, scene_median_5x5, scene_resampled, rasterized_triangles, padded_grid, tile_inference)}

_R = "floor(({0}) * 1e{1} + 0.5) / 1e{1}"
_S = """sc AS MATERIALIZED (SELECT (o_orderkey // 150)::INTEGER AS row, (o_orderkey % 150)::INTEGER AS col, CASE WHEN o_custkey % 41 <> 0 THEN -5.0::DOUBLE - (floor(o_totalprice)::BIGINT % 997) / 100.0::DOUBLE END AS pre,
 -5.0::DOUBLE - ((floor(o_totalprice)::BIGINT * 7) % 1499) / 100.0::DOUBLE AS post, (o_custkey % 100) * 1.5::DOUBLE + (o_orderkey % 150) * 2.0::DOUBLE AS h FROM orders)"""
_AR = g._around("sc", "h", "ar").replace("col = 19", "col = 149").replace("row = 29", "row = (SELECT max(row) FROM sc)")
_STEPS = ", ".join(f"({k}.0::DOUBLE, {r}, {c})" for k, r, c in ((k, round(-k * 0.20791169081775945), round(-k * 0.9781476007338057)) for k in range(1, 11)))
_TERRAIN = f"""{_S}, {_AR}, g AS (SELECT row, col, h, ((z[1] + 2 * z[4] + z[7]) - (z[3] + 2 * z[6] + z[9])) / 8 / 400.0::DOUBLE AS dx, ((z[7] + 2 * z[8] + z[9]) - (z[1] + 2 * z[2] + z[3])) / 8 / 400.0::DOUBLE AS dy FROM ar),
 sa AS MATERIALIZED (SELECT row, col, h, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, degrees(atan2(dy, -dx)) + CASE WHEN degrees(atan2(dy, -dx)) < 0 THEN 360 ELSE 0 END AS aspect FROM g), st(k, dr, dc) AS (VALUES {_STEPS}),
 bl AS (SELECT a.row, a.col, bool_or(atan2(f.h - a.h, k * 400.0) > radians(51.0)) AS hidden FROM sa a, st JOIN sa f ON f.row = least(greatest(a.row + dr, 0), (SELECT max(row) FROM sc)) AND f.col = least(greatest(a.col + dc, 0), 149) GROUP BY 1, 2),
 tl AS MATERIALIZED (SELECT row, col, h, slope, aspect, {g._lia(39.0)} AS lia, {g._lia(39.0)} >= 90.0 OR hidden AS shadow, radians(slope) * cos(radians(aspect) - radians(78.0)) > radians(51.0) AS layover, slope <= 15 AS plausible FROM sa JOIN bl USING (row, col)),
 te AS MATERIALIZED (SELECT *, NOT shadow AND NOT layover AND plausible AS observable FROM tl)"""
_WET = f"""{_TERRAIN}, mk AS (SELECT row, col, coalesce(observable AND post - pre <= 2.0 AND post <= -6.0, false) AS m FROM sc JOIN te USING (row, col)), {g._morph('mk', 'oo', g._CLOSE + g._OPEN)}, {g._labels('oo', True).replace('row * 20 + col', 'row * 150 + col')},
 big AS (SELECT row, col FROM labels_ WHERE label IN (SELECT label FROM labels_ GROUP BY 1 HAVING count(*) >= 4)), mask_ AS (SELECT sc.row, sc.col, (CASE WHEN pre IS NULL THEN 255 WHEN big.row IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS mask,
 CASE WHEN pre IS NOT NULL AND big.row IS NOT NULL THEN (least(greatest((2.0::DOUBLE - (post - pre)) / 2.0::DOUBLE, 0.0), 1.0) + least(greatest((-6.0::DOUBLE - post) / 10.0::DOUBLE, 0.0), 1.0)) / 2 ELSE 0.0 END AS confidence FROM sc LEFT JOIN big ON big.row = sc.row AND big.col = sc.col)"""
_MIRROR = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > {1} THEN 2 * {1} + 1 - ({0}) ELSE {0} END"
SQL = {
    "scene_terrain": f"WITH {_TERRAIN} SELECT row, col, {_R.format('h', 4)} AS elevation, {_R.format('slope', 4)} AS slope, {_R.format('lia', 4)} AS incidence, CASE WHEN slope > 1e-9 THEN {_R.format('aspect', 3)} ELSE 0.0 END AS aspect, shadow, layover, plausible, observable FROM te",
    "scene_mountain_mask": f"WITH RECURSIVE {_WET} SELECT row, col, mask, {_R.format('confidence', 5)} AS confidence FROM mask_",
    "scene_statistics": f"WITH RECURSIVE {_WET}, c AS (SELECT count(*) FILTER (WHERE mask = 1) AS w, count(*) FILTER (WHERE mask <> 255) AS v, coalesce(avg(confidence) FILTER (WHERE mask = 1), 0.0) AS k FROM mask_) SELECT w AS flooded_pixels, v AS valid_pixels, {_R.format('w * 160000.0::DOUBLE / 1e6', 3)} AS area_km2, {_R.format('w * 100.0::DOUBLE / greatest(v, 1)', 3)} AS percent, {_R.format('k', 3)} AS confidence FROM c",
    "scene_median_5x5": f"""WITH {_S}, hi AS (SELECT max(row) AS b FROM sc), o AS (SELECT a.range AS dr, b.range AS dc FROM range(-2, 3) a, range(-2, 3) b), n AS (SELECT sc.row, sc.col, {_MIRROR.format('sc.row + dr', 'hi.b')} AS r2, {_MIRROR.format('sc.col + dc', '149')} AS c2 FROM sc, hi, o)
 SELECT n.row, n.col, {_R.format('list_sort(list(s.post))[13]', 4)} AS median FROM n JOIN sc s ON s.row = n.r2 AND s.col = n.c2 GROUP BY 1, 2""",
    "scene_resampled": f"""WITH {_S}, t AS (SELECT row, col, ((col * 150.0::DOUBLE + 75) - 25.0::DOUBLE) / 100 - 0.5 AS sx, ((row * -150.0::DOUBLE - 75) + 10.0::DOUBLE) / -100 - 0.5 AS sy FROM sc WHERE row * 3 < 2 * (SELECT max(row) + 1 FROM sc) AND col < 100),
 u AS (SELECT t.row, t.col, (floor(sy) + i.range)::INTEGER AS r2, (floor(sx) + j.range)::INTEGER AS c2, CASE WHEN i.range = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END * CASE WHEN j.range = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END AS w FROM t, range(2) i, range(2) j),
 v AS (SELECT u.row, u.col, sum(w * pre) / sum(w) AS v FROM u JOIN sc ON sc.row = r2 AND sc.col = c2 WHERE w > 0 AND pre IS NOT NULL GROUP BY 1, 2) SELECT t.row, t.col, {_R.format('v', 6)} AS v FROM t LEFT JOIN v ON v.row = t.row AND v.col = t.col""",
    "rasterized_triangles": """WITH p AS (SELECT p_partkey AS id, (p_partkey * 17 % 1950) / 10.0::DOUBLE AS x, (p_partkey * 29 % 2950) / 10.0::DOUBLE AS y, p_size % 5 AS s FROM part), t AS (SELECT id, [x, x + 1.1::DOUBLE + s, x + 0.4::DOUBLE] AS xs, [y, y + 0.3::DOUBLE, y + 2.2::DOUBLE] AS ys FROM p),
 c AS (SELECT id, xs, ys, unnest(range(floor(list_min(ys))::INTEGER, floor(list_max(ys))::INTEGER + 1)) AS row FROM t), d AS (SELECT id, xs, ys, row, unnest(range(floor(list_min(xs))::INTEGER, floor(list_max(xs))::INTEGER + 1)) AS col FROM c),
 e AS (SELECT id, row, col, len(list_filter([1, 2, 3], lambda i: ((ys[i] > row + 0.5) <> (ys[i % 3 + 1] > row + 0.5)) AND (col + 0.5 < (xs[i % 3 + 1] - xs[i]) * (row + 0.5::DOUBLE - ys[i]) / (ys[i % 3 + 1] - ys[i]) + xs[i]))) AS n FROM d)
 SELECT row::INTEGER AS row, col::INTEGER AS col, min(id) AS id FROM e WHERE n % 2 = 1 GROUP BY 1, 2""",
    "padded_grid": f"""WITH {g._PX}, r AS (SELECT range AS i, CASE WHEN range < 30 THEN range ELSE 58 - range END AS s FROM range(36)), c AS (SELECT range AS j, CASE WHEN range < 20 THEN range ELSE 38 - range END AS s FROM range(36))
 SELECT i::INTEGER AS row, j::INTEGER AS col, {_R.format('coalesce(post, 0.0)', 4)} AS v FROM r, c JOIN px ON px.row = r.s AND px.col = c.s""",
    "tile_inference": f"WITH {_S}, p AS (SELECT row, col, CASE WHEN pre IS NULL THEN 0.0 ELSE least(greatest((pre - post) / 10 + 0.5, 0.0), 1.0) END AS p FROM sc) SELECT row, col, {_R.format('p', 5)} AS p, (CASE WHEN p >= 0.5 - 1e-12 THEN 1 ELSE 0 END)::INTEGER AS mask FROM p",
}
