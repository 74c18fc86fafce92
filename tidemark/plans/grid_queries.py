"""Raster queries: days are rows, users modulo 20 columns; mean view and click values are the images before and after."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions.expr import rounded
from tidemark.operators import grid
from tidemark.session import table

H, W = 30, 20


def pixels(spark, sf):
    """Every cell of the grid; pre and post are NULL where no event fell."""
    e = table(spark, sf, "events").where("event_type IN ('view', 'click')")
    v, kind = F.col("value").cast("decimal(18,4)"), F.col("event_type")
    mean = lambda k: F.sum(F.when(kind == k, v)).cast("double") / F.nullif(F.count_if(kind == k), F.lit(0))
    have = e.groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("row"), (F.col("user_id") % W).cast("int").alias("col")).agg(mean("view").alias("pre"), mean("click").alias("post"))
    every = spark.range(H * W).select((F.col("id") / W).cast("int").alias("row"), (F.col("id") % W).cast("int").alias("col"))
    return every.join(have, ["row", "col"], "left")


WATER, DROP = 45.0, 5.0


def _flood(p):
    return p.withColumn("flood", F.coalesce((F.col("post") < WATER) & (F.col("post") - F.col("pre") < -DROP), F.lit(False)))


def flood_summary(spark, sf):
    p = _flood(pixels(spark, sf))
    valid, wet = F.count_if(F.col("pre").isNotNull() & F.col("post").isNotNull()), F.count_if("flood")
    return p.agg(wet.alias("flooded_pixels"), valid.alias("valid_pixels"), F.count("*").alias("total_pixels"), rounded(wet * 100.0 / F.greatest(valid, F.lit(1)), 2).alias("flooded_percent"), rounded(wet * 100.0 / 1e6, 4).alias("area_km2"))


def flood_mask_dual_threshold(spark, sf):
    return _flood(pixels(spark, sf)).select("row", "col", "flood")


def flood_mask_mountain(spark, sf):
    """Inclusive thresholds, valid terrain only, with confidence; 255 where there is no data."""
    p = pixels(spark, sf)
    ok = F.col("pre").isNotNull() & F.col("post").isNotNull()
    wet = (F.col("post") - F.col("pre") <= -DROP) & (F.col("post") <= WATER) & ((F.col("row") + F.col("col")) % 7 != 0)
    return p.select("row", "col", F.when(~ok, 255).when(wet, 1).otherwise(0).alias("mask"), F.when(ok, rounded(expr.flood_confidence(F.col("pre"), F.col("post"), -DROP, WATER), 6)).alias("confidence"))


def median_filter_3x3(spark, sf):
    p = pixels(spark, sf).withColumn("v", F.coalesce("post", F.lit(0.0)))
    return grid.median_filter(p, "v", "m").select("row", "col", rounded(F.col("m"), 6).alias("median"))


def lee_filter(spark, sf):
    return grid.lee_filter(pixels(spark, sf), "post", "lee").select("row", "col", rounded(F.col("lee"), 4).alias("lee"))


def _mask(spark, sf):
    return pixels(spark, sf).select("row", "col", (F.coalesce("post", F.lit(99.0)) < 55.0).alias("m"))


def morph_open_close(spark, sf):
    m = _mask(spark, sf)
    a = grid.opened(m, "m").withColumnRenamed("m", "opened")
    b = grid.closed(m, "m").withColumnRenamed("m", "closed")
    c = grid.opened_even(m, "m").withColumnRenamed("m", "opened_even")
    return a.join(b, ["row", "col"]).join(c, ["row", "col"])


def label_components_4(spark, sf):
    return grid.label(_mask(spark, sf), "m", W)


def label_components_8(spark, sf):
    return grid.label(_mask(spark, sf), "m", W, diagonal=True)


def min_pixels_filter(spark, sf):
    return grid.large_enough(label_components_4(spark, sf), 5)


def polygon_areas(spark, sf):
    """Area, perimeter and box of each component: an edge between two of its pixels counts for neither."""
    x = label_components_4(spark, sf)
    right = x.select("row", (F.col("col") - 1).alias("col"), F.lit(1).alias("r"))
    down = x.select((F.col("row") - 1).alias("row"), "col", F.lit(1).alias("d"))
    y = x.join(right, ["row", "col"], "left").join(down, ["row", "col"], "left")
    return y.groupBy("label").agg((F.count("*") * 100.0).alias("area_m2"), ((F.count("*") * 4 - 2 * F.count("r") - 2 * F.count("d")) * 10.0).alias("perimeter_m"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))


def baseline_flood_mask(spark, sf):
    """The whole lowland mask: median filters, dual test, opening, components of at least 3 pixels."""
    p = pixels(spark, sf)
    ok = F.col("pre").isNotNull() & F.col("post").isNotNull()
    p = p.select("row", "col", ok.alias("ok"), F.when(ok, F.col("pre")).otherwise(0.0).alias("a"), F.when(ok, F.col("post")).otherwise(0.0).alias("b"))
    p = grid.median_filter(grid.median_filter(p, "a", "fa"), "b", "fb")
    p = p.select("row", "col", (F.col("ok") & (F.col("fb") < 48.0) & (F.col("fb") - F.col("fa") < 3.0)).alias("m"))
    return grid.large_enough(grid.label(grid.opened(p, "m"), "m", W), 3)


def mountain_flood_mask(spark, sf):
    """The whole mountain mask: dual test, closing before opening, 8-connected components of at least 3 pixels."""
    p = pixels(spark, sf)
    wet = F.coalesce((F.col("post") - F.col("pre") <= 3.0) & (F.col("post") <= 60.0), F.lit(False))
    return grid.large_enough(grid.label(grid.opened(grid.closed(p.select("row", "col", wet.alias("m")), "m"), "m"), "m", W, diagonal=True), 3)


def _terrain(spark, sf):
    p = pixels(spark, sf).select("row", "col", (F.coalesce("pre", F.lit(50.0)) * 20).alias("z"))
    return grid.slope_aspect(p, "z", 400.0, 400.0)


def terrain_slope_aspect(spark, sf):
    return _terrain(spark, sf).select("row", "col", rounded(F.col("slope"), 5).alias("slope"), F.when(F.col("slope") > 1e-9, rounded(F.col("aspect"), 4)).otherwise(0.0).alias("aspect"))


def terrain_lia_layover(spark, sf):
    t = _terrain(spark, sf)
    lia = grid.incidence(F.col("slope"), F.col("aspect"), 78.0, 39.0)
    return t.select("row", "col", rounded(lia, 4).alias("lia"), grid.layover(F.col("slope"), F.col("aspect"), 78.0, 39.0).alias("layover"), (F.col("slope") <= 15).alias("plausible"))


def terrain_shadow(spark, sf):
    t = _terrain(spark, sf)
    steep = t.select("row", "col", (grid.incidence(F.col("slope"), F.col("aspect"), 78.0, 80.0) >= 90.0).alias("steep"))
    hidden = grid.blocked(t, "z", H, W, 400.0, 78.0, 80.0)
    return steep.join(hidden, ["row", "col"]).select("row", "col", (F.col("steep") | F.col("blocked")).alias("shadow"))


def tile_grid(spark, sf):
    return grid.tiles(spark, H, W, 8, 5)


def overlap_add_blend(spark, sf):
    """Predictions of overlapping tiles, here the pixel's own value shifted by its tile, blended."""
    t = grid.tiles(spark, H, W, 8, 5).select("tile_row", "tile_col", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    t = t.select((F.col("tile_row") + F.col("i")).alias("row"), (F.col("tile_col") + F.col("j")).alias("col"), ((F.col("tile_row") + F.col("tile_col")) % 3).alias("shift"), grid.tile_weight(F.col("i"), F.col("j"), 8).alias("w"))
    x = t.join(pixels(spark, sf), ["row", "col"]).select("row", "col", (F.coalesce("post", F.lit(0.0)) + F.col("shift")).alias("p"), "w")
    return grid.blend(x).select("row", "col", rounded(F.col("p"), 6).alias("p"))


QUERIES = {f.__name__: f for f in (flood_summary, flood_mask_dual_threshold, flood_mask_mountain, median_filter_3x3, lee_filter, morph_open_close, label_components_4, label_components_8, min_pixels_filter, polygon_areas, baseline_flood_mask, mountain_flood_mask, terrain_slope_aspect, terrain_lia_layover, terrain_shadow, tile_grid, overlap_add_blend)}

_R = "floor(({0}) * 1e{1} + 0.5) / 1e{1}"
_PX = """e AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS row, (user_id % 20)::INTEGER AS col,
  sum(value::DECIMAL(18,4)) FILTER (WHERE event_type = 'view')::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS pre,
  sum(value::DECIMAL(18,4)) FILTER (WHERE event_type = 'click')::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS post FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
px AS (SELECT (g.range // 20)::INTEGER AS row, (g.range % 20)::INTEGER AS col, pre, post FROM range(600) g LEFT JOIN e ON e.row = g.range // 20 AND e.col = g.range % 20)"""


def _around(source: str, value: str, name: str) -> str:
    """CTEs name3 and name: the nine values around each pixel of source."""
    return f"""{name}3 AS (SELECT *, [CASE WHEN col = 0 THEN {value} ELSE lag({value}) OVER r END, {value}, CASE WHEN col = 19 THEN {value} ELSE lead({value}) OVER r END] AS t FROM {source} WINDOW r AS (PARTITION BY row ORDER BY col)),
{name} AS (SELECT * EXCLUDE (t), list_concat(list_concat(CASE WHEN row = 0 THEN t ELSE lag(t) OVER c END, t), CASE WHEN row = 29 THEN t ELSE lead(t) OVER c END) AS z FROM {name}3 WINDOW c AS (PARTITION BY col ORDER BY row))"""


def _morph(source: str, name: str, steps: list[tuple[bool, int, int]]) -> str:
    """CTEs that erode (true) or dilate over windows lo..hi; the last is called name."""
    out, at = [], source
    for k, (erode, lo, hi) in enumerate(steps):
        for a, o in (("col", "row"), ("row", "col")):
            frame = f"OVER (PARTITION BY {o} ORDER BY {a} RANGE BETWEEN {-lo} PRECEDING AND {hi} FOLLOWING)"
            v = f"(min(m::INTEGER) {frame} = 1 AND count(*) {frame} = {hi - lo + 1})" if erode else f"(max(m::INTEGER) {frame} = 1)"
            last = k == len(steps) - 1 and a == "row"
            nxt = name if last else f"{name}_{k}{a}"
            out.append(f"{nxt} AS (SELECT row, col, {v} AS m FROM {at})")
            at = nxt
    return ", ".join(out)


def _labels(source: str, diagonal: bool) -> str:
    near = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1" if diagonal else "abs(a.row - b.row) + abs(a.col - b.col) <= 1"
    return f"""on_ AS MATERIALIZED (SELECT row, col, (row * 20 + col)::BIGINT AS id FROM {source} WHERE m), ed AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM on_ a JOIN on_ b ON {near}),
rc AS (SELECT id AS x, id AS root FROM on_ UNION SELECT ed.y, rc.root FROM rc JOIN ed ON rc.x = ed.x WHERE ed.y > rc.root), lb AS (SELECT x, min(root) AS label FROM rc GROUP BY 1), labels_ AS (SELECT row, col, label FROM on_ JOIN lb ON id = x)"""


_BIG = "SELECT label, row, col, n AS pixels FROM labels_ JOIN (SELECT label, count(*) AS n FROM labels_ GROUP BY 1) USING (label) WHERE n >= {0}"
_MASK = f"{_PX}, mk AS (SELECT row, col, coalesce(post, 99.0) < 55.0 AS m FROM px)"
_OPEN, _CLOSE = [(True, -1, 1), (False, -1, 1)], [(False, -1, 1), (True, -1, 1)]
_HORN = f"""{_PX}, zz AS (SELECT row, col, coalesce(pre, 50.0) * 20 AS h FROM px), {_around('zz', 'h', 'ar')},
g AS (SELECT row, col, h, ((z[1] + 2 * z[4] + z[7]) - (z[3] + 2 * z[6] + z[9])) / 8 / 400.0::DOUBLE AS dx, ((z[7] + 2 * z[8] + z[9]) - (z[1] + 2 * z[2] + z[3])) / 8 / 400.0::DOUBLE AS dy FROM ar),
sa AS (SELECT row, col, h, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, degrees(atan2(dy, -dx)) + CASE WHEN degrees(atan2(dy, -dx)) < 0 THEN 360 ELSE 0 END AS aspect FROM g)"""


def _lia(nominal: float) -> str:
    return f"degrees(acos(least(greatest(cos(radians({nominal})) * cos(radians(slope)) + sin(radians({nominal})) * sin(radians(slope)) * cos(radians(aspect) - radians(78.0)), -1.0), 1.0)))"


_SHADOW_STEPS = ", ".join(f"({k}.0::DOUBLE, {r}, {c})" for k, r, c in ((k, round(-k * 0.20791169081775945), round(-k * 0.9781476007338057)) for k in range(1, 11)))
SQL = {
    "flood_summary": f"WITH RECURSIVE {_PX}, f AS (SELECT *, coalesce(post < 45.0 AND post - pre < -5.0, false) AS flood FROM px) SELECT count(*) FILTER (WHERE flood) AS flooded_pixels, count(*) FILTER (WHERE pre IS NOT NULL AND post IS NOT NULL) AS valid_pixels, count(*) AS total_pixels, {_R.format('count(*) FILTER (WHERE flood) * 100.0::DOUBLE / greatest(count(*) FILTER (WHERE pre IS NOT NULL AND post IS NOT NULL), 1)', 2)} AS flooded_percent, {_R.format('count(*) FILTER (WHERE flood) * 100.0::DOUBLE / 1e6', 4)} AS area_km2 FROM f",
    "flood_mask_dual_threshold": f"WITH {_PX} SELECT row, col, coalesce(post < 45.0 AND post - pre < -5.0, false) AS flood FROM px",
    "flood_mask_mountain": f"WITH {_PX} SELECT row, col, (CASE WHEN pre IS NULL OR post IS NULL THEN 255 WHEN post - pre <= -5.0 AND post <= 45.0 AND (row + col) % 7 <> 0 THEN 1 ELSE 0 END)::INTEGER AS mask, CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN {_R.format('(least(greatest((-5.0::DOUBLE - (post - pre)) / 5.0::DOUBLE, 0.0), 1.0) + least(greatest((45.0::DOUBLE - post) / 10.0::DOUBLE, 0.0), 1.0)) / 2', 6)} END AS confidence FROM px",
    "median_filter_3x3": f"WITH {_PX}, v AS (SELECT row, col, coalesce(post, 0.0) AS v FROM px), {_around('v', 'v', 'ar')} SELECT row, col, {_R.format('list_sort(z)[5]', 6)} AS median FROM ar",
    "lee_filter": f"""WITH {_PX}, {_around('px', 'post', 'ar')}, h AS (SELECT row, col, post, list_filter(z, lambda x: x IS NOT NULL) AS z FROM ar),
 s AS (SELECT row, col, post, CASE WHEN len(z) > 0 THEN list_sum(z) / len(z) END AS m, CASE WHEN len(z) > 0 THEN greatest(list_sum(list_transform(z, lambda x: x * x)) / len(z) - (list_sum(z) / len(z)) * (list_sum(z) / len(z)), 0.0) END AS v FROM h), n AS (SELECT median(v) AS noise FROM s)
 SELECT row, col, CASE WHEN post IS NOT NULL THEN {_R.format('m + least(greatest(v / (v + noise + 1e-10), 0.0), 1.0) * (post - m)', 4)} END AS lee FROM s, n""",
    "morph_open_close": f"WITH {_MASK}, {_morph('mk', 'oo', _OPEN)}, {_morph('mk', 'cc', _CLOSE)}, {_morph('mk', 'ee', [(True, -1, 0), (False, 0, 1)])} SELECT row, col, oo.m AS opened, cc.m AS closed, ee.m AS opened_even FROM oo JOIN cc USING (row, col) JOIN ee USING (row, col)",
    "label_components_4": f"WITH RECURSIVE {_MASK}, {_labels('mk', False)} SELECT * FROM labels_",
    "label_components_8": f"WITH RECURSIVE {_MASK}, {_labels('mk', True)} SELECT * FROM labels_",
    "min_pixels_filter": f"WITH RECURSIVE {_MASK}, {_labels('mk', False)} {_BIG.format(5)}",
    "polygon_areas": f"WITH RECURSIVE {_MASK}, {_labels('mk', False)} SELECT a.label, count(*) * 100.0::DOUBLE AS area_m2, (count(*) * 4 - 2 * count(b.row) - 2 * count(c.row)) * 10.0::DOUBLE AS perimeter_m, min(a.row) AS top, max(a.row) AS bottom, min(a.col) AS left, max(a.col) AS right FROM labels_ a LEFT JOIN labels_ b ON b.row = a.row AND b.col = a.col + 1 LEFT JOIN labels_ c ON c.row = a.row + 1 AND c.col = a.col GROUP BY 1",
    "baseline_flood_mask": f"""WITH RECURSIVE {_PX}, v AS (SELECT row, col, pre IS NOT NULL AND post IS NOT NULL AS ok, CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN pre ELSE 0.0 END AS a, CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN post ELSE 0.0 END AS b FROM px),
 {_around('v', 'a', 'aa')}, {_around('v', 'b', 'bb')}, mk AS (SELECT row, col, aa.ok AND list_sort(bb.z)[5] < 48.0 AND list_sort(bb.z)[5] - list_sort(aa.z)[5] < 3.0 AS m FROM aa JOIN bb USING (row, col)), {_morph('mk', 'oo', _OPEN)}, {_labels('oo', False)} {_BIG.format(3)}""",
    "mountain_flood_mask": f"WITH RECURSIVE {_PX}, mk AS (SELECT row, col, coalesce(post - pre <= 3.0 AND post <= 60.0, false) AS m FROM px), {_morph('mk', 'oo', _CLOSE + _OPEN)}, {_labels('oo', True)} {_BIG.format(3)}",
    "terrain_slope_aspect": f"WITH {_HORN} SELECT row, col, {_R.format('slope', 5)} AS slope, CASE WHEN slope > 1e-9 THEN {_R.format('aspect', 4)} ELSE 0.0 END AS aspect FROM sa",
    "terrain_lia_layover": f"WITH {_HORN} SELECT row, col, {_R.format(_lia(39.0), 4)} AS lia, radians(slope) * cos(radians(aspect) - radians(78.0)) > radians(51.0) AS layover, slope <= 15 AS plausible FROM sa",
    "terrain_shadow": f"""WITH {_HORN}, st(k, dr, dc) AS (VALUES {_SHADOW_STEPS}), b AS (SELECT a.row, a.col, bool_or(atan2(f.h - a.h, k * 400.0) > radians(10.0)) AS hidden FROM sa a, st JOIN sa f ON f.row = least(greatest(a.row + dr, 0), 29) AND f.col = least(greatest(a.col + dc, 0), 19) GROUP BY 1, 2)
 SELECT row, col, {_lia(80.0)} >= 90.0 OR hidden AS shadow FROM sa JOIN b USING (row, col)""",
    "tile_grid": "SELECT r AS tile_row, c AS tile_col FROM (SELECT unnest(list_distinct(list_concat(range(0, 23, 5), [22])))::INTEGER AS r), (SELECT unnest(list_distinct(list_concat(range(0, 13, 5), [12])))::INTEGER AS c)",
    "overlap_add_blend": f"""WITH {_PX}, t AS (SELECT r, c FROM (SELECT unnest([0, 5, 10, 15, 20, 22]) AS r), (SELECT unnest([0, 5, 10, 12]) AS c)),
 x AS (SELECT r + i.range AS row, c + j.range AS col, (r + c) % 3 AS shift, greatest((1 - cos(i.range * (2 * pi() / 7))) / 2 * ((1 - cos(j.range * (2 * pi() / 7))) / 2), 1e-4) AS w FROM t, range(8) i, range(8) j)
 SELECT px.row, px.col, {_R.format('sum((coalesce(post, 0.0) + shift) * w) / greatest(sum(w), 1e-8)', 6)} AS p FROM x JOIN px ON px.row = x.row AND px.col = x.col GROUP BY 1, 2""",
}
