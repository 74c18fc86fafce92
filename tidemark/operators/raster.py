"""Raster operators beyond neighbourhoods of three: wide medians, resampling, rasterising, padding, tiles, terrain
products, the whole mountain mask, and predictions of a scorer over overlapping tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shapes
from tidemark.functions.expr import flood_confidence, is_finite
from tidemark.operators import grid
from tidemark.session import dealt


def checked(pre, post, is_db: bool, drop: float, speckle: int, least: int) -> None:
    """Refuses shapes and parameters of a flood mask that make no sense: TypeError for wrong kinds, else ValueError."""
    if pre is None or post is None:
        raise ValueError("both images are needed")
    if len(pre) != 2 or tuple(pre) != tuple(post) or not all(n > 0 for n in pre):
        raise ValueError("both images must have the same two sizes above 0")
    if not isinstance(is_db, bool):
        raise TypeError("is_db must be a bool")
    if isinstance(speckle, bool) or not isinstance(speckle, int):
        raise TypeError("the filter size must be an int")
    if speckle < 1 or speckle % 2 == 0:
        raise ValueError("the filter size must be odd and above 0")
    if not np.isfinite(drop) or drop <= 0:
        raise ValueError("the drop must be finite and above 0")
    if isinstance(least, bool) or not isinstance(least, int) or least < 0:
        raise ValueError("the least number of pixels must be an int from 0 on")


def band(bands: DataFrame, name: str = "vv") -> DataFrame:
    """The band (raster_id, band, description) whose description holds the name, the first of several; else the first."""
    first = F.struct(F.when(F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(name)), 0).otherwise(1).alias("other"), F.col("band"))
    return bands.groupBy("raster_id").agg(F.min(first)["band"].alias("band"))


def pixels_of(tiles: DataFrame) -> DataFrame:
    """raster_id, band, row, col, v of tiles (raster_id, band, tile_row, tile_col, w, data: values row by row), the place
    of a tile in pixels; NaN, infinite and missing values are NULL."""
    x = tiles.select("raster_id", "band", "tile_row", "tile_col", "w", F.posexplode("data").alias("i", "v"))
    return x.select("raster_id", "band", (F.col("tile_row") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("row"), (F.col("tile_col") + F.col("i") % F.col("w")).cast("int").alias("col"), F.when(is_finite(F.col("v")), F.col("v")).alias("v"))


def tiles_of(pixels: DataFrame, size: int) -> DataFrame:
    """The tiles of pixels (raster_id, band, row, col, v), size by size at most; a tile holds a bounded number of values."""
    own = lambda c: (F.floor(F.col(c) / size) * size).cast("int")
    t = pixels.groupBy("raster_id", "band", own("row").alias("tile_row"), own("col").alias("tile_col")).agg(F.array_sort(F.collect_list(F.struct("row", "col", "v"))).alias("p"))
    w = F.array_max(F.transform("p", lambda s: s["col"])) - F.col("tile_col") + 1
    return t.select("raster_id", "band", "tile_row", "tile_col", (F.array_max(F.transform("p", lambda s: s["row"])) - F.col("tile_row") + 1).alias("h"), w.alias("w"), F.transform("p", lambda s: s["v"]).alias("data"))


def population(pixels: DataFrame, nodata: float) -> DataFrame:
    """v with nodata, NaN, infinite, missing and negative values as 0."""
    v = F.col("v")
    return pixels.withColumn("v", F.when(is_finite(v) & (v != nodata) & (v > 0), v).otherwise(0.0))


def cell_of(x: Column, y: Column, a: float, c: float, e: float, f: float) -> tuple[Column, Column]:
    """Row and column of a place in a raster whose north-up transform has the pixel sizes a, e and the corner c, f."""
    return F.floor((y - f) / e).cast("int"), F.floor((x - c) / a).cast("int")


def wide_neighbourhood(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """The k * k values around each pixel (k odd), beyond borders mirrored with the edge repeated; in no order. Two
    window passes; a side must have k // 2 pixels at least."""
    h = k // 2

    def along(d: DataFrame, axis: str, other: str, v: str, nested: bool) -> DataFrame:
        line = Window.partitionBy(other).orderBy(axis)
        d = d.withColumn("_all", F.collect_list(v).over(line.rowsBetween(-h, h))).withColumn("_n", F.row_number().over(line)).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(other)))
        before, after = F.greatest(h + 1 - F.col("_n"), F.lit(0)), F.greatest(F.col("_n") + h - F.col("_size"), F.lit(0)).cast("int")
        some = F.concat(F.slice("_all", F.lit(1), before), F.col("_all"), F.when(after > 0, F.slice("_all", -after, after)).otherwise(F.slice("_all", F.lit(1), F.lit(0))))
        return d.withColumn(v if nested else "_line", F.flatten(some) if nested else some).drop("_all", "_n", "_size")

    x = along(df, "col", "row", value, False)
    return along(x, "row", "col", "_line", True).withColumnRenamed("_line", out)


def wide_median(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """The median of the k * k neighbourhood; no value may be NULL."""
    return wide_neighbourhood(df, value, k, "_wide").withColumn(out, F.sort_array("_wide")[k * k // 2]).drop("_wide")


def resampled(target: DataFrame, source: DataFrame, own: tuple[float, float, float, float], other: tuple[float, float, float, float]) -> DataFrame:
    """row, col, v of the target's pixels from the source's (row, col, v) by bilinear weights; transforms a, c, e, f of
    both in one projection. Pixels without a value count nowhere; where all four have none, v is NULL."""
    a, c, e, f = own
    a2, c2, e2, f2 = other
    x, y = F.col("col") * a + (a / 2 + c), F.col("row") * e + (e / 2 + f)
    t = target.select("row", "col", ((x - c2) / a2 - 0.5).alias("sx"), ((y - f2) / e2 - 0.5).alias("sy"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = t.select("row", "col", "sx", "sy", corner.alias("o"))
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    w = F.when(F.col("o.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("o.j") == 1, fx).otherwise(1 - fx)
    t = t.select("row", "col", (F.floor("sy") + F.col("o.i")).cast("int").alias("r2"), (F.floor("sx") + F.col("o.j")).cast("int").alias("c2"), w.alias("w")).where("w > 0")
    have = source.where(is_finite(F.col("v"))).select(F.col("row").alias("r2"), F.col("col").alias("c2"), "v")
    sums = t.join(have, ["r2", "c2"]).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return target.select("row", "col").join(sums, ["row", "col"], "left")


def rasterized(rings: DataFrame) -> DataFrame:
    """row, col and the least id of the rings (id, ring) that hold a pixel's centre."""
    end = lambda f, k: F.floor(f(F.transform("ring", lambda p: p[k]))).cast("int")
    rows = rings.where(F.size("ring") >= 3).select("id", "ring", F.explode(F.sequence(end(F.array_min, "y"), end(F.array_max, "y"))).alias("row"), end(F.array_min, "x").alias("lo"), end(F.array_max, "x").alias("hi"))
    cells = rows.select("id", "ring", "row", F.explode(F.sequence("lo", "hi")).alias("col"))
    return cells.where(shapes.inside_ring(F.col("col") + 0.5, F.col("row") + 0.5, F.col("ring"))).groupBy("row", "col").agg(F.min("id").alias("id"))


def padded(df: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """The raster grown to `size` by mirroring at its far edges without repeating them."""
    place = lambda c, n: F.explode(F.array_compact(F.array(F.col(c), F.when((2 * (n - 1) - F.col(c) >= n) & (2 * (n - 1) - F.col(c) < size), 2 * (n - 1) - F.col(c)))))
    rest = [c for c in df.columns if c not in ("row", "col")]
    return df.select(place("row", height).alias("row"), "col", *rest).select("row", place("col", width).alias("col"), *rest)


def terrain(df: DataFrame, elevation: str, height: int, width: int, pixel: float, look: float, nominal: float, steepest: float = 15.0) -> DataFrame:
    """Eight layers of a scene: elevation, slope, aspect, incidence, shadow, layover, plausible (not too steep) and
    observable (plausible and in no shadow or layover)."""
    t = grid.slope_aspect(df.select("row", "col", F.col(elevation).alias("elevation")), "elevation", pixel, pixel)
    t = t.withColumn("incidence", grid.incidence(F.col("slope"), F.col("aspect"), look, nominal)).withColumn("layover", grid.layover(F.col("slope"), F.col("aspect"), look, nominal))
    t = t.join(dealt(grid.blocked(df, elevation, height, width, pixel, look, nominal)), ["row", "col"])
    t = t.withColumn("shadow", (F.col("incidence") >= 90.0) | F.col("blocked")).withColumn("plausible", F.col("slope") <= steepest)
    return t.select("row", "col", "elevation", "slope", "aspect", "incidence", "shadow", "layover", "plausible", (~F.col("shadow") & ~F.col("layover") & F.col("plausible")).alias("observable"))


def mountain_mask(df: DataFrame, layers: DataFrame, width: int, drop: float, water: float, least: int) -> DataFrame:
    """row, col, mask (1 flood, 0 dry, 255 without data) and confidence: inclusive dual test on observable pixels,
    closing, opening, 8-connected components of at least `least` pixels."""
    x = df.join(dealt(layers.select("row", "col", "observable")), ["row", "col"])
    ok = is_finite(F.col("pre")) & is_finite(F.col("post"))
    x = x.select("row", "col", "pre", "post", ok.alias("ok"), (ok & F.col("observable") & (F.col("post") - F.col("pre") <= drop) & (F.col("post") <= water)).alias("m"))
    m = grid.opened(grid.closed(x.select("row", "col", "m"), "m"), "m")
    big = grid.large_enough(grid.label(m, "m", width, diagonal=True), least).select("row", "col", F.lit(True).alias("wet"))
    wet = F.col("ok") & F.coalesce("wet", F.lit(False))
    return x.join(dealt(big), ["row", "col"], "left").select("row", "col", F.when(~F.col("ok"), 255).when(wet, 1).otherwise(0).alias("mask"), F.when(wet, flood_confidence(F.col("pre"), F.col("post"), drop, water)).otherwise(0.0).alias("confidence"))


def mask_statistics(mask: DataFrame, pixel_m2: float) -> DataFrame:
    """Flooded and valid pixels, km2, percent of the valid ones, mean confidence of the flooded: one row."""
    wet, valid = F.count_if(F.col("mask") == 1), F.count_if(F.col("mask") != 255)
    return mask.agg(wet.alias("flooded_pixels"), valid.alias("valid_pixels"), (wet * pixel_m2 / 1e6).alias("area_km2"), (wet * 100.0 / F.greatest(valid, F.lit(1))).alias("percent"), F.coalesce(F.avg(F.when(F.col("mask") == 1, F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def predicted(df: DataFrame, channels: list[str], height: int, width: int, size: int, stride: int, scorer: Callable[[np.ndarray], np.ndarray], least: float = 0.5) -> DataFrame:
    """row, col, p and mask by a scorer over overlapping tiles, blended by Hann weights. The scorer gets the channels of
    one tile (channels, size, size; no value as NaN) and returns size by size probabilities; it runs in Python workers,
    a tile at a time. Pixels with a NULL channel are 0."""
    import pyarrow as pa

    spark = df.sparkSession
    places = grid.tiles(spark, height, width, size, stride)
    # Tiles that hold a pixel: the origins are few a side, and each pixel looks only for those of its own rows and columns.
    axis = lambda c, d: places.select(F.col(c).alias(f"t{d}")).distinct().select(f"t{d}", F.explode(F.sequence(F.col(f"t{d}"), F.col(f"t{d}") + size - 1)).alias(d))
    x = df.join(F.broadcast(axis("tile_row", "row")), "row").join(F.broadcast(axis("tile_col", "col")), "col")

    def one(key, table):
        own = np.full((len(channels), size, size), np.nan)
        r, c = table.column("row").to_numpy() - key[0].as_py(), table.column("col").to_numpy() - key[1].as_py()
        for k, name in enumerate(channels):
            own[k, r, c] = table.column(name).to_numpy(zero_copy_only=False).astype(float)
        p = np.asarray(scorer(own), float)[r, c]
        taper = (1 - np.cos(2 * np.pi * np.arange(size) / (size - 1))) / 2
        return pa.table({"row": table.column("row"), "col": table.column("col"), "p": pa.array(p), "w": pa.array(np.maximum(np.outer(taper, taper), 1e-4)[r, c])})

    scored = x.select("trow", "tcol", "row", "col", *channels).groupBy("trow", "tcol").applyInArrow(one, "row int, col int, p double, w double")
    blended = grid.blend(scored.where(~F.isnan("p")))
    ok = F.lit(True)
    for c in channels:
        ok = ok & is_finite(F.col(c))
    return df.join(blended, ["row", "col"], "left").select("row", "col", F.when(ok, F.coalesce("p", F.lit(0.0))).otherwise(0.0).alias("p")).withColumn("mask", (F.col("p") >= least).cast("int"))
