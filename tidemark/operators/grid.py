"""Raster operators on pixel tables (row, col and value columns; a row for every pixel, NULL where it has no data).

Neighbourhoods are built in two window passes, along the rows and along the columns, so a pixel is shuffled twice
however large the kernel is, and no task holds more than one row or one column. With `by`, all operators work on many
rasters in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import dealt


def _line(by: list[str], along: str):
    other = "row" if along == "col" else "col"
    return Window.partitionBy(*by, other).orderBy(along)


def neighbourhood(df: DataFrame, value: str, out: str = "around", by: list[str] | None = None) -> DataFrame:
    """Adds the 9 values of each pixel's 3 x 3 window, row by row; at borders the edge pixel is repeated."""
    by, v = by or [], F.col(value)
    w = _line(by, "col")
    three = F.array(F.lag(v, 1, None).over(w), v, F.lead(v, 1, None).over(w))
    n, last = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*by, "row"))
    three = F.array(F.when(n == 1, v).otherwise(three[0]), v, F.when(n == last, v).otherwise(three[2]))
    df = df.withColumn("_three", three)
    w = _line(by, "row")
    n, last = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*by, "col"))
    t = F.col("_three")
    return df.withColumn(out, F.concat(F.when(n == 1, t).otherwise(F.lag(t).over(w)), t, F.when(n == last, t).otherwise(F.lead(t).over(w)))).drop("_three")


def median_filter(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """The middle of the 9 values; no value may be NULL."""
    return neighbourhood(df, value, "_around", by).withColumn(out, F.sort_array("_around")[4]).drop("_around")


def lee_filter(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Speckle filter m + w * (x - m), w = variance / (variance + noise); noise is the scene's median local variance.
    Pixels without data stay so and count in no window."""
    by = by or []
    df = neighbourhood(df, value, "_around", by)
    have = F.filter("_around", lambda x: x.isNotNull())
    n = F.size(have)
    total = lambda f: F.aggregate(have, F.lit(0.0), lambda a, x: a + f(x))
    df = df.withColumn("_m", F.when(n > 0, total(lambda x: x) / n)).withColumn("_v", F.when(n > 0, F.greatest(total(lambda x: x * x) / n - F.col("_m") * F.col("_m"), F.lit(0.0)))).drop("_around")
    noise = df.groupBy(*by).agg(F.median("_v").alias("_noise"))
    df = df.join(F.broadcast(noise), by) if by else df.crossJoin(F.broadcast(noise))  # a row per scene
    w = F.least(F.greatest(F.col("_v") / (F.col("_v") + F.col("_noise") + 1e-10), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.col("_m") + w * (F.col(value) - F.col("_m")))).drop("_m", "_v", "_noise")


def _pass(df: DataFrame, mask: str, along: str, low: int, high: int, erode: bool, by: list[str]) -> DataFrame:
    w = _line(by, along).rangeBetween(low, high)
    m = F.col(mask).cast("int")
    v = (F.min(m).over(w) == 1) & (F.count(m).over(w) == high - low + 1) if erode else F.max(m).over(w) == 1
    return df.withColumn(mask, v)


def erode(df: DataFrame, mask: str, by: list[str] | None = None, low: int = -1, high: int = 1) -> DataFrame:
    """True where the whole window is; outside counts as false."""
    return reduce(lambda d, a: _pass(d, mask, a, low, high, True, by or []), ("col", "row"), df)


def dilate(df: DataFrame, mask: str, by: list[str] | None = None, low: int = -1, high: int = 1) -> DataFrame:
    return reduce(lambda d, a: _pass(d, mask, a, low, high, False, by or []), ("col", "row"), df)


def opened(df: DataFrame, mask: str, by: list[str] | None = None) -> DataFrame:
    return dilate(erode(df, mask, by), mask, by)


def closed(df: DataFrame, mask: str, by: list[str] | None = None) -> DataFrame:
    """The erosion clears the rim of the image too, as outside counts as false."""
    return erode(dilate(df, mask, by), mask, by)


def opened_even(df: DataFrame, mask: str, by: list[str] | None = None) -> DataFrame:
    """Opening with a 2 x 2 kernel: erodes towards the start, dilates back."""
    return dilate(erode(df, mask, by, -1, 0), mask, by, 0, 1)


def runs(df: DataFrame, mask: str) -> DataFrame:
    """Maximal runs of true pixels in each row: row, lo, hi."""
    w = Window.partitionBy("row").orderBy("col")
    on = df.where(F.col(mask)).select("row", "col").withColumn("g", F.col("col") - F.row_number().over(w))
    return on.groupBy("row", "g").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).drop("g")


def label(df: DataFrame, mask: str, width: int, diagonal: bool = False) -> DataFrame:
    """row, col, label of true pixels; a label is the least row * width + col of its component.

    Runs of rows are the nodes, so components are searched over far fewer nodes than pixels."""
    from tidemark.operators.graph import components

    r = runs(df, mask).withColumn("node", F.col("row").cast("long") * width + F.col("lo"))
    d = 1 if diagonal else 0
    up = r.select((F.col("row") + 1).alias("row"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("node").alias("b"))
    edges = r.join(dealt(up), "row").where((F.col("lo2") <= F.col("hi") + d) & (F.col("hi2") >= F.col("lo") - d)).select(F.col("node").alias("a"), "b")
    found = components(edges)
    r = r.join(dealt(found), "node", "left").select("row", "lo", "hi", F.coalesce("component", "node").alias("label"))
    return r.select("row", F.explode(F.sequence("lo", "hi")).alias("col"), "label")


def large_enough(labels: DataFrame, least: int) -> DataFrame:
    """The pixels of components of at least `least` pixels."""
    big = labels.groupBy("label").agg(F.count("*").alias("pixels")).where(F.col("pixels") >= least)
    return labels.join(dealt(big), "label")


def slope_aspect(df: DataFrame, elevation: str, px: float, py: float, by: list[str] | None = None) -> DataFrame:
    """Slope and aspect in degrees by Horn's weights, edges repeated. The reference's convolution flips its kernels, so
    both gradients have the sign of west minus east and of its row order reversed."""
    df = neighbourhood(df, elevation, "_z", by)
    z = lambda i: F.col("_z")[i]
    east, west = z(2) + 2 * z(5) + z(8), z(0) + 2 * z(3) + z(6)
    north, south = z(0) + 2 * z(1) + z(2), z(6) + 2 * z(7) + z(8)
    dx, dy = (west - east) / 8 / px, (south - north) / 8 / py
    return df.withColumn("slope", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).withColumn("aspect", F.pmod(F.degrees(F.atan2(dy, -dx)), F.lit(360.0))).drop("_z")


def incidence(slope: Column, aspect: Column, look: float, nominal: float) -> Column:
    """Local incidence angle in degrees."""
    s, t = F.radians(slope), F.radians(F.lit(nominal))
    c = F.cos(t) * F.cos(s) + F.sin(t) * F.sin(s) * F.cos(F.radians(aspect) - F.radians(F.lit(look)))
    return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))


def layover(slope: Column, aspect: Column, look: float, nominal: float) -> Column:
    return F.radians(slope) * F.cos(F.radians(aspect) - F.radians(F.lit(look))) > F.radians(F.lit(90.0 - nominal))


def blocked(df: DataFrame, elevation: str, height: int, width: int, pixel: float, look: float, nominal: float, most: float = 4000.0) -> DataFrame:
    """row, col, blocked: whether terrain towards the satellite hides a pixel, looking up to 50 pixels far. Every step
    joins pixels to the one in sight by its place (clamped to the raster)."""
    import math

    dx, dy = -math.sin(math.radians(look)), -math.cos(math.radians(look))
    steps = [(k, round(k * dy), round(k * dx)) for k in range(1, min(int(most / pixel), 50) + 1)]
    way = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, r, c in steps]))
    at = lambda x, d, n: F.least(F.greatest(F.col(x) + d, F.lit(0)), F.lit(n - 1))
    eye = df.select("row", "col", F.col(elevation).alias("z"), way.alias("s")).select("row", "col", "z", "s.k", at("row", F.col("s.r"), height).alias("r2"), at("col", F.col("s.c"), width).alias("c2"))
    far = df.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col(elevation).alias("z2"))
    seen = eye.join(dealt(far), ["r2", "c2"])
    return seen.groupBy("row", "col").agg(F.bool_or(F.atan2(F.col("z2") - F.col("z"), F.col("k") * pixel) > math.radians(90.0 - nominal)).alias("blocked"))


def tiles(spark, height: int, width: int, size: int, stride: int) -> DataFrame:
    """Origins of overlapping tiles; the last ones touch the far edges."""
    axis = lambda n: F.explode(F.array_union(F.sequence(F.lit(0), F.lit(max(n - size, 0)), F.lit(stride)), F.array(F.lit(max(n - size, 0)))))
    return spark.range(1).select(axis(height).alias("tile_row")).select("tile_row", axis(width).alias("tile_col"))


def tile_weight(i: Column, j: Column, size: int, kind: str = "hann", floor: float = 1e-4) -> Column:
    """Weight of a tile's pixel: it tapers towards the edges, so seams of overlapping tiles blend."""
    import math

    if kind == "gaussian":
        x, y = (2 * k / (size - 1) - 1 for k in (i, j))
        w = F.exp((x * x + y * y) / -0.5)
    else:
        one = lambda k: (1 - F.cos(k * (2 * math.pi / (size - 1)))) / 2
        w = one(i) * one(j)
    return F.greatest(w, F.lit(floor))


def blend(predictions: DataFrame) -> DataFrame:
    """Weighted mean of overlapping predictions: row, col, p, w to row, col, p."""
    return predictions.groupBy("row", "col").agg((F.sum(F.col("p") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("p"))
