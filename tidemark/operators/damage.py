"""Damage to roads, bridges and buildings from flooded raster cells, and the road network that is cut at bridges.

Flood and unobservable zones are tables of unit cells (row, col): a union of polygons is the set of their cells. Lines
are arrays of points in units of a cell. A layer's row without points can't be assessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shapes
from tidemark.operators import spatial
from tidemark.session import dealt


def _inside(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """id and the length of each line (id, points) within the cells; every segment of a line is clipped by itself."""
    parts = lines.select("id", F.posexplode(shapes.segments(F.col("points"))).alias("part", "s")).select(F.struct("id", "part").alias("id"), "s.*")
    return spatial.clipped_length(parts, cells).groupBy(F.col("id.id").alias("id")).agg(F.sum("inside").alias("inside"))


def near_cells(points: DataFrame, cells: DataFrame, reach: float) -> DataFrame:
    """ids of the points (id, x, y) with a cell within the reach: each point looks into the blocks of cells around."""
    size = int(reach) + 1
    block = lambda c: F.floor(c / size)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    p = points.select("id", "x", "y", around.alias("o")).select("id", "x", "y", (block(F.col("x")) + F.col("o.i")).alias("bx"), (block(F.col("y")) + F.col("o.j")).alias("by"))
    c = cells.select("row", "col", block(F.col("col")).alias("bx"), block(F.col("row")).alias("by"))
    near = shapes.cell_distance(F.col("x"), F.col("y"), F.col("col"), F.col("row")) <= reach
    return p.join(c, (p.bx == c.bx) & (p.by == c.by) & near, "left_semi").select("id").distinct()


def _no_points(points: Column) -> Column:
    return F.coalesce(F.size(points) < 2, F.lit(True))


def roads(lines: DataFrame, flood: DataFrame, unseen: DataFrame, least: float = 10.0, left: float = 1.0) -> DataFrame:
    """id, status, flooded_length, length of roads (id, points): not_assessable without points or with less than `left`
    outside the unseen cells, affected from a flooded length of `least` on in seen cells, else not_affected."""
    seen = flood.select("row", "col").distinct().join(unseen.select("row", "col").distinct(), ["row", "col"], "left_anti")
    whole = lines.where(~_no_points(F.col("points")))
    wet, hidden = _inside(whole, seen).withColumnRenamed("inside", "wet"), _inside(whole, unseen.select("row", "col").distinct()).withColumnRenamed("inside", "hidden")
    x = lines.select("id", "points", shapes.line_length(F.col("points")).alias("size")).join(dealt(wet), "id", "left").join(dealt(hidden), "id", "left")
    lost = _no_points(F.col("points")) | ((F.coalesce("hidden", F.lit(0.0)) > 0) & (F.col("size") - F.col("hidden") < left))
    flooded = F.when(lost, 0.0).otherwise(F.coalesce("wet", F.lit(0.0)))
    return x.select("id", F.when(lost, "not_assessable").when(flooded >= least, "affected").otherwise("not_affected").alias("status"), flooded.alias("flooded_length"), F.coalesce("size", F.lit(0.0)).alias("length"))


def touched(lines: DataFrame, flood: DataFrame, reach: float = 40.0) -> DataFrame:
    """ids of lines that meet the flood, or whose first or last point is within the reach of it."""
    whole = lines.where(~_no_points(F.col("points")))
    ends = whole.select("id", F.explode(F.array(F.col("points")[0], F.element_at("points", -1))).alias("p")).select("id", "p.*")
    return _inside(whole, flood).where("inside > 0").select("id").unionByName(near_cells(ends, flood, reach)).distinct()


def bridges(lines: DataFrame, flood: DataFrame, reach: float = 40.0) -> DataFrame:
    """id, approach_severed and status of bridges (id, points)."""
    cut = touched(lines, flood, reach).withColumn("cut", F.lit(True))
    lost, severed = _no_points(F.col("points")), F.coalesce("cut", F.lit(False))
    return lines.join(dealt(cut), "id", "left").select("id", severed.alias("approach_severed"), F.when(lost, "not_assessable").when(severed, "affected").otherwise("not_affected").alias("status"))


def buildings(rings: DataFrame, flood: DataFrame) -> DataFrame:
    """id, is_flooded and confidence (flooded share of the footprint) of convex footprints (id, ring): each is clipped
    by the flooded cells under its box."""
    end = lambda f, c: F.floor(f(F.transform("ring", lambda p: p[c]))).cast("int")
    boxes = rings.where(F.size("ring") >= 3).select("id", "ring", F.explode(F.sequence(end(F.array_min, "y"), end(F.array_max, "y"))).alias("row"), end(F.array_min, "x").alias("c1"), end(F.array_max, "x").alias("c2"))
    under = boxes.select("id", "ring", "row", F.explode(F.sequence("c1", "c2")).alias("col")).join(flood.select("row", "col").distinct(), ["row", "col"], "left_semi")
    part = under.select("id", shapes.let(shapes.clip_ring(F.col("ring"), F.col("col").cast("double"), F.col("row").cast("double")), shapes.ring_area).alias("part"))
    wet = part.groupBy("id").agg(F.sum("part").alias("wet")).where("wet > 0")
    share = F.least(F.lit(1.0), F.col("wet") / F.greatest(shapes.ring_area(F.col("ring")), F.lit(1e-4)))
    return rings.join(dealt(wet), "id", "left").select("id", F.col("wet").isNotNull().alias("is_flooded"), F.when(F.col("wet").isNotNull(), share).otherwise(0.0).alias("confidence"))


def edge_status(edges: DataFrame, flood: DataFrame, reach: float = 40.0) -> DataFrame:
    """id and status of edges (id, points, is_bridge): affected if they meet the flood, bridges also by their ends."""
    whole = edges.where(~_no_points(F.col("points")))
    hit = _inside(whole, flood).where("inside > 0").select("id").unionByName(touched(whole.where("is_bridge"), flood, reach)).distinct().withColumn("hit", F.lit(True))
    return edges.join(dealt(hit), "id", "left").select("id", F.when(F.col("hit"), "affected").otherwise("not_affected").alias("status"))


def tagged_status(flooded: Column, status: Column) -> Column:
    """flooded, else the status that a road has already, else passable."""
    return F.when(flooded, "flooded").otherwise(F.coalesce(status, F.lit("passable")))


def summary(road: DataFrame, bridge: DataFrame, building: DataFrame) -> DataFrame:
    """One row: kilometres of road by status, bridges severed, buildings flooded (lengths in metres)."""
    km = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("length").cast("decimal(28,6)"))), F.lit(0)).cast("double") / 1000
    r = road.agg((F.coalesce(F.sum(F.col("length").cast("decimal(28,6)")), F.lit(0)).cast("double") / 1000).alias("total_road_km"), km("affected").alias("affected_road_km"), km("not_affected").alias("not_affected_road_km"), km("not_assessable").alias("not_assessable_road_km"))
    b = bridge.agg(F.count("*").alias("total_bridges"), F.count_if("approach_severed").alias("severed_bridges"))
    return r.crossJoin(b).crossJoin(building.agg(F.count("*").alias("total_buildings"), F.count_if("is_flooded").alias("flooded_buildings")))  # one row each


def _segment_cells(d: DataFrame, size: float) -> DataFrame:
    """d with bx and by of every square cell that its segments (x1, y1, x2, y2) pass, a hair around them included."""
    hair = lambda c: (F.abs(F.col(f"{c}1")) + F.abs(F.col(f"{c}2")) + size) * 1e-9
    cells = lambda low, high, m: F.explode(F.sequence(F.floor((low - m) / size), F.floor((high + m) / size)))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = d.select("*", cells(F.least("y1", "y2"), F.greatest("y1", "y2"), hair("y")).alias("by"))
    place = lambda edge: F.least(F.greatest(F.coalesce((edge - F.col("y1")) / F.nullif(dy, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    t0, t1 = place(F.col("by") * size - hair("y")), F.when(dy == 0, 1.0).otherwise(place((F.col("by") + 1) * size + hair("y")))
    rows = rows.withColumn("_a", F.col("x1") + dx * t0).withColumn("_b", F.col("x1") + dx * t1)
    return rows.select("*", cells(F.least("_a", "_b"), F.greatest("_a", "_b"), hair("x")).alias("bx")).drop("_a", "_b")


def crossed(roads: DataFrame, bridges: DataFrame, width: float) -> DataFrame:
    """id and cuts of the roads that bridges meet between their ends: the sorted places from 0 to 1. Segments meet in
    cells of a quarter of the width that they pass, where only pairs that cross are kept; no pair is moved."""
    ends = ("x1", "y1", "x2", "y2")
    a = _segment_cells(roads.select("id", *ends), width / 4)
    b = _segment_cells(bridges.select(*ends), width / 4).select("bx", "by", *(F.col(c).alias(f"b_{c}") for c in ends))
    c = lambda name, k: F.col(("b_" if k else "") + name)
    apart = [(F.greatest(c(f"{v}1", i), c(f"{v}2", i)) >= F.least(c(f"{v}1", 1 - i), c(f"{v}2", 1 - i))) for v in "xy" for i in (0, 1)]
    ax, ay, bx, by = (F.col(f"{p}{v}2") - F.col(f"{p}{v}1") for p in ("", "b_") for v in "xy")
    dx, dy = F.col("b_x1") - F.col("x1"), F.col("b_y1") - F.col("y1")
    det = F.nullif(ax * by - ay * bx, F.lit(0.0))
    meets = F.coalesce(((dx * by - dy * bx) / det).between(0, 1) & ((dx * ay - dy * ax) / det).between(0, 1), dx * ay - dy * ax == 0)
    pairs = a.join(dealt(b), (a.bx == b.bx) & (a.by == b.by) & apart[0] & apart[1] & apart[2] & apart[3] & meets)
    segment = lambda p: F.struct(*(F.col(p + v).alias(v) for v in ends))
    places = pairs.select("id", F.explode(shapes.crossing(segment(""), segment("b_"))).alias("t")).where("t > 0 AND t < 1")
    return places.groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("cuts"))


def _split(roads: DataFrame, bridges: DataFrame, width: float) -> DataFrame:
    """roads with the places from 0 to 1 where their parts begin and end (cuts)."""
    return roads.join(dealt(crossed(roads, bridges, width)), "id", "left").withColumn("cuts", F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0))))


def _length(x1, y1, x2, y2) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def _node(x: Column, y: Column, tolerance: float) -> Column:
    return F.concat_ws(":", *[(F.rint(c / tolerance) * tolerance).cast("decimal(28,3)").cast("string") for c in (x, y)])


def network(roads: DataFrame, bridges: DataFrame, width: float, least: float = 0.1, tolerance: float = 1.0) -> DataFrame:
    """Edges (road, part, u, v, length, is_bridge) of straight roads and bridges (id, x1, y1, x2, y2): roads are split
    where bridges meet them, parts under `least` and loops go, ends are merged on a grid of the tolerance, and the
    bridges are edges of their own."""
    x = _split(roads, bridges, width)
    x = x.select("*", F.posexplode(F.expr("zip_with(slice(cuts, 1, size(cuts) - 1), slice(cuts, 2, size(cuts) - 1), (a, b) -> struct(a AS a, b AS b))")).alias("part", "c"))
    at = lambda c, t: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col(f"c.{t}")
    parts = x.select("id", "part", at("x", "a").alias("x1"), at("y", "a").alias("y1"), at("x", "b").alias("x2"), at("y", "b").alias("y2"), F.lit(False).alias("is_bridge"))
    every = parts.unionByName(bridges.select("id", F.lit(0).alias("part"), "x1", "y1", "x2", "y2", F.lit(True).alias("is_bridge")))
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    edges = every.select(F.col("id").alias("road"), F.col("part").cast("int").alias("part"), _node(*ends[:2], tolerance).alias("u"), _node(*ends[2:], tolerance).alias("v"), _length(*ends).alias("length"), "is_bridge")
    return edges.where((F.col("is_bridge") | (F.col("length") >= least)) & (F.col("u") != F.col("v")))


def network_sizes(roads: DataFrame, bridges: DataFrame, width: float, least: float = 0.1, tolerance: float = 1.0) -> DataFrame:
    """road, is_bridge, parts, length and starts (different u) of the edges of network(), summed up beside each road, so
    that no part is moved. The nodes along a straight line follow each other, so equal ones are neighbours; only rows
    that share an id need their nodes by name."""
    x = _split(roads, bridges, width).select("id", F.lit(False).alias("is_bridge"), "x1", "y1", "x2", "y2", "cuts", F.lit(least).alias("least"))
    y = bridges.select("id", F.lit(True).alias("is_bridge"), "x1", "y1", "x2", "y2", F.array(F.lit(0.0), F.lit(1.0)).alias("cuts"), F.lit(0.0).alias("least"))
    return _sizes(x, tolerance).unionByName(_sizes(y, tolerance))


def _sizes(lines: DataFrame, tolerance: float) -> DataFrame:
    at = lambda c, t: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t
    point = lambda t: F.struct(at("x", t).alias("x"), at("y", t).alias("y"))
    grid = lambda p, c: F.rint(p[c] / tolerance) + 0.0  # noqa: E731  no negative zeros
    corner = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), grid(p, "x").alias("i"), grid(p, "y").alias("j"))
    corners = F.transform(F.transform("cuts", point), corner)
    part = lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["i"].alias("i"), p["j"].alias("j"), _length(p["x"], p["y"], q["x"], q["y"]).alias("length"), ((p["i"] != q["i"]) | (p["j"] != q["j"])).alias("open"))
    x = lines.withColumn("n", F.size("cuts") - 1).withColumn("corners", corners)
    x = x.withColumn("kept", F.filter(F.zip_with(F.slice("corners", F.lit(1), F.col("n")), F.slice("corners", F.lit(2), F.col("n")), part), lambda p: (p["length"] >= F.col("least")) & p["open"]))
    zero = F.struct(F.lit(0.0).alias("length"), F.lit(0).alias("starts"), F.lit(None).cast("double").alias("i"), F.lit(None).cast("double").alias("j"))
    step = lambda s, p: F.struct((s["length"] + p["length"]).alias("length"), (s["starts"] + F.when((s["i"] == p["i"]) & (s["j"] == p["j"]), 0).otherwise(1)).alias("starts"), p["i"].alias("i"), p["j"].alias("j"))
    x = x.withColumn("sums", F.aggregate("kept", zero, step))
    names = F.when(F.count("*").over(Window.partitionBy("id")) > 1, F.transform("kept", lambda p: _node(p["x"], p["y"], tolerance)))
    own = x.select(F.col("id").alias("road"), "is_bridge", F.size("kept").alias("parts"), "sums.length", "sums.starts", names.alias("names"))
    whole = own.groupBy("road", "is_bridge").agg(F.sum("parts").alias("parts"), F.sum("length").alias("length"), F.max("starts").alias("starts"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    return whole.where("parts > 0").select("road", "is_bridge", "parts", "length", F.when(F.size("names") > 0, F.size("names")).otherwise(F.col("starts")).cast("long").alias("starts"))
