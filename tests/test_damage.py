"""Geometry, damage and cut-off operators on small cases against values worked out by hand or by plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import shapes, tags
from tidemark.operators import cutoff, damage, spatial

POINTS = "array<struct<x:double,y:double>>"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ring_of(spark, *points):
    return F.array(*[shapes.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_rings_and_lines(spark):
    diamond = ring_of(spark, (1, 0), (2, 1), (1, 2), (0, 1))
    r = one(spark, shapes.ring_area(diamond).alias("a"), shapes.let(shapes.clip_ring(diamond, F.lit(0.0), F.lit(0.0)), shapes.ring_area).alias("q"), shapes.ring_centroid(ring_of(spark, (0, 0), (4, 0), (0, 2))).alias("c"), shapes.inside_ring(F.lit(1.0), F.lit(1.0), diamond).alias("i"), shapes.inside_ring(F.lit(0.1), F.lit(0.1), diamond).alias("o"))
    assert (r["a"], r["q"], r["i"], r["o"]) == (2.0, 0.5, True, False) and (round(r["c"]["x"], 6), round(r["c"]["y"], 6)) == (1.333333, 0.666667)
    long, short = ring_of(spark, (0, 0), (3, 4)), ring_of(spark, (0, 0), (1, 0), (1, 1))
    r = one(spark, shapes.line_length(short).alias("n"), shapes.longest_part(F.array(short, long)).alias("l"), shapes.straight(F.lit(None).cast(POINTS), F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("s"))
    assert r["n"] == 2.0 and r["l"][1]["y"] == 4.0 and len(r["s"]) == 2


def test_crossings_and_snapping(spark):
    seg = lambda a, b, c, d: F.struct(*[F.lit(float(v)).alias(k) for v, k in zip((a, b, c, d), ("x1", "y1", "x2", "y2"))])
    a = seg(0, 0, 10, 0)
    r = one(spark, shapes.crossing(a, seg(4, -1, 4, 1)).alias("x"), shapes.crossing(a, seg(2, 0, 5, 0)).alias("on"), shapes.crossing(a, seg(0, 1, 10, 1)).alias("none"), shapes.snapped(F.lit(3.0), F.lit(0.5), a, 1.0).alias("s"), shapes.snapped(F.lit(3.0), F.lit(5.0), a, 1.0).alias("far"))
    assert r["x"] == [0.4] and r["on"] == [0.2, 0.5] and r["none"] == []
    assert (r["s"]["x"], r["s"]["y"], r["s"]["t"], r["s"]["near"]) == (3.0, 0.0, 0.3, True) and r["far"]["y"] == 5.0 and not r["far"]["near"]


def test_buildings_against_a_fine_grid(spark):
    """Convex footprints that are no boxes: the flooded share of a fine grid of points."""
    rnd = random.Random(5)
    rings = []
    for i in range(6):
        cx, cy, n = rnd.uniform(2, 6), rnd.uniform(2, 6), rnd.randint(3, 7)
        turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
        rings.append((i, [(cx + 1.7 * math.cos(t), cy + 1.7 * math.sin(t)) for t in turns]))
    cells = [(r, c) for r in range(9) for c in range(9) if (r * 5 + c * 3) % 4 == 0]
    got = {r["id"]: r for r in damage.buildings(spark.createDataFrame([*rings, (9, None), (10, [(50.0, 50.0), (51.0, 50.0), (50.0, 51.0)])], f"id long, ring {POINTS}"), spark.createDataFrame(cells, "row int, col int")).collect()}
    for i, ring in rings:
        def inside(x, y):
            return all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(ring, ring[1:] + ring[:1]))
        grid = [(x / 60, y / 60) for x in range(540) for y in range(540) if inside(x / 60, y / 60)]
        share = sum((int(y), int(x)) in set(cells) for x, y in grid) / max(1, len(grid))
        assert abs(got[i]["confidence"] - share) < 0.02
    assert not got[9]["is_flooded"] and got[9]["confidence"] == 0 and not got[10]["is_flooded"]


def test_roads_without_points_or_out_of_sight(spark):
    lines = [(1, [(0.0, 0.5), (20.0, 0.5)]), (2, None), (3, [(0.0, 5.5), (3.0, 5.5)]), (4, [(0.0, 5.5), (6.0, 5.5)]), (5, [(0.0, 9.5), (20.0, 9.5)])]
    wet = spark.createDataFrame([(0, c) for c in range(12)] + [(5, c) for c in range(6)] + [(9, c) for c in range(9)], "row int, col int")
    hidden = spark.createDataFrame([(5, c) for c in range(3)], "row int, col int")
    got = {r["id"]: (r["status"], round(r["flooded_length"], 6)) for r in damage.roads(spark.createDataFrame(lines, f"id long, points {POINTS}"), wet, hidden).collect()}
    assert got == {1: ("affected", 12.0), 2: ("not_assessable", 0.0), 3: ("not_assessable", 0.0), 4: ("not_affected", 3.0), 5: ("not_affected", 9.0)}


def test_nearest_passes_points_without_a_place(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 9e6, -9e6)], "id long, x double, y double")
    hubs = spark.createDataFrame([(7, 1.0, 0.0), (8, None, None)], "hub long, x double, y double")
    assert sorted((r["id"], r["hub"]) for r in spatial.nearest(points, hubs, 2.0).collect()) == [(1, 7), (4, 7)]
    assert spatial.nearest(points, hubs.where("false"), 2.0).count() == 0


def test_cutoff_graph(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0, i, i == 0, f"N{i}" if i == 3 else f"node_{i}") for i in range(6)], "node long, x double, y double, n_buildings int, is_facility boolean, name string")
    edges = spark.createDataFrame([(0, 1, 500.0, "not_affected", False), (1, 2, 500.0, "affected", True), (2, 3, 500.0, "not_affected", False), (3, 4, 500.0, "not_affected", False)], "a long, b long, length double, status string, is_bridge boolean")
    reach = cutoff.reachability(nodes, edges)
    assert {r["node"]: r["status"] for r in reach.collect()} == {0: "accessible", 1: "accessible", 2: "cut_off", 3: "cut_off", 4: "cut_off", 5: "accessible"}
    s = cutoff.settlements(reach, edges).collect()
    assert len(s) == 1 and (s[0]["cluster"], s[0]["n_nodes"], s[0]["n_buildings"], s[0]["name"], s[0]["n_bridges"], s[0]["buffer"]) == (2, 3, 9, "N3", 1, 50.0) and s[0]["response"].startswith("Airdrop")
    assert cutoff.summary(reach).first()["buildings_cut_off"] == 9
    with pytest.raises(ValueError):
        cutoff.checked(nodes.where("false"), edges)
    with pytest.raises(ValueError):
        cutoff.checked(nodes.withColumn("x", F.lit(None).cast("double")), edges)
    bare = cutoff.checked(nodes.select("node", "x", "y"), edges.select("a", "b"))
    assert bare[0].first()["name"] == "node_0" and bare[1].first()["length"] == 100.0


def test_bounds_and_extent(spark):
    r = one(spark, tags.bounds(F.array(*map(F.lit, (85.1, 27.8, 85.4, 28.2)))).alias("a"), tags.bounds(F.array(*map(F.lit, (28.2, 27.8, 85.4, 85.1)))).alias("b"))
    assert tuple(r["a"]) == tuple(r["b"]) == (28.2, 27.8, 85.4, 85.1)
    m = spark.createDataFrame([(1, 0.0, 0.0), (1, 200.0, 0.0), (2, 5.0, 5.0)], "component long, x double, y double")
    assert {r["component"]: r["radius"] for r in cutoff.extent(m).collect()} == {1: 100.0, 2: 50.0}


def test_network_sizes_sum_up_the_edges_of_the_network(spark):
    import random

    r = random.Random(5)
    seg = lambda i, reach: (i, *[float(round(r.uniform(0, 60), 1)) for _ in range(2)], *[float(round(r.uniform(-reach, reach), 1)) for _ in range(2)])
    rows = [[(i, x, y, x + dx, y + dy) for i, x, y, dx, dy in (seg(k % m, reach) for k in range(n))] for n, m, reach in ((60, 50, 40), (40, 40, 12))]
    rows[0] += [(90, 0.0, 5.0, 30.0, 5.0), (91, 7.0, 0.0, 7.0, 30.0), (92, 3.0, 3.0, 3.0, 3.0), (93, None, 1.0, 2.0, 2.0)]
    rows[1] += [(90, 10.0, 5.0, 20.0, 5.0), (91, 7.0, 12.0, 7.0, 40.0)]
    roads, bridges = (spark.createDataFrame(x, "id long, x1 double, y1 double, x2 double, y2 double") for x in rows)
    e = damage.network(roads, bridges, 16.0).groupBy("road", "is_bridge").agg(F.count("*").alias("parts"), F.sum("length").alias("length"), F.countDistinct("u").alias("starts"))
    plain = lambda d: sorted((x["road"], x["is_bridge"], x["parts"], round(x["length"], 6), x["starts"]) for x in d.collect())
    assert plain(damage.network_sizes(roads, bridges, 16.0)) == plain(e)
    met = {x["id"]: x["cuts"] for x in damage.crossed(roads, bridges, 16.0).collect()}
    every = roads.where("x1 IS NOT NULL").crossJoin(bridges.select(F.struct("x1", "y1", "x2", "y2").alias("o"))).select("id", F.explode(damage.shapes.crossing(F.struct("x1", "y1", "x2", "y2"), F.col("o"))).alias("t")).where("t > 0 AND t < 1").groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("cuts"))
    assert met == {x["id"]: x["cuts"] for x in every.collect()} and len(met) > 20
