"""Published and derived values, and behaviour of the operators on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import facts, graph, grid, metrics, ranking, spatial


def settlements(spark, rows):
    return spark.createDataFrame([(f"C{i}", i, *r, None) for i, r in enumerate(rows)], "cluster_id string, ord int, population double, distance_km double, trapped_nodes int, has_bridge_cut boolean, has_highway_cut boolean, num_cut_edges int, obstacles string")


@pytest.mark.parametrize(
    ("rows", "given", "scores"),
    [
        ([(27.4, 1.94, 1, False, False, 1), (27.1, 7.66, 1, False, False, 1), (26.4, 4.92, 1, False, False, 1)], None, [30.0, 40.9, 13.7]),
        ([(3000.0, 18.0, 60, True, True, 4), (800.0, 8.0, 20, False, True, 2), (250.0, 3.0, 8, False, False, 1), (20.0, 0.5, 2, False, False, 1)], None, [97.4, 35.5, 11.8, 3.2]),
        ([(3000.0, 18.0, 60, True, True, 4), (800.0, 8.0, 20, False, True, 2), (250.0, 3.0, 8, False, False, 1), (20.0, 0.5, 2, False, False, 1)], {"pop": 0.7, "dist": 0.1, "nodes": 0.1, "vuln": 0.1}, [98.8, 32.1, 10.2, 2.2]),
        ([(4500.0, 16.5, 12, True, True, 0), (45.0, 1.2, 2, False, False, 0)], None, [90.3, 2.5]),
        ([(1200.0, 8.5, 1, True, False, 0)], None, [39.1]),
    ],
)
def test_priority_scores(spark, rows, given, scores):
    got = {r["cluster_id"]: r["priority_score"] for r in ranking.prioritise(settlements(spark, rows), given).collect()}
    assert [got[f"C{i}"] for i in range(len(rows))] == scores


def test_no_settlements(spark):
    assert ranking.prioritise(settlements(spark, [(1.0, 1.0, 1, False, False, 0)]).where("false")).count() == 0


def test_weights():
    assert ranking.weights({"population": 0, "distance": 0, "trapped_nodes": 0, "vulnerability": 0}) == ranking.WEIGHTS
    assert sum(ranking.weights({"pop": 3}).values()) == pytest.approx(1)


def test_pooled_metrics(spark):
    df = spark.createDataFrame([(143430, 365174, 132912, 1328671), (10304, 419886, 93437, 1967834), (0, 0, 0, 0)], "tp long, fp long, fn long, tn long")
    a, b, c = metrics.scores(df).collect()
    assert (a["iou"], a["f1"], a["precision"], a["recall"], a["accuracy"], a["kappa"]) == (0.2236, 0.3655, 0.2820, 0.5190, 0.7472, 0.2245)
    assert (b["iou"], b["kappa"]) == (0.0197, -0.0305) and c["iou"] == 0.0


def edges(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_id int, a long, b long, flooded boolean")


BASE = [(100, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 200), (98, 99)]


@pytest.mark.parametrize(
    ("cut", "hubs", "lost"),
    [
        ([], [100, 200], set()),
        # A hub whose roads are all flooded no longer works, and is cut off itself.
        ([(100, 1), (6, 200)], [100, 200], {1, 2, 3, 4, 5, 6, 100, 200}),
        ([(100, 1)], [100, 200], {100}),
        ([(100, 1), (3, 4)], [100, 200], {1, 2, 3, 100}),
        ([(100, 1), (3, 4), (6, 200)], [100, 200], {1, 2, 3, 4, 5, 6, 100, 200}),
    ],
)
def test_isolated(spark, cut, hubs, lost):
    e = edges(spark, [(a, b, (a, b) in cut) for a, b in BASE])
    h = spark.createDataFrame([(x,) for x in hubs], "node long")
    assert {r["node"] for r in graph.isolated(e, h).collect()} == lost


def test_parallel_dry_edge_keeps_the_link(spark):
    e = edges(spark, [(10, 20, False), (20, 30, True), (20, 30, True), (30, 40, True), (30, 40, False)])
    assert {r["node"] for r in graph.isolated(e, spark.createDataFrame([(30,)], "node long")).collect()} == {10, 20}


def test_two_clusters(spark):
    e = edges(spark, [(a, b, (a, b) in [(100, 1), (3, 4), (6, 200)]) for a, b in BASE])
    nodes = spark.createDataFrame([(x,) for x in range(1, 7)], "node long")
    got = {r["node"]: r["component"] for r in graph.clusters(e.where("NOT flooded"), nodes, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_distances(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 20.0), (3, 4, 1.0), (8, 9, 1.0), (2, 1, 4.0)], "a long, b long, length double")
    got = {r["node"]: r["dist"] for r in graph.distances(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0.0, 2: 4.0, 3: 9.0, 4: 10.0}


@pytest.mark.parametrize(
    ("pre", "post", "status", "ratio"),
    [(None, None, "accessible", 1.0), (4.0, None, "cut_off", 999.0), (4.0, 8.0, "severely_delayed", 2.0), (40.0, 55.0, "severely_delayed", 1.375), (0.2, 0.5, "accessible", 0.5)],
)
def test_classify(spark, pre, post, status, ratio):
    df = spark.createDataFrame([(pre, post)], "pre double, post double")
    s, r = graph.classify(F.col("pre"), F.col("post"))
    assert tuple(df.select(s, r).first()) == (status, ratio)


@pytest.mark.parametrize(
    ("fraction", "flooded", "u", "v", "mode", "score"),
    [(0.9, True, False, False, "submerged", 0.94), (0.9, True, True, False, "submerged", 0.99), (0.4, False, False, True, "high_hydrodynamic_load", 0.89), (None, False, True, True, "approaches_cut", 0.8), (0.0, False, True, False, "approaches_cut", 0.6), (0.02, False, False, False, "high_hydrodynamic_load", 0.41), (float("nan"), False, False, False, "", 0.0)],
)
def test_bridge_damage(spark, fraction, flooded, u, v, mode, score):
    df = spark.createDataFrame([(fraction, flooded, u, v)], "f double, w boolean, u boolean, v boolean")
    m, s = graph.bridge_damage(*(F.col(c) for c in "fwuv"))
    assert tuple(df.select(m, s).first()) == (mode, score)


def test_decibels(spark):
    x = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),)], "v double").select(expr.to_db(F.col("v"))).collect()
    assert x[0][0] == -60.0 and x[1][0] == 0.0 and math.isnan(x[2][0])


def raster(spark, h, w, wet):
    return spark.createDataFrame([(r, c, wet(r, c)) for r in range(h) for c in range(w)], "row int, col int, m boolean")


def test_opening_removes_specks_and_keeps_blocks(spark):
    m = raster(spark, 12, 12, lambda r, c: (2 <= r < 8 and 3 <= c < 9) or (r, c) == (10, 10))
    on = {(r["row"], r["col"]) for r in grid.opened(m, "m").where("m").collect()}
    assert on == {(r, c) for r in range(2, 8) for c in range(3, 9)}


def test_closing_clears_the_rim(spark):
    on = {(r["row"], r["col"]) for r in grid.closed(raster(spark, 5, 5, lambda r, c: True), "m").where("m").collect()}
    assert on == {(r, c) for r in range(1, 4) for c in range(1, 4)}


def test_labels_by_corner_or_side(spark):
    m = raster(spark, 4, 4, lambda r, c: (r, c) in {(0, 0), (1, 1), (1, 2), (3, 3)})
    assert {r["label"] for r in grid.label(m, "m", 4).collect()} == {0, 5, 15}
    assert {r["label"] for r in grid.label(m, "m", 4, diagonal=True).collect()} == {0, 15}


def by_series(lon, lat, central):
    """Transverse Mercator by the power series in the longitude difference (Snyder, 1987)."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    p, ep = math.radians(lat), e2 / (1 - e2)
    n, t, c, x = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, ep * math.cos(p) ** 2, math.radians(lon - central) * math.cos(p)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
    east = 0.9996 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * x**5 / 120) + 500000
    north = 0.9996 * (m + n * math.tan(p) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * x**6 / 720))
    return east, north


def test_utm_and_geodesic(spark):
    df = spark.createDataFrame([(85.0, 27.0), (87.0, 0.0)], "lon double, lat double")
    x, y = expr.utm_project(F.col("lon"), F.col("lat"))
    a, b = df.select(x.alias("x"), y.alias("y"), expr.utm_zone(F.col("lon"), F.col("lat")).alias("z")).collect()
    assert a["z"] == 32645 and b["x"] == pytest.approx(500000.0, abs=1e-6) and b["y"] == pytest.approx(0.0, abs=1e-6)
    east, north = by_series(85.0, 27.0, 87.0)
    assert a["x"] == pytest.approx(east, abs=0.01) and a["y"] == pytest.approx(north, abs=0.01)
    km = expr.geodesic_km(F.lit(0.0), F.lit(0.0), F.col("lon") * 0 + 1, F.lit(0.0))
    north = expr.geodesic_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("lat") * 0 + 1)
    r = df.select(km.alias("e"), north.alias("n"), expr.geodesic_km(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat")).alias("o")).first()
    assert r["e"] == pytest.approx(111.319491, abs=1e-5) and r["n"] == pytest.approx(110.574389, abs=1e-5) and r["o"] == pytest.approx(0.0, abs=1e-9)


def test_grounding_in_two_scripts(spark):
    f = spark.createDataFrame([(1, "AREA", 4.12), (2, "ROADS", 6.8), (3, "BRIDGES", 2.0), (4, "BUILDINGS", 280.0), (5, "CUT", 72.0)], "ord int, fact_id string, value_num double")
    t = spark.createDataFrame([("Extent 4.12 km2, 6.8 km of roads, 280 buildings, 72 cut off.",), ("क्षेत्र ४.१२, भवन २८०",), ("People: 9999",), ("मानिस ९९९९",), ("none",), (None,)], "text string")
    got = [(r["total"], r["violations"], r["score"]) for r in facts.grounded(t, f).collect()]
    assert got == [(4, 0, 1.0), (2, 0, 1.0), (1, 1, 0.0), (1, 1, 0.0), (0, 0, 1.0), (0, 0, 1.0)]


def test_digest_ignores_order(spark):
    rows = [(1, "B", 2.5), (2, "A", 10.0), (3, "C", None)]
    a = facts.digest(spark.createDataFrame(rows, "ord int, fact_id string, value_num double")).first()[0]
    b = facts.digest(spark.createDataFrame(rows[::-1], "ord int, fact_id string, value_num double")).first()[0]
    import hashlib

    assert a == b == hashlib.sha256(b'{"A": 10.0, "B": 2.5}').hexdigest()


def test_sampling_off_the_raster(spark):
    lines = spark.createDataFrame([(1, 0.5, 0.5, 3.5, 0.5), (2, 50.0, 50.0, 60.0, 50.0), (3, 0.5, 1.5, 3.5, 1.5)], "id long, x1 double, y1 double, x2 double, y2 double")
    mask = raster(spark, 2, 4, lambda r, c: r == 0).withColumnRenamed("m", "wet")
    got = {r["id"]: (r["flood_frac"], r["flooded"], r["covered"]) for r in spatial.sampled_fraction(lines, mask).collect()}
    assert got == {1: (1.0, True, True), 2: (None, False, False), 3: (0.0, False, True)}


def test_clipped_length(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.5, 4.0, 0.5), (2, 0.0, 0.0, 2.0, 2.0), (3, 1.0, 0.0, 1.0, 3.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(0, 1), (1, 1)], "row int, col int")
    got = {r["id"]: r["inside"] for r in spatial.clipped_length(lines, cells).collect()}
    assert got == {1: 1.0, 2: pytest.approx(math.sqrt(2)), 3: 2.0}


def test_router(spark):
    q = [("How many deaths?", "refused"), ("Which bridge?", "road_bridge"), ("सम्पर्कविहीन बस्ती", "cutoff"), ("hello", "brief"), ("river depth", "refused")]
    df = spark.createDataFrame(q, "q string, want string")
    assert df.where(facts.route(F.col("q"))[1] != F.col("want")).count() == 0
