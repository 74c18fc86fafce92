"""The graph queries over every order line on a small fixture, against plain versions and their SQL; all customers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import graph_queries, registry
from tests.test_oracle import SF, plain

NAMES = sorted(set(graph_queries.QUERIES) - {"graph_build_merge_nodes"})


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Few lines for many places, so that some are cut off, by returns or by small quantities."""
    rng, at = np.random.default_rng(4), str(tmp_path_factory.mktemp("roads"))
    lines = [(int(o), int(n), int(p), int(s), float(q), f"199{y}-03-01", "RN"[f], int(t) / 100, int(d) / 100) for o, n, p, s, q, y, f, t, d in zip(np.arange(60) // 2, np.arange(60) % 2, rng.integers(0, 20, 60), rng.integers(1, 25, 60), rng.integers(30, 100, 60), rng.integers(2, 10, 60), rng.integers(0, 2, 60), rng.integers(0, 9, 60), rng.integers(0, 11, 60), strict=True)]
    orders = [(o, int(rng.integers(0, 25))) for o in range(30)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_shipdate string, l_returnflag string, l_tax double, l_discount double").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(p, "ECONOMY" if p % 3 == 0 else "SMALL", f"Brand#{p % 4}", p * 3) for p in range(20)], "p_partkey long, p_type string, p_brand string, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(s,) for s in range(1, 25)], "s_suppkey long").write.parquet(f"{at}/supplier.parquet")
    cust = dict(orders)
    return at, [(2 * cust[x[0]], 2 * x[3] + 1, x[6] == "R" or x[4] < 50, x[8] * 1000 + 1) for x in lines], {2 * s + 1 for s in range(5, 25, 5)}


def nearest(edges, seeds):
    best = dict.fromkeys(seeds, 0.0)
    for _ in range(len(edges)):
        for a, b, _, n in edges:
            for x, y in ((a, b), (b, a)):
                if x in best and best[x] + n < best.get(y, np.inf):
                    best[y] = best[x] + n
    return best


def test_components_distances_isolation(spark, small):
    at, edges, hubs = small
    run = lambda name: registry.QUERIES[name](spark, at).collect()
    nodes = {x for e in edges for x in e[:2]}
    assert {r["node"]: r["component"] for r in run("connected_components")} == {x: min(nearest(edges, [x])) for x in nodes}
    assert {r["node"]: r["dist"] for r in run("multi_source_distance")} == pytest.approx(nearest(edges, hubs))
    dry = [e for e in edges if not e[2]]
    gone = {h for h in hubs & nodes if not any(h in e[:2] for e in dry)}
    lost = (set(nearest(edges, hubs & nodes)) - set(nearest(dry, hubs - gone)))
    assert lost and {r["node"] for r in run("isolated_nodes")} == lost
    assert {r["edge_id"] for r in run("edge_adjacency_bridges")} and {r["node"] for r in run("classify_reachability")} == nodes


@pytest.mark.parametrize("name", NAMES)
def test_all_roads_equal_their_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small[0]}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, small[0])
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    assert got == want and got


def test_geodesic_distance_of_every_customer(spark):
    got = {r["c_custkey"]: r["km"] for r in registry.QUERIES["geodesic_distance"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/customer.parquet").count()
    # Customer 0: from 180 W 80 S to 90 W 40 S; the sphere of the mean radius is within 0.6 %.
    a, b = np.radians((-80, -40))
    assert got[0] == pytest.approx(6371.0088 * np.arccos(np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.pi / 2)), rel=0.006)


def test_obstacles_do_not_depend_on_the_order_of_rows(spark):
    from tidemark.plans import graph_queries

    rows = [(1, 7, False, False, 0.5, True, f"R{i}") for i in range(6)]
    got = [graph_queries._obstacles(spark.createDataFrame(r, "component long, edge_id long, is_bridge boolean, major boolean, fraction double, boundary boolean, name string").coalesce(1)).first()["obstacles"] for r in (rows, rows[::-1], rows[3:] + rows[:3])]
    assert got == ["Road R0 (50% flooded); Road R1 (50% flooded); Road R2 (50% flooded)"] * 3


def test_geodesic_steps_equal_the_fold(spark):
    from tidemark.functions import expr

    k = F.col("id")
    lon, lat = (k * 37 % 3600) / 10.0 - 180, (k * 53 % 1600) / 10.0 - 80
    df = expr.with_geodesic_km(spark.range(0, 6000, 100), lon, lat, lon / 2, lat / 2, "km")
    got = df.select("id", "km", expr.geodesic_km(lon, lat, lon / 2, lat / 2).alias("fold")).collect()
    assert len(got) == 60 and all(r["km"] == pytest.approx(r["fold"], rel=1e-12) for r in got)
    assert "aggregate(" not in registry.QUERIES["geodesic_distance"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
