"""Segments through a corner of cells: which cells they meet is decided by the clip's rounding, as in the SQL."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import shapes
from tidemark.operators import damage, spatial
from tidemark.plans import registry

CORNERS = [(2.6, 3.2, 7.2, 0.9, 0, 6), (7.3, 0.0, 2.5, 32.0, 1, 6), (21.4, 7.2, 14.2, 3.6, 4, 14)]


def clip(p, d, cell):
    return sorted(((cell - p) / d, (cell + 1 - p) / d))


@pytest.mark.parametrize("corner", CORNERS)
def test_a_cell_at_a_corner_is_clipped(spark, corner):
    x1, y1, x2, y2, row, col = corner
    (a, b), (c, d) = clip(y1, y2 - y1, row), clip(x1, x2 - x1, col)
    share = max(0.0, min(1.0, b, d) - max(0.0, a, c))
    assert 0 < share < 1e-14
    line, cells = spark.createDataFrame([(1, x1, y1, x2, y2)], "id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame([(row, col)], "row int, col int")
    r = spatial.clipped_length(line, cells).first()
    assert r["inside"] == share * r["length"]
    edge = line.select("id", F.array(shapes.point(F.col("x1"), F.col("y1")), shapes.point(F.col("x2"), F.col("y2"))).alias("points"), F.lit(False).alias("is_bridge"))
    assert damage.edge_status(edge, cells, 0.5).first()["status"] == "affected"


def test_edge_flood_status_at_a_corner_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    when = datetime.datetime(2024, 1, 5, 12)
    spark.createDataFrame([(145884, 13272, "5-LOW"), (1, 1, "5-LOW"), (2, 2, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, when, 14, "click", 1.0)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["edge_flood_status"]).fetchall()
    got = registry.QUERIES["edge_flood_status"](spark, str(tmp_path)).select("id", "status").collect()
    assert sorted(map(tuple, got)) == sorted(want) and (145884, "affected") in want
