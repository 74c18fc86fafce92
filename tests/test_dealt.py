"""Tables that grow with the data are never planned as a broadcast, however small their files look."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import shapes
from tidemark.operators import damage, grid, raster, spatial


def lines(spark):
    x = F.col("id").cast("double")
    return spark.range(9).select("id", x.alias("x1"), x.alias("y1"), (x + 3).alias("x2"), (x + 1).alias("y2"))


def pieces(spark):
    return lines(spark).select("id", F.array(shapes.point(F.col("x1"), F.col("y1")), shapes.point(F.col("x2"), F.col("y2"))).alias("points"), (F.col("id") > 3).alias("is_bridge"))


def cells(spark):
    return spark.range(50).crossJoin(spark.range(9).toDF("k")).select((F.col("id") % 10).cast("int").alias("row"), F.floor(F.col("id") / 10).cast("int").alias("col")).distinct()


CASES = {
    "damage_summary": lambda s: damage.roads(pieces(s), cells(s), cells(s)),
    "building_damage": lambda s: damage.buildings(pieces(s).select("id", F.concat("points", F.array(shapes.point(F.lit(0), F.lit(5)))).alias("ring")), cells(s)),
    "edge_flood_status": lambda s: damage.edge_status(pieces(s), cells(s), 0.5),
    "bridge_approaches": lambda s: damage.bridges(pieces(s), cells(s), 0.5),
    "segment_cell_clip": lambda s: spatial.clipped_length(lines(s), cells(s)),
    "line_sampling_fraction": lambda s: spatial.sampled_fraction(lines(s), cells(s).withColumn("wet", F.col("row") > 2)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_growing_tables_are_dealt_out(spark, name):
    plan = CASES[name](spark)._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"BroadcastHashJoin.*", plan)
    assert "SortMergeJoin [id" in plan and not [j for j in joins if "BuildLeft" in j or "[id#" in j]


def test_rasters_are_dealt_out(spark):
    r = cells(spark).withColumn("z", F.col("row") * 2.0).withColumn("pre", F.lit(-5.0)).withColumn("post", F.lit(-9.0))
    layers = raster.terrain(r, "z", 10, 5, 400.0, 78.0, 39.0)
    big = grid.large_enough(r.select("row", "col", F.col("row").alias("label")), 2)
    for df in (layers, raster.mountain_mask(r, layers, 5, 2.0, -6.0, 4), big):
        assert not re.findall(r"BroadcastHashJoin \[(?:row|r2|label|node)#", df._jdf.queryExecution().sparkPlan().toString())


def test_equal_boxes_meet_once(spark):
    """300 copies of each of 20 boxes on both sides: 20 pairs of different boxes at most reach the join."""
    box = lambda k: spark.range(6000).select(F.col("id").alias(k), *[(F.col("id") % 20 * 3.0 + d).alias(c) for c, d in (("x1", 0), ("x2", 2), ("y1", 0), ("y2", 1))])
    df = spatial.overlap_counts(box("a"), box("b"), 4.0)
    assert {(r["a"] % 20 == r["first"], r["n"]) for r in df.collect()} == {(True, 300)} and df.count() == 6000
