"""Who lost access: distances to facilities before and after the damage, cut-off clusters and their severed ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import shapes, tags
from tidemark.operators import graph
from tidemark.session import written


def checked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y and optionally n_buildings, is_facility, name) and edges (a, b and optionally length, status,
    is_bridge) with defaults. Without nodes, or with one that has no place, ValueError."""
    state = nodes.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("lost")).first()
    if not state["n"] or state["lost"]:
        raise ValueError("the graph has no nodes" if not state["n"] else f"{state['lost']} nodes have no coordinates")
    have = lambda d, c, v: F.coalesce(F.col(c), v) if c in d.columns else v
    n = nodes.select("node", "x", "y", have(nodes, "n_buildings", F.lit(0)).cast("long").alias("n_buildings"), have(nodes, "is_facility", F.lit(False)).alias("is_facility"), have(nodes, "name", F.concat(F.lit("node_"), F.col("node").cast("string"))).alias("name"))
    e = edges.select("a", "b", have(edges, "length", F.lit(100.0)).cast("double").alias("length"), have(edges, "status", F.lit("not_affected")).alias("status"), have(edges, "is_bridge", F.lit(False)).alias("is_bridge"))
    return n, e


def reachability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, status, pre, post (km to the nearest facility over all and over the unaffected edges) and ratio. Without
    a facility the southernmost node (the first of equals) stands for one."""
    n, e = checked(nodes, edges)
    seeds = n.where("is_facility").select("node")
    if seeds.isEmpty():
        seeds = n.orderBy("y", "node").limit(1).select("node")
    km = e.withColumn("length", F.col("length") / 1000)
    pre = graph.distances(km, seeds).withColumnRenamed("dist", "pre")
    post = graph.distances(km.where("status <> 'affected'"), seeds).withColumnRenamed("dist", "post")
    status, ratio = graph.classify(F.col("pre"), F.col("post"))
    return n.join(pre, "node", "left").join(post, "node", "left").select("*", status.alias("status"), ratio.alias("ratio"))


def settlements(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per component of cut-off nodes over all edges: cluster (least node), n_nodes, n_buildings, centre, name of
    its largest named node, severed ways and bridges among them, response, and ring: its hull, or its centre alone
    where it has fewer than three nodes (the buffers of 50 and 100 are columns, as a circle is no list of points)."""
    lost = reach.where("status = 'cut_off'")
    _, e = checked(reach, edges)
    member = written(graph.clusters(e, lost.select("node")).join(lost.select("node", "x", "y", "n_buildings", "name"), "node"), "settlements")
    named = F.when(~F.col("name").startswith("node_") & (F.col("name") != ""), F.struct("n_buildings", (-F.col("node")).alias("order"), "name"))
    c = member.groupBy("component").agg(F.count("*").alias("n_nodes"), F.sum("n_buildings").alias("n_buildings"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.max(named)["name"].alias("name"))
    cut = graph.boundary(e.where("status = 'affected'"), member.select("node", "component")).where("boundary")
    cut = cut.groupBy("component").agg(F.count("*").alias("n_severed"), F.count_if("is_bridge").alias("n_bridges"))
    c = c.join(cut, "component", "left").na.fill(0, ["n_severed", "n_bridges"])
    from tidemark.operators.spatial import hulls

    ring = hulls(member.select(F.col("component").alias("zone"), "x", "y")).select(F.col("zone").alias("component"), "ring")
    small = F.col("n_nodes") < 3
    return c.join(ring, "component").select(
        F.col("component").alias("cluster"), "n_nodes", "n_buildings", "x", "y",
        F.coalesce("name", F.concat(F.lit("Settlement Cluster #"), F.col("component").cast("string"))).alias("name"),
        "n_severed", "n_bridges", tags.response(F.col("n_severed"), F.col("n_bridges") > 0).alias("response"),
        F.when(small, F.array(shapes.point(F.col("x"), F.col("y")))).otherwise(F.col("ring")).alias("ring"), F.when(small, 100.0).otherwise(50.0).alias("buffer"),
    )


def summary(reach: DataFrame) -> DataFrame:
    """Nodes by status and the buildings that are cut off: one row."""
    n = lambda s: F.count_if(F.col("status") == s)
    return reach.agg(n("accessible").alias("accessible"), n("severely_delayed").alias("severely_delayed"), n("cut_off").alias("cut_off"), F.coalesce(F.sum(F.when(F.col("status") == "cut_off", F.col("n_buildings"))), F.lit(0)).alias("buildings_cut_off"))


def extent(members: DataFrame) -> DataFrame:
    """component and the largest distance from its centre to a member (component, x, y), 50 at least, to a tenth."""
    c = members.groupBy("component").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    far = members.join(c, "component").groupBy("component").agg(F.max(d).alias("far"))
    return far.select("component", (F.floor(F.greatest("far", F.lit(50.0)) * 10 + 0.5) / 10).alias("radius"))
