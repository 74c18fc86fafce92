"""Graph queries: customers and suppliers are places, all order lines roads between them; returned lines and those of a
quantity under HIGH are flooded."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.expr import rounded
from tidemark.operators import graph
from tidemark.session import table


#: Which roads stay above the water, and which suppliers are hubs.
HIGH, HUBS = 50, "s_suppkey % 5 = 0"


def edges(spark, sf):
    """Even nodes are customers, odd ones suppliers; an edge for every order line."""
    l, o, p = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part")
    x = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    flooded = (F.col("l_returnflag") == "R") | (F.col("l_quantity") < HIGH)
    return x.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_id"), (F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), flooded.alias("flooded"), (F.col("p_type") == "ECONOMY").alias("is_bridge"), (F.col("l_tax") * 10).alias("fraction"), (F.col("l_discount") * 1000 + 1).alias("length"), F.col("p_brand").alias("name"), (F.col("p_size") > 25).alias("major"))


def hubs(spark, sf):
    return table(spark, sf, "supplier").where(HUBS).select((F.col("s_suppkey") * 2 + 1).alias("node"))


def connected_components(spark, sf):
    return graph.components(edges(spark, sf))


def isolated_nodes(spark, sf):
    return graph.isolated(edges(spark, sf), hubs(spark, sf))


def _clusters(spark, sf):
    e = edges(spark, sf)
    return e, graph.clusters(e.where("NOT flooded"), graph.isolated(e, hubs(spark, sf)))


def cluster_metrics(spark, sf):
    """Size, name, people (from the node count) and extent of each cut-off community."""
    _, c = _clusters(spark, sf)
    g = c.groupBy("component").agg(F.count("*").alias("n_nodes"), F.max("node").alias("last_node"))
    nn = F.lpad(F.row_number().over(Window.orderBy(F.desc("n_nodes"), "component")).cast("string"), 4, "0")
    return g.select("component", "n_nodes", "last_node", F.concat(F.when(F.col("n_nodes") > 1, "Village_Cluster_").otherwise("Isolated_Junction_"), nn).alias("cluster_id"), F.greatest(F.col("n_nodes") * 75, F.lit(50)).alias("population"))


def multi_source_distance(spark, sf):
    return graph.distances(edges(spark, sf), hubs(spark, sf)).select("node", rounded(F.col("dist"), 4).alias("dist"))


def classify_reachability(spark, sf):
    e, h = edges(spark, sf), hubs(spark, sf)
    pre = graph.distances(e, h).select("node", (F.col("dist") / 1000).alias("pre"))
    post = graph.distances(e.where("NOT flooded"), h).select("node", (F.col("dist") / 1000).alias("post"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    status, ratio = graph.classify(F.col("pre"), F.col("post"))
    return nodes.join(pre, "node", "left").join(post, "node", "left").select("node", status.alias("status"), rounded(ratio, 4).alias("delay_ratio"))


def severed_bottlenecks(spark, sf):
    """Flooded edges with exactly one end in a cluster."""
    e, c = _clusters(spark, sf)
    return graph.boundary(e.where("flooded"), c).where("boundary").select("component", "edge_id", "a", "b", "is_bridge")


def cluster_obstacles(spark, sf):
    """The three worst different obstacles of each cluster, boundary ones if any."""
    e, c = _clusters(spark, sf)
    return _obstacles(graph.boundary(e.where("flooded"), c))


def _obstacles(x):
    """Edge ids repeat in the tables; of equals the name decides, so that the order of rows does not."""
    own = Window.partitionBy("component")
    x = x.withColumn("any", F.max(F.col("boundary").cast("int")).over(own)).where((F.col("any") == 0) | F.col("boundary"))
    worst = [F.desc("is_bridge"), F.desc("major"), F.desc("fraction"), F.col("edge_id"), F.col("name")]
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("component", "is_bridge", "major", "name").orderBy(*worst))).where("k = 1")
    x = x.withColumn("r", F.row_number().over(own.orderBy(*worst))).where("r <= 3")
    text = F.format_string("%s %s (%d%% flooded)", F.when(F.col("is_bridge"), "Bridge on").when(F.col("major"), "Highway").otherwise("Road"), F.col("name"), F.floor(F.col("fraction") * 100 + 0.5))
    g = x.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))).alias("l"), F.bool_or("is_bridge").alias("has_bridge_cut"), F.bool_or("major").alias("has_highway_cut"))  # at most three rows each
    return g.select("component", F.array_join(F.transform("l", lambda s: s["t"]), "; ").alias("obstacles"), "has_bridge_cut", "has_highway_cut")


def edge_adjacency_bridges(spark, sf):
    return graph.assess_bridges(edges(spark, sf))


def graph_build_merge_nodes(spark, sf):
    """Points merged on a grid, half to even; the first point of a cell gives its place."""
    c = table(spark, sf, "customer")
    tol = 500.0
    gx, gy = F.rint(F.col("c_acctbal") / tol).cast("long"), F.rint((F.col("c_custkey") % 100) * 37.5 / tol).cast("long")
    first = F.struct("c_custkey", "c_acctbal")
    return c.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.min(first).alias("f"), F.count("*").alias("merged")).select("gx", "gy", F.col("f.c_custkey").alias("first_id"), F.col("f.c_acctbal").alias("x"), "merged")


QUERIES = {f.__name__: f for f in (connected_components, isolated_nodes, cluster_metrics, multi_source_distance, classify_reachability, severed_bottlenecks, cluster_obstacles, edge_adjacency_bridges, graph_build_merge_nodes)}

_R = "floor(({0}) * 1e{1} + 0.5) / 1e{1}"
_E = """e AS MATERIALIZED (SELECT l_orderkey * 100 + l_linenumber AS edge_id, o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b, (l_returnflag = 'R' OR l_quantity < 50) AS flooded, p_type = 'ECONOMY' AS is_bridge, l_tax * 10 AS fraction, l_discount * 1000 + 1 AS length, p_brand AS name, p_size > 25 AS major
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), hub AS MATERIALIZED (SELECT s_suppkey * 2 + 1 AS node FROM supplier WHERE s_suppkey % 5 = 0)"""


def _reach(name: str, source: str, seeds: str) -> str:
    return f"{name}_b AS MATERIALIZED (SELECT DISTINCT a AS x, b AS y FROM {source} UNION SELECT b, a FROM {source}), {name} AS (SELECT x AS root, x AS node FROM ({seeds}) UNION SELECT root, y FROM {name} JOIN {name}_b ON node = x)"


def _comp(name: str, source: str, nodes: str) -> str:
    return f"{name}_b AS MATERIALIZED (SELECT DISTINCT a AS x, b AS y FROM {source} UNION SELECT b, a FROM {source}), {name}_r AS (SELECT x AS root, x AS node FROM ({nodes}) UNION SELECT root, y FROM {name}_r JOIN {name}_b ON node = x WHERE y > root), {name} AS MATERIALIZED (SELECT node, min(root) AS component FROM {name}_r GROUP BY 1)"


_ISO = f"""{_E}, pairs AS MATERIALIZED (SELECT a, b, bool_and(flooded) AS flooded FROM e GROUP BY 1, 2), dry AS (SELECT * FROM pairs WHERE NOT flooded),
gone AS (SELECT node FROM hub JOIN pairs ON node = a OR node = b GROUP BY 1 HAVING bool_and(flooded)), alive AS (SELECT node FROM hub WHERE node NOT IN (SELECT node FROM gone)),
{_reach('pre', 'pairs', 'SELECT node AS x FROM hub JOIN pairs ON node = a OR node = b')}, {_reach('post', 'dry', 'SELECT node AS x FROM alive')}, iso AS MATERIALIZED (SELECT DISTINCT node FROM pre WHERE node NOT IN (SELECT node FROM post))"""
_CLUSTER = f"{_ISO}, inner_ AS (SELECT a, b FROM e WHERE NOT flooded AND a IN (SELECT node FROM iso) AND b IN (SELECT node FROM iso)), {_comp('cl', 'inner_', 'SELECT node AS x FROM iso')}"
_BOUNDARY = f"{_CLUSTER}, tb AS (SELECT e.*, ca.component AS ca, cb.component AS cb FROM e LEFT JOIN cl ca ON e.a = ca.node LEFT JOIN cl cb ON e.b = cb.node WHERE flooded AND (ca.component IS NOT NULL OR cb.component IS NOT NULL)), bo AS (SELECT *, ca AS component, ca IS DISTINCT FROM cb AS boundary FROM tb WHERE ca IS NOT NULL UNION ALL SELECT *, cb, true FROM tb WHERE cb IS NOT NULL AND cb IS DISTINCT FROM ca)"


def _dist(name: str, where: str, rounds: int = 60) -> str:
    out = [f"{name}_b AS MATERIALIZED (SELECT x, y, min(length) AS length FROM (SELECT a AS x, b AS y, length FROM e WHERE {where} UNION ALL SELECT b, a, length FROM e WHERE {where}) GROUP BY 1, 2)", f"{name}0 AS MATERIALIZED (SELECT node, 0.0::DOUBLE AS dist FROM hub)"]
    for k in range(rounds):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT node, min(dist) AS dist FROM (SELECT * FROM {name}{k} UNION ALL SELECT y, dist + length FROM {name}{k} JOIN {name}_b ON node = x) GROUP BY 1)")
    return ", ".join(out) + f", {name} AS (SELECT * FROM {name}{rounds})"


SQL = {
    "connected_components": f"WITH RECURSIVE {_E}, {_comp('cc', 'e', 'SELECT a AS x FROM e UNION SELECT b FROM e')} SELECT node, component FROM cc",
    "isolated_nodes": f"WITH RECURSIVE {_ISO} SELECT node FROM iso",
    "cluster_metrics": f"WITH RECURSIVE {_CLUSTER}, g AS (SELECT component, count(*) AS n_nodes, max(node) AS last_node FROM cl GROUP BY 1) SELECT component, n_nodes, last_node, CASE WHEN n_nodes > 1 THEN 'Village_Cluster_' ELSE 'Isolated_Junction_' END || lpad(row_number() OVER (ORDER BY n_nodes DESC, component)::VARCHAR, 4, '0') AS cluster_id, greatest(n_nodes * 75, 50) AS population FROM g",
    "multi_source_distance": f"WITH {_E}, {_dist('d', 'true')} SELECT node, {_R.format('dist', 4)} AS dist FROM d",
    "classify_reachability": f"WITH {_E}, {_dist('d', 'true')}, {_dist('f', 'NOT flooded')}, n AS (SELECT a AS node FROM e UNION SELECT b FROM e), j AS (SELECT n.node, d.dist / 1000 AS pre, f.dist / 1000 AS post FROM n LEFT JOIN d USING (node) LEFT JOIN f USING (node)) SELECT node, CASE WHEN pre IS NULL THEN 'accessible' WHEN post IS NULL THEN 'cut_off' WHEN post / greatest(pre, 1.0) >= 2 OR post - pre >= 15 THEN 'severely_delayed' ELSE 'accessible' END AS status, {_R.format('CASE WHEN pre IS NULL THEN 1.0 WHEN post IS NULL THEN 999.0 ELSE post / greatest(pre, 1.0) END', 4)} AS delay_ratio FROM j",
    "severed_bottlenecks": f"WITH RECURSIVE {_BOUNDARY} SELECT component, edge_id, a, b, is_bridge FROM bo WHERE boundary",
    "cluster_obstacles": f"""WITH RECURSIVE {_BOUNDARY}, k1 AS (SELECT *, bool_or(boundary) OVER (PARTITION BY component) AS any_ FROM bo), k2 AS (SELECT *, row_number() OVER (PARTITION BY component, is_bridge, major, name ORDER BY fraction DESC, edge_id) AS k FROM k1 WHERE boundary OR NOT any_),
 k3 AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY is_bridge DESC, major DESC, fraction DESC, edge_id) AS r FROM k2 WHERE k = 1) SELECT component, string_agg(printf('%s %s (%d%% flooded)', CASE WHEN is_bridge THEN 'Bridge on' WHEN major THEN 'Highway' ELSE 'Road' END, name, floor(fraction * 100 + 0.5)::BIGINT), '; ' ORDER BY r) AS obstacles, bool_or(is_bridge) AS has_bridge_cut, bool_or(major) AS has_highway_cut FROM k3 WHERE r <= 3 GROUP BY 1""",
    "edge_adjacency_bridges": f"""WITH {_E}, wet AS (SELECT * FROM e WHERE flooded OR fraction >= 0.3), ends AS (SELECT a AS node, b AS other FROM wet UNION SELECT b, a FROM wet),
 x AS (SELECT e.*, EXISTS (SELECT 1 FROM ends n WHERE n.node = e.a AND n.other <> e.b) AS u, EXISTS (SELECT 1 FROM ends n WHERE n.node = e.b AND n.other <> e.a) AS v, least(greatest(fraction, 0.0), 1.0) AS ff, flooded OR fraction >= 0.3 AS w FROM e WHERE is_bridge),
 y AS (SELECT *, CASE WHEN w AND ff >= 0.5 THEN 'submerged' WHEN w THEN 'high_hydrodynamic_load' WHEN u OR v THEN 'approaches_cut' WHEN ff > 0.01 THEN 'high_hydrodynamic_load' ELSE '' END AS failure_mode FROM x)
 SELECT edge_id, a, b, failure_mode, {_R.format("CASE WHEN w AND ff >= 0.5 THEN least(0.70::DOUBLE + 0.30::DOUBLE * least(1.0, greatest(0.0, (ff - 0.5) / 0.5)) + CASE WHEN u OR v THEN 0.05::DOUBLE ELSE 0 END, 1.0) WHEN w THEN least(0.50::DOUBLE + 0.30::DOUBLE * least(1.0, ff / 0.5) + CASE WHEN u OR v THEN 0.15::DOUBLE ELSE 0 END, 1.0) WHEN u OR v THEN CASE WHEN u AND v THEN 0.80::DOUBLE ELSE 0.60::DOUBLE END WHEN ff > 0.01 THEN 0.40::DOUBLE + 0.30::DOUBLE * ff ELSE 0.0 END", 2)} AS damage_score, failure_mode <> '' AS likely_damaged FROM y""",
    "graph_build_merge_nodes": "SELECT round_even(c_acctbal / 500.0::DOUBLE, 0)::BIGINT AS gx, round_even((c_custkey % 100) * 37.5::DOUBLE / 500.0::DOUBLE, 0)::BIGINT AS gy, min(c_custkey) AS first_id, min_by(c_acctbal, c_custkey) AS x, count(*) AS merged FROM customer GROUP BY 1, 2",
}
