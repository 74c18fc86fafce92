"""Ranking, dispatch and summary queries: nations stand for cut-off settlements, order lines for road segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expr import rounded
from tidemark.operators import ranking
from tidemark.session import table


def clusters(spark, sf):
    """A settlement for each nation: people from customers, distance from balances, obstacles from returned lines."""
    c, o, l, n = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "nation"))
    people = c.groupBy("c_nationkey").agg((F.count("*") * 10.0).alias("population"), (F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("*") / 500).alias("distance_km"))
    returned = l.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("r"))
    cuts = o.join(returned, o.o_orderkey == returned.l_orderkey, "left").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.sum(F.coalesce("r", F.lit(0))).alias("returned"))
    x = n.join(people, n.n_nationkey == people.c_nationkey).drop("c_nationkey").join(cuts, F.col("n_nationkey") == F.col("c_nationkey"))
    return x.select(F.col("n_name").alias("cluster_id"), F.col("n_nationkey").alias("ord"), "population", "distance_km", (F.col("orders") / 10.0).alias("trapped_nodes"), (F.col("returned") % 2 == 0).alias("has_bridge_cut"), (F.col("n_nationkey") % 3 == 0).alias("has_highway_cut"), (F.col("returned") % 5).cast("int").alias("num_cut_edges"), F.when(F.col("n_nationkey") % 7 == 0, "Old viaduct on trunk road").alias("obstacles"))


_CLUSTERS = """
people AS (SELECT c_nationkey, count(*) * 10.0::DOUBLE AS population, sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*) / 500 AS distance_km FROM customer GROUP BY 1),
returned AS (SELECT l_orderkey, count(*) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
cuts AS (SELECT c_nationkey, count(*) AS orders, sum(coalesce(r, 0)) AS returned FROM orders LEFT JOIN returned ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
c0 AS (SELECT n_name AS cluster_id, n_nationkey AS ord, population AS pop, distance_km AS dist, greatest(orders / 10.0::DOUBLE, 1.0) AS nodes, returned % 2 = 0 AS raw_bridge,
  returned % 2 = 0 OR n_nationkey % 7 = 0 AS bridge, n_nationkey % 3 = 0 OR n_nationkey % 7 = 0 AS highway, returned % 5 AS cuts
  FROM nation JOIN people p ON n_nationkey = p.c_nationkey JOIN cuts k ON n_nationkey = k.c_nationkey)"""


def _priority_sql(w: dict[str, float]) -> str:
    def part(x: str, cap: float) -> str:
        share = f"least(greatest({x} / {cap}, 0.0), 1.0)"
        lo, hi = f"min({x}) OVER ()", f"max({x}) OVER ()"
        return f"least(greatest(CASE WHEN {hi} > {lo} THEN ({x} - {lo}) / ({hi} - {lo}) * 0.65::DOUBLE + {share} * 0.35::DOUBLE ELSE {share} END, 0.0), 1.0)"

    return f"""WITH {_CLUSTERS},
v AS (SELECT *, least(0.10::DOUBLE + CASE WHEN bridge THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN highway THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN cuts >= 3 THEN 0.15::DOUBLE WHEN cuts >= 1 THEN 0.08::DOUBLE ELSE 0 END
  + CASE WHEN pop >= 300 AND dist >= 5 THEN 0.10::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS vul FROM c0),
s AS (SELECT *, floor(least(greatest(({part('pop', 2500.0)} * {w['population']}::DOUBLE + {part('dist', 20.0)} * {w['distance']}::DOUBLE + {part('nodes', 80.0)} * {w['trapped_nodes']}::DOUBLE + vul * {w['vulnerability']}::DOUBLE) * 100, 0.0), 100.0) * 10 + 0.5) / 10 AS priority_score FROM v),
t AS (SELECT *, CASE WHEN priority_score >= 75 THEN 'CRITICAL' WHEN priority_score >= 50 THEN 'HIGH' WHEN priority_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority_tier FROM s)
SELECT row_number() OVER (ORDER BY priority_score DESC, pop DESC, ord)::INTEGER AS rank, cluster_id, priority_tier,
  CASE priority_tier WHEN 'CRITICAL' THEN '#D32F2F' WHEN 'HIGH' THEN '#F57C00' WHEN 'MEDIUM' THEN '#FBC02D' ELSE '#1976D2' END AS priority_color,
  priority_score, floor(vul * 1000 + 0.5) / 1000 AS vulnerability, floor(pop * 10000 + 0.5) / 10000 AS population, floor(dist * 10000 + 0.5) / 10000 AS distance_km, nodes AS trapped_nodes,
  CASE priority_tier WHEN 'CRITICAL' THEN CASE WHEN raw_bridge OR dist >= 8 THEN 'Airdrop supplies / Amphibious rescue' WHEN pop >= 500 THEN 'Immediate boat evacuation & medical air-evac' ELSE 'Airdrop supplies / Amphibious rescue' END
    WHEN 'HIGH' THEN CASE WHEN pop >= 150 OR raw_bridge OR dist < 6 THEN 'Boat evacuation' ELSE 'Amphibious transport & emergency supply drop' END
    WHEN 'MEDIUM' THEN CASE WHEN dist <= 5 AND NOT raw_bridge THEN 'Road detour possible / High-clearance vehicle rescue' ELSE 'Shallow-draft boat evacuation / monitoring' END
    ELSE 'Road detour possible / Monitor flood levels' END AS recommended_action
FROM t"""


_CUSTOM = {"pop": 0.7, "dist": 0.1, "nodes": 0.1, "vuln": 0.3}


def rescue_priority_rank(spark, sf):
    return ranking.prioritise(clusters(spark, sf))


def priority_custom_weights(spark, sf):
    return ranking.prioritise(clusters(spark, sf), _CUSTOM)


def dispatch_filter_topk(spark, sf):
    ranked = ranking.dispatch(rescue_priority_rank(spark, sf), ["CRITICAL", "HIGH", "MEDIUM"], 100.0, "nation_1|nation_2", 5)
    return ranked.select("rank", "cluster_id", "priority_tier", ranking.coordinates(F.col("distance_km"), F.col("population")).alias("place"))


def road_stats(spark, sf):
    """Lengths, flooded lengths and primary corridors cut, in one pass of conditional sums."""
    l = table(spark, sf, "lineitem")
    q, cut = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_returnflag") == "R"
    s = l.agg(F.sum(q).alias("t"), F.coalesce(F.sum(F.when(cut, q)), F.lit(0)).alias("f"), F.count("*").alias("segments"), F.count_if(cut).alias("flooded_segments"), F.count_if(cut & (F.col("l_linestatus") == "F")).alias("primary_cut"))
    return s.select(rounded(F.col("t").cast("double"), 2).alias("total_length"), rounded(F.col("f").cast("double"), 2).alias("flooded_length"), rounded(F.when(F.col("t") > 0, F.col("f").cast("double") / F.col("t").cast("double") * 100).otherwise(0.0), 2).alias("percent_cut"), "segments", "flooded_segments", "primary_cut")


def damage_summary_pivot(spark, sf):
    l = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("decimal(18,2)")
    return l.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.coalesce(F.sum(q), F.lit(0)).cast("double")).select("l_linestatus", *(F.coalesce(k, F.lit(0.0)).alias(f"length_{k.lower()}") for k in "ANR"))


def union_by_name_layers(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    a = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (rescue_priority_rank, priority_custom_weights, dispatch_filter_topk, road_stats, damage_summary_pivot, union_by_name_layers)}
SQL = {
    "rescue_priority_rank": _priority_sql(ranking.weights()),
    "priority_custom_weights": _priority_sql(ranking.weights(_CUSTOM)),
    "dispatch_filter_topk": f"""SELECT rank, cluster_id, priority_tier, printf('%.4f° N, %.4f° E', distance_km, population) AS place FROM ({_priority_sql(ranking.weights())})
WHERE priority_tier IN ('CRITICAL', 'HIGH', 'MEDIUM') AND population >= 100 AND regexp_matches(lower(cluster_id), 'nation_1|nation_2') ORDER BY rank LIMIT 5""",
    "road_stats": """SELECT floor(t * 100 + 0.5) / 100 AS total_length, floor(f * 100 + 0.5) / 100 AS flooded_length, CASE WHEN t > 0 THEN floor(f / t * 100 * 100 + 0.5) / 100 ELSE 0.0 END AS percent_cut, segments, flooded_segments, primary_cut
FROM (SELECT sum(l_quantity::DECIMAL(18,2))::DOUBLE AS t, coalesce(sum(l_quantity::DECIMAL(18,2)) FILTER (WHERE l_returnflag = 'R'), 0)::DOUBLE AS f, count(*) AS segments, count(*) FILTER (WHERE l_returnflag = 'R') AS flooded_segments,
 count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS primary_cut FROM lineitem)""",
    "damage_summary_pivot": "SELECT l_linestatus, " + ", ".join(f"coalesce(sum(l_quantity::DECIMAL(18,2)) FILTER (WHERE l_returnflag = '{k}'), 0)::DOUBLE AS length_{k.lower()}" for k in "ANR") + " FROM lineitem GROUP BY 1",
    "union_by_name_layers": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
}
