"""Rescue priority of cut-off settlements, and the dispatch list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import clip, rounded

#: Weights, reference capacities, tier borders.
WEIGHTS = {"population": 0.40, "distance": 0.25, "trapped_nodes": 0.20, "vulnerability": 0.15}
CAPS = {"population": 2500.0, "distance": 20.0, "trapped_nodes": 80.0}
TIERS = [(75.0, "CRITICAL", "#D32F2F"), (50.0, "HIGH", "#F57C00"), (25.0, "MEDIUM", "#FBC02D"), (0.0, "LOW", "#1976D2")]
ALIASES = {"pop": "population", "estimated_population": "population", "dist": "distance", "distance_km": "distance", "hub_dist": "distance", "nodes": "trapped_nodes", "nodes_count": "trapped_nodes", "vuln": "vulnerability", "vulnerability_factor": "vulnerability", "critical_vulnerability": "vulnerability"}


def weights(given: dict[str, float] | None = None) -> dict[str, float]:
    """Weights with aliases resolved, scaled to the sum 1; the defaults if all are 0."""
    w = WEIGHTS | {ALIASES.get(k, k): float(v) for k, v in (given or {}).items() if ALIASES.get(k, k) in WEIGHTS}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else dict(WEIGHTS)


def blended(x: Column, low: Column, high: Column, cap: float) -> Column:
    """0.65 of the place between the least and the largest and 0.35 of the share of the cap; that share alone if all are equal."""
    share = clip(x / cap, 0.0, 1.0)
    return clip(F.when(high > low, (x - low) / (high - low) * 0.65 + share * 0.35).otherwise(share), 0.0, 1.0)


def vulnerability(population: Column, distance: Column, bridge: Column, highway: Column, cuts: Column) -> Column:
    one = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    v = F.lit(0.10) + one(bridge, 0.40) + one(highway, 0.25) + F.when(cuts >= 3, 0.15).when(cuts >= 1, 0.08).otherwise(0.0)
    return F.least(v + one((population >= 300) & (distance >= 5), 0.10), F.lit(1.0))


def tier(score: Column, place: int = 1) -> Column:
    out = F.when(score >= TIERS[0][0], TIERS[0][place])
    for t in TIERS[1:3]:
        out = out.when(score >= t[0], t[place])
    return out.otherwise(TIERS[3][place])


def action(tier_: Column, population: Column, distance: Column, bridge: Column) -> Column:
    """The dispatch recommendation."""
    air, boat, detour = "Airdrop supplies / Amphibious rescue", "Boat evacuation", "Road detour possible / "
    return (
        F.when(tier_ == "CRITICAL", F.when(bridge | (distance >= 8), air).when(population >= 500, "Immediate boat evacuation & medical air-evac").otherwise(air))
        .when(tier_ == "HIGH", F.when((population >= 150) | bridge | (distance < 6), boat).otherwise("Amphibious transport & emergency supply drop"))
        .when(tier_ == "MEDIUM", F.when((distance <= 5) & ~bridge, detour + "High-clearance vehicle rescue").otherwise("Shallow-draft boat evacuation / monitoring"))
        .otherwise(detour + "Monitor flood levels")
    )


def prioritise(clusters: DataFrame, given: dict[str, float] | None = None) -> DataFrame:
    """Scores, tiers, actions and ranks clusters (cluster_id, population, distance_km, trapped_nodes, has_bridge_cut,
    has_highway_cut, num_cut_edges, obstacles, ord); ties keep the order of `ord`.

    The extremes are one aggregated row, joined to all; only the rank needs a global order, and that is the result's."""
    w = weights(given)
    text = F.lower(F.coalesce("obstacles", F.lit("")))
    c = clusters.select(
        "cluster_id", "ord",
        F.nanvl(F.coalesce(F.col("population").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("pop"),
        F.greatest(F.coalesce(F.col("distance_km").cast("double"), F.lit(10.0)), F.lit(0.0)).alias("dist"),
        F.greatest(F.coalesce(F.col("trapped_nodes").cast("double"), F.lit(1.0)), F.lit(1.0)).alias("nodes"),
        F.coalesce("has_bridge_cut", F.lit(False)).alias("raw_bridge"),
        (F.coalesce("has_bridge_cut", F.lit(False)) | text.rlike("bridge|viaduct")).alias("bridge"),
        (F.coalesce("has_highway_cut", F.lit(False)) | text.rlike("highway|motorway|trunk|primary")).alias("highway"),
        F.coalesce("num_cut_edges", F.lit(0)).alias("cuts"),
    )
    ends = c.agg(*[f(x).alias(f"{n}_{x}") for x in ("pop", "dist", "nodes") for n, f in (("lo", F.min), ("hi", F.max))])
    c = c.crossJoin(F.broadcast(ends))  # one row
    v = vulnerability(F.col("pop"), F.col("dist"), F.col("bridge"), F.col("highway"), F.col("cuts"))
    parts = [("population", "pop"), ("distance", "dist"), ("trapped_nodes", "nodes")]
    raw = sum((blended(F.col(x), F.col(f"lo_{x}"), F.col(f"hi_{x}"), CAPS[k]) * w[k] for k, x in parts), v * w["vulnerability"])
    c = c.withColumn("priority_score", rounded(clip(raw * 100, 0.0, 100.0), 1)).withColumn("vulnerability", rounded(v, 3))
    c = c.withColumn("priority_tier", tier(F.col("priority_score"))).withColumn("priority_color", tier(F.col("priority_score"), 2))
    order = Window.orderBy(F.desc("priority_score"), F.desc("pop"), "ord")
    return c.select(F.row_number().over(order).alias("rank"), "cluster_id", "priority_tier", "priority_color", "priority_score", "vulnerability", rounded(F.col("pop"), 4).alias("population"), rounded(F.col("dist"), 4).alias("distance_km"), F.col("nodes").alias("trapped_nodes"), action(F.col("priority_tier"), F.col("pop"), F.col("dist"), F.col("raw_bridge")).alias("recommended_action"))


MANIFEST = ["Rank", "Cluster_ID", "Priority_Tier", "Priority_Score", "Estimated_Population", "Trapped_Nodes", "Dist_to_Hub_km", "Nearest_Hub", "Centroid_Lat", "Centroid_Lon", "Recommended_Action"]


def dispatch(ranked: DataFrame, tiers: list[str], least: float, pattern: str, k: int) -> DataFrame:
    """The first k ranked rows of the tiers with enough people and an id like the pattern."""
    return ranked.where(F.col("priority_tier").isin(tiers) & (F.col("population") >= least) & F.lower("cluster_id").rlike(pattern.lower())).orderBy("rank").limit(k)


def coordinates(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f° N, %.4f° E", lat, lon)
