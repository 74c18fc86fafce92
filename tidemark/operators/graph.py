"""Graph operators on edge tables: components, distances, isolation, bottlenecks, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import rounded
from tidemark.session import dealt, written


def _is_stars(e: DataFrame) -> bool:
    """Whether every node of the edges (a, b) either points to one node or is only pointed to."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out > 0 AND in > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes of undirected edges (columns a, b).

    Alternating large and small stars: each round every node links its larger (then its smaller) neighbours to its
    least one. Minima are pre-aggregated, each round is written to the shared folder, and few rounds suffice: none, where
    the edges are stars around their least nodes already."""
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "links")
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(dealt(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def distances(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, dist from the nearest seed over undirected edges (a, b, length): only nodes that got closer in a round
    relax their edges in the next, all seeds at once."""
    both = edges.select("a", "b", "length").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    both = written(both.groupBy("a", "b").agg(F.min("length").alias("length")), "edges")
    best = written(seeds.select(F.col("node"), F.lit(0.0).alias("dist")).distinct(), "distances")
    front = best
    while not front.isEmpty():
        offers = front.join(both, front.node == both.a).select(F.col("b").alias("node"), (F.col("dist") + F.col("length")).alias("dist")).groupBy("node").agg(F.min("dist").alias("offer"))
        merged = written(best.join(offers, "node", "full").select("node", F.least("dist", "offer").alias("dist"), (F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))).alias("closer")), "distances")
        best, front = merged.select("node", "dist"), merged.where("closer").select("node", "dist")
    return best


def reachable(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """node: all in a component with a hub."""
    comp = components(edges)
    alive = comp.join(hubs.select("node").distinct(), "node", "left_semi").select("component").distinct()
    return comp.join(alive, "component", "left_semi").select("node")


def isolated(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """node: reached from a hub over all edges (a, b, flooded) but not over the dry ones. A dry one of parallel edges
    keeps its link; nodes that never had a way to a hub are not isolated."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "flooded").groupBy("a", "b").agg(F.bool_and("flooded").alias("flooded"))
    dry = pairs.where("NOT flooded")
    hub_edges = pairs.join(hubs.select(F.col("node").alias("a")), "a", "left_semi").unionByName(pairs.join(hubs.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "flooded"))
    lost = hub_edges.select(F.explode(F.array("a", "b")).alias("node"), "flooded").join(hubs, "node", "left_semi").groupBy("node").agg(F.bool_and("flooded").alias("gone")).where("gone").select("node")
    alive = hubs.join(lost, "node", "left_anti")
    before, after = reachable(pairs, hubs), reachable(dry, alive).unionByName(alive.select("node")).distinct()
    return before.join(after, "node", "left_anti")


def clusters(edges: DataFrame, nodes: DataFrame, least: int = 1) -> DataFrame:
    """node, component of the given nodes over the edges inside them; components of at least `least` nodes."""
    inside = edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    found = nodes.join(components(inside), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    big = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return found.join(big, "component", "left_semi").select("node", "component")


def classify(pre: Column, post: Column) -> tuple[Column, Column]:
    """Status and delay ratio from distances in km before and after."""
    ratio = post / F.greatest(pre, F.lit(1.0))
    status = F.when(pre.isNull(), "accessible").when(post.isNull(), "cut_off").when((ratio >= 2) | (post - pre >= 15), "severely_delayed").otherwise("accessible")
    return status, F.when(pre.isNull(), 1.0).when(post.isNull(), 999.0).otherwise(ratio)


def boundary(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with an end in a component, with it, and whether the other end is outside (boundary)."""
    a = members.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = members.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    x = edges.join(a, "a", "left").join(b, "b", "left").where("ca IS NOT NULL OR cb IS NOT NULL")
    both = x.select("*", F.explode(F.array_distinct(F.array_compact(F.array("ca", "cb")))).alias("component"))
    return both.withColumn("boundary", ~F.col("ca").eqNullSafe(F.col("cb"))).drop("ca", "cb")


def bridge_damage(fraction: Column, flooded: Column, start_cut: Column, end_cut: Column) -> tuple[Column, Column]:
    """Failure mode and damage score of a bridge from its flooded fraction and its flooded approaches."""
    ff = F.least(F.greatest(F.nanvl(F.coalesce(fraction, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    wet, near = F.coalesce(flooded, F.lit(False)) | (ff >= 0.3), start_cut | end_cut
    under = 0.70 + 0.30 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ff - 0.5) / 0.5)) + F.when(near, 0.05).otherwise(0.0)
    load = 0.50 + 0.30 * F.least(F.lit(1.0), ff / 0.5) + F.when(near, 0.15).otherwise(0.0)
    mode = F.when(wet & (ff >= 0.5), "submerged").when(wet, "high_hydrodynamic_load").when(near, "approaches_cut").when(ff > 0.01, "high_hydrodynamic_load").otherwise("")
    score = F.when(wet & (ff >= 0.5), F.least(under, F.lit(1.0))).when(wet, F.least(load, F.lit(1.0))).when(near, F.when(start_cut & end_cut, 0.80).otherwise(0.60)).when(ff > 0.01, 0.40 + 0.30 * ff).otherwise(0.0)
    return mode, rounded(score, 2)


def assess_bridges(edges: DataFrame) -> DataFrame:
    """Bridge edges (edge_id, a, b, is_bridge, flooded, fraction) with mode and score; approaches are the other edges
    at an end that do not lead to the opposite end."""
    wet = edges.where(F.coalesce("flooded", F.lit(False)) | (F.nanvl(F.coalesce("fraction", F.lit(0.0)), F.lit(0.0)) >= 0.3))
    ends = wet.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(wet.select(F.col("b").alias("node"), F.col("a").alias("other")))
    # Of each node's wet neighbours two suffice to know whether one differs from the opposite end.
    near = ends.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    x = edges.where("is_bridge")
    for end, opposite, name in (("a", "b", "start_cut"), ("b", "a", "end_cut")):
        x = x.join(near.select(F.col("node").alias(end), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), end, "left")
        x = x.withColumn(name, F.coalesce((F.col("_lo") != F.col(opposite)) | (F.col("_hi") != F.col(opposite)), F.lit(False))).drop("_lo", "_hi")
    mode, score = bridge_damage(F.col("fraction"), F.col("flooded"), F.col("start_cut"), F.col("end_cut"))
    return x.select("edge_id", "a", "b", mode.alias("failure_mode"), score.alias("damage_score"), (mode != "").alias("likely_damaged"))
