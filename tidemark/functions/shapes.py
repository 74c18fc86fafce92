"""Column expressions over points: arrays of structs x, y. Lines, rings, clipping by a unit cell, snapping, crossings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(points: Column) -> Column:
    """The segments of a line as structs x1, y1, x2, y2."""
    pair = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), pair)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def line_length(points: Column) -> Column:
    return _sum(F.transform(segments(points), lambda s: F.sqrt((s["x2"] - s["x1"]) * (s["x2"] - s["x1"]) + (s["y2"] - s["y1"]) * (s["y2"] - s["y1"]))))


def longest_part(parts: Column) -> Column:
    """The longest line of a list of lines; the first of equals."""
    scored = F.transform(parts, lambda p, i: F.struct(line_length(p).alias("size"), (-i).alias("order"), p.alias("part")))
    return F.array_max(scored)["part"]


def straight(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A line's points, or the straight line between its ends where it has none."""
    return F.when(F.size(points) >= 2, points).otherwise(F.array(point(x1, y1), point(x2, y2)))


def _ring_pairs(ring: Column) -> Column:
    """Each corner with the next one, the last with the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def ring_area(ring: Column) -> Column:
    """The area of a ring that is not closed."""
    return F.abs(_sum(F.transform(_ring_pairs(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))) / 2


def ring_centroid(ring: Column) -> Column:
    """The centre of gravity of a ring; of a ring without area, the mean of its corners."""
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    pairs, n = _ring_pairs(ring), F.size(ring)
    twice = _sum(F.transform(pairs, cross))
    gravity = lambda c: _sum(F.transform(pairs, lambda e: (e["p"][c] + e["q"][c]) * cross(e))) / (twice * 3)
    mean = lambda c: _sum(F.transform(ring, lambda p: p[c])) / n
    return F.when(twice == 0, point(mean("x"), mean("y"))).otherwise(point(gravity("x"), gravity("y")))


def let(value: Column, use) -> Column:
    """use(value) with value computed once: bodies of higher-order functions share no common expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _half_plane(axis: str, sign: float, edge: Column):
    other, none = "y" if axis == "x" else "x", F.array().cast("array<struct<x:double,y:double>>")

    def cut(e: Column) -> Column:
        p, q = e["p"], e["q"]
        dp, dq = (p[axis] - edge) * sign, (q[axis] - edge) * sign
        along = p[other] + (q[other] - p[other]) * dp / F.nullif(dp - dq, F.lit(0.0))
        at = point(edge, along) if axis == "x" else point(along, edge)
        return F.concat(F.when((dp >= 0) != (dq >= 0), F.array(at)).otherwise(none), F.when(dq >= 0, F.array(point(q["x"], q["y"]))).otherwise(none))

    return lambda ring: F.flatten(F.transform(_ring_pairs(ring), cut))


def clip_ring(ring: Column, col: Column, row: Column) -> Column:
    """The part of a convex ring inside the unit cell at (col, row), half-plane by half-plane (Sutherland, Hodgman)."""
    for axis, sign, edge in (("x", 1.0, col), ("x", -1.0, col + 1), ("y", 1.0, row), ("y", -1.0, row + 1)):
        ring = let(ring, _half_plane(axis, sign, edge))
    return ring


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring: an odd number of its edges cross the ray to the right."""
    cross = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"])
    return F.size(F.filter(_ring_pairs(ring), cross)) % 2 == 1


def cell_distance(x: Column, y: Column, col: Column, row: Column) -> Column:
    """Distance of a point to a unit cell."""
    dx = F.greatest(F.lit(0.0), col - x, x - (col + 1))
    dy = F.greatest(F.lit(0.0), row - y, y - (row + 1))
    return F.sqrt(dx * dx + dy * dy)


def crossing(a: Column, b: Column) -> Column:
    """Where segment a (x1, y1, x2, y2) meets segment b: its places along a from 0 to 1 (one, or both ends of the common
    part of two segments on one line)."""
    ax, ay, bx, by = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    dx, dy = b["x1"] - a["x1"], b["y1"] - a["y1"]
    det, size = ax * by - ay * bx, ax * ax + ay * ay
    t, u = (dx * by - dy * bx) / F.nullif(det, F.lit(0.0)), (dx * ay - dy * ax) / F.nullif(det, F.lit(0.0))
    none = F.array().cast("array<double>")
    p, q = (dx * ax + dy * ay) / F.nullif(size, F.lit(0.0)), ((dx + bx) * ax + (dy + by) * ay) / F.nullif(size, F.lit(0.0))
    low, high = F.greatest(F.lit(0.0), F.least(p, q)), F.least(F.lit(1.0), F.greatest(p, q))
    on_line = F.when((dx * ay - dy * ax == 0) & (size > 0) & (low <= high), F.array_distinct(F.array(low, high))).otherwise(none)
    return F.when(det == 0, on_line).when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.array(t)).otherwise(none)


def snapped(x: Column, y: Column, s: Column, tolerance: float) -> Column:
    """A point moved onto a segment (x1, y1, x2, y2) if that is within the tolerance, and its place along it."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    t = F.least(F.greatest(F.coalesce(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    px, py = s["x1"] + dx * t, s["y1"] + dy * t
    near = F.sqrt((px - x) * (px - x) + (py - y) * (py - y)) <= tolerance
    return F.struct(F.when(near, px).otherwise(x).alias("x"), F.when(near, py).otherwise(y).alias("y"), t.alias("t"), near.alias("near"))
