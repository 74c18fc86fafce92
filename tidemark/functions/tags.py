"""Column expressions over map tags (lists of strings, as tags may hold several values): kinds of roads, speeds, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Free-flow speeds in km/h, main corridors, and tag values that name a bridge.
SPEEDS = {
    "motorway": 100.0, "motorway_link": 60.0, "trunk": 80.0, "trunk_link": 50.0, "primary": 60.0, "primary_link": 40.0, "secondary": 50.0, "secondary_link": 35.0,
    "tertiary": 40.0, "tertiary_link": 30.0, "unclassified": 30.0, "residential": 25.0, "service": 15.0, "track": 15.0, "default": 30.0,
}
CORRIDORS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"]
UNSET = ["no", "false", "none", "0", ""]
STRUCTURES = ["bridge", "tunnel", "viaduct", "culvert", "aqueduct"]
BRIDGES = ["yes", "true", "True", "1", "viaduct", "aqueduct"]
FACILITIES = ["hospital", "clinic", "doctors", "pharmacy"]


def _clean(v: Column) -> Column:
    return F.lower(F.trim(v))


def _any(tag: Column, test) -> Column:
    return F.coalesce(F.exists(F.filter(tag, lambda v: v.isNotNull()), test), F.lit(False))


def crossing(bridge: Column, man_made: Column, tunnel: Column, structure: Column) -> Column:
    """A bridge, tunnel or the like by any of four tags; `no`, `false`, `none`, `0` and empty don't count."""
    given = lambda t: _any(t, lambda v: ~_clean(v).isin(UNSET))
    return given(bridge) | _any(man_made, lambda v: _clean(v) == "bridge") | given(tunnel) | _any(structure, lambda v: _clean(v).isin(STRUCTURES))


def flagged_bridge(damaged: Column, is_bridge: Column, bridge: Column, man_made: Column) -> Column:
    """A bridge by either flag or by one of a few values as they are; tunnels don't count."""
    no = F.lit(False)
    return F.coalesce(damaged, no) | F.coalesce(is_bridge, no) | F.coalesce(bridge.isin(BRIDGES), no) | F.coalesce(man_made == "bridge", no)


def plain_bridge(bridge: Column) -> Column:
    return F.coalesce(F.lower(bridge).isin("true", "yes", "1"), F.lit(False))


def corridor(highway: Column) -> Column:
    return _any(highway, lambda v: _clean(v).isin(CORRIDORS))


def speed(highway: Column) -> Column:
    """km/h by the first kind of road; unknown or none: the default."""
    table = F.create_map(*[F.lit(x) for kv in SPEEDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.get(highway, F.lit(0))), F.lit(SPEEDS["default"]))


def free_flow_seconds(length_m: Column, kmh: Column) -> Column:
    return F.when(kmh <= 0, F.lit(float("inf"))).otherwise(length_m / 1000.0 / kmh * 3600.0)


def _filled(tag: Column) -> Column:
    return F.filter(F.coalesce(tag, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))


def road_name(name: Column, default: str = "Access Road") -> Column:
    return F.coalesce(F.nullif(F.array_join(_filled(name), ", "), F.lit("")), F.lit(default))


def road_kind(highway: Column, default: str = "road") -> Column:
    return F.coalesce(F.get(_filled(highway), F.lit(0)), F.lit(default))


def edge_id(osmid: Column, u: Column, v: Column, key: Column) -> Column:
    """The ids of the map joined, else both ends and the key."""
    return F.coalesce(F.nullif(F.array_join(osmid, ","), F.lit("")), F.concat_ws("_", u, v, key))


def response(severed: Column, bridge: Column) -> Column:
    """What to do for a cut-off cluster, by its severed ways and whether one is a bridge."""
    return (
        F.when(severed == 0, "Local road blockages - ground reconnaissance recommended")
        .when(bridge, "Airdrop / Foot trail access only (Bridge severed by GLOF torrent)")
        .otherwise("Heavy equipment road clearance required (Highway corridor blocked)")
    )


def grey(db: Column, low: float, high: float) -> Column:
    """A backscatter value as a grey of 0 to 255."""
    return F.floor(F.least(F.greatest((db - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def length_m(attribute: Column, projected: Column, degrees: Column) -> Column:
    """A road's length: its attribute if that is a number from 0 on, else the projected length, else degrees times
    111,000 metres."""
    given = attribute.try_cast("double")
    return F.coalesce(F.when((given >= 0) & ~F.isnan(given), given), projected, degrees * 111000.0)


def bounds(b: Column) -> Column:
    """north, south, east, west of four numbers given in that order or as west, south, east, north: the first and the
    third are taken for longitudes if they lie nearer together than the first two."""
    x = lambda i: F.element_at(b, i + 1)
    swapped = F.abs(x(0) - x(2)) < F.abs(x(0) - x(1))
    pick = lambda f, a, c: F.when(swapped, f(x(a[0]), x(a[1]))).otherwise(f(x(c[0]), x(c[1])))
    return F.struct(pick(F.greatest, (1, 3), (0, 1)).alias("north"), pick(F.least, (1, 3), (0, 1)).alias("south"), pick(F.greatest, (0, 2), (2, 3)).alias("east"), pick(F.least, (0, 2), (2, 3)).alias("west"))
