"""Column expressions: rounding, radiometry, map projection, terrain angles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value, alike in all engines: floor(x * 10**d + 0.5) / 10**d."""
    p = float(10**digits)
    return F.floor(x * p + 0.5).cast("double") / F.lit(p)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def to_db(x: Column) -> Column:
    """Linear backscatter in decibels, floored at 1e-6; NaN stays."""
    return F.log10(F.greatest(x, F.lit(1e-6))) * 10.0


def from_db(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normalised(db: Column, low: float = -30.0, high: float = 0.0, epsilon: float = 0.0) -> Column:
    """A decibel value scaled to 0..1 between low and high."""
    return (clip(db, low, high) - low) / (high - low + epsilon)


def flood_confidence(pre: Column, post: Column, drop: float, water: float, vh: Column | None = None) -> Column:
    """Mean of two clipped margins: of the drop and of the dark post value; a second polarisation can only raise it."""
    c = (clip((F.lit(drop) - (post - pre)) / abs(drop), 0.0, 1.0) + clip((F.lit(water) - post) / 10.0, 0.0, 1.0)) / 2
    return c if vh is None else F.greatest(c, (c + vh) / 2)


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone, without the Norwegian exceptions."""
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + F.floor((lon + 180) / 6).cast("int") + 1


#: WGS 84 and the third flattening's series of the transverse Mercator projection (Krueger), order 4.
_A, _FLATTENING = 6378137.0, 1 / 298.257223563
_N = _FLATTENING / (2 - _FLATTENING)
RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def utm_project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the point's own UTM zone, in metres."""
    central = (F.floor((lon + 180) / 6) * 6 - 177).cast("double")
    phi, lam = F.radians(lat), F.radians(lon - central)
    e = F.lit(ECCENTRICITY)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        y = y + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return F.lit(0.9996 * RADIUS) * x + 500000.0, F.lit(0.9996 * RADIUS) * y + F.when(lat < 0, F.lit(1e7)).otherwise(F.lit(0.0))


def utm_unproject(x: Column, y: Column, zone: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing in a zone given by its EPSG code (326zz north, 327zz south):
    the series backwards, then the latitude from its conformal one by four steps of a fixed-point iteration."""
    south, number = zone >= 32700, F.pmod(zone, F.lit(100))
    xi, eta = (y - F.when(south, F.lit(1e7)).otherwise(F.lit(0.0))) / F.lit(0.9996 * RADIUS), (x - 500000.0) / F.lit(0.9996 * RADIUS)
    a, b = xi, eta
    for j, k in enumerate(BETA, 1):
        a = a - F.lit(k) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        b = b - F.lit(k) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    target = F.sin(a) / F.sqrt(F.sinh(b) * F.sinh(b) + F.cos(a) * F.cos(a))  # tangent of the conformal latitude
    e = ECCENTRICITY

    def step(t: Column, _: Column) -> Column:
        s = F.sinh(F.atanh(t / F.sqrt(1 + t * t) * e) * e)
        own = t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)
        slope = F.sqrt((1 + own * own) * (1 + t * t)) * (1 - e * e) / (1 + (1 - e * e) * t * t)
        return t + (target - own) / slope

    t = F.aggregate(F.sequence(F.lit(1), F.lit(4)), target, step)
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + number * 6 - 183, F.degrees(F.atan(t))


def geodesic_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int = 6) -> Column:
    """Distance on the WGS 84 ellipsoid by Vincenty's inverse formula with a fixed number of iterations (a point pair
    that is nearly antipodal does not converge). The iteration is a fold over a small struct, inside the JVM."""
    b = _A * (1 - _FLATTENING)
    u1, u2 = F.atan(F.tan(F.radians(lat1)) * (1 - _FLATTENING)), F.atan(F.tan(F.radians(lat2)) * (1 - _FLATTENING))
    l = F.radians(lon2 - lon1)
    su1, cu1, su2, cu2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)

    def terms(lam: Column):
        ss = F.sqrt(F.pow(cu2 * F.sin(lam), 2.0) + F.pow(cu1 * su2 - su1 * cu2 * F.cos(lam), 2.0))
        cs = su1 * su2 + cu1 * cu2 * F.cos(lam)
        sigma = F.atan2(ss, cs)
        sa = F.when(ss > 0, cu1 * cu2 * F.sin(lam) / ss).otherwise(F.lit(0.0))
        c2a = 1 - sa * sa
        c2m = F.when(c2a > 1e-15, cs - 2 * su1 * su2 / c2a).otherwise(F.lit(0.0))
        return ss, cs, sigma, sa, c2a, c2m

    def step(lam: Column, _: Column) -> Column:
        ss, cs, sigma, sa, c2a, c2m = terms(lam)
        c = F.lit(_FLATTENING / 16) * c2a * (4 + F.lit(_FLATTENING) * (4 - 3 * c2a))
        return l + (1 - c) * F.lit(_FLATTENING) * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))

    def finish(lam: Column) -> Column:
        ss, cs, sigma, _, c2a, c2m = terms(lam)
        k = c2a * ((_A * _A - b * b) / (b * b))
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = small * ss * (c2m + small / 4 * (cs * (2 * c2m * c2m - 1) - small / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
        return F.lit(b) * big * (sigma - delta) / 1000.0

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), l, step, finish)


def with_geodesic_km(df: DataFrame, lon1: Column, lat1: Column, lon2: Column, lat2: Column, out: str, steps: int = 6) -> DataFrame:
    """Adds geodesic_km as a column, each term of an iteration in a step of its own: these compile, and nothing is
    computed twice, while the fold is interpreted and repeats its terms."""
    b, f = _A * (1 - _FLATTENING), F.lit(_FLATTENING)
    c = lambda k: F.col(f"_g_{k}")
    put = lambda d, **new: d.withColumns({f"_g_{k}": v for k, v in new.items()})
    names = df.columns
    x = put(df, u1=F.atan(F.tan(F.radians(lat1)) * (1 - _FLATTENING)), u2=F.atan(F.tan(F.radians(lat2)) * (1 - _FLATTENING)), l=F.radians(lon2 - lon1))
    x = put(x, su1=F.sin(c("u1")), cu1=F.cos(c("u1")), su2=F.sin(c("u2")), cu2=F.cos(c("u2")), lam=c("l"))
    su1, cu1, su2, cu2, ss, cs, sigma, sa, c2a, c2m = map(c, ("su1", "cu1", "su2", "cu2", "ss", "cs", "sigma", "sa", "c2a", "c2m"))
    for k in range(steps + 1):
        x = put(x, sl=F.sin(c("lam")), cl=F.cos(c("lam")))
        x = put(x, ss=F.sqrt(F.pow(cu2 * c("sl"), 2.0) + F.pow(cu1 * su2 - su1 * cu2 * c("cl"), 2.0)), cs=su1 * su2 + cu1 * cu2 * c("cl"))
        x = put(x, sigma=F.atan2(ss, cs), sa=F.when(ss > 0, cu1 * cu2 * c("sl") / ss).otherwise(F.lit(0.0)))
        x = put(x, c2a=1 - sa * sa)
        x = put(x, c2m=F.when(c2a > 1e-15, cs - 2 * su1 * su2 / c2a).otherwise(F.lit(0.0)), c=F.lit(_FLATTENING / 16) * c2a * (4 + f * (4 - 3 * c2a)))
        if k < steps:
            x = put(x, lam=c("l") + (1 - c("c")) * f * sa * (sigma + c("c") * ss * (c2m + c("c") * cs * (2 * c2m * c2m - 1))))
    x = put(x, k=c2a * ((_A * _A - b * b) / (b * b)))
    x = put(x, big=1 + c("k") / 16384 * (4096 + c("k") * (-768 + c("k") * (320 - 175 * c("k")))), small=c("k") / 1024 * (256 + c("k") * (-128 + c("k") * (74 - 47 * c("k")))))
    small = c("small")
    delta = small * ss * (c2m + small / 4 * (cs * (2 * c2m * c2m - 1) - small / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
    return x.select(*[F.col(n) for n in names], (F.lit(b) * c("big") * (sigma - delta) / 1000.0).alias(out))


def pixel_area_m2(a: Column, e: Column, geographic: Column, latitude: Column) -> Column:
    """Area of a pixel of size a by e: projected as it is, geographic by the metres of a degree at the latitude."""
    p = F.radians(latitude)
    m_lat = 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p)
    m_lon = 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p)
    return F.when(geographic, F.abs(a * m_lon) * F.abs(e * m_lat)).otherwise(F.abs(a * e))
