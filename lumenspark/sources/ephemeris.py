"""Positions of Sun and Earth as seen from the Moon, as a table (ts, body, x, y, z) in km.

The engine takes any such table. ``approximate`` makes one from published low-precision series (mean elements of the Moon
and the Sun; about a tenth of a degree) in an inertial frame turned by the Moon's mean rotation. It is no substitute for a
precise ephemeris.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUN, EARTH, MOON = 10, 399, 301
AU_KM = 149597870.7
#: 2023-12-01T00:00:00 UTC as seconds of dynamical time after J2000: 37 leap seconds and 32.184 s (fixed values).
EPOCH_UNIX = 1701388800
EPOCH_ET = EPOCH_UNIX - 946728000 + 69.184


def et_seconds(ts: Column) -> Column:
    """Dynamical seconds after J2000: the fixed epoch plus elapsed time without further leap seconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6 - EPOCH_UNIX + EPOCH_ET


def _wave(terms, angles) -> Column:
    """Sum of a * sin or cos(k . angles)."""
    total = F.lit(0.0)
    for amplitude, function, multiples in terms:
        angle = sum((m * a for m, a in zip(multiples, angles, strict=True)), F.lit(0.0))
        total = total + amplitude * function(F.radians(angle))
    return total


def approximate(times: DataFrame, column: str = "ts") -> DataFrame:
    """(ts, body, x, y, z) for Sun and Earth over ``times``."""
    t = et_seconds(F.col(column)) / (36525 * 86400)
    # Mean longitude, elongation, solar and lunar anomaly, argument of latitude (degrees; leading published terms).
    mean, elongation = 218.3165 + 481267.8813 * t, 297.8502 + 445267.1115 * t
    sun_anomaly, moon_anomaly, latitude_arg = 357.5291 + 35999.0503 * t, 134.9634 + 477198.8676 * t, 93.2721 + 483202.0175 * t
    angles = (elongation, sun_anomaly, moon_anomaly, latitude_arg)
    lon = mean + _wave([(6.289, F.sin, (0, 0, 1, 0)), (1.274, F.sin, (2, 0, -1, 0)), (0.658, F.sin, (2, 0, 0, 0)), (0.214, F.sin, (0, 0, 2, 0)), (-0.186, F.sin, (0, 1, 0, 0)), (-0.114, F.sin, (0, 0, 0, 2))], angles)
    lat = _wave([(5.128, F.sin, (0, 0, 0, 1)), (0.281, F.sin, (0, 0, 1, 1)), (0.278, F.sin, (0, 0, 1, -1)), (0.173, F.sin, (2, 0, 0, -1))], angles)
    far = 385001 + _wave([(-20905, F.cos, (0, 0, 1, 0)), (-3699, F.cos, (2, 0, -1, 0)), (-2956, F.cos, (2, 0, 0, 0)), (-570, F.cos, (0, 0, 2, 0))], angles)
    sun_lon = 280.4665 + 36000.7698 * t + _wave([(1.9146, F.sin, (0, 1, 0, 0)), (0.02, F.sin, (0, 2, 0, 0))], angles)
    sun_far = AU_KM * (1.000140 + _wave([(-0.016708, F.cos, (0, 1, 0, 0)), (-0.000141, F.cos, (0, 2, 0, 0))], angles))
    spin = F.radians(mean + 180)  # the mean Earth stands over the prime meridian

    def polar(lon_deg, lat_deg, r):
        a, b = F.radians(lon_deg), F.radians(lat_deg)
        return r * F.cos(b) * F.cos(a), r * F.cos(b) * F.sin(a), r * F.sin(b)

    moon, sun = polar(lon, lat, far), polar(sun_lon, F.lit(0.0), sun_far)
    earth = tuple(-i for i in moon)
    from_moon = tuple(s - m for s, m in zip(sun, moon, strict=True))

    def turned(v):
        return F.cos(spin) * v[0] + F.sin(spin) * v[1], -F.sin(spin) * v[0] + F.cos(spin) * v[1], v[2]

    def row(body, v):
        x, y, z = turned(v)
        return F.struct(F.lit(body).alias("body"), x.alias("x"), y.alias("y"), z.alias("z"))

    return times.select(column, F.explode(F.array(row(SUN, from_moon), row(EARTH, earth))).alias("b")).select(column, "b.*")


def at_times(times: DataFrame, ephemeris: DataFrame, column: str = "ts") -> DataFrame:
    """One row a time with both bodies: (ts, sx, sy, sz, ex, ey, ez). Times that ``ephemeris`` lacks have no row; see
    ``require_positions``."""
    of = lambda body, p: ephemeris.where(F.col("body") == body).select(column, *(F.col(i).alias(f"{p}{i}") for i in "xyz"))
    return times.join(of(SUN, "s"), column).join(of(EARTH, "e"), column)


def require_positions(times: DataFrame, ephemeris: DataFrame, column: str = "ts") -> None:
    """Raises where ``ephemeris`` lacks a time. Runs a small job over times only."""
    lacking = times.select(column).join(at_times(times, ephemeris, column), column, "left_anti").select(F.col(column).cast("string")).head(1)
    if lacking:
        raise ValueError(f"the ephemeris has no positions at {lacking[0][0]}")


def interpolated(times: DataFrame, ephemeris: DataFrame, column: str = "ts") -> DataFrame:
    """Positions between the rows of an ephemeris, on the straight line between the two that enclose each time."""
    from pyspark.sql import Window

    w = Window.partitionBy("body").orderBy(column)
    spans = ephemeris.withColumns({f"_{i}": F.lead(i).over(w) for i in (column, "x", "y", "z")})
    inside = (F.col("t") >= F.col(column)) & (F.col("t") < F.coalesce(F.col(f"_{column}"), F.col(column) + F.expr("interval 1 microsecond")))
    both = times.select(F.col(column).alias("t")).join(spans, inside)
    whole = F.timestamp_diff("MICROSECOND", F.col(column), F.col(f"_{column}"))
    share = F.when(whole > 0, F.timestamp_diff("MICROSECOND", F.col(column), F.col("t")) / whole).otherwise(0.0)
    return both.select(F.col("t").alias(column), "body", *((F.col(i) + share * (F.coalesce(f"_{i}", i) - F.col(i))).alias(i) for i in "xyz"))
