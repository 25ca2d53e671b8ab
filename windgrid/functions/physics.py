"""Wind and surface-layer expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define results.
GRAVITY, LAYER_DEPTH, WIND_FLOOR = 9.81, 10.0, 0.5
RATED_SPEED, CUT_IN, CUT_OUT, LAST_KNOT = 12.0, 3, 25, 30
POWER_COEFFICIENT = 0.33


def finite(*cols: Column) -> Column:
    """All are neither null, NaN nor infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out


def speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def richardson(skin_t: Column, t2: Column, u10: Column) -> Column:
    """Bulk Richardson number of the lowest 10 m, the wind no less than 0.5 m/s."""
    u = F.greatest(u10, F.lit(WIND_FLOOR))
    return F.lit(-GRAVITY * LAYER_DEPTH) * (skin_t - t2) / (t2 * u * u)


def cube(x: Column) -> Column:
    return x * x * x


def power_curve(u: Column) -> Column:
    """Capacity factor: linear between whole speeds from 0 to 30, clamped outside."""
    knots = F.array(*[F.lit(min(1.0, k**3 / RATED_SPEED**3) if CUT_IN <= k <= CUT_OUT else 0.0) for k in range(LAST_KNOT + 2)])
    x = F.least(F.greatest(u, F.lit(0.0)), F.lit(float(LAST_KNOT)))
    low = F.floor(x).cast("int")
    return F.get(knots, low) + (F.get(knots, low + 1) - F.get(knots, low)) * (x - low)


def components(ws: Column, wd: Column) -> tuple[Column, Column]:
    """Eastward and northward wind from speed and the direction it comes from."""
    return -ws * F.sin(F.radians(wd)), -ws * F.cos(F.radians(wd))


def direction(u: Column, v: Column) -> Column:
    """The direction that a wind comes from. A calm's is that of the signs of its zeros, 0 or 180, which Spark's atan2 leaves out."""
    calm = F.when((-v).cast("string") == "-0.0", 180.0).otherwise(0.0)
    return F.when((u == 0) & (v == 0), calm).otherwise(F.pmod(F.degrees(F.atan2(-u, -v)) + 360, F.lit(360.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def power_density(mean_u: Column, rotor_radius: float, rho: float = 1.225) -> Column:
    """Compatible form in kW: the cube of the mean speed, so it understates the mean of cubes."""
    return F.lit(0.5 * rho * math.pi * rotor_radius**2 * POWER_COEFFICIENT / 1000) * cube(mean_u)
