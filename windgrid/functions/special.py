"""Gamma function, Weibull mean and map projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7, nine terms (published values).
LANCZOS_G = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
SPHERE_RADIUS = 6_370_000.0


def gamma_fn(x: Column) -> Column:
    """Gamma of x >= 0.5."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + LANCZOS_G + 0.5
    return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, z + 0.5) * F.exp(-t) * series


def weibull_mean(a: Column, k: Column) -> Column:
    return a * gamma_fn(1 + 1 / k)


def utm_forward(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere, WGS84) by the Krueger series of third order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    d = F.radians(lon - F.lit(6.0 * zone - 183))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500_000.0) + F.lit(0.9996 * big_a) * east, F.lit(0.9996 * big_a) * north


def lcc_forward(lat: Column, lon: Column, lat0: float, lon0: float, lat1: float, lat2: float, radius: float = SPHERE_RADIUS) -> tuple[Column, Column]:
    """Lambert conformal conic on a sphere, origin at (lat0, lon0)."""
    p1, p2, p0 = (math.radians(x) for x in (lat1, lat2, lat0))
    tan = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if lat1 == lat2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(tan(p2) / tan(p1))
    scale = math.cos(p1) * tan(p1) ** n / n
    rho0 = radius * scale / tan(p0) ** n
    rho = F.lit(radius * scale) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(n))
    theta = F.lit(n) * F.radians(lon - F.lit(lon0))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)
