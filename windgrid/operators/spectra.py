"""Spatial spectra of rasters of any size: a two-dimensional transform by blocks.

A field's rows are dealt to blocks of rows, each transformed along its rows in one task;
the results go, cut by columns, through one shuffle (the transpose) to blocks of columns,
transformed along those. What leaves a block of columns are sums of power by ranges of the
radius, which are added up. So no task holds more than one block (`cells` numbers, or one row
or column if that is longer), whatever the field's size, and nothing goes through the driver.

Band shares, the high share and the radial spectrum differ in the radius, the window and
the ranges. Fields have no gaps: a missing, null or infinite cell is an error, in the task that meets it.
Repeated cells count as an error, too. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

# Fixed values that define results: limits of radii in units of the Nyquist wavenumber.
BAND_LIMITS = (0.0, 0.1, 0.25, 0.5, 2.0)
HIGH = 0.5
RADIAL_BINS = 40
#: Numbers that a block holds.
CELLS = 1 << 21


def relative_numbers(n: int) -> np.ndarray:
    """An axis's wave numbers over the Nyquist one. On an odd axis they are counted from half a wave off, as positions from the middle are."""
    return (np.fft.fftfreq(n, 1 / n) - n % 2 / 2) / (n / 2)


def thickness(length: int, cells: int) -> int:
    """How many rows (or columns) of this length a block holds."""
    return max(1, cells // max(1, length))


def _rows(cells: int):
    """A block of rows to its transform along them, cut by blocks of columns."""

    def run(x: pa.Table) -> pa.Table:
        nx, ny = x["nx"][0].as_py(), x["ny"][0].as_py()
        i, j, v = (x[c].to_numpy() for c in ("i", "j", "v"))
        first = int(j.min())
        a = np.full((int(j.max()) + 1 - first, nx), np.nan)
        a[j - first, i] = v
        if len(v) != a.size or not np.isfinite(a).all():
            raise ValueError("fill gaps before a spectrum (grid.fill_nearest)")
        waves = np.fft.fft(a, axis=1)
        wide = thickness(ny, cells)
        parts = [waves[:, k : k + wide] for k in range(0, nx, wide)]
        n = len(parts)
        same = {c: [x[c][0].as_py()] * n for c in ("f", "nx", "ny")}
        return pa.table({
            "f": pa.array(same["f"], x["f"].type), "nx": pa.array(same["nx"], pa.int32()), "ny": pa.array(same["ny"], pa.int32()), "part": pa.array(range(n), pa.int32()),
            "j": pa.array([first] * n, pa.int32()), "waves": pa.array([p.astype("<c16").tobytes() for p in parts], pa.binary()),
        })

    return run


def _columns(cells: int, numbers: Callable[[int], np.ndarray], limits: Callable[[int, int], np.ndarray]):
    """A block of columns to its sums by range: place -1 is all power, the others are [limits[place], limits[place + 1])."""

    def run(x: pa.Table) -> pa.Table:
        nx, ny, part = (x[c][0].as_py() for c in ("nx", "ny", "part"))
        wide = thickness(ny, cells)
        here = min(wide, nx - part * wide)
        a = np.full((ny, here), np.nan, dtype=complex)
        for j, waves in zip(x["j"].to_pylist(), x["waves"], strict=True):
            rows = np.frombuffer(waves.as_buffer(), "<c16").reshape(-1, here)
            a[j : j + len(rows)] = rows
        if np.isnan(a).any():
            raise ValueError("fill gaps before a spectrum (grid.fill_nearest)")
        power = np.abs(np.fft.fft(a, axis=0)) ** 2
        across, along = numbers(nx)[part * wide : part * wide + here], numbers(ny)
        edges = limits(nx, ny)
        at = np.searchsorted(edges, np.sqrt(along[:, None] ** 2 + across[None, :] ** 2), side="right").ravel()
        total, waves = np.bincount(at, weights=power.ravel(), minlength=len(edges) + 1)[1:-1], np.bincount(at, minlength=len(edges) + 1)[1:-1]
        n = len(total) + 1
        return pa.table({
            "f": pa.array([x["f"][0].as_py()] * n, x["f"].type), "place": pa.array(range(-1, n - 1), pa.int32()), "low": pa.array([0.0, *edges[: n - 1]], pa.float64()),
            "power": pa.array([power.sum(), *total], pa.float64()), "waves": pa.array([power.size, *waves], pa.int64()),
        })

    return run


def power_by_radius(df: DataFrame, by: str, value: str, numbers: Callable, limits: Callable, hann: bool = False, cells: int = CELLS) -> DataFrame:
    """by, place, low, power, waves: power and number of the waves in each range of the radius, of each field's deviations from its mean; place -1 is all power.

    numbers: an axis's wave numbers by its length. limits: ranges' ends, rising, by both lengths. hann: of the square
    crop at the origin under a Hann window.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[by]
    rows = df.select(F.col(by).alias("f"), "i", "j", F.col(value).cast("double").alias("v"))
    side = rows.groupBy("f").agg(*[f(c).cast("int").alias(f"{c}{n}") for c in "ij" for f, n in ((F.min, 0), (F.max, 1))], F.avg("v").alias("mean"))
    side = side.select(F.col("f").alias("_f"), "i0", "j0", "mean", (F.col("i1") - F.col("i0") + 1).alias("nx"), (F.col("j1") - F.col("j0") + 1).alias("ny"))
    if hann:
        side = side.withColumn("nx", F.least("nx", "ny")).withColumn("ny", F.col("nx"))
    rows = rows.join(side, rows["f"].eqNullSafe(side["_f"]))
    rows = rows.select("f", (F.col("i") - F.col("i0")).cast("int").alias("i"), (F.col("j") - F.col("j0")).cast("int").alias("j"), (F.col("v") - F.col("mean")).alias("v"), "nx", "ny")
    if hann:
        taper = lambda c: F.pow(F.sin(F.lit(math.pi) * F.col(c) / F.greatest(F.col("nx") - 1, F.lit(1))), 2.0)
        rows = rows.where((F.col("i") < F.col("nx")) & (F.col("j") < F.col("ny"))).withColumn("v", F.col("v") * taper("i") * taper("j"))
    high = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("nx")))
    blocks = rows.withColumn("block", F.floor(F.col("j") / high)).groupBy("f", "block")
    cut = blocks.applyInArrow(_rows(cells), f"f {kind}, nx int, ny int, part int, j int, waves binary")
    sums = cut.groupBy("f", "part").applyInArrow(_columns(cells, numbers, limits), f"f {kind}, place int, low double, power double, waves long")
    return sums.groupBy(F.col("f").alias(by), "place", "low").agg(F.sum("power").alias("power"), F.sum("waves").alias("waves"))


def _share(sums: DataFrame, by: str) -> tuple[DataFrame, Column]:
    """Ranges beside their field's whole power, and the share of it (0 where there is none)."""
    whole = sums.where("place = -1").select(F.col(by).alias("_by"), F.col("power").alias("_whole"))
    both = sums.where("place >= 0").join(whole, sums[by].eqNullSafe(F.col("_by")))
    return both, F.when(F.col("_whole") > 0, F.col("power") / F.col("_whole")).otherwise(0.0)


def band_shares(df: DataFrame, by: str, value: str, cells: int = CELLS) -> DataFrame:
    """by, band, share: percent of the spatial variance in each band of wavenumbers."""
    both, share = _share(power_by_radius(df, by, value, relative_numbers, lambda nx, ny: np.array(BAND_LIMITS), cells=cells), by)
    return both.select(by, F.col("place").alias("band"), (100 * share).alias("share"))


def high_share(df: DataFrame, by: str, value: str, least: float = HIGH, cells: int = CELLS) -> DataFrame:
    """by, share: the part of the variance beyond a radius."""
    both, share = _share(power_by_radius(df, by, value, relative_numbers, lambda nx, ny: np.array([np.nextafter(least, np.inf), np.inf]), cells=cells), by)
    return both.select(by, share.alias("share"))


def radial_spectrum(df: DataFrame, by: str, value: str, dx: float = 1.0, bins: int = RADIAL_BINS, cells: int = CELLS) -> DataFrame:
    """by, k, power: mean power in logarithmic bins of wavenumber, of the square crop under a Hann window; bins without waves are left out."""
    sums = power_by_radius(df, by, value, lambda m: np.fft.fftfreq(m, dx), lambda nx, ny: np.geomspace(1 / (nx * dx), 0.5 / dx, bins), True, cells)
    return sums.where("place >= 0 AND waves > 0").select(by, F.col("low").alias("k"), (F.col("power") / F.col("waves")).alias("power"))
