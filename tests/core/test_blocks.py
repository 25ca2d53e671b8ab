"""Operators cut into blocks and ranges, against one-piece versions: spectra, scans, long series, Wasserstein distances."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windgrid.operators import metrics, scan, spectra, timeline


@pytest.fixture(scope="module")
def fields(spark):
    """A 30 by 23 field and a flat one."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(23, 30)).cumsum(0)
    rows = [("rough", i, j, float(a[j, i])) for j in range(23) for i in range(30)] + [("flat", i + 5, j - 2, 7.0) for j in range(4) for i in range(4)]
    return a, spark.createDataFrame(rows, "f string, i int, j int, v double")


@pytest.mark.parametrize("cells", [7, 64, 200, 1 << 20])
def test_spectra_in_blocks(fields, cells):
    """Blocks of one row, of some, and of all give the transform of the whole field."""
    a, df = fields
    power = np.abs(np.fft.fft2(a - a.mean())) ** 2
    y, x = (spectra.relative_numbers(n) for n in a.shape)
    radius = np.sqrt(y[:, None] ** 2 + x[None, :] ** 2)
    want = [100 * power[(radius >= lo) & (radius < hi)].sum() / power.sum() for lo, hi in zip(spectra.BAND_LIMITS, spectra.BAND_LIMITS[1:], strict=False)]
    got = {(r["f"], r["band"]): r["share"] for r in spectra.band_shares(df, "f", "v", cells).collect()}
    assert [got["rough", k] for k in range(4)] == pytest.approx(want, rel=1e-9)
    assert [got["flat", k] for k in range(4)] == [0, 0, 0, 0]
    got = {r["f"]: r["share"] for r in spectra.high_share(df, "f", "v", cells=cells).collect()}
    assert got["rough"] == pytest.approx(power[radius > 0.5].sum() / power.sum(), rel=1e-9)
    n = 23
    taper = np.sin(np.pi * np.arange(n) / (n - 1)) ** 2
    power = np.abs(np.fft.fft2((a - a.mean())[:n, :n] * taper[:, None] * taper)) ** 2
    k = np.fft.fftfreq(n, 50.0)
    radius, edges = np.hypot(k[:, None], k[None, :]), np.geomspace(1 / (n * 50), 0.01, 12)
    want = {round(lo, 9): power[(radius >= lo) & (radius < hi)].mean() for lo, hi in zip(edges, edges[1:], strict=False) if ((radius >= lo) & (radius < hi)).any()}
    got = {round(r["k"], 9): r["power"] for r in spectra.radial_spectrum(df.where("f = 'rough'"), "f", "v", 50.0, 12, cells).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_no_block_is_larger(fields):
    assert [spectra.thickness(n, 64) for n in (1, 30, 64, 65, 1000)] == [64, 2, 1, 1, 1]
    _, df = fields
    seen = df.where("f = 'rough'").withColumn("block", F.floor(F.col("j") / 2)).groupBy("f", "block").count().collect()
    assert max(r["count"] for r in seen) <= 64  # rows of 30 in blocks of 64 cells: two a block


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), "missing", "twice"])
def test_spectra_refuse_gaps(spark, bad):
    rows = [("f", i, j, float(i * j)) for i in range(6) for j in range(6)]
    rows = rows[:-8] + rows[-7:] if bad == "missing" else [*rows, rows[3]] if bad == "twice" else [*rows[:9], ("f", 1, 3, bad), *rows[10:]]
    df = spark.createDataFrame(rows, "f string, i int, j int, v double")
    with pytest.raises(Exception, match="fill gaps"):
        spectra.band_shares(df, "f", "v", 12).collect()


def test_spectra_of_nothing(spark):
    df = spark.createDataFrame([], "f string, i int, j int, v double")
    assert spectra.band_shares(df, "f", "v").collect() == [] == spectra.radial_spectrum(df, "f", "v").collect()


@pytest.mark.parametrize("ranges", [1, 2, 9])
def test_running_over_ranges(spark, ranges):
    rng = np.random.default_rng(2)
    rows = [(k, int(t), float(rng.integers(-5, 6)) if rng.random() > 0.2 else None, int(rng.integers(0, 9)) if rng.random() > 0.6 else None) for k in ("a", None, "b") for t in rng.permutation(60 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, t int, v double, mark int")
    got = scan.running(df, ["k"], ["t"], sums={"total": F.col("v")}, lasts={"seen": F.col("mark")}, lags={"v_before": F.col("v")}, ranges=ranges)
    assert got.columns == ["k", "t", "v", "mark", "total", "seen", "v_before"]
    held = {(r["k"], r["t"]): r for r in got.collect()}
    assert len(held) == len(rows)
    for k in ("a", None, "b"):
        total, seen, before = 0.0, None, None
        for _, t, v, mark in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            total, seen = total + (v or 0), mark if mark is not None else seen
            r = held[k, t]
            assert (r["total"], r["seen"], r["v_before"]) == (total, seen, before)
            before = v
    assert scan.running(df.limit(0), ["k"], ["t"], sums={"total": F.col("v")}).collect() == []


def test_one_long_series_is_many_tasks(spark):
    """A single key is dealt to ranges: no task has all of its rows."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    got = scan.running(df, ["k"], ["t"], sums={"n": F.lit(1)}, ranges=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_r_part" in plan and "partitionBy" not in plan.replace("_r_part", "")
    assert {r["t"]: r["n"] for r in got.where("t % 4999 = 0").collect()} == {t: t + 1 for t in range(0, 20_000, 4999)}
    by_part = spark.read.parquet(*got.inputFiles()).groupBy("_r_part").count().collect()
    assert len(by_part) == 8 and max(r["count"] for r in by_part) < 6000


def test_segments_and_autocorrelation_in_pieces(spark):
    rng = np.random.default_rng(5)
    start, rows, want = datetime(2020, 1, 1), [], []
    for pixel in (0, 1, None):
        t, seg, x = start, 0, 0.0
        for k in range(400 if pixel == 0 else 30):
            if rng.random() < 0.02 and k:
                t, seg = t + timedelta(hours=5), seg + 1
            x = 0.9 * x + rng.normal()
            rows.append((pixel, t, x))
            want.append((pixel, t, seg, x))
            t += timedelta(minutes=10)
    df = spark.createDataFrame(rows, "pixel int, time timestamp, ws double").select("pixel", F.col("time").cast("timestamp_ntz").alias("time"), "ws")
    for ranges in (1, 7):
        got = timeline.segments(df, ["pixel"], "time", 600, [], ranges=ranges)
        assert sorted(map(str, [(r["pixel"], r["time"], r["segment"], r["ws"]) for r in got.collect()])) == sorted(map(str, want))
    lags = [1, 2, 5, 18]
    series = pd.DataFrame(want, columns=["pixel", "time", "segment", "x"]).fillna({"pixel": -1})
    top, bottom = dict.fromkeys(lags, 0.0), dict.fromkeys(lags, 0.0)
    for _, g in series.groupby(["pixel", "segment"]):
        d = (g.x - g.x.mean()).to_numpy()
        for k in lags:
            if len(d) > k:
                top[k] += (d[:-k] * d[k:]).sum()
                bottom[k] += (d[:-k] ** 2).sum()
    cut = timeline.segments(df, ["pixel"], "time", 600, [])
    for block_rows in (1, 19, 40, 50_000):
        got = {r["lag"]: r["rho"] for r in timeline.autocorrelation(cut, ["pixel", "segment"], ["time"], "ws", lags, block_rows).collect()}
        assert got == pytest.approx({k: top[k] / bottom[k] for k in lags}, rel=1e-9)


def test_halo_reaches_the_next_block(spark):
    df = spark.range(10).select(F.lit("s").alias("k"), F.col("id").alias("at"))
    got = [(r["block"], r["at"], r["own"]) for r in scan.with_halo(df, ["k"], "at", 2, 4).orderBy("block", "at").collect()]
    assert got == [(0, t, t < 4) for t in range(6)] + [(1, t, t < 8) for t in range(4, 10)] + [(2, t, True) for t in (8, 9)]


def test_wasserstein_over_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(m, y, float(np.round(rng.normal(y, 2), 1))) for m in (1, 2) for y in (3, 4, 5) for _ in range(80 * m)] + [(9, 3, 1.0)] * 5
    df = spark.createDataFrame(rows, "m int, y int, x double")
    got = {(r["m"], r["y"]): r["distance"] for r in metrics.wasserstein(df, df, ["m"], "y", "x").collect()}
    table = pd.DataFrame(rows, columns=["m", "y", "x"])
    for (m, y), own in table.groupby(["m", "y"]):
        whole = np.sort(table[table.m == m].x.to_numpy())
        at = np.unique(whole)
        f = lambda v: np.searchsorted(np.sort(v), at, side="right")[:-1] / len(v)
        assert got[m, y] == pytest.approx((np.abs(f(own.x.to_numpy()) - f(whole)) * np.diff(at)).sum(), abs=1e-9)
