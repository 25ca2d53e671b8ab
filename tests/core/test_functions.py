"""Column functions at their edges."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from windgrid.functions import binning as B
from windgrid.functions import campaign as C
from windgrid.functions import physics as P
from windgrid.functions import special as S


def values(spark, column, xs, kind="double"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(column).collect()]


def test_sectors_are_closed_on_the_left(spark):
    assert values(spark, B.sector_left(F.col("x")), [0.0, 14.999, 15.0, 345.0, 359.999]) == [0, 0, 1, 0, 0]


def test_wrg_sectors_are_closed_on_the_right(spark):
    assert values(spark, B.sector_right(F.col("x")), [11.25, 11.2501, 0.0, 348.75, 348.76, 360.0, -1.0]) == [0, 1, 0, 15, 0, 0, None]


def test_speed_bins_and_stability(spark):
    assert values(spark, B.speed_bin(F.col("x")), [0.0, 2.9999, 3.0, 15.0, 100.0]) == [0, 0, 1, 5, 5]
    assert values(spark, B.speed_bin(F.col("x"), B.SPEED_EDGES_V1), [-1.0, 19.0, 20.0, 150.0]) == [0, 5, 6, 6]
    assert values(spark, B.stability_class(F.col("x")), [-0.2, -0.1, -0.01, 0.01, 0.1]) == [0, 1, 2, 3, 4]


def test_power_curve(spark):
    got = values(spark, P.power_curve(F.col("x")), [2.5, 8.0, 11.5, 12.0, 25.0, 25.5, 26.0, 40.0, -1.0])
    assert got == pytest.approx([0.0078125, 0.2962963, 0.8851273, 1, 1, 0.5, 0, 0, 0], abs=1e-6)


def test_finite_and_ratio(spark):
    assert values(spark, P.finite(F.col("x")), [1.0, None, float("nan"), float("inf"), float("-inf")]) == [True, False, False, False, False]
    assert values(spark, P.ratio(F.col("x"), F.lit(0.0)), [1.0, 0.0]) == [0.0, 0.0]


def test_gamma(spark):
    xs = [1 + k / 7 for k in range(60)]
    assert values(spark, S.gamma_fn(F.col("x")), xs) == pytest.approx([math.gamma(x) for x in xs], rel=1e-12)


def test_projections(spark):
    row = spark.createDataFrame([(34.5, -105.0)], "la double, lo double")
    e, n = row.select(*S.utm_forward(F.col("la"), F.col("lo"), 13)).first()
    assert e == pytest.approx(500_000) and 3_800_000 < n < 3_830_000
    x, y = row.select(*S.lcc_forward(F.col("la"), F.col("lo"), 34.5, -105.0, 35.5, 33.5)).first()
    assert x == pytest.approx(0, abs=1e-6) and y == pytest.approx(0, abs=1e-6)


def test_projections_at_published_coordinates(spark):
    """The CN Tower's UTM coordinates (17T 630084 4833438), and Snyder's worked example of the spherical Lambert conformal conic."""
    row = spark.createDataFrame([(43.642567, -79.387139, 35.0, -75.0)], "la double, lo double, sla double, slo double")
    e, n = row.select(*S.utm_forward(F.col("la"), F.col("lo"), 17)).first()
    assert abs(e - 630_084) < 1 and abs(n - 4_833_438) < 1
    x, y = row.select(*S.lcc_forward(F.col("sla"), F.col("slo"), 23.0, -96.0, 33.0, 45.0, 1.0)).first()
    assert x == pytest.approx(0.2966785, abs=1e-6) and y == pytest.approx(0.2462112, abs=1e-6)


def test_block_window_at_the_end_of_a_month(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2001-01-31 00:00:00' AS t, 1 AS d")
    begin, end, last = df.select(*C.block_window(F.col("t"), F.col("d"))).first()
    assert (str(begin), str(end), str(last)) == ("2001-01-30 18:00:00", "2001-02-01 00:00:00", "2001-01-31 23:50:00")


def test_cold_restart_rule(spark):
    df = spark.createDataFrame([(10, 60), (11, 60), (5, 0)], "r long, t long")
    assert [r[0] for r in df.select(C.restarts_cold(F.col("r"), F.col("t"))).collect()] == [False, True, False]


def test_direction_of_calms_follows_the_signs_of_zeros(spark):
    calm = [P.direction(*P.components(F.lit(0.0) * F.col("x"), F.col("x"))), P.direction(*P.components(F.lit(5.0), F.col("x")))]
    assert values(spark, calm[0], [0.0, 45.0, 135.0, 225.0, 315.0, None]) == [0, 0, 180, 180, 0, None]
    assert values(spark, F.round(calm[1], 9), [0.0, 90.0, 135.0, 180.0, 225.0]) == [0, 90, 135, 180, 225]
