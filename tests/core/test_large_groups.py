"""Weibull fits of groups too large to be gathered, against the fits of gathered ones."""

from __future__ import annotations

import numpy as np
import pytest
from windgrid.operators import metrics, weibull


@pytest.fixture(scope="module")
def speeds(spark):
    rng = np.random.default_rng(21)
    rows = []
    for g, (k, n) in {"a": (2.0, 400), "b": (0.7, 300), None: (6.0, 150), "small": (2.5, 12)}.items():
        rows += [(g, float(x), float(w)) for x, w in zip(5 * rng.weibull(k, n), rng.uniform(0.1, 3, n), strict=True)]
    rows += [("constant", 4.0, 1.0)] * 300 + [("steep", 10 + 1e-3 * float(x), 1.0) for x in rng.normal(size=250)]
    rows += [("a", float("nan"), 1.0), ("a", None, 1.0), ("b", -1.0, 2.0), ("b", 3.0, 0.0), ("b", 0.0, 1.0), ("bad", float("inf"), 1.0)]
    return spark.createDataFrame(rows, "g string, ws double, w double")


def found(df) -> dict:
    return {r["g"]: (r["k"], r["a"]) for r in df.collect()}


def test_rounds_are_the_gathered_fit(speeds):
    """Groups of up to 100 speeds are gathered, the others solved in rounds."""
    held = weibull.distinct_speeds(speeds, ["g"], "ws", "w")
    want, got = found(weibull.fit_speeds(held, ["g"])), found(weibull.fit_speeds(held, ["g"], 100))
    assert want.keys() == got.keys() and want["constant"] == got["constant"] == (None, None) == got["bad"]
    assert want["steep"][0] > 50  # beyond the weighted bracket: the unweighted fit
    for g, (k, a) in want.items():
        if k is not None:
            assert got[g] == pytest.approx((k, a), rel=1e-9)


def test_no_large_group_is_gathered(speeds):
    """The plan of a large group's fit has no list of its speeds."""
    held = weibull.distinct_speeds(speeds.where("g = 'a'"), ["g"], "ws", "w")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    large, small = weibull.fit_speeds(held, ["g"], 100), weibull.fit_speeds(held, ["g"], 10_000)
    assert "collect_list" in plan(small)
    assert "collect_list" in plan(large) and large.count() == 1  # the branch of small groups has none to gather
    assert weibull._gathered(held.limit(0), ["g"]).count() == 0


def test_grid_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, ws double, wd double")
    assert weibull.resource_grid(empty, ["g"]).collect() == []
    assert weibull.fit_speeds(weibull.distinct_speeds(empty, ["g"], "ws", None), ["g"]).collect() == []


def test_upper_median_of_a_large_group_is_many_tasks(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.integers(0, 40, 3001).tolist(), "b": rng.integers(0, 9, 4).tolist(), None: [7, 7, 1], "one": [3]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double")
    got = metrics.upper_median(df, ["g"], "x")
    assert {r["g"]: r["median"] for r in got.collect()} == {g: float(sorted(xs)[len(xs) // 2]) for g, xs in groups.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window [" in line and "_x" in line]
    assert ordered and all("_r_part" in line for line in ordered)  # no window orders a whole group's values
