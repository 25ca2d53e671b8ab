"""Selection judged at every point, against plain numpy with unequal counts, in parts of any size."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from windgrid.operators import points
from windgrid.operators.selection import Blocks, forward_and_swap


@pytest.fixture(scope="module")
def record(spark):
    """Seven points over sixty days with unequal counts; point 3 has no rows on many days, and one point is null."""
    rng = np.random.default_rng(12)
    rows = []
    for day in range(60):
        for k, pixel in enumerate((0, 1, 2, 3, 40, 41, None)):
            for _ in range(0 if k == 3 and day % 3 else int(rng.integers(2, 9))):
                rows.append((dt.datetime(2003, 1, 1) + dt.timedelta(days=day, hours=int(rng.integers(24))), pixel, float(rng.gamma(2, 3 + k)), float(rng.uniform(0, 360))))
    df = spark.createDataFrame(rows, "time timestamp, pixel int, ws double, wd double")
    return rows, df.selectExpr("CAST(time AS TIMESTAMP_NTZ) AS time", "pixel", "ws", "wd")


def power_curve(u: np.ndarray) -> np.ndarray:
    k = np.arange(31)
    return np.interp(u, k, np.where((k >= 3) & (k <= 25), np.minimum(1, k**3 / 1728), 0))


def plain_cost(rows: list[tuple], days: set, direction: float) -> float:
    """From the definition, for the days chosen."""
    t = pd.DataFrame(rows, columns=["time", "pixel", "ws", "wd"]).fillna({"pixel": -1})
    t["cf"], t["sect"] = power_curve(t.ws.to_numpy()), (((t.wd + 15) % 360) // 30).astype(int)
    own = t[t.time.dt.date.isin(days)]
    names = sorted(t.pixel.unique())
    mean = lambda d, c: d.groupby("pixel")[c].mean().reindex(names).fillna(0).to_numpy()
    out = 0.0
    for c in ("ws", "cf"):
        m, f = mean(own, c), mean(t, c)
        out += abs(m.mean() / f.mean() - 1)
        if c == "ws" or not direction:
            out += 2 * np.sqrt((((m / m.mean()) / (f / f.mean()) - 1) ** 2).mean())
    if direction:
        for weight in (t.ws * 0 + 1, t.ws**3):
            rose = lambda d: d.assign(w=weight[d.index]).pivot_table(index="pixel", columns="sect", values="w", aggfunc="sum").reindex(index=names, columns=range(12)).fillna(0).to_numpy()  # noqa: B023, E731
            a, b = (x / np.maximum(x.sum(1, keepdims=True), 1e-300) for x in (rose(own), rose(t)))
            out += direction * 0.5 * np.abs(a - b).sum(1).mean()
    return out


def days_of(table, chosen) -> set:
    return {dt.date.fromordinal(int(table.blocks.start[c]) + d) for c in chosen for d in range(table.blocks.length)}


@pytest.mark.parametrize("size", [1, 3, 16])
@pytest.mark.parametrize("direction", [0.0, 1.0])
def test_costs_are_the_definition(record, size, direction):
    rows, df = record
    table = points.point_sums(df, 2, 6, points=size)
    assert table.whole[0] == 7 and table.parts.count() >= (1 if size == 16 else 2)
    asked = [([], np.arange(len(table.blocks.start))), ([3, 20], np.array([0, 9, 40]))]
    alone, beside = (table.cost(m, direction) for m in table.evaluate(asked))
    assert len(alone) == 59
    for b in range(0, 59, 7):
        assert alone[b] == pytest.approx(plain_cost(rows, days_of(table, [b]), direction), rel=1e-9)
    for b, cost in zip((0, 9, 40), beside, strict=True):
        assert cost == pytest.approx(plain_cost(rows, days_of(table, [3, 20, b]), direction), rel=1e-9)


def test_whole_record_costs_nothing(record):
    _, df = record
    table = points.point_sums(df, 2, 6)
    m = table.evaluate([(list(range(0, 58, 2)), np.array([58]))])[0]  # not quite all days: each once but the last two
    assert table.cost(m, 1.0)[0] < 0.3
    every = points.point_sums(df, 1, 1)
    assert every.cost(every.evaluate([(list(range(59)), np.array([59]))])[0])[0] == pytest.approx(0, abs=1e-7)


@pytest.mark.parametrize("direction", [0.0, 1.0])
def test_search_is_the_plain_one(record, direction):
    """Step by step, the choice that a search on the whole matrices makes."""
    _, df = record
    table = points.point_sums(df, 2, 6, points=2)
    cost = lambda rest, options: table.cost(table.evaluate([(list(rest), np.array(options))])[0], direction)
    free = lambda rest: np.flatnonzero(table.blocks.free(rest))
    want = forward_and_swap(4, free, cost)
    chosen, value = points.select(table, 4, direction)
    assert chosen == want and value == pytest.approx(float(cost(want[:-1], want[-1:])[0]))
    _, greedy = points.select(table, 4, direction, refine=False)
    several = points.select(table, 4, direction, restarts=4, seed=3)
    assert several[1] <= value <= greedy
    assert all(abs(a - b) >= 2 for k, a in enumerate(table.blocks.start[several[0]]) for b in table.blocks.start[several[0]][:k])


def test_hold_out(record):
    _, df = record
    out = points.hold_out(df, 2, 6, 4)
    assert set(out) == {"train", "held_out"} and all(np.isfinite(v) for e in out.values() for v in e.values())
    assert out["train"]["speed_pattern"] < 60


def test_nothing_to_choose(record):
    _, df = record
    none = points.point_sums(df.limit(0), 2, 6)
    assert points.select(none, 3) == ([], float("inf"))
    assert points.select(points.point_sums(df, 2, 10_000), 3) == ([], float("inf"))
    assert points.hold_out(df.limit(0), 2, 6, 3) == {}
    table = points.point_sums(df, 50, 6)
    assert len(points.select(table, 3)[0]) == 1  # blocks of fifty of sixty days all overlap
    assert isinstance(table.blocks, Blocks)
