"""Weighted Weibull fits by maximum likelihood, and wind resource grids of them.

The shape k solves  sum(w x^k ln x) / sum(w x^k) - 1/k - sum(w ln x) / sum(w) = 0
in [0.1, 50]; the left side rises with k. Speeds are scaled by their largest, so
x^k stays within range. Without a root the unweighted fit stands in. Rows are first
summed by distinct speed, map-side, so a group is solved over its distinct speeds and
not over its rows; the groups of a batch are solved side by side, those of very many distinct
speeds in rounds of grouped sums, so no task gathers a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from ..functions import binning as B
from ..functions import physics as P
from ..functions.special import gamma_fn
from ..scratch import durable

# Fixed value that defines results: the power of the method of moments.
MOMENTS_POWER = -1.086
LOW, HIGH, HIGH_UNWEIGHTED = 0.1, 50.0, 5000.0
#: Distinct speeds of a group that are gathered in a worker.
MOST_SPEEDS = 1_000_000


def solve_many(x: np.ndarray, w: np.ndarray, n: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k and A of many groups side by side; size: how many entries each has, one after another. n: how many rows an entry stands for.

    NaN for fewer than two speeds or equal ones. Only positive, finite speeds and weights count.
    """
    group = np.repeat(np.arange(len(size)), size)
    m = np.isfinite(x) & (x > 0) & np.isfinite(w) & (w > 0)
    x, w, n, group = x[m], w[m], n[m], group[m]
    k, a = np.full(len(size), np.nan), np.full(len(size), np.nan)
    if not len(x):
        return k, a
    each, first, at, count = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    spread = np.maximum.reduceat(np.abs(x - x[first][at]), first)
    fits = (count >= 2) & (spread > 1e-8 + 1e-5 * x[first])
    keep = fits[at]
    if not keep.any():
        return k, a
    x, w, n, each, count = x[keep], w[keep], n[keep], each[fits], count[fits]
    first = np.cumsum(count) - count
    total = lambda v: np.add.reduceat(v, first)
    top = np.maximum.reduceat(x, first)
    y = np.log(x / np.repeat(top, count))

    def gap(k: np.ndarray, v: np.ndarray) -> np.ndarray:
        p = v * np.exp(y * np.repeat(k, count))
        return total(p * y) / total(p) - 1 / k - total(v * y) / total(v)

    low, high = np.full(len(each), LOW), np.full(len(each), HIGH)
    bare = gap(low, w) * gap(high, w) > 0  # no root in the bracket: the unweighted fit
    w, high = np.where(np.repeat(bare, count), n, w), np.where(bare, HIGH_UNWEIGHTED, high)
    for _ in range(80):
        mid = (low + high) / 2
        below = gap(mid, w) < 0
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    k[each] = mid = (low + high) / 2
    a[each] = top * (total(w * np.exp(y * np.repeat(mid, count))) / total(w)) ** (1 / mid)
    return k, a


def solve(x: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(k, A) of one group."""
    k, a = solve_many(np.asarray(x, dtype=float), np.asarray(w, dtype=float), np.ones(len(x)), np.array([len(x)]))
    return float(k[0]), float(a[0])


def distinct_speeds(df: DataFrame, by: list[str], speed: str, weight: str | None) -> DataFrame:
    """by, _x, _w, _n: each group's distinct speeds with their weight and rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*by, F.col(speed).alias("_x")).agg(F.sum(w.cast("double")).alias("_w"), F.count(F.lit(1)).cast("double").alias("_n"))


def fit_speeds(speeds: DataFrame, by: list[str], most: int = MOST_SPEEDS) -> DataFrame:
    """by, k, a (null where there is no fit) of distinct speeds. Groups of more than `most` of them are never gathered: they are solved in rounds of grouped sums."""
    speeds = durable(speeds)
    large = speeds.groupBy(*by).count().where(F.col("count") > most).drop("count")
    if not large.limit(1).count():
        return _gathered(speeds, by)
    large = durable(large).withColumnsRenamed({c: f"_l_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= speeds[c].eqNullSafe(F.col(f"_l_{c}"))
    return _gathered(speeds.join(large, same, "left_anti"), by).unionByName(_in_rounds(durable(speeds.join(large, same, "left_semi")), by))


#: Values of the shape that a round tries within each bracket, and rounds: a bracket ends 16^13 times as narrow as it began (1e-12 of HIGH_UNWEIGHTED, 1e-14 of HIGH).
TRIES, ROUNDS = 15, 13


def _in_rounds(speeds: DataFrame, by: list[str]) -> DataFrame:
    """fit_speeds() of groups of any size: each round sums every group at several shapes at once and keeps the bracket that holds the root."""
    x, good = F.col("_x"), P.finite(F.col("_x"), F.col("_w")) & (F.col("_x") > 0) & (F.col("_w") > 0)
    groups = speeds.select(*by).distinct()
    rows = speeds.where(good)
    of = {"_top": F.max(x), "_low_x": F.min(x), "_v0": F.sum("_w"), "_v1": F.sum(F.col("_w") * F.log(x)), "_n0": F.sum("_n"), "_n1": F.sum(F.col("_n") * F.log(x))}
    state = rows.groupBy(*by).agg(*[v.alias(n) for n, v in of.items()]).where(F.col("_top") - F.col("_low_x") > 1e-8 + 1e-5 * F.col("_low_x"))
    state = durable(state.withColumns({"_lo": F.lit(LOW), "_hi": F.lit(HIGH), "_bare": F.lit(False)}))

    def sums(state: DataFrame, shapes: list[Column]) -> DataFrame:
        """state with _s: for each shape its gap, and the sum of powers over that of weights."""
        y, v = F.log(x / F.col("_top")), F.when(F.col("_bare"), F.col("_n")).otherwise(F.col("_w"))
        named = state.withColumnsRenamed({c: f"_g_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same &= rows[c].eqNullSafe(F.col(f"_g_{c}"))
        both = rows.join(named, same)
        power = [v * F.exp(k * y) for k in shapes]
        kept = [F.col(c) for c in state.columns if c not in by]
        got = both.groupBy(*by, *kept).agg(*[F.sum(p).alias(f"_p{n}") for n, p in enumerate(power)], *[F.sum(p * y).alias(f"_q{n}") for n, p in enumerate(power)])
        total, mean = (F.when(F.col("_bare"), F.col(f"_n{d}")).otherwise(F.col(f"_v{d}")) for d in (0, 1))
        mean = mean / total - F.log("_top")
        each = [F.struct(k.alias("k"), (F.col(f"_q{n}") / F.col(f"_p{n}") - 1 / k - mean).alias("gap"), (F.col(f"_p{n}") / total).alias("power")) for n, k in enumerate(shapes)]
        return got.select(*by, *kept, F.array(*each).alias("_s"))

    ends = sums(state, [F.col("_lo"), F.col("_hi")])
    bare = F.col("_s")[0]["gap"] * F.col("_s")[1]["gap"] > 0  # no root in the bracket: the unweighted fit
    state = durable(ends.withColumns({"_bare": bare, "_hi": F.when(bare, HIGH_UNWEIGHTED).otherwise(F.col("_hi"))}).drop("_s"))
    for _ in range(ROUNDS):
        shapes = [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (n / (TRIES + 1)) for n in range(1, TRIES + 1)]
        tried = sums(state, shapes)
        below = F.filter("_s", lambda e: e["gap"] < 0)
        above = F.filter("_s", lambda e: ~(e["gap"] < 0))
        lo = F.coalesce(F.array_max(F.transform(below, lambda e: e["k"])), F.col("_lo"))
        hi = F.coalesce(F.array_min(F.transform(above, lambda e: e["k"])), F.col("_hi"))
        state = durable(tried.withColumns({"_lo": lo, "_hi": hi}).drop("_s"))
    k = (F.col("_lo") + F.col("_hi")) / 2
    found = sums(state, [k]).select(*[F.col(c).alias(f"_f_{c}") for c in by], F.col("_s")[0]["k"].alias("k"), (F.col("_top") * F.pow(F.col("_s")[0]["power"], 1 / F.col("_s")[0]["k"])).alias("a"))
    same = F.lit(True)
    for c in by:
        same &= groups[c].eqNullSafe(F.col(f"_f_{c}"))
    return groups.join(found, same, "left").select(*by, "k", "a")


def _gathered(speeds: DataFrame, by: list[str]) -> DataFrame:
    """fit_speeds() of groups that fit into a worker, solved side by side."""
    ship(speeds.sparkSession)
    there = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))  # noqa: E731  lists leave nulls out
    grouped = speeds.groupBy(*by).agg(*[F.collect_list(there(c)).alias(c) for c in ("_x", "_w", "_n")])
    keys = speeds.select(*by).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, w, n = (b.column(c) for c in ("_x", "_w", "_n"))
                k, a = solve_many(*(c.flatten().to_numpy() for c in (x, w, n)), np.diff(x.offsets.to_numpy()))
                found = [pa.array(v, from_pandas=True) for v in (k, a)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], *found], names=[*by, "k", "a"])

    return grouped.mapInArrow(run, T.StructType([*keys, T.StructField("k", T.DoubleType()), T.StructField("a", T.DoubleType())]))


def fit(df: DataFrame, by: list[str], speed: str = "ws", weight: str | None = None) -> DataFrame:
    """by, k, a (null where there is no fit)."""
    return fit_speeds(distinct_speeds(df, by, speed, weight), by)


def fit_moments(df: DataFrame, by: list[str], speed: str = "ws") -> DataFrame:
    """k = (sd / mean)^-1.086, A = mean / Gamma(1 + 1/k); sd of the population."""
    s = df.groupBy(*by).agg(F.avg(speed).alias("_m"), F.stddev_pop(speed).alias("_s")).withColumn("k", F.pow(F.try_divide("_s", "_m"), F.lit(MOMENTS_POWER)))
    s = s.withColumn("k", F.when((F.col("_s") > 0) & (F.col("_m") > 0), F.col("k")))
    return s.select(*by, "k", (F.col("_m") / gamma_fn(1 + 1 / F.col("k"))).alias("a"))


def resource_grid(df: DataFrame, by: list[str], weight: str | None = None, rotor_radius: float = 50.0, width: float = B.WRG_BIN_DEGREES) -> DataFrame:
    """by, k, a, pd of all sectors, and sectors: a dense array of (freq * 1000, A * 10, k * 100).

    A sector's frequency counts all its weight, also of calm rows; a sector without a fit has freq
    and null A and k. Directions outside 0 to 360 count in the total alone.
    """
    n = round(360 / width)
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, F.col("ws").alias("_ws"), w.cast("double").alias("_wt"), B.sector_right(F.col("wd"), width).alias("_sector"))
    cells = durable(distinct_speeds(rows, [*by, "_sector"], "_ws", "_wt"))  # one pass over the rows; all else adds these up
    sums = [F.sum("_w").alias("_w"), F.sum("_n").alias("_n")]
    whole = fit_speeds(cells.groupBy(*by, "_x").agg(*sums), by)
    mean = cells.groupBy(*by).agg(F.sum("_w").alias("_total"), (F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_mean"))
    per = fit_speeds(cells.where("_sector IS NOT NULL"), [*by, "_sector"])
    share = cells.where("_sector IS NOT NULL").groupBy(*by, "_sector").agg(F.sum("_w").alias("_sw"))
    per = share.join(per, [*by, "_sector"], "left").join(mean, by)
    got = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_sector", F.struct((F.col("_sw") / F.col("_total") * 1000).alias("freq"), (F.col("a") * 10).alias("a"), (F.col("k") * 100).alias("k"))))).alias("_m"))
    empty = F.struct(F.lit(0.0).alias("freq"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("k"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.coalesce(F.try_element_at("_m", s), empty))
    out = whole.join(mean, by).join(got, by, "left")
    return out.select(*by, "k", "a", P.power_density(F.col("_mean"), rotor_radius).alias("pd"), F.coalesce(dense, F.array_repeat(empty, n)).alias("sectors"))
