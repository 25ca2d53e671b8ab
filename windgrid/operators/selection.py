"""Choice of representative day blocks with weights.

Spark builds the blocks' additive statistics: observations are summed by day once, and
days are added into the blocks that hold them. What reaches the driver is one row a
block (some thousands, whatever the number of observations). The searches run there
in numpy: each is a forward pass and swaps over one cost, which is evaluated for all
admissible candidates at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import binning as B
from ..functions import physics as P
from ..scratch import durable
from . import histograms as H
from . import timeline as T

# Fixed values that define results.
SUM_WEIGHT = 50.0
SCREEN = 250
TOLERANCE = 1e-12
WEIGHTS_V1 = (1.0, 1.0, 0.3, 0.3)
WEIGHTS_V2 = (1.0, 1.0, 0.3, 0.3, 3.0, 3.0, 4.0)
PATTERN_WEIGHT = 2.0


@dataclass
class Blocks:
    """start: first day of each block as a number of days; length in days."""

    start: np.ndarray
    length: int
    stats: dict[str, np.ndarray] = field(default_factory=dict)

    def free(self, chosen: list[int]) -> np.ndarray:
        """Blocks that overlap none of the chosen."""
        ok = np.ones(len(self.start), dtype=bool)
        for c in chosen:
            ok &= np.abs(self.start - self.start[c]) >= self.length
        return ok


# ---- features


def add_days(days: DataFrame, valid: DataFrame, length: int, keys: list[str], values: list[str]) -> DataFrame:
    """start, keys, values: sums by day (day, keys, values) added into every valid block (start) of `length` days that holds the day."""
    start = F.explode(F.sequence(F.date_sub("day", length - 1), F.col("day")))
    own = days.withColumn("start", start).join(valid.select("start"), "start", "left_semi")
    return own.groupBy("start", *keys).agg(*[F.sum(v).alias(v) for v in values])


def by_day(rows: DataFrame) -> DataFrame:
    """day, grp, bin, value: the histograms of every day, written once (at most 257 rows a day, and those of missing values). A table that is
    already by day, or some of its days, stays as it is: so one pass over observations serves any number of lengths and parts of a record."""
    if "grp" in rows.columns:
        return rows
    return durable(H.histograms(H.with_bins(rows).withColumn("day", F.to_date("time")), ["day"]))


def _counts(days: DataFrame) -> DataFrame:
    """day, n: rows of every day of by_day(). Each has a month, or is counted beside the months."""
    return days.where("grp = 'month'").groupBy("day").agg(F.sum("value").cast("long").alias("n"))


def _whole(days: DataFrame) -> DataFrame:
    """grp, bin, value: the normalised histograms of all days of by_day()."""
    hist = days.groupBy("grp", "bin").agg(F.sum("value").alias("value"))
    return H.shares(hist, _counts(days).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n")), [])


def features(rows: DataFrame, length: int, least_per_day: int = 6) -> DataFrame:
    """start, grp, bin, value: normalised histograms of every block, scalars over the whole record's. rows: observations, or by_day() of them."""
    days = by_day(rows)
    valid = T.blocks_of_days(_counts(days), length, least_per_day)
    hist = add_days(days, valid, length, ["grp", "bin"], ["value"])
    hist = H.shares(hist, valid.select("start", F.col("rows").alias("_n")), ["start"])
    ref = _whole(days).where("grp = 'scalar'").select("grp", "bin", F.col("value").alias("_ref"))
    both = hist.join(F.broadcast(ref), ["grp", "bin"], "left")  # three rows
    return both.select("start", "grp", "bin", F.when(F.col("grp") == "scalar", F.col("value") / F.col("_ref")).otherwise(F.col("value")).alias("value"))


def scaled(long: DataFrame) -> DataFrame:
    """value times the root of its group's weight."""
    root = F.element_at(F.create_map(*[F.lit(x) for g, w in zip(H.GROUPS, H.WEIGHTS, strict=True) for x in (g, float(np.sqrt(w)))]), F.col("grp"))
    return long.withColumn("value", F.col("value") * root)


def _places() -> dict[str, int]:
    return dict(zip(H.GROUPS, np.cumsum([0, *H.SIZES[:-1]]).tolist(), strict=True))


def target(rows: DataFrame) -> np.ndarray:
    """The feature vector of a whole record, scaled by its groups' weights; scalars are 1. rows: observations, or by_day() of them."""
    place, weight = _places(), dict(zip(H.GROUPS, H.WEIGHTS, strict=True))
    t = np.zeros(sum(H.SIZES))
    for row in _whole(by_day(rows)).collect():
        t[place[row["grp"]] + row["bin"]] = np.sqrt(weight[row["grp"]]) * (1.0 if row["grp"] == "scalar" else row["value"])
    return t


def design_matrix(rows: DataFrame, length: int, least_per_day: int = 6) -> tuple[Blocks, np.ndarray, np.ndarray]:
    """Blocks, the matrix A (257 by blocks) and the target of the whole record. rows: observations, or by_day() of them."""
    rows = by_day(rows)
    at = F.element_at(F.create_map(*[F.lit(x) for g, p in _places().items() for x in (g, p)]), F.col("grp")) + F.col("bin")
    got = scaled(features(rows, length, least_per_day)).groupBy("start").agg(F.collect_list(F.struct(at.alias("p"), "value")).alias("f")).orderBy("start").collect()
    a = np.zeros((sum(H.SIZES), len(got)))
    for k, row in enumerate(got):
        for p, v in row["f"]:
            a[p, k] = v
    start = np.array([row["start"].toordinal() for row in got])
    return Blocks(start, length), a, target(rows)


def reweighted(x: np.ndarray, groups: dict[str, float]) -> np.ndarray:
    """Features (a matrix's rows or a vector) with other weights for these groups."""
    factor = np.concatenate([np.full(n, np.sqrt(groups.get(g, w) / w)) for g, n, w in zip(H.GROUPS, H.SIZES, H.WEIGHTS, strict=True)])
    return x * (factor[:, None] if x.ndim == 2 else factor)


# ---- bounded least squares


def bounded_ls(gram: np.ndarray, rhs: np.ndarray, high: float, rounds: int = 500, start: np.ndarray | None = None) -> np.ndarray:
    """Minimises w'Gw / 2 - r'w over 0 <= w <= high by an active set. A start near the minimum saves most rounds."""
    n = len(rhs)
    w = np.full(n, min(high, 1.0 / max(n, 1))) if start is None else start.copy()
    free = np.ones(n, dtype=bool) if start is None else (w > 0) & (w < high)
    if start is not None and not free.any():
        free[:] = True
    least = 1e-10 * max(1.0, np.abs(rhs).max(initial=0.0))
    for _ in range(rounds):
        if free.any():
            at = np.flatnonzero(free)
            g, r = gram[np.ix_(at, at)], rhs[at] - gram[np.ix_(at, np.flatnonzero(~free))] @ w[~free]
            try:
                target = np.linalg.solve(g, r)
            except np.linalg.LinAlgError:
                target = np.linalg.lstsq(g, r, rcond=None)[0]
            if target.min() >= 0 and target.max() <= high:
                w[at] = target
            else:  # stop where the first bound is met
                step = target - w[at]
                with np.errstate(divide="ignore", invalid="ignore"):
                    room = np.where(step > 0, (high - w[at]) / step, np.where(step < 0, -w[at] / step, np.inf))
                k = int(room.argmin())
                w[at] += max(0.0, room[k]) * step
                w[at[k]] = high if step[k] > 0 else 0.0
                free[at[k]] = False
                continue
        pull = rhs - gram @ w  # positive: wants to grow
        wrong = np.where(free, 0, np.where(w <= 0, pull, -pull))
        k = int(wrong.argmax())
        if wrong[k] <= least:
            break
        free[k] = True
    return np.clip(w, 0, high)


class Fitter:
    """Weights of a set of columns: bounded, with a soft sum of one; or all equal."""

    def __init__(self, a: np.ndarray, t: np.ndarray, high: float, weighted: bool = True) -> None:
        self.a, self.t, self.high, self.weighted = a, t, high, weighted
        self.gram, self.rhs = a.T @ a, a.T @ t
        self.tt = float(t @ t)

    def __call__(self, index: list[int], start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Weights and distance; start: weights from which to search."""
        g, r = self.gram[np.ix_(index, index)], self.rhs[index]
        w = bounded_ls(g + SUM_WEIGHT**2, r + SUM_WEIGHT**2, self.high, start=start) if self.weighted else np.full(len(index), 1 / len(index))
        return w, float(np.sqrt(max(0.0, w @ g @ w - 2 * r @ w + self.tt)))

    def with_each(self, rest: list[int], options: list[int]) -> np.ndarray:
        """The distance of `rest` with each option.

        All options are first solved side by side as if the weights of `rest` that lie on a bound stayed there and the others stayed off
        it; where that holds and no bound pulls (the conditions of the minimum) it is the solution, the rest is searched one by one.
        """
        options, n = np.asarray(options, dtype=int), len(rest)
        if not len(options):
            return np.zeros(0)
        g = self.gram[np.ix_(rest, rest)]
        gj, gjj, rj = self.gram[np.ix_(rest, options)], self.gram[options, options], self.rhs[options]
        if not self.weighted:
            square = (g.sum() + 2 * gj.sum(0) + gjj) / (n + 1) ** 2 - 2 * (self.rhs[rest].sum() + rj) / (n + 1) + self.tt
            return np.sqrt(np.maximum(0.0, square))
        more = SUM_WEIGHT**2
        w = self(rest)[0] if n else np.zeros(0)
        free = (w > 0) & (w < self.high)
        at, bound = np.flatnonzero(free), np.flatnonzero(~free)
        shift = np.linalg.lstsq(g[np.ix_(at, at)] + more, gj[at] + more, rcond=None)[0] if len(at) else np.zeros((0, len(options)))
        curve = gjj + more - ((gj[at] + more) * shift).sum(0)
        pull = rj + more - w @ (gj + more) if n else rj + more
        mine = np.where(pull > 0, pull / np.maximum(curve, 1e-300), 0.0)
        each = np.repeat(w[:, None], len(options), axis=1)
        each[at] -= shift * mine
        least = 1e-10 * max(1.0, np.abs(self.rhs[rest]).max(initial=0.0) + more)
        drawn = (self.rhs[rest] + more)[:, None] - (g + more) @ each - (gj + more) * mine if n else np.zeros((0, len(options)))
        low, high = bound[w[bound] <= 0], bound[w[bound] >= self.high]
        fine = (curve > 1e-9 * (gjj + more)) & (mine <= self.high) & (each[at] >= 0).all(0) & (each[at] <= self.high).all(0)
        fine &= (drawn[low] <= least).all(0) & (drawn[high] >= -least).all(0)
        square = (each * (g @ each)).sum(0) + 2 * mine * (each * gj).sum(0) + mine**2 * gjj - 2 * (self.rhs[rest] @ each + rj * mine) + self.tt if n else mine**2 * gjj - 2 * rj * mine + self.tt
        out = np.sqrt(np.maximum(0.0, square))
        start = np.append(w, 0.0)
        for k in np.flatnonzero(~fine).tolist():
            out[k] = self([*rest, int(options[k])], start if n else None)[1]
        return out


def select_weighted(blocks: Blocks, a: np.ndarray, t: np.ndarray, k: int, high: float | None = None, weighted: bool = True, refine: bool = True, screen: int = SCREEN) -> tuple[list[int], np.ndarray, float]:
    """Chosen blocks, weights that sum to one, and the distance before they were made to."""
    fit = Fitter(a, t, 3.0 / k if high is None else high, weighted)

    def candidates(rest: list[int]) -> list[int]:
        """Those whose columns align best with what `rest` leaves."""
        missing = t - a[:, rest] @ fit(rest)[0] if rest else t
        order = np.argsort(-(a.T @ missing), kind="stable")
        return order[blocks.free(rest)[order]][:screen].tolist()

    chosen = forward_and_swap(k, candidates, fit.with_each, refine)
    w, d = fit(chosen)
    return chosen, w / w.sum(), d


def search_all(spark: SparkSession, made: dict[int, tuple[Blocks, np.ndarray, np.ndarray]], held: np.ndarray, jobs: list[dict]) -> DataFrame:
    """job, distance, held_out (to another record's target), ess of independent searches, a task each.

    made: design matrices by length, shared with the workers (257 numbers a block); a job: length, k, high, groups (weights), weighted.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast((made, held, jobs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrices, test, every = shared.value
        for n in (int(n) for x in batches for n in x["id"]):
            job = every[n]
            blocks, a, t = matrices[job["length"]]
            a, t, away = (reweighted(x, job["groups"]) for x in (a, t, test))
            chosen, w, d = select_weighted(blocks, a, t, job["k"], job["high"], weighted=job["weighted"])
            yield pd.DataFrame([(n, round(d, 6), round(float(np.sqrt(((a[:, chosen] @ w - away) ** 2).sum())), 6), round(float(1 / (w**2).sum()), 6))], columns=["job", "distance", "held_out", "ess"])

    return spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, "job int, distance double, held_out double, ess double")


def forward_and_swap(k: int, candidates: Callable, cost: Callable, refine: bool = True, chosen: list[int] | None = None) -> list[int]:
    """Adds the cheapest candidate until k are chosen, then exchanges one at a time while that lowers the cost.

    A cost may come out a little different beside other options. So a block is not exchanged for itself, and each exchange must
    come out under the last one: else rounding alone could go on exchanging for ever.
    """
    chosen = list(chosen or [])
    while len(chosen) < k:
        options = candidates(chosen)
        if not len(options):
            break
        chosen.append(int(options[int(np.argmin(cost(chosen, options)))]))
    better, last = refine, np.inf
    while better:
        better = False
        for place in range(len(chosen)):
            rest = chosen[:place] + chosen[place + 1 :]
            now = float(cost(rest, [chosen[place]])[0])
            options = np.asarray(candidates(rest), dtype=int)
            options = options[options != chosen[place]]
            costs = cost(rest, options)
            if len(options) and costs.min() < min(now, last) - TOLERANCE:
                chosen[place], last = int(options[int(costs.argmin())]), float(costs.min())
                better = True
    return chosen


def anneal(blocks: Blocks, a: np.ndarray, t: np.ndarray, chosen: list[int], high: float, moves: int = 4000, seed: int = 0) -> tuple[list[int], float]:
    """The best set met by Metropolis exchanges of one block for another, and its distance.

    All proposals are drawn beforehand. The temperature falls by a constant factor a move, from 5 % to
    0.01 % of the first distance; a proposal is taken if its rise stays under the temperature times an
    exponential draw, which is the Metropolis rule.
    """
    fit, rng = Fitter(a, t, high), np.random.default_rng(seed)
    members = np.array(chosen)
    now = fit(members.tolist())[1]
    least, best = now, members.copy()
    bars = now * np.geomspace(0.05, 1e-4, moves, endpoint=False) * rng.exponential(size=moves)
    proposals = np.column_stack([rng.integers(len(members), size=moves), rng.integers(len(blocks.start), size=moves)])
    for (place, comes), bar in zip(proposals.tolist(), bars.tolist(), strict=True):
        others = np.delete(members, place)
        if len(others) and np.abs(blocks.start[others] - blocks.start[comes]).min() < blocks.length:
            continue
        d = fit([*others.tolist(), comes])[1]
        if d - now <= bar:
            members, now = np.append(others, comes), d
            if now < least:
                least, best = now, members.copy()
    return best.tolist(), least


def random_blocks(blocks: Blocks, k: int, seed: int) -> list[int]:
    """k blocks that don't overlap, in the order of a seeded shuffle."""
    chosen: list[int] = []
    for j in np.random.default_rng(seed).permutation(len(blocks.start)).tolist():
        if len(chosen) == k:
            break
        if blocks.free(chosen)[j]:
            chosen.append(j)
    return chosen


# ---- additive statistics and the costs over them


def additive_statistics(rows: DataFrame, length: int, least_per_day: int = 20) -> tuple[Blocks, np.ndarray]:
    """Blocks with stats freq, energy, month, hour, ws, ws3, cf, n (a row a block), and the whole record's sums under "target"."""
    binned = H.with_bins(rows).withColumns({"h6": B.hour6(F.col("time")), "day": F.to_date("time")})
    cells = binned.groupBy("day", "sect", "spd", "month0", "h6").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in ("ws", "ws3", "cf")])
    flat = F.col("sect") * 6 + F.col("spd")
    parts = [("freq", flat, "n"), ("energy", flat, "ws3"), ("month", F.col("month0"), "n"), ("hour", F.col("h6"), "n")]
    parts += [(c, F.lit(0), c) for c in ("ws", "ws3", "cf", "n")]
    each = F.array(*[F.struct(F.lit(g).alias("g"), b.cast("int").alias("b"), F.col(v).cast("double").alias("v")) for g, b, v in parts])
    days = cells.select("day", F.inline(each)).groupBy("day", "g", "b").agg(F.sum("v").alias("v"))
    own = add_days(days, T.contiguous_blocks(rows, length, least_per_day), length, ["g", "b"], ["v"])
    got = own.groupBy("start").agg(F.collect_list(F.struct("g", "b", "v")).alias("f")).orderBy("start").collect()
    sizes = {"freq": 72, "energy": 72, "month": 12, "hour": 4, "ws": 1, "ws3": 1, "cf": 1, "n": 1}
    blocks = Blocks(np.array([r["start"].toordinal() for r in got]), length, {g: np.zeros((len(got), n)) for g, n in sizes.items()})
    for k, row in enumerate(got):
        for g, b, v in row["f"]:
            blocks.stats[g][k, b] = v
    target = {g: np.zeros(n) for g, n in sizes.items()}
    for row in days.groupBy("g", "b").agg(F.sum("v").alias("v")).collect():
        target[row["g"]][row["b"]] = row["v"]
    return blocks, target


def _shares(x: np.ndarray) -> np.ndarray:
    total = x.sum(-1, keepdims=True)
    return np.divide(x, total, out=np.zeros_like(x), where=total > 0)


def distance_v1(sample: dict, target: dict) -> np.ndarray:
    """Weighted L1 distance of the four normalised histograms."""
    return sum(w * np.abs(_shares(sample[g]) - _shares(target[g])).sum(-1) for w, g in zip(WEIGHTS_V1, ("freq", "energy", "month", "hour"), strict=True))


def distance_v2(sample: dict, target: dict) -> np.ndarray:
    """distance_v1 and relative errors of the means of speed, cube and capacity factor."""
    out = distance_v1(sample, target)
    for w, g in zip(WEIGHTS_V2[4:], ("ws", "ws3", "cf"), strict=True):
        out = out + w * np.abs((sample[g] / sample["n"])[..., 0] / (target[g] / target["n"])[0] - 1)
    return out


def select_additive(blocks: Blocks, target: dict, k: int, cost: Callable, refine: bool = True, restarts: int = 1, seed: int = 0) -> tuple[list[int], float]:
    """Chosen blocks and their cost, the best of several starts; the first start is empty, later ones hold a random block. Without blocks: none, at an infinite cost."""
    if not len(blocks.start):
        return [], float("inf")
    stats = {g: blocks.stats[g] for g in target}
    rng = np.random.default_rng(seed)

    def candidates(rest: list[int]) -> np.ndarray:
        return np.flatnonzero(blocks.free(rest))

    def of(rest: list[int], options) -> np.ndarray:
        base = {g: s[rest].sum(0) for g, s in stats.items()}
        return cost({g: base[g] + s[options] for g, s in stats.items()}, target)

    best: tuple[list[int], float] | None = None
    for start in range(restarts):
        first = [] if start == 0 else [int(rng.integers(len(blocks.start)))]
        chosen = forward_and_swap(k, candidates, of, refine, first)
        value = float(of(chosen[:-1], chosen[-1:])[0])
        if best is None or value < best[1]:
            best = chosen, value
    return best
