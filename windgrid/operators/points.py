"""Block selection judged at every point of a field, over any number of points.

Sums of each block and point are kept as a table of parts, a few points a part with all blocks, written
once. A step of the search asks for the costs of all admissible blocks beside those chosen so far: each task
reads its parts, and per candidate adds up a few moments over the points (of the means, of their ratios to the
whole record's, of the roses' distances); the driver gets these moments alone, one short row a candidate, and
turns them into costs. Searches from several starts go on side by side, so a step is one job for all of them.

Each point is averaged over its own rows. A point without rows in a sample has the mean 0 and an empty rose there:
it counts as wholly missed. Points whose whole record has no speed (or no capacity factor) stay out of the
pattern of that quantity. Null points are a point; rows need finite speeds and directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import binning as B
from ..functions import physics as P
from ..scratch import durable
from . import timeline as T
from .selection import PATTERN_WEIGHT, TOLERANCE, Blocks, add_days

#: Points of a part.
POINTS = 16
NAMES = ["sws", "scf", "n", "e"]
#: Moments over points of a candidate: mean speed, its relative error and its square, the same of the capacity factor, and the distances of the roses by rows and by energy.
MOMENTS = 8


def _unpacked(content: bytes, blocks: int, points: int, sectors: int) -> list[np.ndarray]:
    """Speed and capacity factor (block by point), rows and energy (block by point by sector); the last block is the whole record."""
    a, at, out = np.frombuffer(content, "<f8"), 0, []
    for shape in ((blocks + 1, points),) * 2 + ((blocks + 1, points, sectors),) * 2:
        n = int(np.prod(shape))
        out.append(a[at : at + n].reshape(shape))
        at += n
    return out


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b > 0)


def moments(parts: list[np.ndarray], chosen: list[int], options: np.ndarray) -> np.ndarray:
    """The moments of each option beside the chosen blocks."""
    full = [x[-1] for x in parts]
    speed, cf, rows, energy = (x[chosen].sum(0) + x[options] for x in parts)
    own, all_ = rows.sum(-1), full[2].sum(-1)
    out = np.zeros((len(options), MOMENTS))
    for k, (s, f) in enumerate(((speed, full[0]), (cf, full[1]))):
        mean, whole = _over(s, own), _over(f, all_)
        error = _over(mean, whole) - (whole > 0)
        out[:, 3 * k], out[:, 3 * k + 1], out[:, 3 * k + 2] = mean.sum(1), error.sum(1), (error**2).sum(1)
    for k, (s, f) in enumerate(((rows, full[2]), (energy, full[3]))):
        out[:, 6 + k] = 0.5 * np.abs(_over(s, s.sum(-1, keepdims=True)) - _over(f, f.sum(-1, keepdims=True))).sum((1, 2))
    return out


@dataclass
class PointSums:
    """parts: part, points, content. whole: points, and for speed and capacity factor the sum of the points' means and the number of points that have one."""

    parts: DataFrame
    blocks: Blocks
    sectors: int
    whole: tuple[int, float, float, int, int]

    def evaluate(self, asked: list[tuple[list[int], np.ndarray]]) -> list[np.ndarray]:
        """Of each request (chosen blocks, options) the options' moments over all points."""
        n, sectors = len(self.blocks.start), self.sectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(options), MOMENTS)) for _, options in asked]
            for b in batches:
                for points, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    parts = _unpacked(content.as_buffer(), n, points, sectors)
                    for t, (chosen, options) in zip(total, asked, strict=True):
                        t += moments(parts, chosen, options)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["request", "sums"])

        def add(x: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_buffer(), "<f8") for v in x["sums"])
            return pa.table({"request": x["request"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        kinds = "request int, sums binary"
        got = self.parts.select("points", "content").mapInArrow(run, kinds).groupBy("request").applyInArrow(add, kinds).collect()
        found = {r["request"]: np.frombuffer(r["sums"], "<f8").reshape(-1, MOMENTS) for r in got}
        return [found[k] for k in range(len(asked))]

    def errors(self, m: np.ndarray) -> dict[str, np.ndarray]:
        """Relative level errors of speed and capacity factor and their pattern errors, and the mean distances of the points' roses."""
        points, speed, cf, has_speed, has_cf = self.whole
        out = {}
        for k, (name, total, has) in enumerate((("speed", speed, has_speed), ("cf", cf, has_cf))):
            with np.errstate(divide="ignore", invalid="ignore"):
                c = total / m[:, 3 * k]  # the whole's mean over the sample's
                square = (c - 1) ** 2 + 2 * (c - 1) * c * m[:, 3 * k + 1] / has + c**2 * m[:, 3 * k + 2] / has
                out[name] = m[:, 3 * k] / total - 1
                out[f"{name}_pattern"] = np.where(m[:, 3 * k] > 0, np.sqrt(np.maximum(square, 0)), np.inf)
        return out | {"rose": m[:, 6] / points, "rose_energy": m[:, 7] / points}

    def cost(self, m: np.ndarray, direction: float = 0.0) -> np.ndarray:
        """Level errors, twice the pattern error, and with `direction` the roses' distances in place of the capacity factor's pattern."""
        e = self.errors(m)
        out = np.abs(e["speed"]) + np.abs(e["cf"]) + PATTERN_WEIGHT * e["speed_pattern"]
        if direction:
            return out + direction * (e["rose"] + e["rose_energy"])
        return out + PATTERN_WEIGHT * e["cf_pattern"]


def point_sums(rows: DataFrame, length: int, least_per_day: int, sectors: int = B.SELECTION_SECTORS, points: int = POINTS, where: Column | None = None) -> PointSums:
    """The table of blocks of `length` days. rows: time, pixel, ws, wd. where: a condition on pixel; blocks are those of all rows."""
    ship(rows.sparkSession)
    valid = T.contiguous_blocks(rows, length, least_per_day)
    starts = sorted(r["start"] for r in valid.select("start").collect())  # a row a block
    held = rows if where is None else rows.where(where)
    binned = held.withColumns({"day": F.to_date("time"), "sect": B.sector_left(F.col("wd"), sectors), "ws3": P.cube(F.col("ws")), "cf": P.power_curve(F.col("ws"))})
    days = durable(binned.groupBy("day", "pixel", "sect").agg(F.sum("ws").alias("sws"), F.sum("cf").alias("scf"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("ws3").alias("e")))
    own = add_days(days, valid, length, ["pixel", "sect"], NAMES)
    whole = days.groupBy("pixel", "sect").agg(*[F.sum(c).alias(c) for c in NAMES]).withColumn("start", F.lit(None).cast("date"))
    number = np.array([d.toordinal() for d in starts], dtype=np.int64)
    n, epoch = len(starts), 719163  # of 1970-01-01

    def dense(x: pa.Table) -> pa.Table:
        pixel = x["pixel"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        _, place = np.unique(pixel, return_inverse=True)
        p = int(place.max()) + 1
        day = x["start"].cast(pa.int32()).fill_null(0).to_numpy() + epoch
        row = np.where(x["start"].is_valid().to_numpy(), np.searchsorted(number, day), n)
        flat = row * p + place
        deep = flat * sectors + x["sect"].to_numpy()
        of = lambda at, size, c: np.bincount(at, weights=x[c].to_numpy(), minlength=size)
        size = (n + 1) * p
        content = np.concatenate([of(flat, size, "sws"), of(flat, size, "scf"), of(deep, size * sectors, "n"), of(deep, size * sectors, "e")])
        full = slice(n * p, None)
        f, c = content[:size][full], content[size : 2 * size][full]
        rows = content[2 * size : 2 * size + size * sectors].reshape(size, sectors)[full].sum(1)
        return pa.table({
            "points": pa.array([p], pa.int32()), "content": pa.array([content.astype("<f8").tobytes()], pa.binary()), "speed": pa.array([float((f / rows).sum())]), "cf": pa.array([float((c / rows).sum())]),
            "has_speed": pa.array([int((f > 0).sum())], pa.int32()), "has_cf": pa.array([int((c > 0).sum())], pa.int32()),
        })

    many = days.agg(F.count_distinct(F.xxhash64("pixel"))).first()[0]
    part = F.pmod(F.xxhash64("pixel"), F.lit(max(1, -(-many // points))))
    both = own.unionByName(whole).withColumn("part", part).groupBy("part")
    parts = durable(both.applyInArrow(dense, "points int, content binary, speed double, cf double, has_speed int, has_cf int"))
    total = parts.agg(*[F.sum(c) for c in ("points", "speed", "cf", "has_speed", "has_cf")]).first()
    return PointSums(parts, Blocks(number, length), sectors, tuple(v or 0 for v in total))


def _search(k: int, free: Callable[[list[int]], np.ndarray], refine: bool, chosen: list[int]):
    """A search that yields what it asks (chosen blocks, options), gets the options' costs, and returns its choice and cost."""
    while len(chosen) < k and len(options := free(chosen)):
        costs = yield chosen, options
        chosen = [*chosen, int(options[int(np.argmin(costs))])]
    better = refine
    while better:
        better = False
        for place in range(len(chosen)):
            rest = chosen[:place] + chosen[place + 1 :]
            options = free(rest)
            costs = yield rest, options
            if costs.min() < costs[options == chosen[place]][0] - TOLERANCE:
                chosen[place], better = int(options[int(costs.argmin())]), True
    last = yield chosen[:-1], np.array(chosen[-1:])
    return chosen, float(last[0])


def select(table: PointSums, k: int, direction: float = 0.0, refine: bool = True, restarts: int = 1, seed: int = 0) -> tuple[list[int], float]:
    """Chosen blocks and their cost, the best of several starts (the first is empty, later ones hold a random block), which are searched side by side."""
    n = len(table.blocks.start)
    if not n or not table.whole[0]:
        return [], float("inf")
    rng = np.random.default_rng(seed)
    free = lambda chosen: np.flatnonzero(table.blocks.free(chosen))
    searches = [_search(k, free, refine, [int(rng.integers(n))] if start else []) for start in range(restarts)]
    asks = {s: next(searches[s]) for s in range(restarts)}
    done: dict[int, tuple[list[int], float]] = {}
    while asks:
        found = table.evaluate(list(asks.values()))
        after = {}
        for s, m in zip(asks, found, strict=True):
            try:
                after[s] = searches[s].send(table.cost(m, direction))
            except StopIteration as end:
                done[s] = end.value
        asks = after
    return min((done[s] for s in range(restarts)), key=lambda x: x[1])


def hold_out(rows: DataFrame, length: int, least_per_day: int, k: int, seed: int = 7) -> dict[str, dict[str, float]]:
    """Errors, in percent, of blocks chosen on one half of the points, on that half ("train") and on the other ("held_out"). Halves by a hash of the point and the seed."""
    half = F.pmod(F.xxhash64(F.lit(seed), "pixel"), F.lit(2)) == 0
    train, other = (point_sums(rows, length, least_per_day, where=w) for w in (half, ~half))
    chosen, _ = select(train, k)
    out = {}
    for name, table in (("train", train), ("held_out", other)):
        if chosen and table.whole[0]:
            e = table.errors(table.evaluate([(chosen[:-1], np.array(chosen[-1:]))])[0])
            out[name] = {c: float(100 * e[c][0]) for c in ("speed", "cf", "speed_pattern", "cf_pattern")}
    return out
