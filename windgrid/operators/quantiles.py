"""Exact quantiles of a whole column in bounded memory: histograms narrow the range that holds a rank until few rows are left."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import finite

#: Bins of a histogram, and rows that are few enough to be sorted by one task.
BINS, FEW = 4096, 100_000


def _at_ranks(values: DataFrame, n: int, low: float, high: float, ranks: list[int], few: int) -> dict[int, float]:
    """The values (column v) at these ranks, from 0, of n rows that lie in [low, high]."""
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= few:
        every = values.agg(F.sort_array(F.collect_list("v")).alias("a"))
        got = every.select(*[F.get("a", F.lit(k)) for k in ranks]).first()
        return dict(zip(ranks, got, strict=True))
    width = high / BINS - low / BINS  # the difference itself may overflow
    at = F.least(F.floor((F.col("v") / width) - low / width), F.lit(BINS - 1)) if width else F.lit(0)
    bins = values.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
    out, before = {}, 0
    for b in bins:
        own = [k - before for k in ranks if before <= k < before + b["n"]]
        if own:
            part = values.where(F.col("v").between(b["low"], b["high"]))
            out |= {k + before: v for k, v in _at_ranks(part, b["n"], b["low"], b["high"], own, few).items()}
        before += b["n"]
    return out


def quantiles(df: DataFrame, value: Column, shares: list[float], few: int = FEW) -> list[float | None]:
    """The quantiles at these shares, interpolated linearly between neighbours; null without values. Nulls, NaN and infinities are left out.

    A pass over df counts BINS bins; only those that hold a wanted rank are passed over again, until at most `few` rows are sorted by one task.
    """
    values = df.select(value.cast("double").alias("v")).where(finite(F.col("v")))
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [q * (n - 1) for q in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    at = _at_ranks(values, n, low, high, ranks, few)
    return [at[math.floor(p)] * (math.floor(p) + 1 - p) + at[math.ceil(p)] * (p - math.floor(p)) if p % 1 else at[int(p)] for p in places]


def literals(df: DataFrame, value: Column, named: dict[str, float]) -> list[Column]:
    """quantiles() as named literal columns. They are computed by some jobs when this is called, while the caller's plan is built, and not when that plan runs."""
    return [F.lit(q).cast("double").alias(name) for name, q in zip(named, quantiles(df, value, list(named.values())), strict=True)]
