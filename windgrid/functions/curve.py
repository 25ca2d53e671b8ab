"""Cells of a plane in an order that keeps neighbours of both axes together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def interleaved(x: Column, y: Column, bits: int) -> Column:
    """The low bits of two whole numbers, taken in turns: a cell's place on the Z-shaped curve. Null where either is."""
    at = lambda v, k, odd: F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(1), 2 * k + odd)
    return reduce(lambda a, b: a.bitwiseOR(b), [at(v, k, odd) for k in range(bits) for odd, v in enumerate((x, y))])


def cell(x: Column, low: float | None, high: float | None, bits: int) -> Column:
    """Which of 2^bits equal ranges from low to high holds x; nulls, and all where there is no range, are in the first."""
    if low is None or high is None or high <= low:
        return F.lit(0)
    share = (x - F.lit(low)) / F.lit(high - low) * F.lit(2**bits)
    return F.coalesce(F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(2**bits - 1)), F.lit(0))
