"""Run windows, costs and resume rules of a simulation campaign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPINUP_DAYS = 0.25


def day_cost(blocks: Column, length: Column, spinup: float = SPINUP_DAYS) -> Column:
    return blocks * (length + F.lit(spinup))


def blocks_for(budget: Column, length: Column, spinup: float = SPINUP_DAYS) -> Column:
    """How many blocks a budget of day equivalents pays for; null below 4."""
    k = F.floor(budget / (length + F.lit(spinup)))
    return F.when(k >= 4, k)


def floor_3h(t: Column) -> Column:
    hours = F.make_dt_interval(F.lit(0), F.hour(t) - F.floor(F.hour(t) / 3).cast("int") * 3, F.minute(t), F.second(t).cast("decimal(18,6)"))
    return t - hours


def block_window(start: Column, days: Column, spinup_hours: int = 6) -> tuple[Column, Column, Column]:
    """Begin of the run (spin-up before, on a 3-hour step), its end, and the model's end 10 minutes earlier. start: TIMESTAMP_NTZ."""
    begin = floor_3h(start - F.expr(f"INTERVAL {spinup_hours} HOURS"))
    end = start + F.make_dt_interval(days.cast("int"))
    return begin, end, end - F.expr("INTERVAL 10 MINUTES")


def forcing_times(begin: Column, end: Column) -> Column:
    """Every third hour, both ends included."""
    return F.sequence(begin, end, F.expr("INTERVAL 3 HOURS"))


def restarts_cold(remaining: Column, total: Column) -> Column:
    """A cold start beats a resume when more than a sixth (whole seconds) remains."""
    return (total > 0) & (remaining > F.floor(total / 6))


def is_complete(frame: Column, end: Column, size: Column) -> Column:
    """A frame within the end minute, larger than 1 MB."""
    return (F.date_trunc("minute", frame) == F.date_trunc("minute", end)) & (size > 1_000_000)


def node_seconds(wall: Column, ranks: Column, gpu: Column) -> Column:
    """Node seconds: ranks of a 104-core node, or a quarter of a GPU node priced ten times."""
    return F.when(gpu, wall / 4 * 10).otherwise(wall * ranks / 104)
