"""Windowed statistics over a stream of observations (an extension: batch frames give the same rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binning as B
from ..functions import physics as P


def windowed_rose(obs: DataFrame, window: str = "1 hour", late: str = "10 minutes", sectors: int = B.SELECTION_SECTORS) -> DataFrame:
    """begin, sector, n, energy in tumbling windows. obs: time (TIMESTAMP), ws, wd."""
    rows = obs.withWatermark("time", late) if obs.isStreaming else obs
    keys = [F.window("time", window).alias("w"), B.sector_left(F.col("wd"), sectors).alias("sector")]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(P.cube(F.col("ws"))).alias("energy"))
    return out.select(F.col("w.start").alias("begin"), "sector", "n", "energy")


def sessions(obs: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """pixel, begin, end, n: observations without a longer gap between them."""
    rows = obs.withWatermark("time", late) if obs.isStreaming else obs
    out = rows.groupBy(F.session_window("time", gap).alias("w"), "pixel").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return out.select("pixel", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
