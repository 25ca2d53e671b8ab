"""Weighted wind resource grid of a record, at several hub heights.

    python -m jobs.resource_grid --config jobs/resource_grid.conf --record lineitem.parquet --out FOLDER

Reads a table of observations (any columns; the settings say by SQL expressions what
time step weight, point, speed and direction are), fits a weighted Weibull distribution
to each point and direction sector, carries it to the hub heights by the power law of
the wind profile, and writes

* FOLDER/grid: a row a point and height, Parquet, partitioned by height;
* FOLDER/text: the same as rows of resource-grid text, partitioned by height, which the
  library's reader (windgrid.sources.wrg) reads; FOLDER/header holds each height's first line.

Rows whose speed, direction or weight isn't finite, or whose weight isn't positive, are
counted in the log and left out. A rerun replaces the partitions of the heights it is
asked for and no others, with the same rows. An empty record gives empty tables.

The speed grows with height by a factor, so one fit serves all heights: shape and
frequencies stay, scales grow by the factor and the power density by its cube.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windgrid.functions import physics as P
from windgrid.operators import weibull
from windgrid.plans.q_aggs import SECTOR16, _fit_sql
from windgrid.sources import wrg
from windgrid.sources.views import with_views

from .common import log, main, new_folder, numbers, settings


@dataclass
class Settings:
    """What resource_grid.conf may set; these are the values of the registered query."""

    pixel: str = "l_orderkey % 64"
    ws: str = "l_quantity / 2"
    wd: str = "CAST((l_partkey * 37 + l_suppkey * 11) % 360 AS DOUBLE)"
    weight: str = "1 + l_tax * 10"
    heights: str = "80, 100, 120, 160"
    reference_height: float = 100.0
    shear: float = 0.14
    rotor_radius: float = 50.0
    columns: int = 8
    resolution: float = 100.0

    @classmethod
    def of(cls, found: dict[str, str]) -> Settings:
        kinds = {f.name: type(getattr(cls, f.name)) for f in fields(cls)}
        if unknown := found.keys() - kinds.keys():
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: kinds[k](v) for k, v in found.items()})

    def factor(self, height: float) -> float:
        """Speed at a height over that at the record's own."""
        return (height / self.reference_height) ** self.shear


def observations(record: DataFrame, s: Settings) -> DataFrame:
    """pixel, ws, wd, weight of a record."""
    return record.select(*[F.expr(getattr(s, c)).alias(c) for c in ("pixel", "ws", "wd", "weight")])


def at_heights(grid: DataFrame, s: Settings) -> DataFrame:
    """height, pixel, k, a, pd, sectors: the grid of the record's height, once a hub height."""
    heights = F.array(*[F.struct(F.lit(int(h)).alias("height"), F.lit(s.factor(h)).alias("_f")) for h in numbers(s.heights)])
    rows = grid.select("*", F.inline(heights))
    f = F.col("_f")
    sectors = F.transform("sectors", lambda x: F.struct(x["freq"].alias("freq"), (x["a"] * f).alias("a"), x["k"].alias("k")))
    return rows.select("pixel", "k", (F.col("a") * f).alias("a"), (F.col("pd") * f * f * f).alias("pd"), sectors.alias("sectors"), "height")


def as_text(grid: DataFrame, s: Settings) -> DataFrame:
    """line, height of the resource-grid text."""
    place = {"e": (F.col("pixel") % s.columns) * s.resolution, "n": F.floor(F.col("pixel") / s.columns) * s.resolution, "elev": F.lit(0.0)}
    natural = F.transform("sectors", lambda x: F.struct((x["freq"] / 1000).alias("freq"), (x["a"] / 10).alias("a"), (x["k"] / 100).alias("k")))
    cells = grid.withColumns({n: v.cast("double") for n, v in place.items()}).withColumn("sectors", natural)
    line = wrg.format_rows(cells.withColumn("height", F.col("height").cast("double")), keep=("height",))
    return line.withColumn("height", F.col("height").cast("int"))


def headers(grid: DataFrame, s: Settings) -> DataFrame:
    """line, height: columns, rows, corner and step of each height's grid."""
    top = grid.groupBy("height").agg(F.max(F.floor(F.col("pixel") / s.columns)).alias("top"))
    return top.select(F.format_string(f"{s.columns} %d 0.0 0.0 {s.resolution}", F.col("top") + 1).alias("line"), "height")


def _write(df: DataFrame, form: str, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("height").format(form).save(path)


def run(spark: SparkSession, record: str, out: str, s: Settings | None = None) -> dict[str, int]:
    """The job. Returns what it read and wrote, which it also logs."""
    s = s or Settings()
    rows = observations(spark.read.parquet(record), s)
    good = P.finite(*[F.col(c).cast("double") for c in ("ws", "wd", "weight")]) & (F.col("weight") > 0) & F.col("pixel").isNotNull()
    count = rows.agg(F.count("*").alias("all"), F.count_if(good).alias("good")).first()
    log.info("read %d rows of %s, %d of them are left out", count["all"], record, count["all"] - count["good"])
    _write(at_heights(weibull.resource_grid(rows.where(good), ["pixel"], "weight", s.rotor_radius), s), "parquet", f"{out}/grid")
    wanted = [int(h) for h in numbers(s.heights)]
    grid = spark.read.schema(GRID).parquet(f"{out}/grid").where(F.col("height").isin(wanted))
    _write(as_text(grid, s), "text", f"{out}/text")
    _write(headers(grid, s), "text", f"{out}/header")
    done = {"rows": count["all"], "left_out": count["all"] - count["good"], "cells": grid.count(), "lines": spark.read.text(f"{out}/text").where(F.col("height").isin(wanted)).count() if count["good"] else 0}
    if done["cells"] != done["lines"]:
        raise RuntimeError(f"{done['cells']} cells but {done['lines']} lines of text under {out}")
    log.info("wrote %d cells to %s/grid and as many lines to %s/text, heights %s", done["cells"], out, out, s.heights)
    return done


GRID = "pixel long, k double, a double, pd double, sectors array<struct<freq double, a double, k double>>, height int"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job run twice over lineitem; a row a height, point and sector of what it left."""
    out = new_folder(spark, "resource_grid")
    for _ in range(2):
        run(spark, f"{sf_dir}/lineitem.parquet", out)
    grid = spark.read.schema(GRID).parquet(f"{out}/grid")
    r = lambda x, n: F.round(x, n) + F.lit(0.0)
    rows = grid.select("height", "pixel", r(F.col("a"), 4).alias("all_a"), r(F.col("k"), 4).alias("all_k"), r(F.col("pd"), 3).alias("pd"), F.posexplode("sectors").alias("sector", "s"))
    return rows.select("height", "pixel", "all_a", "all_k", "pd", "sector", r(F.col("s.freq"), 3).alias("freq"), r(F.col("s.a"), 3).alias("a"), r(F.col("s.k"), 2).alias("k"))


_HEIGHTS = ", ".join(f"({int(h)}, {Settings().factor(h)!r}::DOUBLE)" for h in numbers(Settings.heights))
SQL = with_views(f"""WITH RECURSIVE one AS (SELECT CAST(pixel AS BIGINT) AS pixel, {SECTOR16} AS sector, CAST(ws AS DOUBLE) AS ws, CAST(weight AS DOUBLE) AS w FROM forcing_v),
    obs AS (SELECT * FROM one UNION ALL SELECT pixel, -1, ws, w FROM one), {_fit_sql('obs', 'pixel, sector')},
    t AS (SELECT pixel, sum(w) AS total, {0.5 * 1.225 * 3.141592653589793 * 2500 * 0.33 / 1000!r}::DOUBLE * power(sum(ws * w) / sum(w), 3) AS pd FROM one GROUP BY 1),
    q AS (SELECT pixel, sector, sum(w) AS sw FROM one GROUP BY 1, 2), whole AS (SELECT pixel, k, a FROM fit WHERE sector = -1),
    d AS (SELECT pixel, total, pd, unnest(range(0, 16))::INT AS sector FROM t)
    SELECT h.height::INT AS height, pixel, round(whole.a * f, 4) AS all_a, round(whole.k, 4) AS all_k, round(pd * f * f * f, 3) AS pd, sector, round(coalesce(1000 * sw / total, 0), 3) AS freq, round(10 * fit.a * f, 3) AS a, round(100 * fit.k, 2) AS k
    FROM d CROSS JOIN (VALUES {_HEIGHTS}) h(height, f) LEFT JOIN whole USING (pixel) LEFT JOIN q USING (pixel, sector) LEFT JOIN fit USING (pixel, sector)""")


if __name__ == "__main__":
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--config", help="settings, KEY=VALUE")
    args.add_argument("--record", required=True, help="table of observations")
    args.add_argument("--out", required=True, help="folder for the grid")
    a = args.parse_args()
    main("resource grid", lambda spark: run(spark, a.record, a.out, Settings.of(settings(spark, a.config))))
