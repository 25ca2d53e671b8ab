"""CSV, NumPy and text sources and sinks with fixed schemas, and rules on file names."""

from __future__ import annotations

import datetime as dt
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curve

SITE = "time TIMESTAMP_NTZ, t2 DOUBLE, tskin DOUBLE, u10 DOUBLE, v10 DOUBLE, psfc DOUBLE, snow DOUBLE, u10s DOUBLE, dT DOUBLE, ri_b DOUBLE"
HUB = "time TIMESTAMP_NTZ, ws DOUBLE, wd DOUBLE, t2_h DOUBLE, psfc_h DOUBLE"
SELECTION = "start DATE, days INT, weight DOUBLE"
MANIFEST = "run STRING, start TIMESTAMP_NTZ, end TIMESTAMP_NTZ, sample_start DATE, days INT, weight DOUBLE, synthetic_start DATE"


def parse_csv(lines: DataFrame, schema: str, column: str = "line", skip: str | None = None) -> DataFrame:
    """Rows of CSV text. Lines that match skip (a preamble or header) are left out: lines of a distributed file have no number."""
    rows = lines.where(~F.col(column).rlike(skip)) if skip else lines
    return rows.select(F.from_csv(column, schema, {"timestampFormat": "yyyy-MM-dd HH:mm:ss"}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str, preamble: bool = False) -> DataFrame:
    """A CSV file with a header; with preamble, a line of other text stands before it."""
    if not preamble:
        return spark.read.csv(path, schema=schema, header=True)
    return parse_csv(spark.read.text(path), schema, "value", r"^[^0-9]")


def fixed_decimals(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns as text with so many decimals."""
    return df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    fixed_decimals(df, digits).write.csv(path, header=True)


#: Every so many pixels are a lane of the cube: a scan of every LANES-th pixel reads one lane.
LANES = 24


def write_cube(df: DataFrame, path: str, lanes: int = LANES) -> None:
    """time, pixel, height, ...: a folder a height and lane (pixel modulo `lanes`), rows ordered by pixel and time, so a
    strided scan reads its folders alone and one pixel's history is one range of row groups."""
    laid = df.withColumn("lane", F.pmod(F.col("pixel"), F.lit(lanes)).cast("int"))
    laid.repartitionByRange("height", "lane", "pixel").sortWithinPartitions("height", "lane", "pixel", "time").write.partitionBy("height", "lane").parquet(path)


def _micros(time: Column) -> Column:
    """Microseconds from 1970 on of a time without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


#: Cells of the curve: 2^CURVE_BITS ranges of pixels by as many of times.
CURVE_BITS = 12


def write_curve_cube(df: DataFrame, path: str, lanes: int = LANES, files: int | None = None) -> None:
    """The same folders with rows along a curve through pixels and times, so that files and row groups are small ranges of both and
    a scan of a few pixels, or of a short time, skips most of them; a cube in order of pixels serves the first alone.

    Ranges of equal width are laid between the least and greatest pixel and time (four numbers, one pass); files are ranges of the
    curve with about equal numbers of rows, so a pixel or a time that holds many rows has many files. Null pixels and times lie at
    the start. The reader takes no filters on times without a zone, so time_us repeats them as microseconds; read_cube filters by it.
    """
    micros = _micros(F.col("time"))
    ends = df.agg(F.min("pixel").alias("p0"), F.max("pixel").alias("p1"), F.min(micros).alias("t0"), F.max(micros).alias("t1")).first()
    laid = df.withColumns({
        "time_us": micros, "lane": F.pmod(F.col("pixel"), F.lit(lanes)).cast("int"), "_x": curve.cell(F.col("pixel"), ends["p0"], ends["p1"], CURVE_BITS),
        "_y": curve.cell(micros, ends["t0"], ends["t1"], CURVE_BITS),
    })
    laid = laid.withColumn("_z", curve.interleaved(F.col("_x"), F.col("_y"), CURVE_BITS)).drop("_x", "_y")
    ranges = [*([files] if files else []), "height", "lane", "_z", "pixel", "time"]
    laid.repartitionByRange(*ranges).sortWithinPartitions("height", "lane", "_z", "pixel", "time").drop("_z").write.partitionBy("height", "lane").parquet(path)


def read_cube(spark: SparkSession, path: str, heights: list[int] | None = None, lane: int | None = None, since: dt.datetime | None = None, before: dt.datetime | None = None) -> DataFrame:
    """A cube's rows; with heights or a lane, only those folders; of a cube along the curve, with since or before, only the row groups that hold such times."""
    cube = spark.read.parquet(path)
    if heights is not None:
        cube = cube.where(F.col("height").isin(heights))
    if lane is not None:
        cube = cube.where(F.col("lane") == lane)
    time = "time_us" if "time_us" in cube.columns else "time"
    for end, holds in ((since, lambda t, e: t >= e), (before, lambda t, e: t < e)):
        if end is not None:
            exact = (end - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            cube = cube.where(holds(F.col(time), F.lit(exact) if time == "time_us" else F.lit(end).cast("timestamp_ntz")))
    return cube.drop("lane", "time_us")


def _with_numpy(files: DataFrame, schema: str, open_) -> DataFrame:
    """files (path, content) to rows: open_(path, file) gives a frame each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for p, content in zip(x["path"], x["content"], strict=True):
                yield open_(p, io.BytesIO(content))

    return files.select("path", "content").mapInPandas(run, schema)


def parse_npz(files: DataFrame, variables: list[str]) -> DataFrame:
    """files (path, content) to a row a file: path and each variable as an array of float."""

    def open_(path: str, file) -> pd.DataFrame:
        with np.load(file) as z:
            return pd.DataFrame([{"path": path} | {v: z[v].astype(np.float32).ravel() for v in variables}])

    return _with_numpy(files, "path string, " + ", ".join(f"`{v}` array<float>" for v in variables), open_)


def read_npz(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    return parse_npz(spark.read.format("binaryFile").load(path), variables)


def _blobs(df: DataFrame, name: str, order: str, save) -> DataFrame:
    """path, content: the rows of each `name`, in order, saved as one file's content."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        save(out, x.sort_values(order, kind="stable"))
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()]})

    return df.groupBy(name).applyInPandas(run, "path string, content binary")


def npz_contents(df: DataFrame, name: str, order: str, variables: list[str]) -> DataFrame:
    """path, content: a file of arrays for each `name`; its rows must fit into a worker."""
    return _blobs(df.select(name, order, *variables), name, order, lambda out, x: np.savez(out, **{v: x[v].to_numpy(dtype=float) for v in variables}))


def npy_contents(df: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """path, content: the value as one vector for each `name`, aligned to the order."""
    return _blobs(df.select(name, order, value), name, order, lambda out, x: np.save(out, x[value].to_numpy(dtype=float)))


def parse_npy(files: DataFrame) -> DataFrame:
    """path, place (from 0), value of each number of a vector's file. files: path, content."""
    rows = _with_numpy(files, "path string, v array<double>", lambda path, file: pd.DataFrame({"path": [path], "v": [np.load(file).astype(float).ravel()]}))
    return rows.select("path", F.posexplode("v").alias("place", "value"))


def time_of_name(name: Column) -> Column:
    """The time in a name such as KIND:2001-02-03_04; null without one."""
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{2})$", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd_HH")).cast("timestamp_ntz")


def corner_of_name(name: Column) -> tuple[Column, Column]:
    """Signed latitude and longitude of names such as N34_00_W106_00."""
    part = lambda k: F.regexp_extract(name, r"([NS])(\d+)_\d+_([EW])(\d+)", k)
    lat = part(2).try_cast("int") * F.when(part(1) == "S", -1).otherwise(1)
    lon = part(4).try_cast("int") * F.when(part(3) == "W", -1).otherwise(1)
    return lat, lon


def sound_raster(bands: Column, width: Column, height: Column, finite: Column) -> Column:
    """One band, each extent within 2 % of a degree, something finite."""
    return (bands == 1) & width.between(0.98, 1.02) & height.between(0.98, 1.02) & (finite > 0)


def layered(*layers: tuple[str, Column]) -> tuple[Column, Column]:
    """The first layer that has a value, and its name."""
    name = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in layers])
    return F.coalesce(*[v for _, v in layers]), name
