"""Timing lines of a simulation's log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed words of a timing line; the step in brackets stands before the colon in the newer dialect only.
HEAD, BEFORE_DOMAIN, LAST = "Timing for main", "on domain", "elapsed"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Only these columns, computed once a row: projections that read each other would be merged, and a line cut again for every use."""
    return df.select(F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """time (TIMESTAMP_NTZ), domain, elapsed; other lines and malformed stamps are left out.

    A line is cut at colons before white space into its head, its stamp and domain, and its seconds, and these into words.
    """
    at = F.locate(HEAD, F.col(column))
    told = once(lines.where(at > 0), p=F.split(F.substring(F.col(column), at, F.length(column)), r":\s+")).where(F.size("p") >= 3)
    words = lambda k: F.split(F.trim(F.col("p")[k]), r"\s+")
    told = once(told, step=F.trim(F.substring(F.col("p")[0], len(HEAD) + 1, 1000)), m=words(1), t=words(2))
    step = F.col("step")  # nothing, or the step in brackets
    shaped = ((step == "") | (step.startswith("(dt=") & step.endswith(")"))) & (F.size("m") == 5) & (F.get("m", F.lit(0)) == "time")
    shaped &= (F.concat_ws(" ", F.get("m", F.lit(2)), F.get("m", F.lit(3))) == BEFORE_DOMAIN) & (F.get("t", F.lit(1)) == LAST)
    day, hour = F.substring(F.get("m", F.lit(1)), 1, 10), F.substring(F.get("m", F.lit(1)), 12, 100)
    stamp = F.try_to_timestamp(F.concat_ws(" ", day, hour), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    whole = F.substring(F.get("m", F.lit(1)), 11, 1).isin("_", " ")
    found = once(told.where(shaped), time=F.when(whole, stamp), domain=F.get("m", F.lit(4)).try_cast("int"), elapsed=F.get("t", F.lit(0)).try_cast("double"))
    return found.where("time IS NOT NULL AND domain IS NOT NULL AND elapsed IS NOT NULL")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path), "value")
