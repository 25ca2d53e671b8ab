"""Order-based operators on time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import running, with_halo


def decimate(df: DataFrame, step: int, order: list[str], by: list[str]) -> DataFrame:
    """Every step-th row in order, the first included."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % step == 0).drop("_n")


def first_of_time(df: DataFrame, time: str, tiebreak: list[str]) -> DataFrame:
    """One row a time: the first by tiebreak."""
    w = Window.partitionBy(time).orderBy(*tiebreak)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def contiguous_blocks(rows: DataFrame, length: int, least_per_day: int = 6, time: str = "time") -> DataFrame:
    """start, end, rows of every run of `length` days in sequence with at least least_per_day * length rows."""
    return blocks_of_days(rows.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n")), length, least_per_day)


def blocks_of_days(days: DataFrame, length: int, least_per_day: int = 6) -> DataFrame:
    """contiguous_blocks() of days and their numbers of rows (day, n).

    A block is found by adding each day to the `length` blocks that it may belong to, so days are
    never ordered in one partition.
    """
    member = days.withColumn("start", F.explode(F.sequence(F.date_sub("day", length - 1), F.col("day"))))
    whole = member.groupBy("start").agg(F.count(F.lit(1)).alias("_d"), F.sum("n").alias("rows"))
    kept = whole.where((F.col("_d") == length) & (F.col("rows") >= least_per_day * length))
    return kept.select("start", F.date_add("start", length - 1).alias("end"), "rows")


def segments(df: DataFrame, by: list[str], time: str, gap_seconds: float, tiebreak: list[str], exact: bool = False, ranges: int | None = None) -> DataFrame:
    """df with segment (int from 0 within `by`): a new one begins after a longer gap, or, with exact, after any other gap.

    A series may be of any length: the time before a row and the number of cuts come from scans over ranges of time.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = running(df, by, [time, *tiebreak], lags={"_before": t}, ranges=ranges)
    gap = (t - F.col("_before")) / 1_000_000
    cut = F.when(gap != gap_seconds if exact else gap > gap_seconds, 1).otherwise(0)
    rows = running(rows.withColumn("_cut", cut), by, [time, *tiebreak], sums={"segment": F.col("_cut")}, ranges=ranges)
    return rows.select(*df.columns, F.col("segment").cast("int").alias("segment"))


#: Rows of a series that one task of the autocorrelation holds, without the halo of its longest lag.
BLOCK_ROWS = 50_000


def autocorrelation(df: DataFrame, by: list[str], order: list[str], value: str, lags: list[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lag, rho: pooled over groups, the mean of each group taken off.

    Rows are numbered by a scan and cut into blocks, each with as many rows of the next one as the longest lag reaches.
    """
    reach = max(lags)
    mean = df.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(by)]).agg(F.avg(value).alias("_mean"))
    same = F.lit(True)
    for n, k in enumerate(by):
        same &= df[k].eqNullSafe(F.col(f"_k{n}"))
    dev = df.join(mean, same).select(*by, *order, (F.col(value) - F.col("_mean")).alias("_x"))
    dev = running(dev, by, order, sums={"_at": F.lit(1)}).withColumn("_at", F.col("_at").cast("long") - 1)
    w = Window.partitionBy(*by, "block").orderBy("_at")
    ahead = {k: F.lead("_x", k).over(w) for k in lags}
    products = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("_x") * a).alias("p"), F.when(a.isNotNull(), F.col("_x") * F.col("_x")).alias("s")) for k, a in ahead.items()])
    pairs = with_halo(dev, by, "_at", reach, max(block_rows, reach + 1)).select("own", products.alias("a")).where("own").select(F.inline("a")).where("p IS NOT NULL")
    return pairs.groupBy("lag").agg((F.sum("p") / F.sum("s")).alias("rho"))


def integral_timescale(acf: DataFrame, minutes: float = 10.0, up_to: int = 18) -> DataFrame:
    """minutes * (1 + 2 * the sum of rho over lags 1 to up_to)."""
    return acf.where(F.col("lag").between(1, up_to)).agg((minutes * (1 + 2 * F.sum("rho"))).alias("timescale"))


def profile_window(log: DataFrame) -> DataFrame:
    """begin, end of a model log's window: from the second to the last step of domain 1; no row with fewer than 3. log: time, domain."""
    d1 = log.where("domain = 1").groupBy("time").agg(F.count(F.lit(1)).alias("n"))
    # the second step is the second smallest time, with repeats counted: a top-2 list, not a sort of all steps
    two = log.where("domain = 1").orderBy("time").limit(2).agg(F.max("time").alias("begin"))
    return two.crossJoin(d1.agg(F.max("time").alias("end"), F.sum("n").alias("n"))).where("n >= 3").select("begin", "end")
