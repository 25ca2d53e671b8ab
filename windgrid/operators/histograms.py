"""Block histograms, mixtures and distribution metrics, in long form (grp, bin, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binning as B
from ..functions import physics as P

# Fixed values that define results: the groups, their numbers of bins and weights.
GROUPS = ("dir_spd", "dir_spd_e", "dir_stab", "spd_stab", "month", "slot", "scalar")
SIZES = (72, 72, 60, 30, 12, 8, 3)
WEIGHTS = (3.0, 3.0, 1.0, 0.5, 0.5, 0.5, 2.0)
SCALARS = ("ws", "ws3", "cf")


def with_bins(df: DataFrame) -> DataFrame:
    """df (time, ws, wd, ri_b) with sect, spd, stab, month0, slot, ws3, cf."""
    out = df.withColumns({"sect": B.sector_left(F.col("wd")), "spd": B.speed_bin(F.col("ws")), "stab": B.stability_class(F.col("ri_b"))})
    return out.withColumns({"month0": B.month0(F.col("time")), "slot": B.slot3(F.col("time")), "ws3": P.cube(F.col("ws")), "cf": P.power_curve(F.col("ws"))})


def _bins() -> list[tuple[str, Column, Column]]:
    sect, spd, stab, one = F.col("sect"), F.col("spd"), F.col("stab"), F.lit(1.0)
    return [
        ("dir_spd", sect * 6 + spd, one),
        ("dir_spd_e", sect * 6 + spd, F.col("ws3")),
        ("dir_stab", sect * 5 + stab, one),
        ("spd_stab", spd * 5 + stab, one),
        ("month", F.col("month0"), one),
        ("slot", F.col("slot"), one),
        *[("scalar", F.lit(k), F.col(name)) for k, name in enumerate(SCALARS)],
    ]


def spine(df: DataFrame) -> DataFrame:
    """grp, bin of all 257 features."""
    rows = [(g, n) for g, n in zip(GROUPS, SIZES, strict=True)]
    return df.sparkSession.createDataFrame(rows, "grp string, n int").select("grp", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))


def histograms(binned: DataFrame, by: list[str]) -> DataFrame:
    """by, grp, bin, value: sums of every group's bins; bins without rows are absent. Scalars are sums."""
    # joint cells first: one row per distinct (sect, spd, stab, month, slot), then at most nine rows of each
    cells = binned.groupBy(*by, "sect", "spd", "stab", "month0", "slot").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in SCALARS])
    each = F.array(*[F.struct(F.lit(g).alias("grp"), b.cast("int").alias("bin"), (F.col("n").cast("double") if g not in ("scalar", "dir_spd_e") else v).alias("v")) for g, b, v in _bins()])
    return cells.select(*by, F.inline(each)).groupBy(*by, "grp", "bin").agg(F.sum("v").alias("value"))


def shares(hist: DataFrame, n: DataFrame, by: list[str]) -> DataFrame:
    """by, grp, bin, value: groups that sum to 1 (an empty one stays 0), scalars as means. n: by, _n, the rows behind each."""
    total = F.sum("value").over(Window.partitionBy(*by, "grp"))
    share = hist.withColumn("_t", total)
    share = share.join(n, by) if by else share.crossJoin(n)  # one row
    value = F.when(F.col("grp") == "scalar", F.col("value") / F.col("_n")).otherwise(P.ratio(F.col("value"), F.col("_t")))
    return share.select(*by, "grp", "bin", value.alias("value"))


def normalised(hist: DataFrame, binned: DataFrame, by: list[str]) -> DataFrame:
    """shares() of a histogram of `binned`."""
    return shares(hist, binned.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)


def dense(hist: DataFrame, keys: DataFrame) -> DataFrame:
    """Every bin of every row of keys, 0 where it has no rows. keys: one row a group; it decides the size."""
    by = keys.columns
    every = keys.crossJoin(F.broadcast(spine(keys))) if by else spine(hist)  # 257 rows
    return every.join(hist, [*by, "grp", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def mixture(block_hist: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """grp, bin, value: the weighted sum of blocks' histograms. weights: key, weight."""
    both = block_hist.join(weights.select(key, "weight"), key)
    return both.groupBy("grp", "bin").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def total_variation(p: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """by, tv: half the sum of absolute differences, in percent. p, q: by, bin, value."""
    keys = [*by, "bin"]
    both = p.withColumnRenamed("value", "_p").join(q.withColumnRenamed("value", "_q"), keys, "full")
    gap = F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))
    return both.groupBy(*by).agg((50 * F.sum(gap)).alias("tv"))


def report(sample: DataFrame, reference: DataFrame) -> DataFrame:
    """metric, value: the twelve metrics of a sample's histograms against the reference's. Both: grp, bin, value."""

    # at most 257 rows each, read three times: taken to the driver as they are
    sample, reference = (h.sparkSession.createDataFrame(h.collect(), h.schema) for h in (sample.select("grp", "bin", "value"), reference.select("grp", "bin", "value")))

    def folded(h: DataFrame) -> DataFrame:
        """Each bin once for every metric that it counts in."""
        sector, stab = F.floor(F.col("bin") / 6).cast("int"), (F.col("bin") % 5).cast("int")
        one = lambda name, b: F.struct(F.lit(name).alias("metric"), b.alias("b"))
        uses = {"dir_spd": [one("roseF", sector), one("joint", F.col("bin"))], "dir_spd_e": [one("roseE", sector), one("jointE", F.col("bin"))], "dir_stab": [one("stab", stab), one("dirstab", F.col("bin"))]}
        uses |= {"month": [one("month", F.col("bin"))], "slot": [one("hour", F.col("bin"))]}
        every = F.lit(None)
        for g, parts in uses.items():
            every = F.when(F.col("grp") == g, F.array(*parts)).otherwise(every)
        rows = h.where(F.col("grp").isin(*uses)).select(F.inline(every), "value")
        return rows.groupBy("metric", F.col("b").alias("bin")).agg(F.sum("value").alias("value"))

    tv = total_variation(folded(sample), folded(reference), ["metric"]).select("metric", F.col("tv").alias("value"))

    def sector_speed(h: DataFrame, name: str) -> DataFrame:
        mids = F.array(*map(F.lit, B.SPEED_MIDPOINTS))
        sect = F.floor(F.col("bin") / 6).cast("int")
        s = h.where("grp = 'dir_spd'").groupBy(sect.alias("sect")).agg(F.sum("value").alias("share"), F.sum(F.col("value") * F.get(mids, (F.col("bin") % 6).cast("int"))).alias("m"))
        return s.select("sect", F.col("share").alias(f"{name}_share"), (F.col("m") / F.greatest("share", F.lit(1e-12))).alias(name))

    both = sector_speed(reference, "ref").where("ref_share > 0.01").join(sector_speed(sample, "sub"), "sect", "left")
    speed = both.agg((100 * F.avg(F.abs(F.coalesce("sub", F.lit(0.0)) / F.col("ref") - 1))).alias("value")).select(F.lit("secWS").alias("metric"), "value")
    pair = sample.where("grp = 'scalar'").select("bin", F.col("value").alias("a")).join(reference.where("grp = 'scalar'").select("bin", F.col("value").alias("b")), "bin")
    level = pair.select(F.get(F.array(*map(F.lit, ("ws", "en", "cf"))), F.col("bin")).alias("metric"), (100 * (F.col("a") / F.col("b") - 1)).alias("value"))
    return tv.unionByName(speed).unionByName(level)


def effective_size(weights: DataFrame, weight: str = "weight") -> DataFrame:
    """One row, ess: how many equal weights tell as much."""
    w = F.col(weight)
    return weights.agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))
