"""Field, rose and distribution metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..functions.special import gamma_fn
from .quantiles import literals
from .scan import running
from .weibull import MOMENTS_POWER


def point_statistics(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean speed, mean cube and mean capacity factor."""
    ws = F.col("ws")
    return df.groupBy(*by).agg(F.avg(ws).alias("mean"), F.avg(P.cube(ws)).alias("energy"), F.avg(P.power_curve(ws)).alias("aep"))


def level_and_pattern(sample: DataFrame, full: DataFrame, key: str, value: str) -> DataFrame:
    """One row: mean and largest level error in percent, p95, and of the fields over their domain means: correlation and rms."""
    both = sample.select(key, F.col(value).alias("s")).join(full.select(key, F.col(value).alias("f")), key)
    m = both.agg(F.avg("s").alias("ms"), F.avg("f").alias("mf"))
    x = both.crossJoin(F.broadcast(m)).select((100 * (F.col("s") / F.col("f") - 1)).alias("e"), (F.col("s") / F.col("ms")).alias("ps"), (F.col("f") / F.col("mf")).alias("pf"))
    return x.agg(
        F.avg("e").alias("mean_error"),
        F.max(F.abs("e")).alias("max_error"),
        *literals(x, F.abs("e"), {"p95_error": 0.95}),
        F.corr("ps", "pf").alias("r"),
        (100 * F.sqrt(F.avg((F.col("ps") - F.col("pf")) ** 2))).alias("pattern_rms"),
    )


def rose(df: DataFrame, by: list[str], sector: Column, sectors: int, weight: Column | None = None) -> DataFrame:
    """by, sector, n, energy, share, energy_share: dense over all sectors of each group."""
    w = weight if weight is not None else F.lit(1.0)
    got = df.withColumn("sector", sector).groupBy(*by, "sector").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(w).alias("w"), F.sum(w * P.cube(F.col("ws"))).alias("energy"))
    every = got.select(*by).distinct().withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))))
    full = every.join(got, [*by, "sector"], "left").na.fill(0, ["n"]).na.fill(0.0, ["w", "energy"])
    own = Window.partitionBy(*by)
    return full.select(*by, "sector", "n", "energy", P.ratio(F.col("w"), F.sum("w").over(own)).alias("share"), P.ratio(F.col("energy"), F.sum("energy").over(own)).alias("energy_share"))


def rose_fidelity(sample: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """One row: mean and largest share error (percentage points), total variation averaged over points, and the error of sectors' cube-root speed where the full record has over 1 % in it (NaN if such a sector holds calms alone)."""
    a = sample.select(key, "sector", *[F.col(c).alias(f"s_{c}") for c in ("n", "energy", "share", "energy_share")])
    b = full.select(key, "sector", *[F.col(c).alias(f"f_{c}") for c in ("n", "energy", "share", "energy_share")])
    x = b.join(a, [key, "sector"])
    speed = lambda p: F.pow(P.ratio(F.col(f"{p}_energy"), F.col(f"{p}_n").cast("double")), F.lit(1 / 3))
    # a sector of calms alone has no speed to compare: 0 / 0
    over = F.when(speed("f") > 0, F.try_divide(speed("s"), speed("f"))).when(speed("s") > 0, float("inf")).otherwise(float("nan"))
    err = F.when(F.col("f_share") > 0.01, 100 * F.abs(over - 1))
    d, e = F.abs(F.col("s_share") - F.col("f_share")), F.abs(F.col("s_energy_share") - F.col("f_energy_share"))
    per = x.groupBy(key).agg(F.sum(d).alias("sd"), F.max(d).alias("md"), F.sum(e).alias("se"), F.max(e).alias("me"), F.count(F.lit(1)).alias("n"), F.sum(err).alias("sw"), F.count(err).alias("nw"))
    return per.agg(
        (100 * F.sum("sd") / F.sum("n")).alias("sec_f"),
        (100 * F.max("md")).alias("sec_f_max"),
        (100 * F.sum("se") / F.sum("n")).alias("sec_e"),
        (100 * F.max("me")).alias("sec_e_max"),
        (50 * F.avg("sd")).alias("rose_tv"),
        (50 * F.avg("se")).alias("rose_tv_e"),
        F.try_divide(F.sum("sw"), F.sum("nw")).alias("sec_ws"),
    )


def shares(df: DataFrame, key: Column, name: str, means: list[str]) -> DataFrame:
    """Share of each class, and class means."""
    out = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).cast("long").alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return out.crossJoin(total).withColumn("share", F.col("n") / F.col("_t")).drop("_t")  # one row


def crosstab(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """row, col, share: counts over the row's total."""
    n = df.groupBy(row.alias("row"), column.alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("row", "col", (F.col("n") / F.sum("n").over(Window.partitionBy("row"))).alias("share"))


def field_difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: bias, rms, 99th percentile and largest absolute difference, on common cells."""
    d = a.select("i", "j", F.col(value).alias("a")).join(b.select("i", "j", F.col(value).alias("b")), ["i", "j"]).select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.avg("d").alias("bias"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rms"), *literals(d, F.abs("d"), {"p99": 0.99}), F.max(F.abs("d")).alias("largest"))


def _beside(df: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """df with the sums of its keys."""
    named = sums.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= df[k].eqNullSafe(F.col(f"_of_{k}"))
    return df.join(named, same).drop(*[f"_of_{k}" for k in keys])


def wasserstein(sub: DataFrame, whole: DataFrame, keys: list[str], of: str, value: str) -> DataFrame:
    """keys, of, distance: first Wasserstein distance between each group's sub-sample (keys, of) and its whole (keys).

    The integral of the distance of the two quantile functions. A sub-sample's is constant on each of its steps, where the
    whole's lies below it up to the value's own rank and above it from there on; so a step needs the integral of the whole's
    quantile function up to three ranks. That of the value's rank comes by a join on the value (a sub-sample holds no other
    ones than the whole), those of the step's ends by one pass over the whole's steps and all sub-samples' together. Values
    are counted first, so what is ordered are distinct values, once each and not once a sub-sample. All running sums are
    scans over ranges, so a key with any number of distinct values is many tasks.
    """
    x = F.col(value).cast("double")
    n = whole.groupBy(*keys, x.alias("_x")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    n = running(n, keys, ["_x"], sums={"_r": F.col("_n"), "_s": F.col("_x") * F.col("_n")})
    # _r, _s: the share of rows and the integral up to and with this value
    n = _beside(n, n.groupBy(*keys).agg(F.sum("_n").alias("_t")), keys)
    steps = n.select(*keys, "_x", (F.col("_r") / F.col("_t")).alias("_r"), (F.col("_s") / F.col("_t")).alias("_s"), (F.col("_n") / F.col("_t")).alias("_w"))
    m = sub.groupBy(*keys, of, x.alias("_x")).agg(F.count(F.lit(1)).cast("double").alias("_m"))
    m = running(m, [*keys, of], ["_x"], sums={"_u": F.col("_m")})
    m = _beside(m, m.groupBy(*keys, of).agg(F.sum("_m").alias("_all")), [*keys, of])
    # of a step of the sub-sample, both ends
    m = m.select(*keys, of, F.col("_x").alias("_v"), F.posexplode(F.array((F.col("_u") - F.col("_m")) / F.col("_all"), F.col("_u") / F.col("_all"))).alias("_at", "_u"))
    kinds = dict(m.dtypes)
    none = [F.lit(None).cast(kinds[k]).alias(k) for k in (of, "_v", "_at")]
    begins = steps.select(*keys, *none, (F.col("_r") - F.col("_w")).alias("_u"), F.struct((F.col("_r") - F.col("_w")).alias("r"), (F.col("_s") - F.col("_w") * F.col("_x")).alias("s"), F.col("_x").alias("x")).alias("_b"))
    along = begins.unionByName(m.withColumn("_b", F.lit(None).cast(dict(begins.dtypes)["_b"]))).withColumn("_end", F.col("_at").isNotNull())
    ends = running(along, keys, ["_u", "_end", "_v", "_at", of], lasts={"_b": F.col("_b")}).where("_end")
    p = F.col("_b.s") + F.col("_b.x") * (F.col("_u") - F.col("_b.r"))
    of_end = lambda k, v: F.max(F.when(F.col("_at") == k, v))
    ends = ends.groupBy(*keys, of, F.col("_v").alias("_x")).agg(of_end(0, F.col("_u")).alias("_u0"), of_end(1, F.col("_u")).alias("_u"), of_end(0, p).alias("_p0"), of_end(1, p).alias("_p"))
    both = ends.join(steps.drop("_w"), [*keys, "_x"])
    at = F.least(F.greatest("_r", "_u0"), F.col("_u"))
    whole_at = F.when(F.col("_r") <= F.col("_u0"), F.col("_p0")).when(F.col("_r") >= F.col("_u"), F.col("_p")).otherwise(F.col("_s"))
    step = F.col("_x") * (2 * at - F.col("_u0") - F.col("_u")) + F.col("_p0") + F.col("_p") - 2 * whole_at
    return both.groupBy(*keys, of).agg(F.sum(step).alias("distance"))


def random_draws(rows: DataFrame, length: int, blocks: int, draws: int = 40) -> DataFrame:
    """draw, day: `draws` random samples of `blocks` blocks of `length` successive recorded days; a day in two blocks is in once.

    A draw takes the days with the least hashes of (draw, day) as starts. Only days are ordered, not observations.
    """
    day = rows.select(F.to_date("time").alias("day")).distinct()
    placed = day.withColumn("at", F.row_number().over(Window.orderBy("day")) - 1)  # one row a day
    starts = placed.where(F.col("at") < placed.count() - length).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = F.md5(F.concat_ws(":", "draw", "day").cast("binary"))
    taken = starts.withColumn("_n", F.row_number().over(Window.partitionBy("draw").orderBy(key))).where(F.col("_n") <= blocks)
    at = taken.select("draw", F.explode(F.sequence(F.col("at"), F.col("at") + length - 1)).alias("at"))
    return at.distinct().join(placed, "at").select("draw", "day")


def draw_bias(rows: DataFrame, drawn: DataFrame, sector: Column, sectors: int) -> DataFrame:
    """draw, rows, and the draw's errors against the whole record: percent of mean speed (ws), mean cube (energy), Weibull scale
    and shape by moments (a, k), and of sectors' shares the mean error in percentage points (freq_mae) and for shares of
    energy the mean and largest (energy_mae, energy_max).

    Observations are summed by day and sector once; draws add days.
    """
    ws, cube = F.col("ws"), P.cube(F.col("ws"))
    sums = ["n", "s1", "s2", "s3"]
    days = rows.groupBy(F.to_date("time").alias("day"), sector.alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.sum(ws).alias("s1"), F.sum(ws * ws).alias("s2"), F.sum(cube).alias("s3"))
    add = lambda d, by: d.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    whole = add(days, ["sector"])
    each = add(drawn.join(days, "day"), ["draw", "sector"])
    every = each.select("draw").distinct().withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))))
    own, all_ = Window.partitionBy("draw"), whole.select("sector", *[F.col(c).alias(f"all_{c}") for c in sums])
    both = every.join(each, ["draw", "sector"], "left").join(all_, "sector", "left").na.fill(0).na.fill(0.0)
    share = lambda c: F.abs(P.ratio(F.col(c), F.sum(c).over(own)) - P.ratio(F.col(f"all_{c}"), F.sum(f"all_{c}").over(own)))
    both = both.withColumns({"_f": share("n"), "_e": share("s3")})
    total = both.groupBy("draw").agg(
        *[F.sum(c).alias(c) for c in (*sums, *[f"all_{c}" for c in sums])], (100 * F.avg("_f")).alias("freq_mae"), (100 * F.avg("_e")).alias("energy_mae"), (100 * F.max("_e")).alias("energy_max")
    )

    def level(p: str) -> dict[str, Column]:
        n, m = F.col(f"{p}n"), F.col(f"{p}s1") / F.col(f"{p}n")
        k = F.pow(F.sqrt(F.col(f"{p}s2") / n - m * m) / m, F.lit(MOMENTS_POWER))
        return {"ws": m, "energy": F.col(f"{p}s3") / n, "a": m / gamma_fn(1 + 1 / k), "k": k}

    part, full = level(""), level("all_")
    errors = [(100 * (part[c] / full[c] - 1)).alias(c) for c in part]
    return total.select("draw", F.col("n").cast("long").alias("rows"), *errors, "freq_mae", "energy_mae", "energy_max")


def exclusive_cost(log: DataFrame) -> DataFrame:
    """domain, steps, inclusive, exclusive, share, per_step: a domain's time holds its child's (the next domain). log: domain, elapsed."""
    incl = log.groupBy("domain").agg(F.count(F.lit(1)).cast("long").alias("steps"), F.sum("elapsed").alias("inclusive"))
    child = incl.select((F.col("domain") - 1).alias("domain"), F.col("inclusive").alias("_child"))
    top = incl.agg(F.min_by("inclusive", "domain").alias("_top"))
    out = incl.join(child, "domain", "left").crossJoin(top).withColumn("exclusive", F.col("inclusive") - F.coalesce("_child", F.lit(0.0)))
    return out.select("domain", "steps", "inclusive", "exclusive", (100 * F.col("exclusive") / F.col("_top")).alias("share"), (F.col("inclusive") / F.col("steps")).alias("per_step"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at place n div 2 of the sorted group: the upper one of two middles.

    Values are counted first, and what is ordered are distinct values in ranges, so a group of any size is many tasks.
    """
    n = df.groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    n = running(n, by, ["_x"], sums={"_r": F.col("_n")})
    n = _beside(n, n.groupBy(*by).agg(F.sum("_n").alias("_t")), by)
    place = F.floor(F.col("_t") / 2)
    return n.where((F.col("_r") - F.col("_n") <= place) & (place < F.col("_r"))).select(*by, F.col("_x").alias("median"))
