"""Histograms, mixtures, metrics, Weibull fits, costs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import binning as B
from ..functions import physics as P
from ..functions import special as S
from ..operators import grid as G
from ..operators import histograms as H
from ..operators import metrics as M
from ..operators import weibull as WB
from ..operators.quantiles import literals
from ..sources import modellog, wrg
from .q_expr import SECTOR12, SECTOR16, SPEED6, STAB, cf
from .registry import count, query, r

c = F.col

BINNED = f"""binned AS (SELECT *, {SECTOR12} AS sect, {SPEED6} AS spd, {STAB} AS stab, CAST(month(time) - 1 AS INT) AS month0, CAST(hour(time) // 3 AS INT) AS slot,
    ws * ws * ws AS ws3, {cf("ws")} AS cf, CAST(date_trunc('month', time) AS DATE) AS block FROM forcing_v)"""
LONG = """long AS (SELECT block, 'dir_spd' AS grp, sect * 6 + spd AS bin, 1.0::DOUBLE AS v FROM binned UNION ALL SELECT block, 'dir_spd_e', sect * 6 + spd, ws3 FROM binned
    UNION ALL SELECT block, 'dir_stab', sect * 5 + stab, 1 FROM binned UNION ALL SELECT block, 'spd_stab', spd * 5 + stab, 1 FROM binned UNION ALL SELECT block, 'month', month0, 1 FROM binned
    UNION ALL SELECT block, 'slot', slot, 1 FROM binned UNION ALL SELECT block, 'scalar', 0, ws FROM binned UNION ALL SELECT block, 'scalar', 1, ws3 FROM binned UNION ALL SELECT block, 'scalar', 2, cf FROM binned)"""
NORM = """hist AS (SELECT block, grp, bin, sum(v) AS value FROM long GROUP BY ALL), rows_ AS (SELECT block, count(*) AS n FROM binned GROUP BY 1),
    norm AS (SELECT block, grp, bin, CASE WHEN grp = 'scalar' THEN value / n ELSE value / sum(value) OVER (PARTITION BY block, grp) END AS value FROM hist JOIN rows_ USING (block)),
    whole AS (SELECT grp, bin, sum(v) AS value FROM long GROUP BY ALL), ref AS (SELECT grp, bin, CASE WHEN grp = 'scalar' THEN value / (SELECT count(*) FROM binned) ELSE value / sum(value) OVER (PARTITION BY grp) END AS value FROM whole)"""
SPINE = "spine AS (SELECT grp, unnest(range(0, n))::INT AS bin FROM (VALUES ('dir_spd', 72), ('dir_spd_e', 72), ('dir_stab', 60), ('spd_stab', 30), ('month', 12), ('slot', 8), ('scalar', 3)) s(grp, n))"
ALL = f"WITH {BINNED}, {LONG}, {NORM}, {SPINE}"


def binned(i):
    return H.with_bins(i.forcing_v).withColumn("block", F.trunc("time", "month"))


def block_hists(i):
    b = binned(i)
    return H.normalised(H.histograms(b, ["block"]), b, ["block"])


def reference(i):
    b = binned(i)
    return H.normalised(H.histograms(b, []), b, [])


@query("agg1_dense_histogram", f"{ALL} SELECT block, grp, bin, round(coalesce(value, 0), 4) AS value FROM (SELECT DISTINCT block FROM binned) b, spine s LEFT JOIN (SELECT * FROM hist WHERE grp <> 'scalar' AND grp <> 'dir_spd_e') h USING (block, grp, bin) WHERE grp <> 'scalar' AND grp <> 'dir_spd_e'".replace("FROM (SELECT DISTINCT block FROM binned) b, spine s LEFT", "FROM (SELECT block, grp, bin FROM (SELECT DISTINCT block FROM binned) b, spine) s LEFT"))
def _(i):
    b = binned(i)
    full = H.dense(H.histograms(b, ["block"]), b.select("block").distinct())
    return full.where("grp NOT IN ('scalar', 'dir_spd_e')").select("block", "grp", "bin", r(c("value"), 4).alias("value"))


@query("agg2_energy_histogram", f"WITH {BINNED} SELECT sect, spd, count(*) AS n, round(sum(ws3), 3) AS energy FROM binned GROUP BY 1, 2")
def _(i):
    return binned(i).groupBy("sect", "spd").agg(count().alias("n"), r(F.sum("ws3"), 3).alias("energy"))


@query("agg3_normalised_groups", f"{ALL} SELECT block, grp, bin, round(value, 8) AS value FROM norm WHERE grp NOT IN ('scalar')")
def _(i):
    return block_hists(i).where("grp <> 'scalar'").select("block", "grp", "bin", r(c("value"), 8).alias("value"))


@query("agg4_scalars", f"{ALL} SELECT block, bin, round(n.value / ref.value, 8) AS value FROM norm n JOIN ref USING (grp, bin) WHERE grp = 'scalar'")
def _(i):
    ref = reference(i).select("grp", "bin", c("value").alias("ref"))
    return block_hists(i).where("grp = 'scalar'").join(ref, ["grp", "bin"]).select("block", "bin", r(c("value") / c("ref"), 8).alias("value"))


MIX = "w AS (SELECT block, (1 + month(block) % 3)::DOUBLE / sum(1 + month(block) % 3) OVER () AS weight FROM (SELECT DISTINCT block FROM binned WHERE year(block) IN (1996, 1997, 1998))), mix AS (SELECT grp, bin, sum(weight * value) AS value FROM norm JOIN w USING (block) GROUP BY ALL)"


def mixed(i):
    b = binned(i)
    keys = b.select("block").distinct().where(F.year("block").isin(1996, 1997, 1998)).withColumn("weight", (1 + F.month("block") % 3).cast("double"))
    total = keys.agg(F.sum("weight").alias("t"))
    return H.mixture(block_hists(i), keys.crossJoin(total).withColumn("weight", c("weight") / c("t")), "block")


@query("agg5_mixture", f"{ALL}, {MIX} SELECT grp, bin, round(value, 7) AS value FROM mix WHERE grp <> 'scalar'")
def _(i):
    return mixed(i).where("grp <> 'scalar'").select("grp", "bin", r(c("value"), 7).alias("value"))


@query("agg6_reference", f"{ALL} SELECT grp, bin, round(value, 7) AS value FROM ref")
def _(i):
    return reference(i).select("grp", "bin", r(c("value"), 7).alias("value"))


@query("agg7_total_variation", f"{ALL} SELECT block, grp, round(50 * sum(abs(coalesce(n.value, 0) - coalesce(ref.value, 0))), 5) AS tv FROM (SELECT block, grp, bin FROM (SELECT DISTINCT block FROM binned) b, spine) s LEFT JOIN norm n USING (block, grp, bin) LEFT JOIN ref USING (grp, bin) WHERE grp <> 'scalar' GROUP BY ALL")
def _(i):
    b = binned(i)
    every = b.select("block").distinct().crossJoin(F.broadcast(reference(i))).where("grp <> 'scalar'")  # 254 rows to a block
    return H.total_variation(block_hists(i).where("grp <> 'scalar'"), every, ["block", "grp"]).select("block", "grp", r(c("tv"), 5).alias("tv"))


def _report_sql() -> str:
    def tv(name: str, grp: str, key: str) -> str:
        return f"SELECT '{name}' AS metric, 50 * sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS value FROM (SELECT {key} AS k, sum(value) AS v FROM mix WHERE grp = '{grp}' GROUP BY 1) a FULL JOIN (SELECT {key} AS k, sum(value) AS v FROM ref WHERE grp = '{grp}' GROUP BY 1) b USING (k)"

    parts = [tv("roseF", "dir_spd", "bin // 6"), tv("roseE", "dir_spd_e", "bin // 6"), tv("joint", "dir_spd", "bin"), tv("jointE", "dir_spd_e", "bin"), tv("stab", "dir_stab", "bin % 5"), tv("dirstab", "dir_stab", "bin"), tv("month", "month", "bin"), tv("hour", "slot", "bin")]
    mids = "[1.5, 4.5, 7.5, 10.5, 13.5, 18.0]::DOUBLE[]"
    speed = lambda t: f"SELECT bin // 6 AS s, sum(value) AS share, sum(value * ({mids})[bin % 6 + 1]) / greatest(sum(value), 1e-12) AS m FROM {t} WHERE grp = 'dir_spd' GROUP BY 1"
    parts.append(f"SELECT 'secWS', 100 * avg(abs(coalesce(a.m, 0) / b.m - 1)) FROM ({speed('ref')}) b LEFT JOIN ({speed('mix')}) a USING (s) WHERE b.share > 0.01")
    parts.append("SELECT ['ws', 'en', 'cf'][bin + 1], 100 * (a.value / b.value - 1) FROM mix a JOIN ref b USING (grp, bin) WHERE grp = 'scalar'")
    return f"{ALL}, {MIX} SELECT metric, round(value, 5) + 0.0 AS value FROM ({' UNION ALL '.join(parts)})"


@query("agg8_twelve_metrics", _report_sql())
def _(i):
    return H.report(mixed(i), reference(i)).select("metric", r(c("value"), 5).alias("value"))


@query("agg9_effective_size", "SELECT round(power(sum(weight), 2) / sum(weight * weight), 6) AS ess FROM manifest_v")
def _(i):
    return H.effective_size(i.manifest_v).select(r(c("ess")).alias("ess"))


@query("agg10_class_shares", f"SELECT {STAB} AS ri_class, count(*) AS n, round(count(*) / 60000.0::DOUBLE, 6) AS share, round(avg(ws), 6) AS mean_ws, round(avg(wd), 4) AS mean_wd FROM forcing_v GROUP BY 1".replace("60000.0::DOUBLE", "(SELECT count(*) FROM forcing_v)"))
def _(i):
    s = M.shares(i.forcing_v, B.stability_class(c("ri_b")), "ri_class", ["ws", "wd"])
    return s.select("ri_class", "n", r(c("share")).alias("share"), r(c("mean_ws")).alias("mean_ws"), r(c("mean_wd"), 4).alias("mean_wd"))


@query("agg11_crosstab", f"SELECT 'hour' AS kind, CAST(hour(time) AS INT) AS \"row\", {STAB} AS col, round(count(*) / sum(count(*)) OVER (PARTITION BY hour(time)), 6) AS share FROM forcing_v GROUP BY hour(time), {STAB} UNION ALL SELECT 'season', CAST((month(time) % 12) // 3 AS INT), {STAB}, round(count(*) / sum(count(*)) OVER (PARTITION BY (month(time) % 12) // 3), 6) FROM forcing_v GROUP BY (month(time) % 12) // 3, {STAB}")
def _(i):
    kinds = [("hour", F.hour("time")), ("season", B.season(c("time")))]
    a, b = (M.crosstab(i.forcing_v, key, B.stability_class(c("ri_b"))).select(F.lit(name).alias("kind"), "row", "col", r(c("share")).alias("share")) for name, key in kinds)
    return a.unionByName(b)


@query("agg12_describe", "SELECT count(ws) AS n, round(avg(ws), 6) AS mean, round(stddev_samp(ws), 6) AS sd, min(ws) AS lowest, quantile_cont(ws, 0.25) AS q25, quantile_cont(ws, 0.5) AS q50, quantile_cont(ws, 0.75) AS q75, max(ws) AS highest FROM obs_v")
def _(i):
    q = literals(i.obs_v, c("ws"), {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return i.obs_v.agg(F.count("ws").alias("n"), r(F.avg("ws")).alias("mean"), r(F.stddev_samp("ws")).alias("sd"), F.min("ws").alias("lowest"), *q, F.max("ws").alias("highest"))


@query("agg13_point_statistics", f"SELECT pixel, round(avg(ws), 6) AS mean, round(avg(ws * ws * ws), 4) AS energy, round(avg({cf('ws')}), 6) AS aep FROM forcing_v GROUP BY 1")
def _(i):
    s = M.point_statistics(i.forcing_v, ["pixel"])
    return s.select("pixel", r(c("mean")).alias("mean"), r(c("energy"), 4).alias("energy"), r(c("aep")).alias("aep"))


ROSE = f"""r0 AS (SELECT pixel, {SECTOR12} AS sector, count(*) AS n, sum(ws * ws * ws) AS energy FROM obs_v GROUP BY 1, 2),
    r1 AS (SELECT pixel, sector, coalesce(n, 0) AS n, coalesce(energy, 0) AS energy FROM (SELECT pixel, unnest(range(0, 12))::INT AS sector FROM (SELECT DISTINCT pixel FROM obs_v)) s LEFT JOIN r0 USING (pixel, sector)),
    rose AS (SELECT *, n / sum(n) OVER (PARTITION BY pixel) AS share, CASE WHEN sum(energy) OVER (PARTITION BY pixel) = 0 THEN 0 ELSE energy / sum(energy) OVER (PARTITION BY pixel) END AS energy_share FROM r1)"""


@query("wind_rose", f"WITH {ROSE} SELECT pixel, sector, n, round(share, 6) AS share, round(energy_share, 6) AS energy_share FROM rose")
def wind_rose(i):
    s = M.rose(i.obs_v, ["pixel"], B.sector_left(c("wd")), B.SELECTION_SECTORS)
    return s.select("pixel", "sector", "n", r(c("share")).alias("share"), r(c("energy_share")).alias("energy_share"))


@query("agg14_point_rose", f"WITH {ROSE} SELECT pixel, sector, n, round(energy, 4) AS energy FROM rose")
def _(i):
    return M.rose(i.obs_v, ["pixel"], B.sector_left(c("wd")), B.SELECTION_SECTORS).select("pixel", "sector", "n", r(c("energy"), 4).alias("energy"))


def _fidelity_sql() -> str:
    sub = ROSE.replace("FROM obs_v GROUP BY 1, 2", "FROM obs_v WHERE event_id % 3 = 0 GROUP BY 1, 2").replace("SELECT DISTINCT pixel FROM obs_v", "SELECT DISTINCT pixel FROM obs_v WHERE event_id % 3 = 0")
    sub = sub.replace("r0", "s0").replace("r1", "s1").replace("rose AS", "sub AS")
    speed = lambda t: f"(CASE WHEN {t}.n > 0 THEN power({t}.energy / {t}.n, 1 / 3.0::DOUBLE) ELSE 0 END)"
    return f"""WITH {ROSE}, {sub}, x AS (SELECT f.pixel, abs(s.share - f.share) AS d, abs(s.energy_share - f.energy_share) AS e, CASE WHEN f.share > 0.01 THEN 100 * abs({speed("s")} / {speed("f")} - 1) END AS w FROM rose f JOIN sub s USING (pixel, sector)),
        p AS (SELECT pixel, sum(d) AS sd, sum(e) AS se FROM x GROUP BY 1)
        SELECT round(100 * avg(d), 6) AS sec_f, round(100 * max(d), 6) AS sec_f_max, round(100 * avg(e), 6) AS sec_e, round(100 * max(e), 6) AS sec_e_max, round((SELECT 50 * avg(sd) FROM p), 6) AS rose_tv, round((SELECT 50 * avg(se) FROM p), 6) AS rose_tv_e, round(avg(w), 6) AS sec_ws FROM x"""


@query("agg15_rose_fidelity", _fidelity_sql())
def _(i):
    full, sub = (M.rose(o, ["pixel"], B.sector_left(c("wd")), 12) for o in (i.obs_v, i.obs_v.where("event_id % 3 = 0")))
    out = M.rose_fidelity(sub, full, "pixel")
    return out.select(*[r(c(k)).alias(k) for k in out.columns])


@query("agg16_level_and_pattern", """WITH f AS (SELECT pixel, avg(ws) AS f FROM forcing_v GROUP BY 1), s AS (SELECT pixel, avg(ws) AS s FROM forcing_v WHERE year(time) = 1997 GROUP BY 1), b AS (SELECT * FROM f JOIN s USING (pixel)), m AS (SELECT avg(f) AS mf, avg(s) AS ms FROM b)
    SELECT round(avg(100 * (s / f - 1)), 6) + 0.0 AS mean_error, round(max(abs(100 * (s / f - 1))), 6) AS max_error, round(quantile_cont(abs(100 * (s / f - 1)), 0.95), 6) AS p95_error, round(corr(s / ms, f / mf), 6) AS r, round(100 * sqrt(avg((s / ms - f / mf) ** 2)), 6) AS pattern_rms FROM b, m""")  # fmt: skip
def _(i):
    full, sub = (M.point_statistics(f, ["pixel"]) for f in (i.forcing_v, i.forcing_v.where(F.year("time") == 1997)))
    out = M.level_and_pattern(sub, full, "pixel", "mean")
    return out.select(*[r(c(k)).alias(k) for k in out.columns])


def _fit_sql(source: str, by: str, extra: str = "") -> str:
    """Bisection in SQL: 70 halvings folded over each group's list of (log of scaled speed, weight)."""
    gap = "(list_sum(list_transform(p, lambda e: e.w * exp(m * e.l) * e.l)) / list_sum(list_transform(p, lambda e: e.w * exp(m * e.l))) - 1 / m - ml)"
    return f"""src AS (SELECT {by}, ws AS x, w FROM {source} WHERE ws > 0 AND w > 0), top AS (SELECT {by}, max(x) AS top, min(x) AS low, count(*) AS n FROM src GROUP BY ALL),
    g0 AS (SELECT {by}, any_value(top) AS top, list({{'l': ln(x / top), 'w': w}}) AS p, list({{'l': ln(x / top), 'w': 1.0::DOUBLE}}) AS u, sum(w * ln(x / top)) / sum(w) AS ml, avg(ln(x / top)) AS mu, 50.0::DOUBLE AS m FROM src JOIN top USING ({by}) WHERE n > 1 AND low < top * 0.99999 GROUP BY ALL),
    g AS (SELECT {by}, top, CASE WHEN {gap} < 0 THEN u ELSE p END AS p, CASE WHEN {gap} < 0 THEN mu ELSE ml END AS ml, CASE WHEN {gap} < 0 THEN 5000.0 ELSE 50.0 END::DOUBLE AS h FROM g0),
    RECURSIVE_ AS (SELECT 1), it AS (SELECT {by}, top, p, ml, 0.1::DOUBLE AS lo, h AS hi, 0 AS step FROM g UNION ALL SELECT {by}, top, p, ml, CASE WHEN {gap} < 0 THEN m ELSE lo END, CASE WHEN {gap} < 0 THEN hi ELSE m END, step + 1 FROM (SELECT *, (lo + hi) / 2 AS m FROM it WHERE step < 70)),
    fit AS (SELECT {by}, (lo + hi) / 2 AS k, top * power(list_sum(list_transform(p, lambda e: e.w * exp((lo + hi) / 2 * e.l))) / list_sum(list_transform(p, lambda e: e.w)), 2 / (lo + hi)) AS a FROM it WHERE step = 70){extra}""".replace("RECURSIVE_ AS (SELECT 1), ", "")  # fmt: skip


@query("agg17_weibull_fit", f"WITH RECURSIVE wobs AS (SELECT pixel, ws, (1 + pixel % 3)::DOUBLE * (1 + event_id % 4) AS w FROM obs_v), {_fit_sql('wobs', 'pixel')} SELECT pixel, round(k, 4) AS k, round(a, 4) AS a FROM fit")
def _(i):
    o = i.obs_v.withColumn("w", ((1 + c("pixel") % 3) * (1 + c("event_id") % 4)).cast("double"))
    return WB.fit(o, ["pixel"], "ws", "w").select("pixel", r(c("k"), 4).alias("k"), r(c("a"), 4).alias("a"))


@query("agg18_resource_grid", f"""WITH RECURSIVE wobs AS (SELECT pixel, {SECTOR16} AS sector, ws, (1 + event_id % 4)::DOUBLE AS w FROM obs_v), {_fit_sql('wobs', 'pixel, sector')},
    t AS (SELECT pixel, sum(w) AS total FROM wobs GROUP BY 1), q AS (SELECT pixel, sector, sum(w) AS sw FROM wobs GROUP BY 1, 2)
    SELECT pixel, sector, round(coalesce(1000 * sw / total, 0), 3) AS freq, round(10 * a, 3) AS a, round(100 * k, 2) AS k FROM (SELECT pixel, total, unnest(range(0, 16))::INT AS sector FROM t) LEFT JOIN q USING (pixel, sector) LEFT JOIN fit USING (pixel, sector)""")  # fmt: skip
def _(i):
    o = i.obs_v.withColumn("w", (1 + c("event_id") % 4).cast("double"))
    g = WB.resource_grid(o, ["pixel"], "w").select("pixel", F.posexplode("sectors").alias("sector", "s"))
    return g.select("pixel", "sector", r(c("s.freq"), 3).alias("freq"), r(c("s.a"), 3).alias("a"), r(c("s.k"), 2).alias("k"))


@query("agg19_power_density", f"SELECT pixel, round({0.5 * 1.225 * math.pi * 2500 * 0.33 / 1000!r}::DOUBLE * power(sum(ws * (1 + event_id % 4)) / sum(1 + event_id % 4), 3), 4) AS pd FROM obs_v GROUP BY 1")
def _(i):
    w = 1 + c("event_id") % 4
    return i.obs_v.groupBy("pixel").agg(r(P.power_density(F.sum(c("ws") * w) / F.sum(w), 50.0), 4).alias("pd"))


@query("agg20_weibull_moments", "SELECT pixel, round(k, 6) AS k, round(m / gamma(1 + 1 / k), 6) AS a FROM (SELECT pixel, avg(ws) AS m, power(stddev_pop(ws) / avg(ws), -1.086::DOUBLE) AS k FROM obs_v GROUP BY 1)")
def _(i):
    return WB.fit_moments(i.obs_v, ["pixel"]).select("pixel", r(c("k")).alias("k"), r(c("a")).alias("a"))


@query("agg21_bias_set", f"""WITH b AS (SELECT event_id % 4 = 0 AS s, ws, {SECTOR12} AS sector FROM obs_v), st AS (SELECT 'full' AS t, avg(ws) AS m, avg(ws ** 3) AS e, power(stddev_pop(ws) / avg(ws), -1.086::DOUBLE) AS k FROM b UNION ALL SELECT 'sub', avg(ws), avg(ws ** 3), power(stddev_pop(ws) / avg(ws), -1.086::DOUBLE) FROM b WHERE s),
    a AS (SELECT *, m / gamma(1 + 1 / k) AS a FROM st), f AS (SELECT * FROM a WHERE t = 'full'), u AS (SELECT * FROM a WHERE t = 'sub'), x AS (SELECT sector, count(*) / (SELECT count(*) FROM b) AS p, coalesce(sum(s::INT), 0) / (SELECT count(*) FROM b WHERE s) AS q FROM b GROUP BY 1)
    SELECT round(100 * (u.m / f.m - 1), 6) + 0.0 AS ws, round(100 * (u.e / f.e - 1), 6) + 0.0 AS energy, round(100 * (u.a / f.a - 1), 6) + 0.0 AS a, round(100 * (u.k / f.k - 1), 6) + 0.0 AS k, round((SELECT 100 * avg(abs(p - q)) FROM x), 6) AS sector_mae, round((SELECT 100 * max(abs(p - q)) FROM x), 6) AS sector_max FROM f, u""")  # fmt: skip
def _(i):
    o = i.obs_v.withColumn("all", F.lit(1))
    sub = o.where("event_id % 4 = 0")
    stats = lambda d: d.groupBy("all").agg(F.avg("ws").alias("m"), F.avg(P.cube(c("ws"))).alias("e")).join(WB.fit_moments(d, ["all"]), "all")
    f, u = stats(o).alias("f"), stats(sub).alias("u")
    err = lambda k: r(100 * (c(f"u.{k}") / c(f"f.{k}") - 1))
    level = u.join(f, "all").select(err("m").alias("ws"), err("e").alias("energy"), err("a").alias("a"), err("k").alias("k"))
    roses = [M.rose(d, ["all"], B.sector_left(c("wd")), 12).select("sector", c("share").alias(n)) for d, n in ((o, "p"), (sub, "q"))]
    gap = 100 * F.abs(c("p") - c("q"))
    return level.crossJoin(roses[0].join(roses[1], "sector").agg(r(F.avg(gap)).alias("sector_mae"), r(F.max(gap)).alias("sector_max")))


DRAWS = f"""WITH o AS (SELECT CAST(time AS DATE) AS day, ws, {SECTOR12} AS sector FROM forcing_v),
    placed AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT DISTINCT day FROM o)),
    geometry AS (SELECT * FROM (VALUES (3, 10), (5, 6)) g(length, blocks)),
    starts AS (SELECT length, blocks, draw, pos, row_number() OVER (PARTITION BY length, draw ORDER BY md5(draw || ':' || day)) AS k
               FROM placed, geometry, (SELECT unnest(range(0, 40)) AS draw) WHERE pos < (SELECT count(*) FROM placed) - length),
    drawn AS (SELECT DISTINCT length, draw, day FROM (SELECT length, draw, unnest(range(pos, pos + length)) AS pos FROM starts WHERE k <= blocks) JOIN placed USING (pos)),
    part AS (SELECT length, draw, sector, ws FROM drawn JOIN o USING (day)),
    f AS (SELECT avg(ws) AS m, avg(ws ** 3) AS e, power(stddev_pop(ws) / avg(ws), -1.086::DOUBLE) AS k FROM o),
    p AS (SELECT length, draw, count(*) AS n, avg(ws) AS m, avg(ws ** 3) AS e, power(stddev_pop(ws) / avg(ws), -1.086::DOUBLE) AS k FROM part GROUP BY 1, 2),
    fs AS (SELECT sector, count(*) / sum(count(*)) OVER () AS q, sum(ws ** 3) / sum(sum(ws ** 3)) OVER () AS qe FROM o GROUP BY 1),
    ps AS (SELECT length, draw, sector, count(*) AS c, sum(ws ** 3) AS e FROM part GROUP BY 1, 2, 3),
    gap AS (SELECT p.length, p.draw, avg(abs(coalesce(ps.c, 0) / p.n - q)) AS fm, avg(abs(coalesce(ps.e, 0) / (p.e * p.n) - qe)) AS em, max(abs(coalesce(ps.e, 0) / (p.e * p.n) - qe)) AS ex
            FROM p CROSS JOIN fs LEFT JOIN ps ON ps.length = p.length AND ps.draw = p.draw AND ps.sector = fs.sector GROUP BY 1, 2)
    SELECT CAST(length AS INT) AS length, count(*) AS draws, round(avg(n / 24.0::DOUBLE), 6) AS days, round(avg(abs(100 * (p.m / f.m - 1))), 6) AS ws, round(avg(abs(100 * (p.e / f.e - 1))), 6) AS energy,
        round(avg(abs(100 * (p.m / gamma(1 + 1 / p.k) / (f.m / gamma(1 + 1 / f.k)) - 1))), 6) AS a, round(avg(abs(100 * (p.k / f.k - 1))), 6) AS k,
        round(avg(100 * fm), 6) AS freq_mae, round(avg(100 * em), 6) AS energy_mae, round(avg(100 * ex), 6) AS energy_max
    FROM p JOIN gap USING (length, draw), f GROUP BY 1"""


@query("agg22_random_draws", DRAWS)
def _(i):
    """Mean errors over forty draws of ten 3-day blocks, and of six 5-day ones."""
    out = None
    for length, blocks in ((3, 10), (5, 6)):
        bias = M.draw_bias(i.forcing_v, M.random_draws(i.forcing_v, length, blocks), B.sector_left(c("wd")), 12)
        errors = [r(F.avg(F.abs(e))).alias(e) for e in ("ws", "energy", "a", "k", "freq_mae", "energy_mae", "energy_max")]
        part = bias.agg(count().alias("draws"), r(F.avg(c("rows") / 24)).alias("days"), *errors).select(F.lit(length).alias("length"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("agg23_wrg_mean_speed", """WITH p AS (SELECT regexp_split_to_array(trim(line), '\\s+') AS t FROM wrg_text_v), q AS (SELECT CASE WHEN t[1] = 'GridPoint' THEN t[2:] ELSE t END AS t FROM p), s AS (SELECT CAST(t[1] AS INT) AS x, CAST(t[2] AS INT) AS y, t[5]::DOUBLE AS a, t[6]::DOUBLE AS k, t FROM q WHERE len(t) >= 14)
    SELECT x, y, round(a * gamma(1 + 1 / k), 5) AS allsector, round(t[9]::DOUBLE / 1000 * (t[10]::DOUBLE / 10) * gamma(1 + 100 / t[11]::DOUBLE) + t[12]::DOUBLE / 1000 * (t[13]::DOUBLE / 10) * gamma(1 + 100 / t[14]::DOUBLE), 5) AS sector FROM s""")  # fmt: skip
def _(i):
    w = wrg.parse(i.wrg_text_v)
    return w.select(c("e").cast("int").alias("x"), c("n").cast("int").alias("y"), r(S.weibull_mean(c("a"), c("k")), 5).alias("allsector"), r(wrg.sector_mean(c("sectors")), 5).alias("sector"))


@query("agg24_coarse_cells", "WITH g AS (SELECT CAST(i // 8 AS INT) AS ci, CAST(j // 10 AS INT) AS cj, avg(hgt) AS m, stddev_pop(hgt) AS sd, count(*) AS n FROM raster_v GROUP BY 1, 2 HAVING count(*) >= 50) SELECT ci, cj, n, round(m, 6) AS mean, round(sd, 6) AS sd FROM g")
def _(i):
    ci, cj = G.coarse_cell(c("i") * 100.0, c("j") * 100.0, 800.0, 1000.0)
    g = i.raster_v.groupBy(ci.alias("ci"), cj.alias("cj")).agg(count().alias("n"), r(F.avg("hgt")).alias("mean"), r(F.stddev_pop("hgt")).alias("sd"))
    return g.where("n >= 50")


LOG = r"""parsed AS (SELECT try_strptime(regexp_extract(line, 'time (\d{4}-\d{2}-\d{2}_\d{2}:\d{2}:\d{2})', 1), '%Y-%m-%d_%H:%M:%S') AS time, CAST(regexp_extract(line, 'on domain\s+(\d+)', 1) AS INT) AS domain, CAST(regexp_extract(line, ':\s+([0-9.]+) elapsed', 1) AS DOUBLE) AS elapsed FROM modellog_v),
    log AS (SELECT * FROM parsed WHERE time IS NOT NULL)"""


@query("agg25_exclusive_cost", f"WITH {LOG}, n AS (SELECT domain, count(*) AS steps, sum(elapsed) AS inclusive FROM log GROUP BY 1) SELECT domain, steps, inclusive, inclusive - coalesce(lead(inclusive) OVER (ORDER BY domain), 0) AS exclusive, round(100 * (inclusive - coalesce(lead(inclusive) OVER (ORDER BY domain), 0)) / first_value(inclusive) OVER (ORDER BY domain), 6) AS share, round(inclusive / steps, 6) AS per_step FROM n")
def _(i):
    out = M.exclusive_cost(modellog.parse(i.modellog_v))
    return out.select("domain", "steps", "inclusive", "exclusive", r(c("share")).alias("share"), r(c("per_step")).alias("per_step"))


@query("agg26_scaling", f"""WITH {LOG}, x AS (SELECT 8 * domain AS ranks, elapsed / domain AS s FROM log), m AS (SELECT ranks, s AS median FROM (SELECT *, row_number() OVER (PARTITION BY ranks ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY ranks) AS n FROM x) WHERE r = n // 2)
    SELECT ranks, round(median, 6) AS median, round(first_value(median) OVER (ORDER BY ranks) / median, 6) AS speed_up, round(100 * first_value(median) OVER (ORDER BY ranks) / median / (ranks / first_value(ranks) OVER (ORDER BY ranks)), 4) AS efficiency FROM m""")  # fmt: skip
def _(i):
    log = modellog.parse(i.modellog_v).select((8 * c("domain")).alias("ranks"), (c("elapsed") / c("domain")).alias("s"))
    m = M.upper_median(log, ["ranks"], "s")
    base = m.agg(F.min_by("median", "ranks").alias("b"), F.min("ranks").alias("rb"))
    up = c("b") / c("median")
    return m.crossJoin(base).select("ranks", r(c("median")).alias("median"), r(up).alias("speed_up"), r(100 * up / (c("ranks") / c("rb")), 4).alias("efficiency"))


@query("agg27_land_use", "WITH z AS (SELECT k::INT AS lu, (k * 2.5::DOUBLE) AS z0 FROM range(1, 41) t(k)), s AS (SELECT lu, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM raster_v) AS share FROM raster_v GROUP BY 1) SELECT lu, round(share, 6) AS share, z0, round((SELECT sum(share * z0) / 100 FROM s JOIN z USING (lu)), 6) AS area_z0 FROM s LEFT JOIN z USING (lu) ORDER BY share DESC, lu LIMIT 8")
def _(i):
    z = i.spark.range(1, 41).select(c("id").cast("int").alias("lu"), (c("id") * 2.5).alias("z0"))
    n = i.raster_v.agg(F.count(F.lit(1)).alias("n"))
    s = i.raster_v.groupBy("lu").agg(count().alias("k")).crossJoin(n).select("lu", (c("k") * 100 / c("n")).alias("share")).join(F.broadcast(z), "lu", "left")
    area = s.agg(r(F.sum(c("share") * c("z0")) / 100).alias("area_z0"))
    return s.orderBy(F.desc("share"), "lu").limit(8).crossJoin(area).select("lu", r(c("share")).alias("share"), "z0", "area_z0")


GRAD = """g AS (SELECT i, j, hgt, CASE WHEN lag(hgt) OVER wi IS NULL THEN lead(hgt) OVER wi - hgt WHEN lead(hgt) OVER wi IS NULL THEN hgt - lag(hgt) OVER wi ELSE (lead(hgt) OVER wi - lag(hgt) OVER wi) / 2 END / 100 AS gi,
    CASE WHEN lag(hgt) OVER wj IS NULL THEN lead(hgt) OVER wj - hgt WHEN lead(hgt) OVER wj IS NULL THEN hgt - lag(hgt) OVER wj ELSE (lead(hgt) OVER wj - lag(hgt) OVER wj) / 2 END / 100 AS gj FROM raster_v WINDOW wi AS (PARTITION BY j ORDER BY i), wj AS (PARTITION BY i ORDER BY j))"""
NEAR = "nb AS (SELECT * FROM (SELECT i, j, hgt, lu, lag(hgt) OVER wi AS hw, lead(hgt) OVER wi AS he, lag(hgt) OVER wj AS hs, lead(hgt) OVER wj AS hn, lag(lu) OVER wi AS lw, lead(lu) OVER wi AS le, lag(lu) OVER wj AS ls, lead(lu) OVER wj AS ln FROM raster_v WINDOW wi AS (PARTITION BY j ORDER BY i), wj AS (PARTITION BY i ORDER BY j)) WHERE hw IS NOT NULL AND he IS NOT NULL AND hs IS NOT NULL AND hn IS NOT NULL)"


LU = lambda text: text.replace("hgt", "z").replace("FROM raster_v", "FROM lu_v")  # noqa: E731  the same over the land-use codes


@query("agg28_terrain_statistics", f"""WITH lu_v AS (SELECT i, j, lu, lu::DOUBLE AS z FROM raster_v), {LU(GRAD)}, {LU(NEAR)}, d AS (SELECT * FROM (SELECT lead(z) OVER w - z AS a, lead(z, 2) OVER w - lead(z) OVER w AS b FROM lu_v WINDOW w AS (PARTITION BY j ORDER BY i)) WHERE b IS NOT NULL)
    SELECT (SELECT round(quantile_cont(sqrt(gi * gi + gj * gj) * 1000, 0.5), 6) FROM g) AS slope_p50, (SELECT round(quantile_cont(sqrt(gi * gi + gj * gj) * 1000, 0.99), 6) FROM g) AS slope_p99, (SELECT round(max(sqrt(gi * gi + gj * gj) * 1000), 6) FROM g) AS slope_max, (SELECT round(corr(a, b), 6) FROM d) AS diff_lag1,
    (SELECT round(avg((abs(z - hw) < 1e-6 AND abs(z - he) < 1e-6 AND abs(z - hs) < 1e-6 AND abs(z - hn) < 1e-6)::INT), 6) FROM nb) AS plateau_share, round(stddev_pop(z), 6) AS sd, min(z) AS lowest, max(z) AS highest FROM lu_v""")  # fmt: skip
def _(i):
    t = G.terrain_statistics(i.raster_v.withColumn("z", c("lu").cast("double")), "z", 100.0)
    return t.select(*[r(c(k)).alias(k) for k in ("slope_p50", "slope_p99", "slope_max", "diff_lag1", "plateau_share", "sd")], "lowest", "highest")


@query("agg29_full_years", "SELECT * FROM (SELECT CAST(year(time) AS INT) AS year, count(*) AS n FROM forcing_v GROUP BY 1) WHERE n > 8700")
def _(i):
    return i.forcing_v.groupBy(F.year("time").alias("year")).agg(count().alias("n")).where("n > 8700")


@query("agg30_month_coverage", "SELECT m::INT AS month, count(run) AS n FROM range(1, 13) t(m) LEFT JOIN manifest_v ON month(sample_start) = m GROUP BY 1")
def _(i):
    months = i.spark.range(1, 13).select(c("id").cast("int").alias("month"))
    return months.join(i.manifest_v.select(F.month("sample_start").alias("month"), "run"), "month", "left").groupBy("month").agg(F.count("run").alias("n"))


@query("agg31_domain_mean", "SELECT time, round(avg(ws), 6) AS ws, round(avg(-ws * sin(radians(wd))), 6) + 0.0 AS u, round(avg(-ws * cos(radians(wd))), 6) + 0.0 AS v FROM forcing_v GROUP BY 1")
def _(i):
    u, v = P.components(c("ws"), c("wd"))
    return i.forcing_v.groupBy("time").agg(r(F.avg("ws")).alias("ws"), r(F.avg(u)).alias("u"), r(F.avg(v)).alias("v"))


@query("agg32_campaign_counters", "SELECT count(*) AS runs, CAST(count_if(day(sample_start) % 3 = 0) AS BIGINT) AS complete, CAST(count_if(day(sample_start) % 3 = 1) AS BIGINT) AS running, CAST(count_if(day(sample_start) % 3 = 2) AS BIGINT) AS pending FROM manifest_v")
def _(i):
    d = F.day("sample_start") % 3
    return i.manifest_v.agg(count().alias("runs"), *[F.count_if(d == k).cast("long").alias(n) for k, n in enumerate(("complete", "running", "pending"))])


W1 = lambda v: f"SELECT m, y, sum(d) / any_value(sd) AS d FROM (SELECT m, y, abs(cn / tn - cm / tm) * (lead(x) OVER (PARTITION BY m, y ORDER BY x) - x) AS d, sd FROM (SELECT *, sum(n) OVER (PARTITION BY m, y ORDER BY x) AS cn, sum(n) OVER (PARTITION BY m, y) AS tn, sum(k) OVER (PARTITION BY m, y ORDER BY x) AS cm, sum(k) OVER (PARTITION BY m, y) AS tm FROM (SELECT a.m, yy.y, a.x, a.n, coalesce(b.k, 0) AS k FROM (SELECT m, {v} AS x, count(*) AS n FROM f GROUP BY ALL) a JOIN (SELECT DISTINCT m, y FROM f) yy USING (m) LEFT JOIN (SELECT m, y, {v} AS x, count(*) AS k FROM f GROUP BY ALL) b ON b.m = a.m AND b.y = yy.y AND b.x = a.x)) JOIN (SELECT m, stddev_samp({v}) AS sd FROM f GROUP BY m) s USING (m)) GROUP BY m, y"
MONTHS = f"f AS (SELECT CAST(month(time) AS INT) AS m, CAST(year(time) AS INT) AS y, ws, wd, round(ri_b, 3) AS temp FROM forcing_v), ok AS (SELECT m, y FROM f GROUP BY ALL HAVING count(*) >= 600), dist AS (SELECT m, y, sum(d) AS d FROM ({W1('ws')} UNION ALL {W1('wd')} UNION ALL {W1('temp')}) JOIN ok USING (m, y) GROUP BY ALL)"


def month_distances(i):
    f = i.forcing_v.select(F.month("time").alias("m"), F.year("time").alias("y"), "ws", "wd", F.round("ri_b", 3).alias("temp"))
    enough = f.groupBy("m", "y").agg(F.count(F.lit(1)).alias("n")).where("n >= 600").select("m", "y")
    each = f.select("m", "y", F.inline(F.array(*[F.struct(F.lit(v).alias("of"), c(v).alias("x")) for v in ("ws", "wd", "temp")])))
    sd = each.groupBy("m", "of").agg(F.stddev_samp("x").alias("sd"))
    d = M.wasserstein(each, each, ["m", "of"], "y", "x").join(sd, ["m", "of"]).join(enough, ["m", "y"])
    return d.groupBy("m", "y").agg(F.sum(c("distance") / c("sd")).alias("d"))


@query("agg33_wasserstein", f"WITH {MONTHS} SELECT m, y, round(d, 6) AS d FROM dist")
def _(i):
    return month_distances(i).select("m", "y", r(c("d")).alias("d"))


@query("sel14_typical_months", f"WITH {MONTHS} SELECT m, y FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(d, 9), y) AS q FROM dist) WHERE q = 1")
def _(i):
    best = month_distances(i).groupBy("m").agg(F.min(F.struct(F.round("d", 9).alias("d"), "y")).alias("b"))
    return best.select("m", "b.y")


@query("agg34_field_difference", "SELECT round(avg(a.hgt - b.v), 6) + 0.0 AS bias, round(sqrt(avg((a.hgt - b.v) ** 2)), 6) AS rms, round(quantile_cont(abs(a.hgt - b.v), 0.99), 6) AS p99, round(max(abs(a.hgt - b.v)), 6) AS largest FROM raster_v a JOIN (SELECT i, j, 940 + lu::DOUBLE AS v FROM raster_v WHERE lu > 10) b USING (i, j)")
def _(i):
    other = i.raster_v.where("lu > 10").select("i", "j", (940 + c("lu").cast("double")).alias("hgt"))
    out = M.field_difference(i.raster_v, other, "hgt")
    return out.select(*[r(c(k)).alias(k) for k in out.columns])


@query("agg35_aep_error", f"WITH e AS (SELECT pixel, 100 * (avg({cf('ws')}) FILTER (year(time) = 1997) / avg({cf('ws')}) - 1) AS e, avg(wd) AS z FROM forcing_v GROUP BY 1) SELECT round(quantile_cont(e, 0.05), 6) AS p5, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.95), 6) AS p95, round(corr(abs(e), z), 6) AS r FROM e")
def _(i):
    p = P.power_curve(c("ws"))
    e = i.forcing_v.groupBy("pixel").agg((100 * (F.avg(F.when(F.year("time") == 1997, p)) / F.avg(p) - 1)).alias("e"), F.avg("wd").alias("z"))
    return e.agg(*[r(q).alias(n) for q, n in zip(literals(e, c("e"), {"p5": 0.05, "p50": 0.5, "p95": 0.95}), ("p5", "p50", "p95"), strict=True)], r(F.corr(F.abs("e"), c("z"))).alias("r"))


@query("agg36_domain_report", "SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(hgt) AS lowest, max(hgt) AS highest, round(avg(hgt), 6) AS mean, round(100 * avg((lu = 17)::INT), 6) AS water FROM raster_v")
def _(i):
    return i.raster_v.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"), F.min("hgt").alias("lowest"), F.max("hgt").alias("highest"), r(F.avg("hgt")).alias("mean"), r(100 * F.avg((c("lu") == 17).cast("int"))).alias("water"))
