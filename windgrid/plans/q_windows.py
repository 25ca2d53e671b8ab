"""Order-based operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import metrics as M
from ..operators import timeline as T
from ..sources import modellog
from .q_aggs import GRAD, LOG, NEAR
from .q_expr import SECTOR12
from .registry import count, query, r

c = F.col


@query("win1_first_of_time", "SELECT time, pixel, round(ws, 6) AS ws FROM (SELECT *, row_number() OVER (PARTITION BY time ORDER BY pixel, ws, wd) AS q FROM forcing_v) WHERE q = 1")
def _(i):
    return T.first_of_time(i.forcing_v, "time", ["pixel", "ws", "wd"]).select("time", "pixel", r(c("ws")).alias("ws"))


@query("win2_contiguous_blocks", """WITH d AS (SELECT CAST(time AS DATE) AS day, count(*) AS n FROM forcing_v GROUP BY 1), w AS (SELECT day, lead(day, 2) OVER (ORDER BY day) AS last, sum(n) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS rows FROM d)
    SELECT day AS start, last AS "end", CAST(rows AS BIGINT) AS rows FROM w WHERE last - day = 2 AND rows >= 60""")
def _(i):
    return T.contiguous_blocks(i.forcing_v, 3, 20)


@query("win3_segments", """WITH g AS (SELECT pixel, time, event_id, CASE WHEN epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY pixel ORDER BY time, event_id)) > 43200000000 THEN 1 ELSE 0 END AS cut FROM obs_v),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY pixel ORDER BY time, event_id) AS segment FROM g) SELECT pixel, CAST(segment AS INT) AS segment, min(time) AS begin, max(time) AS "end", count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 5""")  # fmt: skip
def _(i):
    s = T.segments(i.obs_v, ["pixel"], "time", 43_200, ["event_id"])
    return s.groupBy("pixel", "segment").agg(F.min("time").alias("begin"), F.max("time").alias("end"), count().alias("n")).where("n > 5")


LAGS = ", ".join(map(str, range(1, 19)))
ACF = f"""dev AS (SELECT pixel, time, event_id, ws - avg(ws) OVER (PARTITION BY pixel) AS x FROM obs_v), lags AS (SELECT unnest([{LAGS}]) AS lag), num AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY time, event_id) AS q FROM dev),
    acf AS (SELECT CAST(lag AS INT) AS lag, sum(a.x * b.x) / sum(a.x * a.x) AS rho FROM lags, num a JOIN num b ON b.pixel = a.pixel AND b.q = a.q + lag GROUP BY 1)"""  # fmt: skip


def acf(i):
    return T.autocorrelation(i.obs_v, ["pixel"], ["time", "event_id"], "ws", list(range(1, 19)))


@query("win4_autocorrelation", f"WITH {ACF.replace('FROM lags, num a JOIN num b ON b.pixel = a.pixel AND b.q = a.q + lag', 'FROM lags JOIN num a ON true JOIN num b ON b.pixel = a.pixel AND b.q = a.q + lag')} SELECT lag, round(rho, 6) + 0.0 AS rho FROM acf")
def _(i):
    return acf(i).select("lag", r(c("rho")).alias("rho"))


@query("win5_integral_timescale", f"WITH {ACF.replace('FROM lags, num a JOIN num b ON b.pixel = a.pixel AND b.q = a.q + lag', 'FROM lags JOIN num a ON true JOIN num b ON b.pixel = a.pixel AND b.q = a.q + lag')} SELECT round(10 * (1 + 2 * sum(rho)), 5) AS timescale FROM acf")
def _(i):
    return T.integral_timescale(acf(i)).select(r(c("timescale"), 5).alias("timescale"))


@query("win6_cadence", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY time, event_id) - 1 AS q FROM obs_v), s AS (SELECT step, pixel, ws, {SECTOR12} AS sector FROM n, (VALUES (1), (3), (6), (18)) k(step) WHERE q % step = 0),
    m AS (SELECT step, pixel, avg(ws) AS mean, avg(ws * ws * ws) AS energy FROM s GROUP BY 1, 2) SELECT CAST(step AS INT) AS step, round(avg(100 * abs(m.mean / f.mean - 1)), 6) AS mean_error, round(avg(100 * abs(m.energy / f.energy - 1)), 6) AS energy_error FROM m JOIN (SELECT * FROM m WHERE step = 1) f USING (pixel) GROUP BY m.step""".replace("SELECT CAST(step AS INT)", "SELECT CAST(m.step AS INT)"))  # fmt: skip
def _(i):
    parts = [T.decimate(i.obs_v, k, ["time", "event_id"], ["pixel"]).withColumn("step", F.lit(k)) for k in (1, 3, 6, 18)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    m = M.point_statistics(every, ["step", "pixel"])
    f = m.where("step = 1").select("pixel", c("mean").alias("fm"), c("energy").alias("fe"))
    err = lambda a, b: r(F.avg(100 * F.abs(c(a) / c(b) - 1)))
    return m.join(f, "pixel").groupBy("step").agg(err("mean", "fm").alias("mean_error"), err("energy", "fe").alias("energy_error"))


@query("win7_profile_window", f"WITH {LOG}, d AS (SELECT time, row_number() OVER (ORDER BY time) AS q, count(*) OVER () AS n FROM log WHERE domain = 1) SELECT max(time) FILTER (q = 2) AS begin, max(time) AS \"end\" FROM d HAVING count(*) >= 3")
def _(i):
    return T.profile_window(modellog.parse(i.modellog_v))


@query("win8_gradients", f"WITH {GRAD} SELECT i, j, round(gi, 6) + 0.0 AS gi, round(gj, 6) + 0.0 AS gj FROM g")
def _(i):
    return G.gradient(i.raster_v, "hgt", 100.0).select("i", "j", r(c("gi")).alias("gi"), r(c("gj")).alias("gj"))


@query("win9_difference_pairs", "SELECT * FROM (SELECT i, j, lead(lu) OVER w - lu AS a, lead(lu, 2) OVER w - lead(lu) OVER w AS b FROM raster_v WINDOW w AS (PARTITION BY j ORDER BY i)) WHERE b IS NOT NULL")
def _(i):
    return G.difference_pairs(i.raster_v, "lu")


@query("win10_four_neighbours", f"WITH {NEAR} SELECT i, j, lu <> lw AND lu <> le AND lu <> ls AND lu <> ln AS isolated, lu <> lw OR lu <> le OR lu <> ls OR lu <> ln AS boundary, lu = lw AND lu = le AND lu = ls AND lu = ln AS plateau FROM nb")
def _(i):
    n = G.neighbours(i.raster_v, "lu")
    return n.select("i", "j", G.isolated("lu").alias("isolated"), G.boundary("lu").alias("boundary"), G.plateau("lu").alias("plateau"))


@query("win11_number_runs", "SELECT 'b' || lpad(CAST(row_number() OVER (ORDER BY sample_start DESC) AS VARCHAR), 3, '0') AS run, sample_start FROM manifest_v")
def _(i):
    from ..operators.campaign import number_runs

    return number_runs(i.manifest_v.select("sample_start"), [F.desc("sample_start")])
