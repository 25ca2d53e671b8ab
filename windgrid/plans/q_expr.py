"""Projections, filters and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import binning as B
from ..functions import campaign as C
from ..functions import physics as P
from ..functions import special as S
from .registry import count, query, r

c = F.col

SECTOR12 = "CAST(floor(((wd + 15) % 360) / 30) AS INT)"
SPEED6 = "(CASE WHEN ws >= 15 THEN 5 WHEN ws >= 12 THEN 4 WHEN ws >= 9 THEN 3 WHEN ws >= 6 THEN 2 WHEN ws >= 3 THEN 1 ELSE 0 END)"
STAB = "(CASE WHEN ri_b >= 0.1::DOUBLE THEN 4 WHEN ri_b >= 0.01::DOUBLE THEN 3 WHEN ri_b >= (-0.01)::DOUBLE THEN 2 WHEN ri_b >= (-0.1)::DOUBLE THEN 1 ELSE 0 END)"
SECTOR16 = "CASE WHEN wd >= 0 AND wd <= 360 THEN CAST(ceil((CASE WHEN wd > 348.75::DOUBLE THEN wd - 360 ELSE wd END + 11.25::DOUBLE) / 22.5::DOUBLE) - 1 AS INT) END"


def cf(u: str) -> str:
    """The power curve of a speed expression, in DuckDB."""
    knot = lambda k: f"(CASE WHEN {k} < 3 OR {k} > 25 THEN 0 ELSE least(1, ({k})::DOUBLE * ({k}) * ({k}) / 1728) END)"
    x = f"least(greatest({u}, 0), 30)"
    low = f"floor({x})"
    return f"({knot(low)} + ({knot(f'({low} + 1)')} - {knot(low)}) * ({x} - {low}))"


@query("prj1_finite_rows", "SELECT time, r6(ws) AS ws, r6(wd) AS wd FROM (SELECT time, CASE WHEN pixel = 3 THEN 'nan'::DOUBLE ELSE ws END AS ws, CASE WHEN pixel = 5 THEN NULL WHEN pixel = 7 THEN 'inf'::DOUBLE ELSE wd END AS wd FROM forcing_v) WHERE isfinite(ws) AND isfinite(wd)".replace("r6(ws)", "round(ws, 6)").replace("r6(wd)", "round(wd, 6)"))
def _(i):
    bad = i.forcing_v.select("time", F.when(c("pixel") == 3, float("nan")).otherwise(c("ws")).alias("ws"), F.when(c("pixel") == 5, None).when(c("pixel") == 7, float("inf")).otherwise(c("wd")).alias("wd"))
    return bad.where(P.finite(c("ws"), c("wd"))).select("time", r(c("ws")).alias("ws"), r(c("wd")).alias("wd"))


@query("prj2_wind_speed", "SELECT event_id, round(sqrt(ws * ws + wd * wd / 100), 6) AS speed FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", r(P.speed(c("ws"), c("wd") / 10)).alias("speed"))


@query("prj3_richardson", "SELECT event_id, round(ws - wd / 10, 6) + 0.0 AS dt, round(-98.1::DOUBLE * ((280 + ws) - (280 + wd / 10)) / ((280 + wd / 10) * power(greatest(ws, 0.5), 2)), 6) + 0.0 AS ri_b FROM obs_v")
def _(i):
    skin, air = 280 + c("ws"), 280 + c("wd") / 10
    return i.obs_v.select("event_id", r(c("ws") - c("wd") / 10).alias("dt"), r(P.richardson(skin, air, c("ws"))).alias("ri_b"))


@query("prj4_sector_left", f"SELECT event_id, {SECTOR12} AS sector FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", B.sector_left(c("wd")).alias("sector"))


@query("prj5_sector_right", f"SELECT event_id, {SECTOR16} AS sector FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", B.sector_right(c("wd")).alias("sector"))


@query("prj6_speed_bin", f"SELECT time, ws, {SPEED6} AS bin, (CASE WHEN ws >= 20 THEN 6 WHEN ws >= 15 THEN 5 WHEN ws >= 12 THEN 4 WHEN ws >= 9 THEN 3 WHEN ws >= 6 THEN 2 WHEN ws >= 3 THEN 1 ELSE 0 END) AS bin_v1 FROM forcing_v")
def _(i):
    return i.forcing_v.select("time", "ws", B.speed_bin(c("ws")).alias("bin"), B.speed_bin(c("ws"), B.SPEED_EDGES_V1).alias("bin_v1"))


@query("prj7_stability", f"SELECT {STAB} AS ri_class, count(*) AS n FROM forcing_v GROUP BY 1")
def _(i):
    return i.forcing_v.groupBy(B.stability_class(c("ri_b")).alias("ri_class")).agg(count().alias("n"))


@query("prj8_calendar_keys", "SELECT time, CAST(month(time) - 1 AS INT) AS month0, CAST(hour(time) // 3 AS INT) AS slot3, CAST((month(time) % 12) // 3 AS INT) AS season FROM forcing_v")
def _(i):
    return i.forcing_v.select("time", B.month0(c("time")).alias("month0"), B.slot3(c("time")).alias("slot3"), B.season(c("time")).alias("season"))


@query("prj9_hour6", "SELECT event_id, CAST(hour(time) // 6 AS INT) AS hour6 FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", B.hour6(c("time")).alias("hour6"))


@query("prj10_energy_proxy", "SELECT event_id, round(ws * ws * ws, 6) AS ws3 FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", r(P.cube(c("ws"))).alias("ws3"))


@query("prj11_capacity_factor", f"SELECT event_id, round({cf('ws')}, 9) AS cf FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", r(P.power_curve(c("ws")), 9).alias("cf"))


@query("prj12_uv_direction", "SELECT event_id, round(-ws * sin(radians(wd)), 6) + 0.0 AS u, round(-ws * cos(radians(wd)), 6) + 0.0 AS v, round((degrees(atan2(ws * sin(radians(wd)), ws * cos(radians(wd)))) + 360) % 360, 4) % 360 AS wd FROM obs_v")
def _(i):
    u, v = P.components(c("ws"), c("wd"))
    return i.obs_v.select("event_id", r(u).alias("u"), r(v).alias("v"), (F.round(P.direction(u, v), 4) % 360).alias("wd"))


@query("prj15_day_membership", "SELECT event_id FROM obs_v WHERE CAST(time AS DATE) IN (SELECT DISTINCT CAST(time AS DATE) FROM obs_v WHERE event_id % 997 = 0)")
def _(i):
    days = i.obs_v.where("event_id % 997 = 0").select(F.to_date("time").alias("day")).distinct()
    return i.obs_v.withColumn("day", F.to_date("time")).join(days, "day", "left_semi").select("event_id")


@query("prj16_year_split", "SELECT CASE WHEN year(time) < 1998 THEN 'early' ELSE 'late' END AS half, CAST(year(time) % 2 AS INT) AS odd, count(*) AS n FROM forcing_v GROUP BY 1, 2")
def _(i):
    half = F.when(F.year("time") < 1998, "early").otherwise("late")
    return i.forcing_v.groupBy(half.alias("half"), (F.year("time") % 2).alias("odd")).agg(count().alias("n"))


@query("prj17_decimate", "SELECT event_id, pixel FROM (SELECT event_id, pixel, row_number() OVER (PARTITION BY pixel ORDER BY time, event_id) - 1 AS n FROM obs_v) WHERE n % 6 = 0")
def _(i):
    from ..operators.timeline import decimate

    return decimate(i.obs_v, 6, ["time", "event_id"], ["pixel"]).select("event_id", "pixel")


@query("prj18_unstagger", "SELECT * FROM (SELECT i, j, round((hgt + lead(hgt) OVER (PARTITION BY j ORDER BY i)) / 2, 6) AS hgt FROM raster_v) WHERE hgt IS NOT NULL")
def _(i):
    from ..operators.grid import unstagger

    return unstagger(i.raster_v, "hgt").select("i", "j", r(c("hgt")).alias("hgt"))


@query("prj19_timestamp_text", "SELECT DISTINCT l_shipdate AS time FROM lineitem")
def _(i):
    text = i.lineitem.select(F.date_format("l_shipdate", "yyyy-MM-dd_HH:mm:ss").alias("t"))
    return text.select(F.to_timestamp_ntz(F.replace("t", F.lit("_"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time")).distinct()


@query("prj20_safe_ratio", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE round(ws / (event_id % 3), 6) END AS q FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", r(P.ratio(c("ws"), (c("event_id") % 3).cast("double"))).alias("q"))


@query("prj21_field_level_key", "SELECT event_id, event_type || ':' || CAST(CAST(round_even(wd, 0) AS INT) AS VARCHAR) AS field FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", F.concat_ws(":", "event_type", F.rint("wd").cast("int").cast("string")).alias("field"))


@query("fn1_gamma_weibull_mean", "SELECT p_partkey, round(gamma(1 + 1 / (1 + p_size / 10.0::DOUBLE)), 6) AS g, round(p_retailprice / 100 * gamma(1 + 1 / (1 + p_size / 10.0::DOUBLE)), 6) AS mean FROM part")
def _(i):
    k = 1 + c("p_size") / 10
    return i.part.select("p_partkey", r(S.gamma_fn(1 + 1 / k)).alias("g"), r(S.weibull_mean(c("p_retailprice") / 100, k)).alias("mean"))


def _utm_sql(zone: int) -> str:
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    e = 2 * math.sqrt(n) / (1 + n)
    d = lambda x: f"{x!r}::DOUBLE"
    east = " + ".join(["eta", *[f"{d(x)} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, x in enumerate(al, 1)]])
    north = " + ".join(["xi", *[f"{d(x)} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, x in enumerate(al, 1)]])
    return f"""WITH p AS (SELECT point_id, radians(34 + y / 50) AS la, radians(-106 + x / 40 - ({6 * zone - 183})) AS d FROM points_v),
        t AS (SELECT *, sinh(atanh(sin(la)) - {d(e)} * atanh({d(e)} * sin(la))) AS t FROM p),
        q AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)
        SELECT point_id, round(500000 + {d(big)} * ({east}), 3) AS easting, round({d(big)} * ({north}), 3) AS northing FROM q"""


@query("fn2_utm_forward", _utm_sql(13))
def _(i):
    e, n = S.utm_forward(34 + c("y") / 50, -106 + c("x") / 40, 13)
    return i.points_v.select("point_id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


def _lcc_sql(lat0: float, lon0: float, lat1: float, lat2: float) -> str:
    tan = lambda p: math.tan(math.pi / 4 + math.radians(p) / 2)
    n = math.log(math.cos(math.radians(lat1)) / math.cos(math.radians(lat2))) / math.log(tan(lat2) / tan(lat1))
    scale = 6370000.0 * math.cos(math.radians(lat1)) * tan(lat1) ** n / n
    return f"""WITH p AS (SELECT point_id, {scale!r}::DOUBLE / power(tan(pi() / 4 + radians(34 + y / 50) / 2), {n!r}::DOUBLE) AS rho, {n!r}::DOUBLE * radians(x / 40 - 0.5::DOUBLE) AS theta FROM points_v)
        SELECT point_id, round(rho * sin(theta), 3) + 0.0 AS x, round({scale / tan(lat0) ** n!r}::DOUBLE - rho * cos(theta), 3) + 0.0 AS y FROM p"""


@query("fn2_lcc_forward", _lcc_sql(34.5, -105.5, 35.5, 33.5))
def _(i):
    x, y = S.lcc_forward(34 + c("y") / 50, -106 + c("x") / 40, 34.5, -105.5, 35.5, 33.5)
    return i.points_v.select("point_id", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("fn3_power_curve_table", f"SELECT CAST(floor(ws * 2) AS BIGINT) AS half_steps, count(*) AS n, round({cf('(floor(ws * 2) / 2.0::DOUBLE)')}, 6) AS cf FROM (SELECT ws FROM forcing_v UNION ALL SELECT ws FROM obs_v) GROUP BY 1, 3")
def _(i):
    """The table of the curve at the half steps of speed that the records hold."""
    speeds = i.forcing_v.select("ws").unionByName(i.obs_v.select("ws")).groupBy(F.floor(c("ws") * 2).alias("half_steps")).agg(count().alias("n"))
    return speeds.select("half_steps", "n", r(P.power_curve(c("half_steps") / 2)).alias("cf"))


@query("fn4_sector_counts", f"SELECT {SECTOR12} AS sector12, {SECTOR16} AS sector16, count(*) AS n FROM forcing_v GROUP BY 1, 2")
def _(i):
    return i.forcing_v.groupBy(B.sector_left(c("wd")).alias("sector12"), B.sector_right(c("wd")).alias("sector16")).agg(count().alias("n"))


@query("fn5_stability_of_richardson", f"SELECT event_id, {STAB} AS ri_class FROM (SELECT event_id, -98.1::DOUBLE * (ws - wd / 100) / ((280 + wd / 100) * power(greatest(ws, 0.5), 2)) AS ri_b FROM obs_v)")
def _(i):
    return i.obs_v.select("event_id", B.stability_class(P.richardson(280 + c("ws"), 280 + c("wd") / 100, c("ws"))).alias("ri_class"))


@query("fn6_day_cost", """WITH m AS (SELECT strftime(day, '%Y') AS year, count(*) AS days FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) GROUP BY 1)
    SELECT year, CAST(l AS INT) AS length, days // l AS k, round((days // l) * (l + 0.25::DOUBLE), 6) AS cost, CASE WHEN floor(days / (l + 0.25::DOUBLE)) >= 4 THEN CAST(floor(days / (l + 0.25::DOUBLE)) AS BIGINT) END AS blocks FROM m, range(1, 6) b(l)""")
def _(i):
    """Of each year of the record: what it costs to run all its blocks of a length, and how many blocks its days pay for."""
    days = i.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct().groupBy(F.date_format("day", "yyyy").alias("year")).agg(count().alias("days"))
    grid = days.withColumn("length", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("k", F.floor(c("days") / c("length")))
    return grid.select("year", "length", "k", r(C.day_cost(c("k"), c("length"))).alias("cost"), C.blocks_for(c("days"), c("length")).alias("blocks"))


WINDOW = "sample_start::TIMESTAMP - INTERVAL 6 HOURS AS begin_, sample_start::TIMESTAMP + to_days(days) AS end_"


@query("fn7_block_window", f"SELECT run, begin_ AS begin, end_ AS \"end\", end_ - INTERVAL 10 MINUTES AS wrf_end FROM (SELECT run, {WINDOW} FROM manifest_v)")
def _(i):
    begin, end, last = C.block_window(c("sample_start").cast("timestamp_ntz"), c("days"))
    return i.manifest_v.select("run", begin.alias("begin"), end.alias("end"), last.alias("wrf_end"))


@query("fn8_forcing_files", f"""SELECT run, kind || ':' || strftime(t, '%Y-%m-%d_%H') AS file, t IN (SELECT DISTINCT time FROM forcing_v) AS present
    FROM (SELECT run, unnest(generate_series(begin_, end_, INTERVAL 3 HOURS)) AS t FROM (SELECT run, {WINDOW} FROM manifest_v)), (VALUES ('SURF'), ('PRES')) k(kind)""")  # fmt: skip
def _(i):
    begin, end, _ = C.block_window(c("sample_start").cast("timestamp_ntz"), c("days"))
    need = i.manifest_v.select("run", F.explode(C.forcing_times(begin, end)).alias("time"))
    have = i.forcing_v.select("time").distinct().withColumn("present", F.lit(True))
    both = need.join(have, "time", "left").withColumn("kind", F.explode(F.array(F.lit("SURF"), F.lit("PRES"))))
    return both.select("run", F.concat_ws(":", "kind", F.date_format("time", "yyyy-MM-dd_HH")).alias("file"), F.coalesce("present", F.lit(False)).alias("present"))


@query("fn9_cold_or_resume", "SELECT o_orderkey, total > 0 AND remaining > total // 6 AS cold FROM (SELECT o_orderkey, o_orderkey % 97 AS total, o_custkey % 23 AS remaining FROM orders)")
def _(i):
    return i.orders.select("o_orderkey", C.restarts_cold(c("o_custkey") % 23, c("o_orderkey") % 97).alias("cold"))


@query("fn10_completion", "SELECT event_id, date_trunc('minute', time) = date_trunc('minute', time + to_seconds(CAST(event_id % 90 AS INT))) AND ws * 100000 > 1000000 AS done FROM obs_v")
def _(i):
    later = c("time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c("event_id") % 90).cast("decimal(18,6)"))
    return i.obs_v.select("event_id", C.is_complete(later, c("time"), c("ws") * 100000).alias("done"))


@query("fn11_node_seconds", "SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN ws / 4 * 10 ELSE ws * (8 * (1 + event_id % 4)) / 104 END, 6) AS cost FROM obs_v")
def _(i):
    return i.obs_v.select("event_id", r(C.node_seconds(c("ws"), 8 * (1 + c("event_id") % 4), c("event_id") % 2 == 0)).alias("cost"))


