"""Joins, sets, sorts and key correspondence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import joins as J
from .registry import count, query, r

c = F.col


@query("join1_on_time", "SELECT f.time, f.pixel, round(f.ws, 6) AS ws, g.n FROM forcing_v f JOIN (SELECT time, count(*) AS n FROM forcing_v WHERE pixel < 32 GROUP BY time) g ON f.time = g.time")
def _(i):
    per = i.forcing_v.where("pixel < 32").groupBy("time").agg(count().alias("n"))
    return i.forcing_v.join(per, "time").select("time", "pixel", r(c("ws")).alias("ws"), "n")


@query("join2_rows_in_blocks", """WITH d AS (SELECT DISTINCT CAST(time AS DATE) AS day FROM forcing_v), n AS (SELECT CAST(time AS DATE) AS day, count(*) AS n FROM forcing_v GROUP BY 1),
    m AS (SELECT day - CAST(k AS INT) AS start, day, n FROM n, range(0, 3) t(k))
    SELECT start, count(*) AS days, CAST(sum(n) AS BIGINT) AS rows FROM m WHERE start IN (SELECT day FROM d) GROUP BY start""")  # fmt: skip
def _(i):
    days = i.forcing_v.groupBy(F.to_date("time").alias("day")).agg(count().alias("n"))
    member = J.block_members(days, "day", 3).join(days.select(c("day").alias("start")), "start", "left_semi")
    return member.groupBy("start").agg(count().alias("days"), F.sum("n").alias("rows"))


@query("join3_weight_per_step", """WITH s AS (SELECT DISTINCT time FROM forcing_v), j AS (SELECT s.time, m.run, m.weight, count(*) OVER (PARTITION BY m.run) AS n FROM s JOIN manifest_v m ON CAST(s.time AS DATE) = m.sample_start)
    SELECT time, run, round(weight / n, 8) AS weight FROM j""")
def _(i):
    steps = i.forcing_v.select("time").distinct()
    return J.weights_by_day(steps, i.manifest_v).select("time", "run", r(c("weight"), 8).alias("weight"))


@query("join4_files_per_run", "SELECT m.run, count(f.time) AS files, count(f.time) = 8 AS complete FROM manifest_v m LEFT JOIN (SELECT DISTINCT time FROM forcing_v) f ON CAST(f.time AS DATE) = m.sample_start GROUP BY m.run")
def _(i):
    steps = i.forcing_v.select("time", F.to_date("time").alias("day")).distinct()
    return J.files_per_run(i.manifest_v, steps, 8)


@query("join5_selected_days", "SELECT event_id FROM obs_v WHERE CAST(time AS DATE) IN (SELECT DISTINCT CAST(l_shipdate AS DATE) + 9131 - 730 FROM lineitem WHERE l_orderkey % 5 = 0) OR CAST(time AS DATE) < DATE '2024-01-05'")
def _(i):
    days = i.lineitem.where("l_orderkey % 5 = 0").select(F.date_add(F.to_date("l_shipdate"), 9131 - 730).alias("day")).distinct()
    early = i.obs_v.select(F.to_date("time").alias("day")).where("day < DATE'2024-01-05'").distinct()
    return i.obs_v.withColumn("day", F.to_date("time")).join(days.union(early).distinct(), "day", "left_semi").select("event_id")


@query("join6_nearest_node", """WITH n AS (SELECT i, j, i::DOUBLE AS x, j::DOUBLE AS y FROM raster_v WHERE (i + j) % 17 <> 0),
    d AS (SELECT point_id, i, j, (n.x - p.x) ** 2 + (n.y - p.y) ** 2 AS d2 FROM points_v p, n),
    k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, i, j) AS q FROM d) SELECT point_id, i, j, round(sqrt(d2), 6) AS dist FROM k WHERE q = 1""")
def _(i):
    nodes = i.raster_v.where("(i + j) % 17 <> 0").select("i", "j", c("i").cast("double").alias("x"), c("j").cast("double").alias("y"))
    return J.nearest_node(i.points_v, nodes, "point_id", ["i", "j"], cell=1.0, max_dist=60.0).select("point_id", "i", "j", r(c("dist")).alias("dist"))


@query("join7_nearest_axis", "SELECT point_id, CAST(least(greatest(ceil(x - 0.5), 0), 39) AS INT) AS i, CAST(least(greatest(ceil(y / 2 - 0.5), 0), 24) AS INT) AS j FROM points_v")
def _(i):
    return i.points_v.select("point_id", J.nearest_index(c("x"), 0.0, 1.0, 40).alias("i"), J.nearest_index(c("y"), 0.0, 2.0, 25).alias("j"))


@query("join8_nearest_2d", """WITH d AS (SELECT point_id, i, j, (i - x) ** 2 + (j - y) ** 2 AS d2, row_number() OVER (PARTITION BY point_id ORDER BY (i - x) ** 2 + (j - y) ** 2, i, j) AS q FROM points_v, raster_v),
    e AS (SELECT max(i) AS mi, max(j) AS mj FROM raster_v) SELECT point_id, i, j, least(i, j, mi - i, mj - j) AS edge, x BETWEEN 0 AND mi AND y BETWEEN 0 AND mj AS inside FROM d JOIN points_v USING (point_id), e WHERE q = 1""")
def _(i):
    nodes = i.raster_v.select("i", "j", c("i").cast("double").alias("x"), c("j").cast("double").alias("y"))
    near = J.nearest_node(i.points_v, nodes, "point_id", ["i", "j"], cell=1.0)
    size = i.raster_v.agg(F.max("i").alias("mi"), F.max("j").alias("mj"))
    both = near.join(i.points_v, "point_id").join(F.broadcast(size))
    return both.select("point_id", "i", "j", F.least("i", "j", c("mi") - c("i"), c("mj") - c("j")).alias("edge"), (c("x").between(0, c("mi")) & c("y").between(0, c("mj"))).alias("inside"))


@query("join9_fine_to_coarse", "SELECT CAST(i // 8 AS INT) AS ci, CAST(j // 10 AS INT) AS cj, count(*) AS n FROM raster_v GROUP BY 1, 2")
def _(i):
    ci, cj = G.coarse_cell(c("i") * 100.0, c("j") * 100.0, 800.0, 1000.0)
    return i.raster_v.groupBy(ci.alias("ci"), cj.alias("cj")).agg(count().alias("n"))


@query("join10_common_times", "SELECT max(time) AS last FROM (SELECT time FROM forcing_v WHERE pixel < 8 INTERSECT SELECT time FROM forcing_v WHERE pixel >= 8 AND pixel < 16 INTERSECT SELECT time FROM forcing_v WHERE pixel >= 16)")
def _(i):
    f = i.forcing_v
    return J.common_times([f.where("pixel < 8"), f.where("pixel >= 8 AND pixel < 16"), f.where("pixel >= 16")]).agg(F.max("time").alias("last"))


@query("join11_bilinear", """WITH p AS (SELECT *, CAST(floor(x) AS INT) AS fi, CAST(floor(y) AS INT) AS fj FROM points_v),
    q AS (SELECT point_id, (1 - (x - fi)) * (1 - (y - fj)) * a.hgt + (x - fi) * (1 - (y - fj)) * b.hgt + (1 - (x - fi)) * (y - fj) * c.hgt + (x - fi) * (y - fj) * d.hgt AS v FROM p
      JOIN raster_v a ON a.i = fi AND a.j = fj JOIN raster_v b ON b.i = fi + 1 AND b.j = fj JOIN raster_v c ON c.i = fi AND c.j = fj + 1 JOIN raster_v d ON d.i = fi + 1 AND d.j = fj + 1)
    SELECT point_id, round(v, 6) AS v FROM points_v LEFT JOIN q USING (point_id)""")
def _(i):
    return G.bilinear(i.points_v, i.raster_v, "point_id", "hgt").select("point_id", r(c("value")).alias("v"))


@query("join12_not_done", "SELECT run FROM manifest_v WHERE run NOT IN (SELECT run FROM manifest_v WHERE day(sample_start) % 3 = 0) AND run NOT IN (SELECT run FROM manifest_v WHERE month(sample_start) = 1)")
def _(i):
    m = i.manifest_v
    return J.pending(m.select("run"), m.where(F.day("sample_start") % 3 == 0).select("run"), m.where(F.month("sample_start") == 1).select("run"))


@query("join13_merge_manifest", "SELECT run, sample_start, days, weight, NULL::DATE AS synthetic_start FROM manifest_v WHERE run <= 'b020' UNION ALL SELECT run, sample_start, days, weight, sample_start + 1 AS synthetic_start FROM manifest_v WHERE run > 'b020' AND run <= 'b030'")
def _(i):
    new = i.manifest_v.where("run <= 'b020'")
    old = i.manifest_v.where("run > 'b010'").withColumn("synthetic_start", F.date_add("sample_start", 1))
    skipped = i.manifest_v.where("run > 'b020' AND run <= 'b030'").select("run")
    return J.merge_manifest(new, old, skipped)


@query("join14_restart_for_all", "SELECT max(time) AS restart FROM (SELECT l_shipdate AS time FROM lineitem GROUP BY 1 HAVING count(DISTINCT 1 + l_linenumber % 5) = 5)")
def _(i):
    have = i.lineitem.select(c("l_shipdate").alias("time"), (1 + c("l_linenumber") % 5).alias("domain"))
    return J.present_for_all(have, "time", "domain", 5).agg(F.max("time").alias("restart"))


@query("join15_tile_probes", """WITH s AS (SELECT DISTINCT CAST(floor(x / 10) AS INT) AS cx, CAST(floor(y / 10) AS INT) AS cy FROM points_v WHERE point_id % 5 = 0),
    t AS (SELECT CAST(a AS INT) AS tx, CAST(b AS INT) AS ty FROM range(0, 8) a(a), range(0, 10) b(b)), p AS (SELECT tx, ty, CAST(floor((tx * 5 + u * 2.5::DOUBLE) / 10) AS INT) AS cx, CAST(floor((ty * 5 + v * 2.5::DOUBLE) / 10) AS INT) AS cy FROM t, range(0, 3) u(u), range(0, 3) v(v))
    SELECT DISTINCT tx, ty FROM p JOIN s USING (cx, cy)""")
def _(i):
    cells = i.points_v.where("point_id % 5 = 0").select(F.floor(c("x") / 10).cast("int").alias("cx"), F.floor(c("y") / 10).cast("int").alias("cy")).distinct()
    tiles = G.tiles(i.spark, 8, 10)
    return G.tiles_touching(tiles, cells, 5.0, 10.0)


@query("set1_union_rows", "SELECT DISTINCT event_id FROM obs_v WHERE pixel IN (1, 2) OR hour(time) = 3")
def _(i):
    o = i.obs_v
    return o.where("pixel IN (1, 2)").select("event_id").union(o.where("hour(time) = 3").select("event_id")).distinct()


@query("set2_intersection", "SELECT pixel FROM obs_v WHERE event_type = 'click' INTERSECT SELECT pixel FROM obs_v WHERE event_type = 'error'")
def _(i):
    o = i.obs_v
    return o.where("event_type = 'click'").select("pixel").intersect(o.where("event_type = 'error'").select("pixel"))


@query("set3_overlap", "SELECT a.run AS a, b.run AS b, abs(a.sample_start - b.sample_start) < 70 AS overlaps FROM manifest_v a JOIN manifest_v b ON a.run < b.run AND b.sample_start - a.sample_start <= 200")
def _(i):
    a, b = i.manifest_v.select(c("run").alias("a"), c("sample_start").alias("sa")), i.manifest_v.select(c("run").alias("b"), c("sample_start").alias("sb"))
    near = J.within_days(a, b, "sa", "sb", 200).where("a < b")
    return near.select("a", "b", (F.abs(F.datediff("sa", "sb")) < 70).alias("overlaps"))


@query("set4_distinct_days", "SELECT DISTINCT CAST(time AS DATE) AS day FROM forcing_v")
def _(i):
    return i.forcing_v.select(F.to_date("time").alias("day")).distinct()


@query("set5_year_month_picks", "SELECT time, pixel FROM forcing_v WHERE (year(time) = 1996 AND month(time) = 2) OR (year(time) = 1999 AND month(time) = 7)")
def _(i):
    picks = i.spark.createDataFrame([(1996, 2), (1999, 7)], "y int, m int")
    f = i.forcing_v.withColumns({"y": F.year("time"), "m": F.month("time")})
    return f.join(F.broadcast(picks), ["y", "m"], "left_semi").select("time", "pixel")


@query("set6_complement", "SELECT i, j FROM raster_v EXCEPT ALL SELECT i, j FROM raster_v WHERE (i * 7 + j * 3) % 2 = 0")
def _(i):
    g = i.raster_v.select("i", "j")
    return g.exceptAll(g.where("(i * 7 + j * 3) % 2 = 0"))


@query("srt1_sorted_runs", "SELECT run, sample_start, CAST(row_number() OVER (ORDER BY sample_start, run) AS INT) AS position FROM manifest_v")
def _(i):
    return i.manifest_v.orderBy("sample_start", "run").select("run", "sample_start", F.row_number().over(Window.orderBy("sample_start", "run")).alias("position"))


@query("srt2_screen_top", "SELECT event_id, round(ws, 6) AS score FROM obs_v WHERE pixel NOT IN (SELECT pixel FROM obs_v WHERE event_id < 20) ORDER BY ws DESC, event_id LIMIT 250")
def _(i):
    used = i.obs_v.where("event_id < 20").select("pixel").distinct()
    return i.obs_v.join(used, "pixel", "left_anti").orderBy(F.desc("ws"), "event_id").limit(250).select("event_id", r(c("ws")).alias("score"))


@query("srt3_top_categories", "SELECT lu, count(*) AS n FROM raster_v GROUP BY lu ORDER BY n DESC, lu LIMIT 8")
def _(i):
    return i.raster_v.groupBy("lu").agg(count().alias("n")).orderBy(F.desc("n"), "lu").limit(8)


@query("srt4_argmin_payload", "SELECT pixel, event_id, round(ws, 6) AS ws FROM (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY ws, event_id) AS q FROM obs_v) WHERE q = 1")
def _(i):
    best = i.obs_v.groupBy("pixel").agg(F.min(F.struct("ws", "event_id")).alias("b"))
    return best.select("pixel", "b.event_id", r(c("b.ws")).alias("ws"))


@query("srt5_best_candidate", "SELECT run, round(abs(weight - 0.025::DOUBLE), 8) AS error FROM manifest_v ORDER BY abs(weight - 0.025::DOUBLE), run LIMIT 1")
def _(i):
    error = F.abs(c("weight") - 0.025)
    return i.manifest_v.orderBy(error, "run").limit(1).select("run", r(error, 8).alias("error"))
