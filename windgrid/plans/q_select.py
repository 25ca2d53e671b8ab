"""Selection of representative blocks. Searches are iterative; where SQL can walk the same steps it does, the others are checked by invariants (tests) and rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import points as PT
from ..operators import selection as S
from .q_aggs import BINNED
from .registry import query, r

c = F.col

FEATURES = f"""WITH {BINNED.replace("CAST(date_trunc('month', time) AS DATE) AS block", "CAST(time AS DATE) AS day")}, d AS (SELECT day, count(*) AS n FROM binned GROUP BY 1 HAVING count(*) >= 6),
    rows_ AS (SELECT b.* FROM binned b JOIN d USING (day)), long AS (SELECT day AS start, 'dir_spd' AS grp, sect * 6 + spd AS bin, 1.0::DOUBLE AS v FROM rows_ UNION ALL SELECT day, 'dir_spd_e', sect * 6 + spd, ws3 FROM rows_ UNION ALL SELECT day, 'dir_stab', sect * 5 + stab, 1 FROM rows_
    UNION ALL SELECT day, 'spd_stab', spd * 5 + stab, 1 FROM rows_ UNION ALL SELECT day, 'month', month0, 1 FROM rows_ UNION ALL SELECT day, 'slot', slot, 1 FROM rows_ UNION ALL SELECT day, 'scalar', 0, ws FROM rows_ UNION ALL SELECT day, 'scalar', 1, ws3 FROM rows_ UNION ALL SELECT day, 'scalar', 2, cf FROM rows_),
    h AS (SELECT start, grp, bin, sum(v) AS v FROM long GROUP BY ALL), f AS (SELECT [avg(ws), avg(ws3), avg(cf)] AS m FROM binned), w AS (SELECT * FROM (VALUES ('dir_spd', 3.0::DOUBLE), ('dir_spd_e', 3.0), ('dir_stab', 1.0), ('spd_stab', 0.5), ('month', 0.5), ('slot', 0.5), ('scalar', 2.0)) w(grp, w))
    SELECT start, grp, bin, round(sqrt(w) * CASE WHEN grp = 'scalar' THEN v / d.n / (SELECT m[bin + 1] FROM f) ELSE v / sum(v) OVER (PARTITION BY start, grp) END, 6) AS value FROM h JOIN d ON d.day = h.start JOIN w USING (grp)"""  # fmt: skip


@query("sel1_features", FEATURES)
def _(i):
    return S.scaled(S.features(i.forcing_v, 1)).select("start", "grp", "bin", r(c("value")).alias("value"))


_LONG_OF = "unnest([{'grp': 'dir_spd', 'bin': sect * 6 + spd, 'v': 1.0::DOUBLE}, {'grp': 'dir_spd_e', 'bin': sect * 6 + spd, 'v': ws3}, {'grp': 'dir_stab', 'bin': sect * 5 + stab, 'v': 1.0}, {'grp': 'spd_stab', 'bin': spd * 5 + stab, 'v': 1.0}, {'grp': 'month', 'bin': month0, 'v': 1.0}, {'grp': 'slot', 'bin': slot, 'v': 1.0}, {'grp': 'scalar', 'bin': 0, 'v': ws}, {'grp': 'scalar', 'bin': 1, 'v': ws3}, {'grp': 'scalar', 'bin': 2, 'v': cf}], recursive := true)"
_HEAD, _, _LAST = FEATURES.rpartition("\n    SELECT start, grp, bin, ")
_SCALED = f"""{_HEAD}, fx AS (SELECT start, grp, bin, {_LAST.replace("round(", "(", 1).replace(", 6) AS value", ") AS value")}), tl AS (SELECT {_LONG_OF} FROM binned),
    tn AS (SELECT grp, bin, sum(v) AS v FROM tl GROUP BY 1, 2), tt AS (SELECT grp, bin, sqrt(w) * CASE WHEN grp = 'scalar' THEN 1 ELSE v / sum(v) OVER (PARTITION BY grp) END AS t FROM tn JOIN w USING (grp))"""
_FIRST = f"""{_SCALED},
    s AS (SELECT start, sum(value * value) AS g, sum(value * t) AS r FROM fx JOIN tt USING (grp, bin) GROUP BY 1), q AS (SELECT sum(t * t) AS tt FROM tt)
    SELECT start, round(w, 6) AS weight, round(sqrt(greatest(0, w * w * g - 2 * w * r + tt)), 6) AS distance FROM (SELECT *, least(0.15::DOUBLE, greatest(0, (r + 2500) / (g + 2500))) AS w FROM s), q"""


def _walk(k: int, length: int, base: str, score: str, cost: str) -> str:
    """Forward steps, then exchanges, as a recursion over one row: the chosen starts, the sum of their vectors, the place whose turn it is (0: growing).

    Needs cand (start, v: the block's vector, and what cost uses of it) and goal (one row). m blocks with the sum b stay; base are columns made of them, score
    orders the candidates that are costed (the highest 250; a constant: all in order of their start), cost is that of a candidate beside them.
    """
    sums = lambda sign, x, y: f"list_transform(list_zip({x}, {y}), lambda p: p[1] {sign} p[2])"
    few = "QUALIFY row_number() OVER (ORDER BY score DESC, start) <= 250" if score else ""
    return f"""walk AS (SELECT CAST([] AS DATE[]) AS chosen, (SELECT list_transform(any_value(v), lambda x: 0.0::DOUBLE) FROM cand) AS acc, {k} AS k, 0 AS place, false AS better, NOT EXISTS (SELECT 1 FROM cand) AS done
        UNION ALL (WITH o AS (SELECT walk.*, g.start AS gone, len(chosen) - CASE WHEN place > 0 THEN 1 ELSE 0 END AS m, CASE WHEN place > 0 THEN {sums("-", "acc", "g.v")} ELSE acc END AS b
                FROM walk LEFT JOIN cand g ON place > 0 AND g.start = chosen[place] WHERE NOT done),
            w AS (SELECT o.*, {base} FROM o, goal),
            x AS (SELECT cand.start, cand.v, {score or "0"} AS score, {cost} AS c FROM w JOIN cand ON len(list_filter(chosen, lambda x: x IS DISTINCT FROM gone AND abs(cand.start - x) < {length})) = 0, goal),
            y AS (SELECT * FROM x {few}), best AS (SELECT start, v, c FROM y ORDER BY round(c, 12), start LIMIT 1), now AS (SELECT x.c AS now FROM x JOIN o ON x.start = o.gone),
            z AS (SELECT o.*, start, v, place > 0 AND coalesce(c < now - 1e-12, false) AS swaps, place = 0 AND start IS NOT NULL AS grows FROM o LEFT JOIN best ON true LEFT JOIN now ON true)
            SELECT CASE WHEN grows THEN list_append(chosen, start) WHEN swaps THEN list_transform(chosen, lambda x: CASE WHEN x = gone THEN start ELSE x END) ELSE chosen END,
                CASE WHEN grows OR swaps THEN {sums("+", "b", "v")} ELSE acc END, CASE WHEN place = 0 AND NOT grows THEN len(chosen) ELSE k END,
                CASE WHEN place = 0 THEN CASE WHEN grows AND len(chosen) + 1 < k THEN 0 ELSE 1 END WHEN place < k THEN place + 1 ELSE 1 END,
                place > 0 AND place < k AND (better OR swaps), place > 0 AND place >= k AND NOT (better OR swaps) FROM z))"""


_EQUAL = f"""{_SCALED.replace("WITH ", "WITH RECURSIVE ", 1)}, tp AS (SELECT grp, bin, t, row_number() OVER (ORDER BY grp, bin) AS p FROM tt), goal AS MATERIALIZED (SELECT list(t ORDER BY p) AS t, sum(t * t) AS tt FROM tp),
    cand AS MATERIALIZED (SELECT e.*, list_inner_product(v, v) AS vv, list_inner_product(v, goal.t) AS vt FROM (SELECT s.start, list(coalesce(value, 0) ORDER BY p) AS v FROM (SELECT DISTINCT start FROM fx) s CROSS JOIN tp LEFT JOIN fx ON fx.start = s.start AND fx.grp = tp.grp AND fx.bin = tp.bin GROUP BY 1) e, goal),
    {_walk(8, 1, "list_inner_product(b, b) AS bb, list_inner_product(b, goal.t) AS bt", "vt - CASE WHEN m > 0 THEN list_inner_product(b, cand.v) / m ELSE 0 END", "sqrt(greatest(0, (bb + 2 * list_inner_product(b, cand.v) + vv) / (m + 1) ** 2 - 2 * (bt + vt) / (m + 1) + tt))")}
    SELECT unnest(chosen) AS start, CAST(1 AS INT) AS days, round(1 / len(chosen)::DOUBLE, 5) AS weight FROM walk WHERE done"""


def _additive_sql(k: int, least: int, record: str = "") -> str:
    """The choice of k two-day blocks by four histograms and three levels, from first step to last exchange. record: what stands for forcing_v."""
    rows = BINNED.replace("FROM forcing_v", f"FROM {record or 'forcing_v'}")
    share = lambda part, n: f"list_sum(list_transform(list_zip(b[{part}], cand.v[{part}], goal.t[{part}]), lambda p: abs((p[1] + p[2]) / {n} - p[3])))"
    n, e, level = "(b[161] + cand.v[161])", "(b[162] + cand.v[162])", lambda at, weight: f"{weight} * abs((b[{at}] + cand.v[{at}]) / (b[161] + cand.v[161]) / goal.t[{at}] - 1)"
    return f"""{rows}, day_n AS (SELECT CAST(time AS DATE) AS day, count(*) AS n FROM binned GROUP BY 1), valid AS (SELECT a.day AS start FROM day_n a JOIN day_n b ON b.day = a.day + 1 WHERE a.n + b.n >= {2 * least}),
    ls AS (SELECT CAST(time AS DATE) AS day, unnest([{{'p': 1 + sect * 6 + spd, 'v': 1.0::DOUBLE}}, {{'p': 73 + month0, 'v': 0.3}}, {{'p': 85 + CAST(hour(time) // 6 AS INT), 'v': 0.3}}, {{'p': 89 + sect * 6 + spd, 'v': ws3}},
        {{'p': 161, 'v': 1.0}}, {{'p': 162, 'v': ws3}}, {{'p': 163, 'v': ws}}, {{'p': 164, 'v': cf}}], recursive := true) FROM binned),
    spine AS (SELECT unnest(range(1, 165)) AS p), whole AS (SELECT p, coalesce(sum(v), 0) AS v FROM spine LEFT JOIN ls USING (p) GROUP BY 1), wn AS (SELECT max(v) FILTER (WHERE p = 161) AS n, max(v) FILTER (WHERE p = 162) AS e FROM whole),
    goal AS MATERIALIZED (SELECT list(v / CASE WHEN p BETWEEN 89 AND 160 THEN e ELSE n END ORDER BY p) AS t FROM whole, wn), sums AS (SELECT start, p, sum(v) AS v FROM valid JOIN ls ON day = start OR day = start + 1 GROUP BY 1, 2),
    cand AS MATERIALIZED (SELECT valid.start, list(coalesce(v, 0) ORDER BY p) AS v FROM valid CROSS JOIN spine LEFT JOIN sums USING (start, p) GROUP BY 1),
    {_walk(k, 2, "0 AS nothing", "", f"{share('1:88', n)} + {share('89:160', e)} + {level(163, 3)} + {level(162, 3)} + {level(164, 4)}")}
    SELECT unnest(chosen) AS start, CAST(2 AS INT) AS days, round(1 / len(chosen)::DOUBLE, 5) AS weight FROM walk WHERE done"""



def _table(i, blocks, rows):
    """start, days, weight."""
    out = [(dt.date.fromordinal(int(blocks.start[j])), blocks.length, round(float(w), 5)) for j, w in rows]
    return i.spark.createDataFrame(sorted(out), "start date, days int, weight double")


def _even(chosen):
    return [(j, 1 / len(chosen)) for j in chosen]


@query("sel2_bounded_ls")
def _(i):
    """Weights of forty evenly spaced blocks."""
    blocks, a, t = S.design_matrix(i.forcing_v, 1)
    index = list(range(0, len(blocks.start), max(1, len(blocks.start) // 40)))[:40]
    w, _ = S.Fitter(a, t, 6 / len(index))(index)
    return _table(i, blocks, zip(index, w, strict=True))


EVEN = f"""WITH d AS (SELECT CAST(time AS DATE) AS start FROM forcing_v GROUP BY 1 HAVING count(*) >= 6), n AS (SELECT start, row_number() OVER (ORDER BY start) - 1 AS k, count(*) OVER () AS all_ FROM d)
    SELECT start, true AS bounded, true AS least FROM n WHERE k % greatest(1, all_ // 40) = 0 AND k // greatest(1, all_ // 40) < 40"""


@query("sel2_conditions", EVEN)
def _(i):
    """Whether each weight of sel2 lies within its bounds and meets its condition of the minimum: no pull inside, none outward at a bound."""
    blocks, a, t = S.design_matrix(i.forcing_v, 1)
    index = list(range(0, len(blocks.start), max(1, len(blocks.start) // 40)))[:40]
    high = 6 / len(index)
    w, _ = S.Fitter(a, t, high)(index)
    pull = a[:, index].T @ (t - a[:, index] @ w) + S.SUM_WEIGHT**2 * (1 - w.sum())
    least = [(x <= 0 and p <= 1e-6) or (x >= high and p >= -1e-6) or abs(p) <= 1e-6 for x, p in zip(w, pull, strict=True)]
    rows = [(dt.date.fromordinal(int(blocks.start[j])), bool(0 <= x <= high), bool(ok)) for j, x, ok in zip(index, w, least, strict=True)]
    return i.spark.createDataFrame(rows, "start date, bounded boolean, least boolean")


@query("sel3_greedy_swap")
def _(i):
    blocks, a, t = S.design_matrix(i.forcing_v, 2)
    chosen, w, _ = S.select_weighted(blocks, a, t, 6)
    return _table(i, blocks, zip(chosen, w, strict=True))


@query("sel4_equal_weights", _EQUAL)
def _(i):
    blocks, a, t = S.design_matrix(i.forcing_v, 1)
    chosen, w, _ = S.select_weighted(blocks, a, t, 8, weighted=False)
    return _table(i, blocks, zip(chosen, w, strict=True))


@query("sel5_anneal")
def _(i):
    blocks, a, t = S.design_matrix(i.forcing_v, 2)
    greedy, _, _ = S.select_weighted(blocks, a, t, 6)
    best, d = S.anneal(blocks, a, t, greedy, 3 / 6, seed=0)
    w, _ = S.Fitter(a, t, 3 / 6)(best)
    return _table(i, blocks, zip(best, w / w.sum(), strict=True)).withColumn("distance", F.lit(round(d, 6)))


def _greedy_sql(steps: int) -> str:
    """The greedy choice by the four-histogram distance, a step at a time."""
    text = f"""WITH {BINNED}, day_n AS MATERIALIZED (SELECT CAST(time AS DATE) AS day, count(*) AS n FROM binned GROUP BY 1),
        valid AS MATERIALIZED (SELECT a.day AS start FROM day_n a JOIN day_n b ON b.day = a.day + 1 WHERE a.n + b.n >= 40),
        ls AS MATERIALIZED (SELECT CAST(time AS DATE) AS day, unnest([{{'g': 'freq', 'b': sect * 6 + spd, 'v': 1.0::DOUBLE}}, {{'g': 'energy', 'b': sect * 6 + spd, 'v': ws3}}, {{'g': 'month', 'b': month0, 'v': 1.0}}, {{'g': 'hour', 'b': CAST(hour(time) // 6 AS INT), 'v': 1.0}}], recursive := true) FROM binned),
        s AS MATERIALIZED (SELECT start, g, b, sum(v) AS v FROM valid JOIN ls ON ls.day = start OR ls.day = start + 1 GROUP BY ALL), sn AS MATERIALIZED (SELECT start, g, sum(v) AS n FROM s GROUP BY ALL),
        t AS MATERIALIZED (SELECT g, b, v / sum(v) OVER (PARTITION BY g) AS share FROM (SELECT g, b, sum(v) AS v FROM ls GROUP BY 1, 2)),
        w AS (SELECT * FROM (VALUES ('freq', 1.0::DOUBLE), ('energy', 1.0), ('month', 0.3), ('hour', 0.3)) w(g, w)), p0 AS MATERIALIZED (SELECT start FROM valid WHERE false)"""
    for k in range(1, steps + 1):
        text += f""", b{k} AS MATERIALIZED (SELECT t.g, t.b, t.share, coalesce(sum(x.v), 0) AS v FROM t LEFT JOIN (SELECT g, b, v FROM s SEMI JOIN p{k - 1} USING (start)) x ON x.g = t.g AND x.b = t.b GROUP BY ALL),
        n{k} AS MATERIALIZED (SELECT g, sum(v) AS n FROM b{k} GROUP BY 1), c{k} AS MATERIALIZED (SELECT start FROM valid WHERE NOT EXISTS (SELECT 1 FROM p{k - 1} p WHERE abs(valid.start - p.start) < 2)),
        d{k} AS MATERIALIZED (SELECT sn.start, sum(w.w * abs((b.v + coalesce(s.v, 0)) / (n.n + sn.n) - b.share)) AS d FROM c{k} SEMI JOIN valid USING (start) JOIN sn USING (start) JOIN b{k} b ON b.g = sn.g JOIN n{k} n ON n.g = sn.g JOIN w ON w.g = sn.g
            LEFT JOIN s ON s.start = sn.start AND s.g = b.g AND s.b = b.b GROUP BY 1),
        p{k} AS MATERIALIZED (SELECT start FROM p{k - 1} UNION ALL (SELECT start FROM d{k} ORDER BY round(d, 12), start LIMIT 1))"""
    return f"{text} SELECT start, CAST(2 AS INT) AS days, round(1 / {steps}::DOUBLE, 5) AS weight FROM p{steps}"


@query("sel6_greedy_v1", _greedy_sql(7))
def _(i):
    blocks, target = S.additive_statistics(i.forcing_v, 2, 20)
    target = {g: target[g] for g in ("freq", "energy", "month", "hour")}
    chosen, _ = S.select_additive(blocks, target, 7, S.distance_v1, refine=False)
    return _table(i, blocks, _even(chosen))


@query("sel15_candidate_distances", _FIRST)
def _(i):
    """What the first step of the final selection sees: every day's best weight by itself, and its distance to the whole record."""
    blocks, a, t = S.design_matrix(i.forcing_v, 1)
    fit, every = S.Fitter(a, t, 6 / 40), np.arange(len(blocks.start))
    more = S.SUM_WEIGHT**2
    weight = np.clip((fit.rhs + more) / (np.diag(fit.gram) + more), 0, fit.high)
    rows = [(dt.date.fromordinal(int(d)), round(float(w), 6), round(float(v), 6)) for d, w, v in zip(blocks.start, weight, fit.with_each([], every), strict=True)]
    return i.spark.createDataFrame(rows, "start date, weight double, distance double")


@query("sel7_candidate_costs", f"""WITH {BINNED}, day_n AS (SELECT CAST(time AS DATE) AS day, count(*) AS n FROM binned GROUP BY 1), valid AS (SELECT a.day AS start FROM day_n a JOIN day_n b ON b.day = a.day + 1 WHERE a.n + b.n >= 40),
    ls AS (SELECT CAST(time AS DATE) AS day, unnest([{{'g': 'freq', 'b': sect * 6 + spd, 'v': 1.0::DOUBLE}}, {{'g': 'energy', 'b': sect * 6 + spd, 'v': ws3}}, {{'g': 'month', 'b': month0, 'v': 1.0}}, {{'g': 'hour', 'b': CAST(hour(time) // 6 AS INT), 'v': 1.0}}], recursive := true) FROM binned),
    s AS (SELECT start, g, b, sum(v) AS v FROM valid JOIN ls ON ls.day = start OR ls.day = start + 1 GROUP BY ALL), sn AS (SELECT start, g, sum(v) AS n FROM s GROUP BY ALL),
    t AS (SELECT g, b, v / sum(v) OVER (PARTITION BY g) AS share FROM (SELECT g, b, sum(v) AS v FROM ls GROUP BY 1, 2)), w AS (SELECT * FROM (VALUES ('freq', 1.0::DOUBLE), ('energy', 1.0), ('month', 0.3), ('hour', 0.3)) w(g, w)),
    d AS (SELECT sn.start, sum(w.w * abs(coalesce(s.v, 0) / sn.n - t.share)) AS d FROM sn JOIN t USING (g) JOIN w USING (g) LEFT JOIN s ON s.start = sn.start AND s.g = t.g AND s.b = t.b GROUP BY 1),
    m AS (SELECT start, avg(ws) AS ws, avg(ws3) AS ws3, avg(cf) AS cf FROM valid JOIN binned ON CAST(time AS DATE) = start OR CAST(time AS DATE) = start + 1 GROUP BY 1), f AS (SELECT avg(ws) AS fws, avg(ws3) AS fws3, avg(cf) AS fcf FROM binned)
    SELECT start, round(d + 3 * abs(ws / fws - 1) + 3 * abs(ws3 / fws3 - 1) + 4 * abs(cf / fcf - 1), 6) AS cost FROM d JOIN m USING (start), f""")  # fmt: skip
def _(i):
    """The same of the selection with level terms: the cost of every block by itself."""
    blocks, target = S.additive_statistics(i.forcing_v, 2, 20)
    cost = S.distance_v2({g: blocks.stats[g] for g in target}, target) if len(blocks.start) else []
    return i.spark.createDataFrame([(dt.date.fromordinal(int(d)), round(float(v), 6)) for d, v in zip(blocks.start, cost, strict=True)], "start date, cost double")


@query("sel7_greedy_v2", f"WITH RECURSIVE {_additive_sql(7, 20)}")
def _(i):
    blocks, target = S.additive_statistics(i.forcing_v, 2, 20)
    chosen, _ = S.select_additive(blocks, target, 7, S.distance_v2)
    return _table(i, blocks, _even(chosen))


def _points(i):
    return PT.point_sums(i.forcing_v, 2, 20)


@query("sel8_supervised")
def _(i):
    table = _points(i)
    chosen, _ = PT.select(table, 7, restarts=6)
    return _table(i, table.blocks, _even(chosen))


# Every block alone against the whole record, at every point; a point without rows in a block has the mean 0.
ALONE = f"""WITH {BINNED}, days AS (SELECT CAST(time AS DATE) AS day, pixel, sect, count(*) AS n, sum(ws) AS s, sum(cf) AS c, sum(ws3) AS e FROM binned GROUP BY ALL),
    day_n AS (SELECT day, sum(n) AS n FROM days GROUP BY 1), valid AS (SELECT a.day AS start FROM day_n a JOIN day_n b ON b.day = a.day + 1 WHERE a.n + b.n >= 40),
    own AS (SELECT start, pixel, sect, sum(n) AS n, sum(s) AS s, sum(c) AS c, sum(e) AS e FROM valid JOIN days ON days.day = start OR days.day = start + 1 GROUP BY ALL),
    whole AS (SELECT pixel, sum(s) / sum(n) AS f, sum(c) / sum(n) AS g FROM days GROUP BY 1),
    m AS (SELECT v.start, w.pixel, f, g, coalesce(sum(s) / sum(n), 0) AS m, coalesce(sum(c) / sum(n), 0) AS a FROM valid v CROSS JOIN whole w LEFT JOIN own o ON o.start = v.start AND o.pixel = w.pixel GROUP BY ALL),
    z AS (SELECT *, avg(m) OVER b AS mm, avg(a) OVER b AS aa, avg(f) OVER b AS ff, avg(g) OVER b AS gg FROM m WINDOW b AS (PARTITION BY start)),
    level AS (SELECT start, any_value(abs(mm / ff - 1) + abs(aa / gg - 1)) AS level, sqrt(avg(power((m / mm) / (f / ff) - 1, 2))) AS pattern, sqrt(avg(power((a / aa) / (g / gg) - 1, 2))) AS pattern_cf FROM z GROUP BY 1),
    r AS (SELECT pixel, sect, sum(n) / sum(sum(n)) OVER w AS p, sum(e) / sum(sum(e)) OVER w AS q FROM days GROUP BY pixel, sect WINDOW w AS (PARTITION BY pixel)),
    x AS (SELECT start, pixel, sect, n / sum(n) OVER w AS p, e / sum(e) OVER w AS q FROM own WINDOW w AS (PARTITION BY start, pixel)),
    rose AS (SELECT v.start, 0.5 * sum(abs(coalesce(x.p, 0) - r.p)) / (SELECT count(*) FROM whole) AS rose, 0.5 * sum(abs(coalesce(x.q, 0) - r.q)) / (SELECT count(*) FROM whole) AS rose_energy
        FROM valid v CROSS JOIN r LEFT JOIN x ON x.start = v.start AND x.pixel = r.pixel AND x.sect = r.sect GROUP BY 1)"""


@query("sel8_candidate_costs", f"{ALONE} SELECT start, round(level + 2 * pattern + 2 * pattern_cf, 6) AS cost FROM level")
def _(i):
    """What the first step of the supervised search sees: the cost of every block by itself."""
    return _costs(i, _points(i), 0.0)


@query("sel9_candidate_costs", f"{ALONE} SELECT start, round(level + 2 * pattern + rose + rose_energy, 6) AS cost FROM level JOIN rose USING (start)")
def _(i):
    return _costs(i, _points(i), 1.0)


def _costs(i, table: PT.PointSums, direction: float):
    every = np.arange(len(table.blocks.start))
    cost = table.cost(table.evaluate([([], every)])[0], direction) if len(every) else every
    rows = [(dt.date.fromordinal(int(d)), round(float(v), 6)) for d, v in zip(table.blocks.start, cost, strict=True)]
    return i.spark.createDataFrame(rows, "start date, cost double")


@query("sel9_directional")
def _(i):
    table = _points(i)
    chosen, _ = PT.select(table, 7, 1.0)
    return _table(i, table.blocks, _even(chosen))


@query("sel10_hold_out")
def _(i):
    found = PT.hold_out(i.forcing_v, 2, 20, 7)
    rows = [(half, *[round(e[c], 6) for c in ("speed", "cf", "speed_pattern", "cf_pattern")]) for half, e in found.items()]
    return i.spark.createDataFrame(rows, "half string, mean_error double, aep_error double, pattern_rms double, aep_pattern_rms double")


_SERIES = f"""WITH RECURSIVE series AS (SELECT time, ws, ri_b, (degrees(atan2(-u, -v)) + 720) % 360 AS wd FROM (SELECT time, avg(ws) AS ws, avg(ri_b) AS ri_b, avg(-ws * sin(radians(wd))) AS u, avg(-ws * cos(radians(wd))) AS v FROM forcing_v GROUP BY 1)),
    {_additive_sql(5, 4, "series")}"""


@query("sel11_domain_series", _SERIES)
def _(i):
    """The v2 selector on the mean over all points."""
    u = F.avg(-c("ws") * F.sin(F.radians("wd")))
    v = F.avg(-c("ws") * F.cos(F.radians("wd")))
    series = i.forcing_v.groupBy("time").agg(F.avg("ws").alias("ws"), F.avg("ri_b").alias("ri_b"), u.alias("u"), v.alias("v"))
    series = series.withColumn("wd", P.direction(c("u"), c("v")))
    blocks, target = S.additive_statistics(series, 2, 4)
    chosen, _ = S.select_additive(blocks, target, 5, S.distance_v2)
    return _table(i, blocks, _even(chosen))


@query("sel12_random_baseline")
def _(i):
    blocks, a, t = S.design_matrix(i.forcing_v, 1)
    fit = S.Fitter(a, t, 0.2)
    rows = [(seed, round(fit(S.random_blocks(blocks, 15, seed))[1], 6)) for seed in range(5)]
    return i.spark.createDataFrame(rows, "seed int, distance double")


GEOMETRIES = ((1, 40), (2, 20), (3, 14), (5, 8), (1, 60), (2, 30), (3, 20))
REWEIGHTED = (("baseline", {}), ("dir_stab 3", {"dir_stab": 3.0}), ("dir_stab 3, dir_spd 5", {"dir_spd": 5.0, "dir_stab": 3.0}))
SPINUPS, BUDGET, LAST_TRAINING_YEAR = (0.25, 0.5), 50.0, 1998
#: sweep, label, days of a block, blocks, bound (over the number of blocks), weights of groups, fitted weights.
SWEEPS = [("bound", str(b), 1, 40, b, {}, True) for b in (1.5, 3.0, 6.0, 20.0)]
SWEEPS += [("groups", label, 1, 40, 3.0, groups, True) for label, groups in REWEIGHTED]
SWEEPS += [("geometry", "fitted" if fitted else "equal", length, k, 3.0, {}, fitted) for length, k in GEOMETRIES for fitted in (False, True)]
SWEEPS += [("cost", f"{spinup * 24:.0f} h", length, k, 6.0, {}, True) for spinup in SPINUPS for length in (1, 2, 3, 5) if (k := int(BUDGET // (length + spinup))) >= 4]


@query("sel13_sweeps")
def _(i):
    """Chosen on the earlier years: by the bound of the weights, by the weights of the groups, by geometry with equal and with fitted
    weights, and by geometry at a fixed budget of day equivalents; each with its distance to the later years. A task a search."""
    days = S.by_day(i.forcing_v)
    early, late = (days.where(cond) for cond in (F.year("day") <= LAST_TRAINING_YEAR, F.year("day") > LAST_TRAINING_YEAR))
    made = {length: S.design_matrix(early, length) for length in sorted({s[2] for s in SWEEPS})}
    jobs = [{"length": length, "k": k, "high": bound / k, "groups": groups, "weighted": fitted} for _, _, length, k, bound, groups, fitted in SWEEPS]
    found = S.search_all(i.spark, made, S.target(late), jobs)
    names = i.spark.createDataFrame([(n, *s[:5]) for n, s in enumerate(SWEEPS)], "job int, sweep string, label string, days int, blocks int, bound double")
    return names.join(found, "job").drop("job")


@query("sel15_final_selection")
def _(i):
    """Forty single days, a weight of at most 6/40."""
    blocks, a, t = S.design_matrix(i.forcing_v, 1)
    chosen, w, _ = S.select_weighted(blocks, a, t, 40, 6 / 40)
    return _table(i, blocks, zip(chosen, w, strict=True))
