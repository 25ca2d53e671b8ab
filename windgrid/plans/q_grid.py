"""Rasters and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import nests
from ..operators import spectra as SP
from .q_aggs import GRAD
from .registry import query, r

c = F.col


@query("grd1_points_to_grid", """WITH p AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points_v), a AS (SELECT point_id, CAST(round_even((x - x0) / 2, 0) AS INT) AS i, CAST(round_even((y - y0) / 2, 0) AS INT) AS j FROM points_v, p),
    s AS (SELECT unnest(range(0, CAST(round_even((x1 - x0) / 2, 0) AS INT) + 1))::INT AS i, y0, y1 FROM p), t AS (SELECT i, unnest(range(0, CAST(round_even((y1 - y0) / 2, 0) AS INT) + 1))::INT AS j FROM s) SELECT i, j, point_id FROM t LEFT JOIN a USING (i, j)""")  # fmt: skip
def _(i):
    return G.to_grid(i.points_v, "point_id", 2.0)


@query("grd2_fill_nearest", """WITH g AS (SELECT i, j, CASE WHEN (i * 13 + j * 7) % 5 < 2 OR (i BETWEEN 10 AND 16 AND j BETWEEN 20 AND 27) THEN NULL ELSE hgt END AS hgt FROM raster_v),
    k AS (SELECT a.i, a.j, b.hgt, row_number() OVER (PARTITION BY a.i, a.j ORDER BY (a.i - b.i) ** 2 + (a.j - b.j) ** 2, b.i, b.j) AS q FROM g a JOIN g b ON a.hgt IS NULL AND b.hgt IS NOT NULL)
    SELECT i, j, hgt FROM g WHERE hgt IS NOT NULL UNION ALL SELECT i, j, hgt FROM k WHERE q = 1""")  # fmt: skip
def _(i):
    gap = F.expr("(i * 13 + j * 7) % 5 < 2 OR (i BETWEEN 10 AND 16 AND j BETWEEN 20 AND 27)")
    return G.fill_nearest(i.raster_v.select("i", "j", F.when(~gap, c("hgt")).alias("hgt")), "hgt")


# A direct transform, axis by axis: the sums over i of each row, then over j.
DFT = """e AS (SELECT field, ni, nj, kx, ky, power(sum(re * cos(2 * pi() * ky * j / nj) + im * sin(2 * pi() * ky * j / nj)), 2) + power(sum(im * cos(2 * pi() * ky * j / nj) - re * sin(2 * pi() * ky * j / nj)), 2) AS p
              FROM (SELECT field, ni, nj, j, kx, sum(v * cos(2 * pi() * kx * i / ni)) AS re, -sum(v * sin(2 * pi() * kx * i / ni)) AS im FROM (SELECT *, unnest(range(0, ni)) AS kx FROM a) GROUP BY ALL), (SELECT unnest(range(0, 200)) AS ky)
              WHERE ky < nj GROUP BY ALL)"""
WAVES = f"""a AS (SELECT field, i, j, v - avg(v) OVER (PARTITION BY field) AS v, max(i) OVER () + 1 AS ni, max(j) OVER () + 1 AS nj FROM f), {DFT},
    w AS (SELECT field, p, sqrt(power(((kx + ni // 2) % ni - ni / 2.0::DOUBLE) / (ni / 2.0::DOUBLE), 2) + power(((ky + nj // 2) % nj - nj / 2.0::DOUBLE) / (nj / 2.0::DOUBLE), 2)) AS r FROM e)"""
FIELDS = "f AS (SELECT 'hgt' AS field, i, j, hgt AS v FROM raster_v UNION ALL SELECT 'lu', i, j, lu::DOUBLE FROM raster_v)"


@query("grd3_band_shares", f"""WITH {FIELDS}, {WAVES}, b AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.1::DOUBLE), (1, 0.1, 0.25), (2, 0.25, 0.5), (3, 0.5, 2.0)) b(band, low, high))
    SELECT field, band, round(100 * sum(CASE WHEN r >= low AND r < high THEN p ELSE 0 END) / sum(p), 6) AS share FROM w, b GROUP BY 1, 2""")  # fmt: skip
def _(i):
    f = i.raster_v.withColumns({"field": F.lit("hgt"), "v": c("hgt")}).select("field", "i", "j", "v").unionByName(i.raster_v.select(F.lit("lu").alias("field"), "i", "j", c("lu").cast("double").alias("v")))
    return SP.band_shares(f, "field", "v").withColumn("share", r(c("share")))


@query("grd4_high_share", f"WITH {FIELDS}, {WAVES} SELECT field, round(sum(CASE WHEN r > 0.5 THEN p ELSE 0 END) / sum(p), 8) AS share FROM w WHERE field = 'hgt' GROUP BY 1")
def _(i):
    return SP.high_share(i.raster_v.withColumn("field", F.lit("hgt")), "field", "hgt").withColumn("share", r(c("share"), 8))


@query("grd5_radial_spectrum", f"""WITH s AS (SELECT least(max(i), max(j)) + 1 AS n, avg(hgt) AS m FROM raster_v),
    a AS (SELECT 'hgt' AS field, n AS ni, n AS nj, i, j, (hgt - m) * power(sin(pi() * i / (n - 1)) * sin(pi() * j / (n - 1)), 2) AS v FROM raster_v, s WHERE i < n AND j < n), {DFT},
    w AS (SELECT ni AS n, p, sqrt(power(least(kx, ni - kx), 2) + power(least(ky, ni - ky), 2)) / (ni * 100.0::DOUBLE) AS r FROM e),
    l AS (SELECT n, unnest(range(0, 40)) AS b, 1 / (n * 100.0::DOUBLE) AS low FROM s), g AS (SELECT b, low * power(0.005::DOUBLE / low, b / 39.0::DOUBLE) * (1 - 1e-12) AS a, low * power(0.005::DOUBLE / low, (b + 1) / 39.0::DOUBLE) * (1 - 1e-12) AS z FROM l WHERE b < 39)
    SELECT CAST(b AS INT) AS bin, round(a, 8) AS k, round(log10(avg(p)), 6) AS log_power FROM w JOIN g ON r >= a AND r < z GROUP BY 1, 2""")  # fmt: skip
def _(i):
    out = SP.radial_spectrum(i.raster_v.withColumn("field", F.lit("hgt")), "field", "hgt", 100.0)
    side = i.raster_v.agg((F.least(F.max("i"), F.max("j")) + 1).alias("n"))  # one row
    at = F.rint(39 * F.log(c("k") * c("n") * 100) / F.log(0.005 * c("n") * 100)).cast("int")
    return out.crossJoin(side).select(at.alias("bin"), r(c("k"), 8).alias("k"), r(F.log10("power")).alias("log_power"))


@query("grd6_gradient_p99", f"WITH {GRAD} SELECT round(quantile_cont(sqrt(gi * gi + gj * gj), 0.99), 8) AS p99 FROM g")
def _(i):
    return G.gradient_p99(i.raster_v, "hgt", 100.0).select(r(c("p99"), 8).alias("p99"))


@query("grd7_field_correlation", "SELECT round(corr(hgt, lu), 6) + 0.0 AS r, count(*) AS n FROM raster_v WHERE (i + j) % 17 <> 0 AND lu > 5")
def _(i):
    a, b = i.raster_v.where("(i + j) % 17 <> 0").select("i", "j", "hgt"), i.raster_v.where("lu > 5").select("i", "j", "lu")
    return a.join(b, ["i", "j"]).agg(r(F.corr("hgt", "lu")).alias("r"), F.count(F.lit(1)).alias("n"))


@query("grd8_robust_limits", "SELECT round(quantile_cont(hgt, 0.01), 6) AS p1, round(quantile_cont(hgt, 0.99), 6) AS p99 FROM raster_v WHERE (i + j) % 17 <> 0")
def _(i):
    v = i.raster_v.select(F.when(F.expr("(i + j) % 17 <> 0"), c("hgt")).alias("v"))
    return G.robust_limits(v, "v").select(r(c("p1")).alias("p1"), r(c("p99")).alias("p99"))


BOXES = {"width": "20000 + (s_suppkey * 1370) % 40000 + 0.5", "height": "18000 + (s_suppkey * 2710) % 50000 + 0.25", "x": "(s_suppkey * 313) % 5000 - 2500.0", "y": "(s_suppkey * 727) % 9000 - 4500.0"}
_UP = "((greatest(n{a} // 3 + 30, 80) + 2) // 3) * 3"
_IN = "least(greatest(CAST(round_even((c - n{k} * {dx}::DOUBLE / 2 - o{p}) / {step}, 0) AS BIGINT) + 1, 16), n{p} - n{k} // 3 + 1 - 15)"
_STEPS = ", ".join(
    f"q{k} AS (SELECT *, o{k - 1} + (s{k} - 1) * {step}::DOUBLE AS o{k} FROM (SELECT *, {_IN.format(k=k, p=k - 1, dx=dx, step=step)} AS s{k} FROM q{k - 1}))" for k, (step, dx) in enumerate(((8100, 2700), (2700, 900), (900, 300), (300, 100)), 2)
)
NESTS = f"""WITH b AS (SELECT s_suppkey AS box, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in BOXES.items())} FROM supplier),
    ax AS (SELECT box, 'x' AS axis, width AS side, x AS c FROM b UNION ALL SELECT box, 'y', height, y FROM b),
    n5 AS (SELECT *, CAST(ceil((side + 4300) / 100 / 3 - 1e-6) AS BIGINT) * 3 AS n5 FROM ax), n4 AS (SELECT *, {_UP.format(a=5)} AS n4 FROM n5), n3 AS (SELECT *, {_UP.format(a=4)} AS n3 FROM n4), n2 AS (SELECT *, {_UP.format(a=3)} AS n2 FROM n3),
    q1 AS (SELECT *, greatest(n2 // 3 + 30, 80) AS n1, CAST(1 AS BIGINT) AS s1, -greatest(n2 // 3 + 30, 80) * 4050.0::DOUBLE AS o1 FROM n2), {_STEPS},
    d AS (SELECT box, axis, least(n1, n2, n3, n4, n5) // 10 AS ranks, unnest([{", ".join(f"{{'domain': {k}, 'dx': {dx}::DOUBLE, 'n': n{k}, 's': s{k}, 'o': o{k}}}" for k, dx in enumerate((8100, 2700, 900, 300, 100), 1))}], recursive := true) FROM q5),
    g AS (SELECT *, o + n * dx AS z, lag(o) OVER w AS po, lag(o + n * dx) OVER w AS pz, lag(dx) OVER w AS pdx FROM d WINDOW w AS (PARTITION BY box, axis ORDER BY domain))
    SELECT x.box, x.domain, x.dx, x.n AS nx, y.n AS ny, x.s AS i_start, y.s AS j_start, x.o AS x0, y.o AS y0, x.z AS x1, y.z AS y1, round(least(x.o - x.po, x.pz - x.z, y.o - y.po, y.pz - y.z) / x.pdx, 6) AS gap_cells, x.ranks * y.ranks AS max_ranks
    FROM g x JOIN g y ON x.box = y.box AND x.domain = y.domain AND x.axis = 'x' AND y.axis = 'y'"""


@query("grd9_nest_design", NESTS)
def _(i):
    boxes = i.supplier.select(c("s_suppkey").alias("box"), *[F.expr(v).cast("double").alias(k) for k, v in BOXES.items()])
    return nests.design(boxes, "box").withColumn("gap_cells", r(c("gap_cells")))


@query("grd10_tiles", """SELECT tx, ty, tx * 8 - 3 AS x0, tx * 8 + 10 AS x1, ty * 8 - 3 AS y0, ty * 8 + 10 AS y1, format('{:05d}-{:05d}.{:05d}-{:05d}', tx * 8 + 1, tx * 8 + 8, ty * 8 + 1, ty * 8 + 8) AS name, cells
    FROM (SELECT i // 8 AS tx, j // 8 AS ty, count(*) AS cells FROM raster_v GROUP BY 1, 2)""")  # fmt: skip
def _(i):
    """The raster's tiles of eight cells, each with its window and name."""
    held = i.raster_v.groupBy(F.floor(c("i") / 8).cast("int").alias("tx"), F.floor(c("j") / 8).cast("int").alias("ty")).agg(F.count("*").alias("cells"))
    return G.tile_windows(held.drop("cells"), 8).join(held, ["tx", "ty"])


@query("grd11_containment", "SELECT lu, min(least(i, j, 39 - i)) AS gap, min(least(i, j, 39 - i)) >= 3 AS ok FROM raster_v WHERE j < 40 AND i BETWEEN lu % 5 AND 39 - lu % 5 AND j >= lu % 5 GROUP BY 1")
def _(i):
    from ..operators.nests import inset

    inner = i.raster_v.where("j < 40 AND i BETWEEN lu % 5 AND 39 - lu % 5 AND j >= lu % 5")
    g = inner.groupBy("lu").agg(F.min(inset(c("i"), c("j"), F.lit(39))).alias("gap"))
    return g.withColumn("ok", c("gap") >= 3)


@query("grd12_centre_crop", "SELECT i, j, hgt FROM raster_v WHERE i BETWEEN 10 AND 29 AND j BETWEEN 15 AND 34")
def _(i):
    return G.crop_centre(i.raster_v, 40, 50, 20).select("i", "j", "hgt")
