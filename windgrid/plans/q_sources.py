"""Sources and sinks, campaign bookkeeping, and the streaming extension."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import scratch
from ..operators import campaign as OC
from ..sources import config, files, folder, gridded, maps, modellog, namelist, netcdf, tiles, windows, wps, wrg
from ..streaming import windows as SW
from .q_aggs import LOG
from .registry import count, query, r

c = F.col


_FOLDERS: dict[tuple, str] = {}


def _forcing_folder(i) -> str:
    """A folder of binary files, written once a session and scale: a file a day with the points' mean speed and largest direction on an 8 by 8 grid; every 50th day's stands there once more, cut short."""
    key = i.spark.sparkContext.applicationId, i.sf_dir
    if key in _FOLDERS:
        return _FOLDERS[key]
    from ..deploy import ship

    ship(i.spark)

    def files_of(day, pixel: np.ndarray, values: np.ndarray) -> list[tuple[str, bytes]]:
        grids = np.full((2, 64), -1, dtype=np.float32)
        grids[:, pixel] = values
        stamp = f"{day:%Y-%m-%d}_00"
        content = b"".join(wps.encode(stamp, name, level, g.reshape(8, 8), 30.0, -110.0, 0.25, 0.5) for name, level, g in zip(("SPEED", "DIR"), (100.0, 10.0), grids, strict=True))
        cut = [(f"{day:%Y}/CUT.{stamp}", content[:520])] if day.toordinal() % 50 == 0 else []
        return [(f"{day:%Y}/FORCING.{stamp}", content), *cut]

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("day", kind="stable")
        pixel, values = x["pixel"].to_numpy(), x[["speed", "dir"]].to_numpy().T
        days, first = np.unique(x["day"].to_numpy(), return_index=True)
        ends = [*first[1:], len(x)]
        made = [f for day, a, b in zip(days, first, ends, strict=True) for f in files_of(day, pixel[a:b], values[:, a:b])]
        return pd.DataFrame(made, columns=["path", "content"])

    days = i.forcing_v.groupBy(F.to_date("time").alias("day"), "pixel").agg(F.avg("ws").cast("double").alias("speed"), F.max("wd").alias("dir"))
    to = scratch.path(i.spark)
    folder.write(days.groupBy(F.trunc("day", "month")).applyInPandas(run, "path string, content binary"), to)
    _FOLDERS[key] = to
    return to


DAYS = """cells AS (SELECT CAST(time AS DATE) AS day, pixel, avg(ws) AS speed, max(wd) AS dir FROM forcing_v GROUP BY 1, 2), days AS (SELECT DISTINCT day, day - DATE '0001-01-01' + 1 AS n FROM cells),
    every AS (SELECT day, CAST(p AS INT) AS pixel FROM days CROSS JOIN range(0, 64) t(p)),
    grid AS (SELECT strftime(day, '%Y-%m-%d_00') AS date, pixel % 8 AS i, pixel // 8 AS j, coalesce(speed::FLOAT, -1)::DOUBLE AS speed, coalesce(dir::FLOAT, -1)::DOUBLE AS dir FROM every LEFT JOIN cells USING (day, pixel))"""


@query("src1_wps_fields", f"WITH {DAYS} SELECT date, 'SPEED' AS field, 100.0::DOUBLE AS level, i, j, round(speed, 6) AS value FROM grid")
def _(i):
    """One field of every file of a folder; the filter goes into the reader."""
    cells = gridded.read(i.spark, _forcing_folder(i)).where("field = 'SPEED' AND level = 100").where("path NOT LIKE '%/CUT.%'")
    return cells.select("date", "field", "level", "i", "j", r(c("value")).alias("value"))


@query("src1_wps_point", f"WITH {DAYS} SELECT date, CASE k WHEN 1 THEN 'SPEED' ELSE 'DIR' END AS field, i, j, round(CASE k WHEN 1 THEN speed ELSE dir END, 6) AS value FROM grid, (VALUES (1), (2)) t(k) WHERE i = 5 AND j = 6")
def _(i):
    """Both fields at the cell nearest to a point."""
    cells = gridded.read(i.spark, _forcing_folder(i), lat=31.55, lon=-107.4).where("error IS NULL AND path NOT LIKE '%/CUT.%'")
    return cells.select("date", "field", "i", "j", r(c("value")).alias("value"))


@query("src1_wps_cells", f"WITH {DAYS} SELECT date, i, j, round(speed, 6) AS value FROM grid WHERE i IN (1, 6) AND j = 2 AND date IN ('1996-02-29_00', '1997-07-01_00', '1998-12-24_00')")
def _(i):
    """Some cells of some days, by pushed filters alone."""
    cells = gridded.read(i.spark, _forcing_folder(i)).where("field = 'SPEED' AND i IN (1, 6) AND j = 2 AND date IN ('1996-02-29_00', '1997-07-01_00', '1998-12-24_00')")
    return cells.where("path NOT LIKE '%/CUT.%'").select("date", "i", "j", r(c("value")).alias("value"))


@query("src1_bytes_read", f"WITH {DAYS} SELECT strftime(day, '%Y-%m-%d_00') AS date, CAST(2 * (10 * 4 + 4 + 156 + 28 + 4 + 256) AS BIGINT) AS bytes, CAST(10 * 4 + 2 * 156 + 16 + 4 AS BIGINT) AS bytes_read FROM days")
def _(i):
    """What a file holds, and what is read of it for one field at a point: ten record lengths, two headers, one grid and one number."""
    found = gridded.read(i.spark, _forcing_folder(i), rows="files", fields="SPEED", lat=31.55, lon=-107.4).where("path NOT LIKE '%/CUT.%'")
    return found.select(F.substring_index("path", ".", -1).alias("date"), "bytes", "bytes_read")


def _contents(i):
    """path (name of the file), content."""
    return i.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_forcing_folder(i)).select(F.substring_index("path", "/", -1).alias("path"), "content")


@query("src2_records", f"""WITH {DAYS} SELECT kind || strftime(day, '%Y-%m-%d_00') AS name, CAST(k AS INT) AS record, CAST(CASE WHEN kind = 'CUT.' AND k = 6 THEN NULL WHEN k % 5 = 0 THEN 4 WHEN k % 5 = 1 THEN 156 WHEN k % 5 = 2 THEN 28 WHEN k % 5 = 3 THEN 4 ELSE 256 END AS BIGINT) AS bytes
    FROM days, (VALUES ('FORCING.'), ('CUT.')) f(kind), range(0, 10) t(k) WHERE kind = 'FORCING.' OR n % 50 = 0 AND k < 7""")
def _(i):
    return wps.record_lengths(_contents(i)).select(c("path").alias("name"), "record", "bytes")


@query("src3_failures_counted", f"WITH {DAYS} SELECT strftime(day, '%Y') AS year, count(*) + count(*) FILTER (WHERE n % 50 = 0) AS files, count(*) FILTER (WHERE n % 50 = 0) AS failed FROM days GROUP BY 1")
def _(i):
    """Files and failures by folder; only lengths and headers are read for it."""
    found = gridded.read(i.spark, _forcing_folder(i), rows="files", fields="none")
    failed = gridded.read(i.spark, _forcing_folder(i)).where("error IS NOT NULL").groupBy("path").agg(count().alias("n"))
    both = found.drop("error").join(failed, "path", "left")
    return both.groupBy(F.element_at(F.split("path", "/"), -2).alias("year")).agg(count().alias("files"), F.count("n").cast("long").alias("failed"))


@query("src4_time_of_name", "SELECT DISTINCT l_shipdate AS time FROM lineitem")
def _(i):
    return i.lineitem.select(files.time_of_name(F.concat(F.lit("/data/SURF:"), F.date_format("l_shipdate", "yyyy-MM-dd_HH"))).alias("time")).distinct()


@query("src5_hub_csv", "SELECT time, ws, wd FROM obs_v".replace("time, ws, wd", "date_trunc('second', time) AS time, round(ws, 4) AS ws, round(wd, 4) AS wd"))
def _(i):
    text = i.obs_v.select(F.concat_ws(",", F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.round("ws", 4).cast("string"), F.round("wd", 4).cast("string"), F.lit("0.5"), F.lit("1")).alias("line"))
    preamble = i.spark.createDataFrame([("site export",), ("time,a,b,c,d",)], "line string")
    return files.parse_csv(preamble.unionByName(text), files.HUB, skip="^[^0-9]").select("time", "ws", "wd")


@query("src6_fixed_decimals", "SELECT event_id, format('{:.4f}', ws) AS ws FROM obs_v")
def _(i):
    return files.fixed_decimals(i.obs_v.select("event_id", "ws"))


@query("src7_manifest_text", "SELECT run, sample_start, days, round(weight, 5) AS weight FROM manifest_v")
def _(i):
    text = i.manifest_v.select(F.concat_ws(",", "run", F.lit(""), F.lit(""), c("sample_start").cast("string"), c("days").cast("string"), F.round("weight", 5).cast("string"), F.lit("")).alias("line"))
    return files.parse_csv(text, files.MANIFEST).select("run", "sample_start", "days", "weight")


def _cube(i) -> str:
    """A cube of four heights, written to the shared folder."""
    to = scratch.path(i.spark)
    files.write_cube(i.obs_v.withColumn("height", F.explode(F.array(*map(F.lit, (80, 100, 120, 160))))), to)
    return to


@query("src8_npz", "SELECT strftime(time, '%Y-%m-%d_%H') AS name, CAST(row_number() OVER (PARTITION BY date_trunc('hour', time) ORDER BY event_id) - 1 AS INT) AS place, round(ws::FLOAT::DOUBLE, 6) AS ws, round(wd::FLOAT::DOUBLE, 6) AS wd FROM obs_v")
def _(i):
    """A file of arrays for each time step of an hour, read back as 32-bit floats."""
    made = files.npz_contents(i.obs_v.withColumn("step", F.date_format("time", "yyyy-MM-dd_HH")), "step", "event_id", ["ws", "wd"])
    rows = files.parse_npz(made, ["ws", "wd"]).select(c("path").alias("name"), F.posexplode(F.arrays_zip("ws", "wd")).alias("place", "v"))
    return rows.select("name", "place", r(c("v.ws").cast("double")).alias("ws"), r(c("v.wd").cast("double")).alias("wd"))


@query("src9_cube_layout", "SELECT height, pixel, min(time) AS begin, max(time) AS \"end\", count(*) AS n, round(sum(ws), 6) AS ws FROM (SELECT time, pixel, ws, unnest([80, 100, 120, 160])::INT AS height FROM obs_v) GROUP BY 1, 2")
def _(i):
    """Written by height and lane, read back whole."""
    return files.read_cube(i.spark, _cube(i)).groupBy("height", "pixel").agg(F.min("time").alias("begin"), F.max("time").alias("end"), count().alias("n"), r(F.sum("ws")).alias("ws"))


@query("src10_every_24th_pixel", "SELECT event_id, pixel, time FROM obs_v WHERE pixel % 24 = 0")
def _(i):
    """The cube's lane 0 at one height: partition pruning reads its folder alone."""
    return files.read_cube(i.spark, _cube(i), [100], 0).select("event_id", "pixel", "time")


_DAY = "time >= TIMESTAMP '2024-01-03 00:00:00' AND time < TIMESTAMP '2024-01-03 12:00:00'"
_FEW = "pixel BETWEEN 20 AND 24"
_SCANS = " UNION ALL ".join(f"SELECT '{name}' AS scan, 'lane ' || (pixel % 24) AS lane, count(*) AS n, count(DISTINCT pixel) AS pixels, round(sum(ws), 6) AS ws FROM obs_v WHERE {where} GROUP BY ALL" for name, where in (("pixels", _FEW), ("half a day", _DAY)))


@query("src10_curve_scans", _SCANS)
def _(i):
    """A few pixels' whole history and all pixels' half day, from one cube along the curve: both skip most of its row groups."""
    to = scratch.path(i.spark)
    files.write_curve_cube(i.obs_v.withColumn("height", F.lit(100)), to)
    found = [("pixels", files.read_cube(i.spark, to).where(_FEW)), ("half a day", files.read_cube(i.spark, to, since=dt.datetime(2024, 1, 3), before=dt.datetime(2024, 1, 3, 12)))]
    one, two = (cube.groupBy(F.format_string("lane %d", F.pmod("pixel", F.lit(24))).alias("lane")).agg(count().alias("n"), F.count_distinct("pixel").alias("pixels"), r(F.sum("ws")).alias("ws")).withColumn("scan", F.lit(name)) for name, cube in found)
    return one.unionByName(two)


@query("src11_netcdf", "SELECT v AS variable, i, j, CASE v WHEN 'HGT_M' THEN round(hgt, 6) ELSE lu::DOUBLE END AS value, '100.0' AS dx FROM raster_v, (VALUES ('HGT_M'), ('LU_INDEX')) v(v)")
def _(i):
    """The raster as netCDF classic files, one for each ten rows with its first row as an attribute; variables and attributes read back."""
    from ..deploy import ship

    ship(i.spark)

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        grids, first = {}, int(key[0]) * 10
        for name, column, dtype in (("HGT_M", "hgt", ">f8"), ("LU_INDEX", "lu", ">i4")):
            values = np.zeros((x["j"].max() + 1 - first, x["i"].max() + 1), dtype)
            values[x["j"] - first, x["i"]] = x[column]
            grids[name] = (["south_north", "west_east"], values)
        return pd.DataFrame({"path": [f"geo.{key[0]:05d}.nc"], "content": [netcdf.encode(grids, {"TITLE": "raster", "DX": 100.0, "FIRST_ROW": float(first)})]})

    to = scratch.path(i.spark)
    folder.write(i.raster_v.groupBy(F.floor(c("j") / 10).alias("block")).applyInPandas(run, "path string, content binary"), to)
    made = i.spark.read.format("binaryFile").load(to).select("path", "content")
    first = c("FIRST_ROW").cast("double").cast("int")
    return netcdf.parse(made, ["HGT_M", "LU_INDEX"], ("DX", "FIRST_ROW")).select("variable", "i", (c("j") + first).alias("j"), r(c("value")).alias("value"), c("DX").alias("dx"))


WRG = """WITH p AS (SELECT regexp_split_to_array(trim(line), '\\s+') AS t FROM wrg_text_v), q AS (SELECT CASE WHEN t[1] = 'GridPoint' THEN t[2:] ELSE t END AS t FROM p), s AS (SELECT t FROM q WHERE len(t) >= 14),
    w AS (SELECT t[1]::DOUBLE AS e, t[2]::DOUBLE AS n, t[3]::DOUBLE AS elev, t[5]::DOUBLE AS a, t[6]::DOUBLE AS k, t FROM s)"""


@query("src12_wrg_any", f"{WRG} SELECT e, n, elev, a, k, round(t[10]::DOUBLE / 10, 6) AS a0, round(t[14]::DOUBLE / 100, 6) AS k1 FROM w")
def _(i):
    return wrg.parse(i.wrg_text_v).select("e", "n", "elev", "a", "k", r(c("sectors")[0]["a"]).alias("a0"), r(c("sectors")[1]["k"]).alias("k1"))


@query("src13_wrg_labelled", f"{WRG} SELECT e, n, CASE WHEN NOT bad THEN elev END AS elev, CASE WHEN NOT bad THEN a END AS a, CASE WHEN NOT bad THEN k END AS k FROM (SELECT *, elev = 0 AND a = 1 AND k = 1.5 AS bad FROM w)")
def _(i):
    return wrg.parse(i.wrg_text_v, dialect="labelled").select("e", "n", "elev", "a", "k")


@query("prj13_masked", f"{WRG} SELECT e, n, a <= 1 AND abs(k - 1.5) < 1e-9 AS masked FROM w")
def _(i):
    return wrg.parse(i.wrg_text_v).select("e", "n", wrg.masked(c("a"), c("k")).alias("masked"))


@query("prj14_no_data", f"{WRG} SELECT elev = 0 AND a = 1 AND k = 1.5 AS no_data, count(*) AS cells FROM w GROUP BY 1")
def _(i):
    return wrg.parse(i.wrg_text_v).groupBy(wrg.no_data(c("elev"), c("a"), c("k")).alias("no_data")).agg(count().alias("cells"))


@query("src14_weight_vector", "SELECT time, round(sum(weight), 6) AS weight FROM forcing_v GROUP BY 1")
def _(i):
    """A vector file a month, read back and aligned to the times again by place."""
    steps = i.forcing_v.groupBy("time").agg(F.sum("weight").alias("weight")).withColumn("month", F.date_format("time", "yyyy-MM"))
    back = files.parse_npy(files.npy_contents(steps, "month", "time", "weight"))
    place = F.row_number().over(Window.partitionBy("month").orderBy("time")) - 1
    times = steps.select("time", c("month").alias("path"), place.alias("place"))
    return back.join(times, ["path", "place"]).select("time", r(c("value")).alias("weight"))


@query("src15_model_log", f"WITH {LOG} SELECT time, domain, elapsed FROM log")
def _(i):
    return modellog.parse(i.modellog_v)


TILES = """WITH v AS (SELECT i, j, hgt FROM raster_v WHERE (i + j) % 7 <> 0 AND NOT (i < 10 AND j < 10)),
    t AS (SELECT DISTINCT i // 10 AS tx, j // 10 AS ty FROM v),
    c AS (SELECT tx, ty, tx * 10 + a AS i, ty * 10 + b AS j FROM t, (SELECT unnest(range(-2, 12)) AS a), (SELECT unnest(range(-2, 12)) AS b))
    SELECT format('{:05d}-{:05d}.{:05d}-{:05d}', tx * 10 + 1, tx * 10 + 10, ty * 10 + 1, ty * 10 + 10) AS path, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round_even(hgt, 0) + 0.0 AS value FROM c LEFT JOIN v USING (i, j)"""


def _known(i):
    return i.raster_v.where("(i + j) % 7 <> 0 AND NOT (i < 10 AND j < 10)")


def _tile_folder(i) -> str:
    """Tiles of ten by ten cells with a border of two; one holds nothing and isn't made."""
    to = scratch.path(i.spark)
    folder.write(tiles.contents(_known(i), "hgt", 10, 2), to)
    return to


@query("src17_terrain_tiles", TILES)
def _(i):
    """Tiles as files and read back, with their borders."""
    made = i.spark.read.format("binaryFile").load(_tile_folder(i)).select(F.substring_index("path", "/", -1).alias("path"), "content")
    return tiles.parse(made, 10, 2)


@query("src16_windows", """WITH w AS (SELECT s_suppkey AS win, CAST((s_suppkey * 7) % 50 - 8 AS INT) AS x0, CAST((s_suppkey * 3) % 40 - 6 AS INT) AS y0 FROM supplier),
    x AS (SELECT win, x0 + CAST(a AS INT) AS i, y0 FROM w, range(0, 13) a(a)), c AS (SELECT win, i, y0 + CAST(b AS INT) AS j FROM x, range(0, 9) b(b))
    SELECT c.win, c.i, c.j, round_even(hgt, 0) + 0.0 AS value FROM c LEFT JOIN (SELECT * FROM raster_v WHERE (i + j) % 7 <> 0 AND NOT (i < 10 AND j < 10)) r ON r.i = c.i AND r.j = c.j""")  # fmt: skip
def _(i):
    """Windows of 13 by 9 cells over tiles of ten, across their edges and beyond the raster; one tile was never made."""
    x0, y0 = (c("s_suppkey") * 7 % 50 - 8), (c("s_suppkey") * 3 % 40 - 6)
    asked = i.supplier.select(c("s_suppkey").alias("window"), x0.alias("x0"), y0.alias("y0"), (x0 + 12).alias("x1"), (y0 + 8).alias("y1"))
    made = i.spark.read.format("binaryFile").load(_tile_folder(i)).select("path")
    return windows.read(asked, made, 10, 2).withColumnRenamed("window", "win")


@query("src19_map_pyramid", """WITH p AS (SELECT l.level, i // (1 << l.level) AS i, j // (1 << l.level) AS j, hgt FROM raster_v, (VALUES (0), (1), (2), (3)) l(level) WHERE (i + j) % 7 <> 0 AND NOT (i < 10 AND j < 10))
    SELECT CAST(level AS INT) AS level, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(floor(greatest(0, least(1, (avg(hgt) - 900) / 1200)) * 255 + 0.5) AS INT) AS grey FROM p GROUP BY 1, 2, 3""")  # fmt: skip
def _(i):
    """Four levels of images of 16 by 16 cells, as files and read back."""
    to = scratch.path(i.spark)
    folder.write(maps.images(maps.levels(_known(i), "hgt", 4), 900.0, 2100.0, 16), to)
    return maps.parse(i.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(to), 16)


@query("src18_tile_names", "SELECT CAST(s_suppkey % 60 - 30 AS INT) AS lat, CAST(-(s_suppkey * 7 % 180) AS INT) AS lon, s_suppkey AS id FROM supplier")
def _(i):
    lat, lon = c("s_suppkey") % 60 - 30, c("s_suppkey") * 7 % 180
    name = F.concat(F.lit("tile_"), F.when(lat < 0, "S").otherwise("N"), F.lpad(F.abs(lat).cast("string"), 2, "0"), F.lit("_00_W"), F.lpad(lon.cast("string"), 3, "0"), F.lit("_00"))
    a, b = files.corner_of_name(name)
    return i.supplier.select(a.alias("lat"), b.alias("lon"), c("s_suppkey").alias("id"))


NAMELIST = r"""WITH t AS (SELECT run, chr(10) AS nl, chr(39) AS q, strftime(sample_start, '%Y-%m-%d_00:00:00') AS s FROM manifest_v)
    SELECT run, '&share' || nl || ' start_date = ' || q || s || q || ', ' || q || s || q || ',' || nl || ' interval_seconds = 10800,' || nl || '/' || nl
        || '&domains' || nl || ' max_dom = 2,' || nl || ' dx = 900.0, 300.0,' || nl || ' run = ' || q || run || q || ',' || nl || ' nested = .false., .true.,' || nl || '/' || nl AS text FROM t"""


@query("src20_namelist", NAMELIST)
def _(i):
    begin = namelist.stamp(c("sample_start").cast("timestamp"), 2)
    quoted = F.concat(F.lit("'"), "run", F.lit("'"))
    groups = {"share": {"start_date": begin, "interval_seconds": 10800}, "domains": {"max_dom": 2, "dx": [900.0, 300.0], "run": quoted, "nested": [False, True]}}
    return i.manifest_v.select("run", namelist.text(groups).alias("text"))


SETTINGS = """SELECT s_suppkey AS site, 'ROOT' AS key, '/case/' || s_nationkey || ' # a' AS value FROM supplier
    UNION ALL SELECT s_suppkey, 'RANKS', CASE WHEN s_suppkey % 10 = 0 THEN '104' ELSE CAST(s_suppkey % 7 AS VARCHAR) END FROM supplier
    UNION ALL SELECT s_suppkey, 'NAME', 'b' FROM supplier"""


@query("src21_settings", SETTINGS)
def _(i):
    """Lines with comments, quotes, exports and a repeated key; every tenth site's environment sets RANKS."""
    own = F.array(F.lit("# settings"), F.concat(F.lit('export ROOT="/case/'), "s_nationkey", F.lit(' # a"')), F.concat(F.lit("RANKS="), c("s_suppkey") % 7, F.lit(" # cores")), F.lit("no value"), F.lit("NAME='a'"), F.lit(" NAME = b "))
    lines = i.supplier.select(c("s_suppkey").alias("site"), "s_nationkey", F.posexplode(own).alias("n", "line"))
    env = i.supplier.where("s_suppkey % 10 = 0").select(c("s_suppkey").alias("site"), F.lit("RANKS").alias("key"), F.lit("104").alias("value"))
    return config.settings(lines, env)


@query("src22_table_rewrite", "SELECT CAST(s_suppkey AS INT) AS n, CASE WHEN s_suppkey = 7 THEN '7, 0.09' ELSE concat(s_suppkey, ', ', s_nationkey) END AS line FROM supplier WHERE s_suppkey > 0")
def _(i):
    """In block 'B' exactly one line begins with 7; it gets a new value."""
    lines = i.supplier.where("s_suppkey > 0").select(c("s_suppkey").cast("int").alias("n"), F.concat_ws(", ", "s_suppkey", "s_nationkey").alias("line"))
    marks = i.spark.createDataFrame([(0, "block A"), (-1, "block Z")], "n int, line string").unionByName(i.spark.createDataFrame([(0, "block B")], "n int, line string").where("n > 0"))
    named = OC.block_lines(lines.unionByName(marks), r"^block (\w)")
    hit = (c("block") == "A") & c("line").rlike(r"^7,")
    hits = named.agg(F.count_if(hit).alias("hits"))
    one = F.assert_true(c("hits") == 1, F.lit("exactly one row must match")).isNull()
    return named.crossJoin(hits).where(one).where("n > 0").select("n", F.when(hit, "7, 0.09").otherwise(c("line")).alias("line"))


@query("src23_raster_checks", "SELECT s_suppkey, s_nationkey % 3 = 1 AND 0.95::DOUBLE + (s_suppkey % 10) / 100.0::DOUBLE BETWEEN 0.98::DOUBLE AND 1.02::DOUBLE AND s_suppkey % 4 > 0 AS ok FROM supplier")
def _(i):
    extent = 0.95 + (c("s_suppkey") % 10) / 100
    return i.supplier.select("s_suppkey", files.sound_raster(c("s_nationkey") % 3, extent, extent, c("s_suppkey") % 4).alias("ok"))


@query("src24_to_fetch", "SELECT point_id, CASE WHEN x <= 20 THEN 'missing' ELSE 'empty' END AS reason FROM points_v WHERE x <= 20 OR floor(y) % 4 = 0")
def _(i):
    """What has no file, or a file without content."""
    have = i.points_v.where("x > 20").select("point_id", F.when(F.floor("y") % 4 == 0, 0).otherwise(F.floor(c("y") * 1000)).alias("bytes"))
    return OC.to_fetch(i.points_v, have, "point_id")


FETCHES = """SELECT s_nationkey AS tile, count(*) AS tries, CAST(count_if(s_suppkey % 3 = 0 OR s_suppkey % 5 = 0) AS BIGINT) AS failures,
    arg_max(CASE WHEN s_suppkey % 3 = 0 THEN 'timeout' WHEN s_suppkey % 5 = 0 THEN 'empty' ELSE 'ok' END, s_suppkey) AS last FROM supplier GROUP BY 1"""


@query("src24_fetch_log", FETCHES)
def _(i):
    attempts = i.supplier.select(c("s_nationkey").alias("tile"), c("s_suppkey").alias("at"), F.when(c("s_suppkey") % 5 != 0, 100).alias("bytes"), F.when(c("s_suppkey") % 3 == 0, "timeout").alias("error"))
    return OC.fetch_log(attempts, "tile").withColumns({"tries": c("tries").cast("long"), "failures": c("failures").cast("long")})


@query("src25_layered_fallback", "SELECT i, j, coalesce(CASE WHEN lu > 30 THEN hgt END, CASE WHEN lu > 10 THEN lu::DOUBLE END, 0.0) AS value, CASE WHEN lu > 30 THEN 'fine' WHEN lu > 10 THEN 'coarse' ELSE 'none' END AS source FROM raster_v")
def _(i):
    v, name = files.layered(("fine", F.when(c("lu") > 30, c("hgt"))), ("coarse", F.when(c("lu") > 10, c("lu").cast("double"))), ("none", F.lit(0.0)))
    return i.raster_v.select("i", "j", v.alias("value"), name.alias("source"))


@query("ops1_stage_plan", "SELECT run, sample_start::TIMESTAMP - INTERVAL 6 HOURS AS begin, sample_start::TIMESTAMP + to_days(days) AS \"end\", sample_start::TIMESTAMP + to_days(days) - INTERVAL 10 MINUTES AS wrf_end, CASE WHEN day(sample_start) % 3 > 0 THEN 'skip' ELSE 'stage' END AS action FROM manifest_v")
def _(i):
    return OC.stage_plan(i.manifest_v, i.manifest_v.select("run", (F.day("sample_start") % 3).alias("frames")))


@query("ops2_status", "SELECT run, CASE WHEN day(sample_start) >= 20 THEN 'complete' WHEN month(sample_start) = 2 THEN 'fail' WHEN month(sample_start) % 2 = 0 THEN 'running' ELSE 'pending' END AS status FROM manifest_v")
def _(i):
    s = OC.status(F.day("sample_start"), 20, F.month("sample_start") % 2 == 0, F.month("sample_start") == 2)
    return i.manifest_v.select("run", s.alias("status"))


@query("ops3_incomplete", "SELECT run, CAST(day(sample_start) AS INT) AS frames FROM manifest_v WHERE day(sample_start) < 28 AND month(sample_start) <> 4")
def _(i):
    facts = i.manifest_v.select("run", F.day("sample_start").alias("frames"))
    return OC.incomplete(facts, i.manifest_v.where(F.month("sample_start") == 4), 28)


@query("ops4_rewrite_setting", "SELECT run, CASE WHEN run <= 'b020' THEN ' end_day = 7, 7, 7, 7, 7,' ELSE ' start_day = ' || CAST(day(sample_start) AS VARCHAR) || ',' END AS line FROM manifest_v")
def _(i):
    line = F.concat(F.when(c("run") <= "b020", " end_day = ").otherwise(" start_day = "), F.day("sample_start").cast("string"), F.lit(","))
    return i.manifest_v.select("run", OC.rewrite_setting(line, "end_day", "7").alias("line"))


@query("ops5_job_chain", "SELECT run, step, run || '-' || step AS job, CASE step WHEN 'metgrid' THEN NULL WHEN 'real' THEN run || '-metgrid' ELSE run || '-real' END AS after FROM manifest_v, (VALUES ('metgrid'), ('real'), ('wrf')) s(step)")
def _(i):
    return OC.job_chain(i.manifest_v, ["metgrid", "real", "wrf"])


@query("ops6_spinup_variants", "SELECT run, CAST(h AS INT) AS spinup, sample_start::TIMESTAMP - to_hours(CAST(h AS INT)) AS begin, CAST((h + 24) // 3 + 1 AS BIGINT) * 2 AS inputs FROM manifest_v, (VALUES (3), (6), (12), (24)) s(h)")
def _(i):
    from ..functions import campaign as C

    out = None
    for h in (3, 6, 12, 24):
        begin, end, _ = C.block_window(c("sample_start").cast("timestamp_ntz"), c("days"), h)
        part = i.manifest_v.select("run", F.lit(h).alias("spinup"), begin.alias("begin"), (F.size(C.forcing_times(begin, end)) * 2).cast("long").alias("inputs"))
        out = part if out is None else out.unionByName(part)
    return out


TREE = """WITH m AS (SELECT run, sample_start::TIMESTAMP - INTERVAL 6 HOURS AS begin_, sample_start::TIMESTAMP + to_days(days) AS end_, chr(10) AS nl, chr(39) AS q FROM manifest_v WHERE day(sample_start) % 3 = 0),
    t AS (SELECT run, nl, unnest(generate_series(begin_, end_, INTERVAL 3 HOURS)) AS t FROM m),
    l AS (SELECT run, string_agg('met_em.' || strftime(t, '%Y-%m-%d_%H') || ' -> ../../met/' || run || '/met_em.' || strftime(t, '%Y-%m-%d_%H') || nl, '' ORDER BY t) AS text FROM t GROUP BY 1),
    f AS (SELECT run || '/links.txt' AS path, text FROM l UNION ALL SELECT run || '/fields.txt', 'ws wd' || nl FROM m
        UNION ALL SELECT run || '/namelist.input', '&share' || nl || ' start_date = ' || q || strftime(begin_, '%Y-%m-%d_%H:%M:%S') || q || ',' || nl || ' end_date = ' || q || strftime(end_, '%Y-%m-%d_%H:%M:%S') || q || ',' || nl || '/' || nl FROM m)
    SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM f"""


@query("ops7_run_tree", TREE)
def _(i):
    """The folders of the runs to stage, written by tasks and read back; written twice, as after a failure."""
    from ..functions import campaign as C

    plan = OC.stage_plan(i.manifest_v, i.manifest_v.select("run", (F.day("sample_start") % 3).alias("frames")))
    text = namelist.text({"share": {"start_date": namelist.stamp(c("begin").cast("timestamp")), "end_date": namelist.stamp(c("end").cast("timestamp"))}})
    inputs = F.transform(C.forcing_times(c("begin"), c("end")), lambda t: F.concat(F.lit("met_em."), F.date_format(t, "yyyy-MM-dd_HH")))
    staged = OC.run_tree(plan.withColumns({"_text": text, "_inputs": inputs}), c("_text"), c("_inputs"), "ws wd\n")
    to = scratch.path(i.spark)
    for _ in range(2):
        folder.write(staged, to)
    back = i.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(to)
    return back.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("path"), c("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("stream_windowed_rose", "SELECT date_trunc('hour', time) AS begin, CAST(floor(((wd + 15) % 360) / 30) AS INT) AS sector, count(*) AS n, round(sum(ws * ws * ws), 5) AS energy FROM obs_v GROUP BY 1, 2")
def _(i):
    obs = i.obs_v.withColumn("time", c("time").cast("timestamp"))
    return SW.windowed_rose(obs).select(c("begin").cast("timestamp_ntz").alias("begin"), "sector", "n", r(c("energy"), 5).alias("energy"))


@query("stream_sessions", """WITH g AS (SELECT pixel, time, CASE WHEN time - lag(time) OVER (PARTITION BY pixel ORDER BY time) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS cut FROM obs_v), s AS (SELECT *, sum(cut) OVER (PARTITION BY pixel ORDER BY time) AS k FROM g)
    SELECT pixel, min(time) AS begin, max(time) + INTERVAL 12 HOURS AS "end", count(*) AS n FROM s GROUP BY pixel, k""")
def _(i):
    s = SW.sessions(i.obs_v.withColumn("time", c("time").cast("timestamp")))
    return s.select("pixel", c("begin").cast("timestamp_ntz").alias("begin"), c("end").cast("timestamp_ntz").alias("end"), "n")
