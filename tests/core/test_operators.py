"""Operators by invariants, round trips and hand-made cases."""

from __future__ import annotations

import datetime as dt
import io
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from windgrid import scratch
from windgrid.operators import campaign, grid, histograms, joins, metrics, nests, quantiles, selection, spectra, timeline, weibull
from windgrid.plans import q_select
from windgrid.plans.catalogue import QUERIES, SQL
from windgrid.sources import config, files, folder, gridded, modellog, netcdf, tiles, wps, wrg
from windgrid.streaming import windows


@pytest.fixture(scope="module")
def record(spark):
    """Three years of 3-hourly observations with a gap."""
    rng = random.Random(1)
    start = dt.datetime(2000, 1, 1)
    rows = []
    for k in range(3 * 365 * 8):
        t = start + dt.timedelta(hours=3 * k)
        if not dt.datetime(2000, 3, 10) <= t < dt.datetime(2000, 3, 12):
            rows.append((t, rng.weibullvariate(8, 2), rng.uniform(0, 360), rng.uniform(-0.2, 0.2), k % 4))
    return spark.createDataFrame(rows, "time timestamp_ntz, ws double, wd double, ri_b double, pixel int").cache()


def test_histogram_invariants(record):
    b = histograms.with_bins(record).withColumn("block", F.trunc("time", "month"))
    h = histograms.normalised(histograms.histograms(b, ["block"]), b, ["block"])
    sums = h.where("grp <> 'scalar'").groupBy("block", "grp").agg(F.sum("value").alias("s")).collect()
    assert all(math.isclose(r["s"], 1, abs_tol=1e-9) for r in sums)
    full = histograms.dense(h, b.select("block").distinct())
    assert full.groupBy("block").count().select("count").distinct().collect() == [(sum(histograms.SIZES),)]
    one = h.where("block = '2000-01-01'").drop("block")
    assert all(abs(r["value"]) < 1e-9 for r in histograms.report(one, one).collect())
    assert histograms.total_variation(one, one, ["grp"]).agg(F.max("tv")).first()[0] == 0


def test_effective_size(spark):
    w = spark.createDataFrame([(1.0,)] * 7, "weight double")
    assert histograms.effective_size(w).first()[0] == pytest.approx(7)


def test_contiguous_blocks_respect_gaps(record):
    starts = {r["start"] for r in timeline.contiguous_blocks(record, 3).collect()}
    assert not starts & {dt.date(2000, 3, d) for d in (8, 9, 10, 11)}
    assert dt.date(2000, 3, 7) in starts and dt.date(2000, 3, 12) in starts


def test_weibull():
    rng = np.random.default_rng(0)
    x = 8 * rng.weibull(2.2, 20_000)
    k, a = weibull.solve(x, np.ones_like(x))
    assert k == pytest.approx(2.2, rel=0.03) and a == pytest.approx(8, rel=0.02)
    assert weibull.solve(x, np.full_like(x, 3.0)) == pytest.approx((k, a))
    assert all(math.isnan(v) for v in weibull.solve(np.array([5.0]), np.ones(1)) + weibull.solve(np.array([5.0, 5.0]), np.ones(2)))
    w = rng.integers(1, 5, len(x)).astype(float)
    assert weibull.solve(x, w) == pytest.approx(weibull.solve(np.repeat(x, w.astype(int)), np.ones(int(w.sum()))))


def test_resource_grid(spark):
    rng = random.Random(2)
    rows = [(1, rng.weibullvariate(8, 2), rng.uniform(0, 180)) for _ in range(3000)] + [(2, 5.0, 10.0), (2, 0.0, 200.0)]
    g = {r["pixel"]: r for r in weibull.resource_grid(spark.createDataFrame(rows, "pixel int, ws double, wd double"), ["pixel"]).collect()}
    assert sum(s["freq"] for s in g[1]["sectors"]) == pytest.approx(1000) and len(g[1]["sectors"]) == 16
    assert g[1]["sectors"][12]["freq"] == 0 and g[1]["sectors"][12]["a"] is None
    assert g[2]["k"] is None and g[2]["sectors"][0]["freq"] == pytest.approx(500)


@pytest.mark.parametrize("dialect", ["any", "labelled"])
def test_wrg_round_trip(spark, dialect):
    sectors = [(0.25, 8.1, 2.1), (0.75, 6.5, 1.9)]
    cells = spark.createDataFrame([(100.0, 200.0, 1800.0, 100.0, 7.2, 2.05, 310.5, sectors), (200.0, 200.0, 0.0, 100.0, 1.0, 1.5, 0.0, sectors), (300.0, 200.0, 12.0, 100.0, 1.0, 1.5, 0.0, sectors)],
                                  "e double, n double, elev double, height double, a double, k double, pd double, sectors array<struct<freq double, a double, k double>>")
    lines = wrg.format_rows(cells)
    noise = spark.createDataFrame([("3 1 100 200 100",), ("GridPoint 1 2 3",), ("GridPoint a b c d e f g h",), ("",)], "line string")
    back = wrg.parse(lines.unionByName(noise), dialect=dialect).orderBy("e").collect()
    assert [r["e"] for r in back] == [100, 200, 300] and back[0]["a"] == 7.2 and back[0]["sectors"][1]["k"] == pytest.approx(1.9)
    assert back[1]["a"] == (None if dialect == "labelled" else 1.0) and back[2]["a"] == 1.0
    assert wrg.parse(wrg.format_rows(cells, None)).count() == 3
    assert tuple(wrg.header(noise).first()) == (3, 1, 100.0, 200.0, 100.0)


def test_wps_reads_only_what_is_wanted(tmp_path):
    """Of two large fields, a point of the second costs headers, record lengths and one number."""
    a = np.arange(250_000, dtype=np.float32).reshape(500, 500)
    data = wps.encode("2001-01-01_00", "TT", 100.0, a) + wps.encode("2001-01-01_00", "UU", 1.0, a * 2, 10.0, 20.0, 0.1, 0.1)
    (tmp_path / "f").write_bytes(data)
    with open(tmp_path / "f", "rb") as f:
        file = wps.Ranges(f, len(data))
        (field,) = wps.fields(file, {"UU"})
        i, j, value = wps.cells(file, field, (12.2, 23.1))
        assert (i[0], j[0], value[0]) == (31, 22, 2 * a[22, 31]) and file.read_bytes < 1000 < len(data) / 1000
    with pytest.raises(ValueError, match="cut short"):
        list(wps.records(wps.Ranges(io.BytesIO(data[:-3]), len(data) - 3)))


def test_netcdf_round_trip(spark):
    grids = {"HGT_M": (["y", "x"], np.arange(12, dtype=">f4").reshape(3, 4)), "LU": (["y", "x"], np.arange(12, dtype=">i4").reshape(3, 4)), "t": (["x"], np.arange(4, dtype=">f8"))}
    data = netcdf.encode(grids, {"TITLE": "abc", "DX": 300.0})
    head = netcdf.Header(data)
    assert head.dims == {"y": 3, "x": 4} and head.attributes == {"TITLE": "abc", "DX": [300.0]}
    assert all((head.values(k) == v).all() for k, (_, v) in grids.items())
    df = spark.createDataFrame([("a", data), ("cut", data[:50]), ("hdf", b"\x89HDF....")], "path string, content binary")
    rows = netcdf.parse(df, ["HGT_M", "t"]).collect()
    assert sum(r["error"] is not None for r in rows) == 2
    assert {(r["j"], r["i"]): r["value"] for r in rows if r["variable"] == "HGT_M"} == {(k // 4, k % 4): k for k in range(12)}
    assert sorted(r["value"] for r in rows if r["variable"] == "t") == [0, 1, 2, 3]


def test_netcdf_records():
    """Two variables along an unlimited dimension lie in turns."""
    text = lambda s: struct.pack(">i", len(s)) + s + b"\0" * (-len(s) % 4)
    head = b"CDF\x02" + struct.pack(">iii", 2, 10, 2) + text(b"Time") + struct.pack(">i", 0) + text(b"x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
    size = len(head) + sum(len(text(n)) + 4 + 8 + 8 + 4 + 4 + 8 for n in (b"a", b"b"))
    for k, n in enumerate((b"a", b"b")):
        head += text(n) + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0) + struct.pack(">iiq", 3, 8, size + 8 * k)
    values = [[1, 2, 3], [10, 20, 30], [4, 5, 6], [40, 50, 60]]
    data = head + b"".join(struct.pack(">hhhxx", *v) for v in values)
    h = netcdf.Header(data)
    assert h.values("a").tolist() == [[1, 2, 3], [4, 5, 6]] and h.values("b").tolist() == [[10, 20, 30], [40, 50, 60]]


def test_terrain_tiles(spark, tmp_path):
    rows = [(i, j, v) for i in range(7) for j in range(5) for v in [(None if (i, j) == (1, 1) else float("nan") if (i, j) == (2, 2) else 1e6 if i == 6 else 2.5 + i)]]
    made = tiles.contents(spark.createDataFrame(rows, "i int, j int, v double"), "v", 4, 1)
    assert {r["path"]: len(r["content"]) for r in made.collect()} == {tiles.name(a, b, 4): 72 for a in (0, 1) for b in (0, 1)}
    folder.write(made, f"{tmp_path}/piece")
    back = spark.read.format("binaryFile").load(f"{tmp_path}/piece")
    cells = {(r["path"].rsplit("/", 1)[1], r["i"], r["j"]): r["value"] for r in tiles.parse(back, 4, 1).collect()}
    first = tiles.name(0, 0, 4)
    assert cells[first, 0, 0] == 2 and cells[first, 1, 0] == 4 and cells[first, 4, 4] == 6 and cells[first, 1, 1] is None and cells[first, 2, 2] is None and cells[first, -1, 0] is None
    assert cells[tiles.name(1, 1, 4), 6, 4] == 32767 and cells[tiles.name(1, 1, 4), 7, 4] is None
    text = tiles.index_text(0.1, 0.1, 30.0, -110.0, "piece 0001")
    assert "known_lat = 30.050000000000\n" in text and "tile_bdr = 3\n" in text and text.endswith('description = "piece 0001"\n')


def test_cube_scans_one_lane(spark, tmp_path):
    rows = [(dt.datetime(2001, 1, 1, h), p, z, float(p + h)) for h in range(3) for p in range(60) for z in (80, 100)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, pixel int, height int, ws double")
    files.write_cube(df, f"{tmp_path}/cube")
    lane = files.read_cube(spark, f"{tmp_path}/cube", [100], 0)
    assert sorted({r["pixel"] for r in lane.collect()}) == [0, 24, 48] and lane.count() == 9
    plan = lane._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "lane" in plan.split("PartitionFilters: [")[-1].split("]")[0]
    assert files.read_cube(spark, f"{tmp_path}/cube").select("time", "pixel", "height", "ws").exceptAll(df.select("time", "pixel", "height", "ws")).count() == 0


def _scanned(df):
    """Rows that the scan of df hands on: those of the row groups and pages that its filters leave."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    stack = [plan]
    while stack:
        node = stack.pop()
        stack += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
    return sum(found)


def test_cube_along_the_curve_skips_by_pixel_and_by_time(spark, tmp_path):
    n = 128
    df = spark.range(n * n).selectExpr("CAST(id % 128 AS INT) AS pixel", "TIMESTAMP_NTZ '2001-01-01 00:00:00' + make_dt_interval(0, CAST(id DIV 128 AS INT)) AS time", "80 AS height", "CAST(id AS DOUBLE) AS ws")
    files.write_curve_cube(df, f"{tmp_path}/curve", lanes=1, files=64)
    cube = files.read_cube(spark, f"{tmp_path}/curve")
    assert cube.select(df.columns).exceptAll(df).count() == 0 and cube.count() == n * n
    at = dt.datetime(2001, 1, 2, 10)
    hour = {"since": at, "before": at + dt.timedelta(hours=1)}
    history, moment = cube.where("pixel = 40"), files.read_cube(spark, f"{tmp_path}/curve", [80], **hour)
    assert history.count() == moment.count() == n
    # a file is about 16 pixels by 16 times: 8 of 64 hold a pixel, 8 a time; the bounds of files come from a sample, hence the room
    assert _scanned(history) <= n * n // 3 and _scanned(moment) <= n * n // 3
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        files.write_cube(df, f"{tmp_path}/pixels", lanes=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by_pixel = files.read_cube(spark, f"{tmp_path}/pixels", **hour)
    assert by_pixel.count() == n and _scanned(by_pixel) == n * n  # what the order of pixels can't skip


def test_curve_cube_of_odd_tables(spark, tmp_path):
    schema = "time timestamp_ntz, pixel int, height int, ws double, lane_name string"
    rows = [(None, 3, 80, 1.0, "a"), (dt.datetime(2001, 1, 1), None, 80, 2.0, "b"), (dt.datetime(2001, 1, 1), 3, 80, 3.0, None), (dt.datetime(2001, 1, 1), 3, 80, 3.0, None)]
    for name, some in (("some", rows), ("one", rows[2:3]), ("none", [])):
        df = spark.createDataFrame(some, schema)
        files.write_curve_cube(df, f"{tmp_path}/{name}")
        got = [] if not some else files.read_cube(spark, f"{tmp_path}/{name}").select(df.columns).collect()
        assert sorted(map(str, got)) == sorted(map(str, df.collect()))


def test_curve_takes_bits_in_turns(spark):
    from windgrid.functions import curve

    got = spark.range(64).selectExpr("id % 8 AS x", "id DIV 8 AS y").withColumn("z", curve.interleaved(F.col("x"), F.col("y"), 3)).collect()
    assert sorted(r["z"] for r in got) == list(range(64))
    assert all(r["z"] == int("".join(a + b for a, b in zip(f"{r['y']:03b}", f"{r['x']:03b}")), 2) for r in got)


def test_vectors_and_arrays_round_trip(spark):
    df = spark.createDataFrame([("m1", k, k / 7, -k / 3) for k in range(20)] + [("m2", 0, 5.0, 6.0)], "name string, at int, a double, b double")
    back = files.parse_npy(files.npy_contents(df, "name", "at", "a")).collect()
    assert {(r["path"], r["place"]): r["value"] for r in back} == {("m1", k): k / 7 for k in range(20)} | {("m2", 0): 5.0}
    z = {r["path"]: r for r in files.parse_npz(files.npz_contents(df, "name", "at", ["a", "b"]), ["b", "a"]).collect()}
    assert np.allclose(z["m1"]["b"], [-k / 3 for k in range(20)]) and list(z["m2"]["a"]) == [5.0]


def test_settings_and_fetches(spark):
    lines = spark.createDataFrame([(1, 0, "export A='x # y' # z"), (1, 1, "B=2"), (1, 2, "B = 3 # c"), (1, 3, "#C=1"), (1, 4, "noise"), (2, 0, "A="), (2, 1, 'D="open')], "site int, n int, line string")
    found = config.settings(lines, spark.createDataFrame([(1, "B", "env")], "site int, key string, value string"))
    assert {(r["site"], r["key"]): r["value"] for r in found.collect()} == {(1, "A"): "x # y", (1, "B"): "env", (2, "A"): "", (2, "D"): "open"}
    assert {tuple(r) for r in config.missing(found, ["A", "B"]).collect()} == {(2, "A"), (2, "B")}
    have = spark.createDataFrame([(1, 10), (2, 0), (2, None)], "k int, bytes int")
    assert {tuple(r) for r in campaign.to_fetch(spark.range(1, 4).select(F.col("id").cast("int").alias("k")), have, "k").collect()} == {(2, "empty"), (3, "missing")}


def test_quantiles_leave_out_what_is_not_finite(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (None, float("nan"), inf, -inf, inf, 1.0, 2.0, 4.0, 8.0, 1e308, -1e308)], "v double")
    x = [1.0, 2.0, 4.0, 8.0, 1e308, -1e308]
    for few in (1, 2, 100):
        assert quantiles.quantiles(df, F.col("v"), [0.0, 0.2, 0.4, 0.6, 1.0], few) == sorted(x)[:4] + [max(x)]
    assert quantiles.quantiles(df.where("v = double('inf')"), F.col("v"), [0.5]) == [None]


def test_quantiles_narrow_ranges(spark):
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=3000), np.repeat([1.0, 5.0], 1500), np.concatenate([rng.exponential(size=2900), [1e9] * 100]), np.array([3.0]), np.array([-1e308, 1e308, 0.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        for few in (50, 100_000):
            assert quantiles.quantiles(df, F.col("v"), [0.0, 0.01, 0.5, 0.95, 1.0], few) == pytest.approx(np.quantile(x, [0, 0.01, 0.5, 0.95, 1]).tolist(), rel=1e-12)
    assert quantiles.quantiles(df.limit(0), F.col("v"), [0.5]) == [None]


def test_fill_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    cells = {(i, j): (rng.random() if rng.random() < 0.12 and not 8 <= i <= 15 else None) for i in range(20) for j in range(24)}
    out = {(r["i"], r["j"]): r["v"] for r in grid.fill_nearest(spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "i int, j int, v double"), "v").collect()}
    known = [(i, j, v) for (i, j), v in cells.items() if v is not None]
    assert out == {(a, b): min(((a - i) ** 2 + (b - j) ** 2, i, j, v) for i, j, v in known)[3] for a, b in cells}


def test_random_draws(record):
    drawn = metrics.random_draws(record, 3, 5, 7).toPandas()
    assert drawn.groupby("draw").day.nunique().between(5, 15).all() and not drawn.duplicated().any() and drawn.draw.nunique() == 7
    whole = record.select(F.to_date("time").alias("day")).distinct().withColumn("draw", F.lit(0))
    bias = metrics.draw_bias(record, whole, F.floor(F.col("wd") / 30).cast("int"), 12).first()
    assert all(abs(bias[c]) < 1e-9 for c in ("ws", "energy", "a", "k", "freq_mae", "energy_mae", "energy_max"))


def test_shared_folder_must_be_set_on_a_cluster():
    class Context:
        def __init__(self, master):
            self.master, self.getCheckpointDir = master, lambda: None

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), self

        def get(self, *_):
            return None

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            scratch.shared_dir(Session(master))


def test_wps_files(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    data = wps.encode("2001-01-01_00", "TT", 100.0, a, 10.0, 250.0, 1.0, 1.0) + wps.encode("2001-01-01_00", "UU", 1.0, a * 2, 10.0, 250.0, 1.0, 1.0)
    (tmp_path / "ok").write_bytes(data)
    (tmp_path / "cut").write_bytes(data[:-7])
    (tmp_path / "lambert").write_bytes(wps.encode("2001-01-01_00", "TT", 1.0, a, code=3))
    rows = wps.read(spark, str(tmp_path), wanted=["UU"], point=(12.2, -108.9)).collect()
    by = {r["path"].rsplit("/", 1)[1]: r for r in rows if r["error"] is None}
    assert set(by) == {"ok"} and (by["ok"]["i"], by["ok"]["j"], by["ok"]["value"]) == (1, 2, 18.0)
    assert sum(r["error"] is not None for r in rows) == 1  # the cut one; the other projection isn't asked for
    assert [r["error"] for r in wps.read(spark, str(tmp_path), "lambert").collect()][0].startswith("projection")
    assert wps.read(spark, str(tmp_path), "ok").count() == 24


def test_model_log(spark):
    lines = ["Timing for main: time 2001-01-01_00:00:08 on domain   1:   10.5 elapsed seconds", "Timing for main (dt=  1.33): time 2001-01-01_00:00:08 on domain   5:    2.0 elapsed seconds",
             "Timing for main: time 2001-13-01_00:00:08 on domain   1:   10.5 elapsed seconds", "Timing for Writing x", ""]
    out = modellog.parse(spark.createDataFrame([(x,) for x in lines], "line string")).orderBy("domain").collect()
    assert [(r["domain"], r["elapsed"]) for r in out] == [(1, 10.5), (5, 2.0)]


def test_csv_and_npz_sources(spark, tmp_path):
    (tmp_path / "hub.csv").write_text("exported by\ntime,a,b,c,d\n2001-01-01 00:00:00,5.5,180,280,900\n")
    assert files.read_csv(spark, str(tmp_path / "hub.csv"), files.HUB, preamble=True).first()["wd"] == 180
    (tmp_path / "sel.csv").write_text("start,days,weight\n2001-01-01,1,0.02\n")
    assert files.read_csv(spark, str(tmp_path / "sel.csv"), files.SELECTION).first()["days"] == 1
    np.savez(tmp_path / "x.npz", u=np.ones((2, 3)))
    assert list(files.read_npz(spark, str(tmp_path / "x.npz"), ["u"]).first()["u"]) == [1.0] * 6
    df = spark.createDataFrame([(1.23456, "a")], "x double, y string")
    files.write_csv(df, str(tmp_path / "out"))
    assert "1.2346,a" in {r[0] for r in spark.read.text(str(tmp_path / "out")).collect()}
    cube = spark.createDataFrame([(dt.datetime(2001, 1, 1), p, h, 1.0) for p in range(4) for h in (80, 100)], "time timestamp_ntz, pixel int, height int, ws double")
    files.write_cube(cube, str(tmp_path / "cube"))
    assert spark.read.parquet(str(tmp_path / "cube")).where("height = 80").count() == 4


def test_config(tmp_path):
    p = tmp_path / "site.env"
    p.write_text("# note\nROOT=/a/b  # where\nNAME='x y'\nexport N=3\n")
    assert config.load(str(p), ("ROOT",), {"N": "4"}) == {"ROOT": "/a/b", "NAME": "x y", "N": "4"}
    with pytest.raises(KeyError):
        config.load(str(p), ("ABSENT",), {})


def test_weights_by_day(spark):
    steps = spark.createDataFrame([(dt.datetime(2001, 1, d, h),) for d in (1, 2) for h in range(24)], "time timestamp_ntz")
    runs = spark.createDataFrame([("b001", dt.date(2001, 1, 1), 0.25), ("b002", dt.date(2001, 1, 2), 0.75)], "run string, sample_start date, weight double")
    out = joins.weights_by_day(steps, runs)
    assert out.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    assert joins.unmatched_steps(steps, runs.where("run = 'b001'")).count() == 24


def test_nearest_node_of_far_points_equals_brute_force(spark):
    """Points among the nodes, in a hole, and far out on all sides; nodes in two clusters, some at equal distances."""
    rng = random.Random(14)
    nodes = [(k, 10 * (k % 2) + rng.uniform(0, 2), -7 + rng.uniform(0, 2)) for k in range(300)] + [(300, 5.0, 5.0), (301, -5.0, 5.0), (302, 5.0, 5.0)]
    points = [(k, rng.uniform(-3, 14), rng.uniform(-9, 8)) for k in range(60)] + [(100, 0.0, 5.0), (101, 500.0, 0.0), (102, -900.0, 731.5), (103, 0.0, -77.0), (104, 6.0, 1000.0)]
    out = joins.nearest_node(spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(nodes, "id int, x double, y double"), "p", ["id"], 0.5).collect()
    want = {p: min(((a - x) ** 2 + (b - y) ** 2, k) for k, x, y in nodes) for p, a, b in points}
    assert {r["p"]: r["id"] for r in out} == {p: k for p, (_, k) in want.items()}
    assert all(r["dist"] == pytest.approx(math.sqrt(want[r["p"]][0])) for r in out)
    empty = spark.createDataFrame([], "id int, x double, y double")
    assert joins.nearest_node(spark.createDataFrame(points, "p int, x double, y double"), empty, "p", ["id"], 0.5).count() == 0


def test_nearest_node_distance_limit(spark):
    points = spark.createDataFrame([(1, 501.0, 0.0)], "p int, x double, y double")
    nodes = spark.createDataFrame([(7, 0.0, 0.0)], "id int, x double, y double")
    with pytest.raises(Exception, match="too far"):
        joins.nearest_node(points, nodes, "p", ["id"], 100.0, 500.0).collect()
    assert joins.nearest_node(points, nodes, "p", ["id"], 100.0, 502.0).first()["dist"] == 501.0


def test_restart_time_needs_all_domains(spark):
    have = spark.createDataFrame([("t1", d) for d in range(5)] + [("t2", d) for d in range(4)], "time string, domain int")
    assert [r[0] for r in joins.present_for_all(have, "time", "domain", 5).collect()] == ["t1"]


def test_fill_nearest_and_bilinear(spark):
    rows = [(i, j, None if (i, j) == (2, 2) else float(i + 10 * j)) for i in range(5) for j in range(5)]
    r = spark.createDataFrame(rows, "i int, j int, v double")
    filled = {(x["i"], x["j"]): x["v"] for x in grid.fill_nearest(r, "v").collect()}
    assert len(filled) == 25 and filled[2, 2] == 21.0
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 4.5, 0.0)], "p int, x double, y double")
    assert {x["p"]: x["value"] for x in grid.bilinear(pts, r, "p", "v").collect()} == {1: 5.5, 2: None}


def test_spectra_of_a_wave(spark):
    rows = [("low", i, j, math.sin(2 * math.pi * i / 32)) for i in range(32) for j in range(32)] + [("high", i, j, (-1.0) ** i) for i in range(32) for j in range(32)]
    df = spark.createDataFrame(rows, "f string, i int, j int, v double")
    shares = {(r["f"], r["band"]): r["share"] for r in spectra.band_shares(df, "f", "v").collect()}
    assert shares["low", 0] == pytest.approx(100) and shares["high", 3] == pytest.approx(100)
    assert {r["f"]: r["share"] for r in spectra.high_share(df, "f", "v").collect()} == pytest.approx({"low": 0, "high": 1}, abs=1e-9)


def test_nests(spark):
    d = nests.design(spark.createDataFrame([(1, 39_000.0, 40_800.0, 0.0, 0.0)], "box int, width double, height double, x double, y double"), "box").toPandas().sort_values("domain", ignore_index=True)
    assert len(d) == 5 and (d.gap_cells[1:] >= 15).all()
    assert ((d.nx[1:] % 3 == 0) & (d.ny[1:] % 3 == 0)).all()
    assert d.x1.iloc[4] - d.x0.iloc[4] >= 39_000 + 2 * nests.MARGIN


def test_wasserstein(spark):
    rows = [("a", 1, float(x)) for x in (0, 1, 2, 3)] + [("a", 2, float(x)) for x in (0, 0, 3, 3)]
    df = spark.createDataFrame(rows, "m string, y int, v double")
    got = {r["y"]: r["distance"] for r in metrics.wasserstein(df, df, ["m"], "y", "v").collect()}
    grid_ = np.arange(4)
    cdf = lambda xs: np.array([np.mean(np.array(xs) <= g) for g in grid_])
    for y in (1, 2):
        assert got[y] == pytest.approx(np.abs(cdf([r[2] for r in rows]) - cdf([r[2] for r in rows if r[1] == y]))[:-1].sum())


@pytest.mark.parametrize("seed", range(5))
def test_bounded_ls_meets_kkt(seed):
    rng = np.random.default_rng(seed)
    a, t = rng.normal(size=(40, 12)), rng.normal(size=40)
    g, r = a.T @ a, a.T @ t
    w = selection.bounded_ls(g, r, 0.3)
    pull = r - g @ w
    assert ((w >= 0) & (w <= 0.3)).all()
    assert (pull[w <= 0] <= 1e-8).all() and (pull[w >= 0.3] >= -1e-8).all() and np.allclose(pull[(w > 0) & (w < 0.3)], 0, atol=1e-8)


def test_selection(record):
    blocks, a, t = selection.design_matrix(record, 2)
    chosen, w, d = selection.select_weighted(blocks, a, t, 5, screen=40)
    assert len(set(chosen)) == 5 and w.sum() == pytest.approx(1) and (w >= 0).all()
    starts = np.sort(blocks.start[chosen])
    assert (np.diff(starts) >= 2).all()
    greedy = selection.select_weighted(blocks, a, t, 5, screen=40, refine=False)
    assert d <= greedy[2] + 1e-9
    equal = selection.select_weighted(blocks, a, t, 5, weighted=False, screen=40)
    assert equal[1].tolist() == [0.2] * 5
    best, after = selection.anneal(blocks, a, t, chosen, 0.6, 200, seed=3)
    assert after <= selection.Fitter(a, t, 0.6)(chosen)[1] + 1e-12 and len(best) == 5
    assert selection.random_blocks(blocks, 5, 1) == selection.random_blocks(blocks, 5, 1)


@pytest.fixture
def candidates(monkeypatch):
    """Queries search 600 made-up blocks, so that a screen of 250 leaves some out."""
    rng = np.random.default_rng(12)
    a = rng.dirichlet(np.full(257, 0.1), 600).T
    made = {length: (selection.Blocks(730_000 + np.arange(600), length), a, a.mean(1)) for length in (1, 2, 3, 5)}
    monkeypatch.setattr(selection, "design_matrix", lambda rows, length: made[length])
    return made


def searched(spark, name, found):
    """Whether a query returns these blocks with these weights."""
    blocks, chosen, w = found
    got = sorted((r["start"].toordinal(), r["weight"]) for r in QUERIES[name](spark, str(DATA / "sf0.001")).collect())
    return got == sorted((int(blocks.start[j]), round(float(x), 5)) for j, x in zip(chosen, w, strict=True))


def test_final_selection_is_the_whole_search(spark, candidates):
    blocks, a, t = candidates[1]
    chosen, w, d = selection.select_weighted(blocks, a, t, 40, 6 / 40, refine=True, screen=250)
    assert d < selection.select_weighted(blocks, a, t, 40, 6 / 40, refine=False, screen=40)[2]
    assert searched(spark, "sel15_final_selection", (blocks, chosen, w))


def test_smaller_selections_are_whole_searches(spark, candidates, monkeypatch):
    blocks, a, t = candidates[2]
    chosen, w, _ = selection.select_weighted(blocks, a, t, 6, screen=250)
    assert searched(spark, "sel3_greedy_swap", (blocks, chosen, w))
    best, d = selection.anneal(blocks, a, t, chosen, 0.5, moves=4000, seed=0)
    w = selection.Fitter(a, t, 0.5)(best)[0]
    assert searched(spark, "sel5_anneal", (blocks, best, w / w.sum()))
    assert d <= selection.Fitter(a, t, 0.5)(chosen)[1]
    blocks, a, t = candidates[1]
    chosen, w, _ = selection.select_weighted(blocks, a, t, 8, weighted=False, screen=250)
    assert searched(spark, "sel4_equal_weights", (blocks, chosen, w))


def test_sweeps_are_whole_searches(spark, candidates, monkeypatch):
    asked = [(length, k, bound, fitted) for _, _, length, k, bound, _, fitted in q_select.SWEEPS]
    geometry = [(length, k, 3.0, fitted) for length, k in ((1, 40), (2, 20), (3, 14), (5, 8), (1, 60), (2, 30), (3, 20)) for fitted in (False, True)]
    cost = [(length, k, 6.0, True) for length, k in ((1, 40), (2, 22), (3, 15), (5, 9), (1, 33), (2, 20), (3, 14), (5, 9))]
    assert asked == [(1, 40, bound, True) for bound in (1.5, 3.0, 6.0, 20.0)] + [(1, 40, 3.0, True)] * 3 + geometry + cost
    monkeypatch.setattr(q_select, "SWEEPS", [s for s in q_select.SWEEPS if s[3] < 15])
    got = {(r["sweep"], r["label"], r["days"]): r for r in QUERIES["sel13_sweeps"](spark, str(DATA / "sf0.001")).collect()}
    assert len(got) == len(q_select.SWEEPS)
    blocks, a, t = candidates[5]
    chosen, w, d = selection.select_weighted(blocks, a, t, 9, 6 / 9)
    r = got["cost", "6 h", 5]
    assert (r["distance"], r["ess"]) == (round(d, 6), round(float(1 / (w**2).sum()), 6))
    base = candidates[1][1]
    assert np.allclose((selection.reweighted(base, {"dir_stab": 4.0}) ** 2).sum() - (base**2).sum(), 3 * (base[144:204] ** 2).sum())


def test_candidates_are_evaluated_side_by_side():
    """The closed form of all options equals the search of each, whether weights lie on bounds or not."""
    rng = np.random.default_rng(4)
    a = rng.dirichlet(np.full(257, 0.1), 80).T
    for high, weighted in ((0.08, True), (0.3, True), (2.0, True), (0.3, False)):
        fit = selection.Fitter(a, a[:, :5].mean(1), high, weighted)
        for rest in ([], [3], [0, 1, 7, 30, 31], list(range(20))):
            options = [j for j in range(80) if j not in rest]
            assert np.allclose(fit.with_each(rest, options), [fit([*rest, j])[1] for j in options], atol=1e-8)


def test_additive_selectors(record):
    blocks, target = selection.additive_statistics(record, 3, 6)
    whole = {g: target[g][None] for g in target}
    assert selection.distance_v2(whole, target)[0] == pytest.approx(0)
    chosen, d = selection.select_additive(blocks, target, 4, selection.distance_v2)
    _, greedy = selection.select_additive(blocks, target, 4, selection.distance_v2, refine=False)
    assert d <= greedy and len(chosen) == 4


def test_campaign(spark):
    lines = spark.createDataFrame([(" end_day = 1,",), (" other = 1",)], "line string")
    assert [r[0] for r in lines.select(campaign.rewrite_setting(F.col("line"), "end_day", "9", 2)).collect()] == [" end_day = 9, 9,", " other = 1"]
    runs = spark.createDataFrame([("b001", dt.date(2001, 1, 1), 1), ("b002", dt.date(2001, 2, 1), 1)], "run string, sample_start date, days int")
    frames = spark.createDataFrame([("b001", 3)], "run string, frames int")
    assert {r["run"]: r["action"] for r in campaign.stage_plan(runs, frames).collect()} == {"b001": "skip", "b002": "stage"}
    assert campaign.stage_plan(runs, frames, force=True).where("action = 'skip'").count() == 0


def test_streaming_gives_the_batch_rows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), 1.0 + m, float(m * 6), h % 2) for h in range(6) for m in range(0, 60, 5)]
    spark.createDataFrame(rows, "time timestamp, ws double, wd double, pixel int").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed_rose(stream).writeStream.outputMode("complete").format("memory").queryName("rose").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM rose").collect())) == sorted(map(tuple, windows.windowed_rose(batch).collect()))


def test_namelist():
    from windgrid.sources import namelist

    text = namelist.render({"domains": {"max_dom": 2, "dx": [900.0, 300.0], "nest": [False, True], "name": "x"}})
    assert text == "&domains\n max_dom = 2,\n dx = 900.0, 300.0,\n nest = .false., .true.,\n name = 'x',\n/\n"


def test_rose_fidelity_beside_a_sector_of_calms(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(n, dt.datetime(2024, 1, 1), 1, "a", 0.0 if n % 2 else 5.0 + n, '{"k": 1}' if n % 2 else '{"k": 30}') for n in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want, got = con.execute(SQL["agg15_rose_fidelity"]).fetchall(), [tuple(r) for r in QUERIES["agg15_rose_fidelity"](spark, str(tmp_path)).collect()]
    assert repr(got) == repr(want) and math.isnan(got[0][-1])


def test_exchanges_end_beside_costs_that_waver():
    """A cost that comes out lower beside other options, by more than the tolerance: a block is as good as itself, and two sets as good as each other."""
    asked = []

    def cost(rest, options):
        asked.append(len(options))
        assert len(asked) < 200, "goes on for ever"
        return np.array([1.0 - (0.1 * (o in (3, 4))) - 1e-11 * (len(options) > 1) for o in options])

    assert len(selection.forward_and_swap(2, lambda rest: [o for o in range(9) if o not in rest], cost)) == 2
    made = selection.forward_and_swap(1, lambda rest: [o for o in range(9) if o not in rest], cost, chosen=[7])
    assert made == [3] or made == [4]
    assert selection.forward_and_swap(1, lambda rest: [5], cost, chosen=[5]) == [5]


def test_days_once_are_the_record(spark, record, monkeypatch):
    """Matrices of a record, of its days and of a part of them; the observations are read once for all."""
    days = selection.by_day(record)
    for part, own in ((record, days), (record.where("year(time) < 2001"), days.where("year(day) < 2001"))):
        (b1, a1, t1), (b2, a2, t2) = selection.design_matrix(part, 2), selection.design_matrix(own, 2)
        assert b1.start.tolist() == b2.start.tolist() and np.allclose(a1, a2, atol=1e-12) and np.allclose(t1, t2, atol=1e-12)
    made = []
    monkeypatch.setattr(selection.H, "with_bins", lambda df: made.append(df))
    selection.design_matrix(days, 1)
    assert not made


def test_grid_lines_are_cut_once(spark):
    lines = spark.createDataFrame([("GridPoint 100 200 30 100 6.5 2.1 300 1 500 60 210",), ("1 2 3",)], "line string")
    grid = wrg.parse(lines)
    assert [(r["e"], r["nsect"], r["sectors"][0]["k"]) for r in grid.collect()] == [(100.0, 1, 2.1)]
    assert grid._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_attributes_stand_beside_cells_without_a_join(spark):
    nc = netcdf.encode({"A": (["y", "x"], np.arange(6, dtype=">f8").reshape(2, 3))}, {"TITLE": "t", "DX": 100.0})
    made = spark.createDataFrame([("a.nc", nc), ("bad.nc", b"no")], "path string, content binary")
    got = netcdf.parse(made, ["A"], ("DX", "NONE"))
    assert {(r["value"], r["DX"], r["NONE"]) for r in got.where("error IS NULL").collect()} == {(float(n), "100.0", None) for n in range(6)}
    assert got.where("error IS NOT NULL").count() == 1
    assert "Join" not in QUERIES["src11_netcdf"](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
