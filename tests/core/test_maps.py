"""Windows over tiles, map pyramids and run trees, as files, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from windgrid.operators import campaign
from windgrid.sources import folder, maps, tiles, windows


@pytest.fixture(scope="module")
def raster(spark):
    """23 by 17 cells, a tile's worth of them without values."""
    rng = np.random.default_rng(1)
    a = rng.integers(-500, 3000, (17, 23)).astype(float)
    a[5:10, 10:15] = np.nan
    a[0, 0] = np.nan
    rows = [(i, j, float(a[j, i])) for j in range(17) for i in range(23)]
    return a, spark.createDataFrame(rows, "i int, j int, v double")


@pytest.fixture(scope="module")
def stored(spark, raster, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tiles"))
    folder.write(tiles.contents(raster[1], "v", 5, 2), to)
    return spark.read.format("binaryFile").load(to).select("path")


WINDOWS = [(1, 0, 0, 22, 16), (2, -7, -3, 4, 2), (3, 11, 6, 13, 8), (4, 20, 15, 40, 30), (5, 100, 100, 101, 100), (6, 9, 4, 15, 10), (6, 9, 4, 15, 10), (7, 5, 5, 4, 9), (8, None, 1, 2, 3), (None, 3, 3, 3, 3)]


def test_windows_are_the_raster(spark, raster, stored):
    a, _ = raster
    asked = spark.createDataFrame(WINDOWS, "window long, x0 int, y0 int, x1 int, y1 int")
    got = sorted(((r["window"] or 0, r["i"], r["j"], r["value"]) for r in windows.read(asked, stored, 5, 2).collect()), key=str)
    at = lambda i, j: float(a[j, i]) if 0 <= i < 23 and 0 <= j < 17 and not np.isnan(a[j, i]) else None
    want = [(w or 0, i, j, at(i, j)) for w, x0, y0, x1, y1 in WINDOWS if x0 is not None for j in range(y0, y1 + 1) for i in range(x0, x1 + 1)]
    assert got == sorted(want, key=str)
    assert not any(p["path"].endswith(tiles.name(2, 1, 5)) for p in stored.collect())  # the tile without values was never made
    assert windows.read(asked.limit(0), stored, 5, 2).collect() == []
    assert {r["value"] for r in windows.read(asked.where("window = 3"), stored.limit(0), 5, 2).collect()} == {None}


def test_only_the_rows_inside_are_read():
    """A part of 3 by 2 cells costs two reads of three cells."""

    class Counted:
        def __init__(self, data: bytes) -> None:
            self.data, self.place, self.read_bytes = data, 0, []

        def seek(self, place: int) -> None:
            self.place = place

        def read(self, n: int) -> bytes:
            self.read_bytes.append(n)
            return self.data[self.place : self.place + n]

    whole = np.arange(81, dtype=">i2")
    file = Counted(whole.tobytes())
    got = windows.cut(file, 2, 1, 11, 6, 13, 7, 5, 2)  # a tile of five cells with a border of two, its own cells from (10, 5)
    assert got.tolist() == [[30, 31, 32], [39, 40, 41]] and file.read_bytes == [6, 6]


def test_pyramid(spark, raster, tmp_path):
    a, df = raster
    held = {(r["level"], r["i"], r["j"]): (r["mean"], r["cells"]) for r in maps.levels(df, "v", 4).collect()}
    want = {}
    for level in range(4):
        step = 1 << level
        for i in range(0, 23, step):
            for j in range(0, 17, step):
                part = a[j : j + step, i : i + step]
                if (n := int(np.isfinite(part).sum())) > 0:
                    want[level, i // step, j // step] = (pytest.approx(np.nanmean(part)), n)
    assert held == want
    folder.write(maps.images(maps.levels(df, "v", 4), 0.0, 2550.0, 8), str(tmp_path))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = {(r["level"], r["i"], r["j"]): r["grey"] for r in maps.parse(files, 8).collect()}
    assert got.keys() == held.keys()
    assert all(got[k] == int(min(255, max(0, m / 10)) + 0.5) for k, (m, _) in held.items())
    assert files.count() == 9 + 4 + 1 + 1
    assert maps.images(maps.levels(df.limit(0), "v", 2), 0.0, 1.0).collect() == []


def test_png_is_one():
    grey, alpha = np.arange(12, dtype=np.uint8).reshape(3, 4), np.full((3, 4), 255, np.uint8)
    content = maps.png(grey, alpha)
    assert content.startswith(b"\x89PNG\r\n\x1a\n") and content.endswith(b"IEND\xaeB`\x82")
    back = maps.pixels(content)
    assert (back[0] == grey).all() and (back[1] == alpha).all()


def test_run_tree(spark, tmp_path):
    plan = spark.createDataFrame([("b001", "stage", "a é\n"), ("b002", "skip", "b"), ("b003", "stage", "c")], "run string, action string, text string")
    made = campaign.run_tree(plan, F.col("text"), F.array(F.lit("x.1"), F.lit("y.2")), "ws wd\n")
    for _ in range(2):
        folder.write(made, str(tmp_path))
    held = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    links = "x.1 -> ../../met/{0}/x.1\ny.2 -> ../../met/{0}/y.2\n"
    assert held == {f"{r}/{n}": t for r, text in (("b001", "a é\n"), ("b003", "c")) for n, t in (("namelist.input", text), ("links.txt", links.format(r)), ("fields.txt", "ws wd\n"))}
