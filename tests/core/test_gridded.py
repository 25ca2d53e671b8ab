"""The folder source of gridded binary files and the sink of whole files: filters in the reader, planning by size, broken files, repeated attempts."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull

from windgrid.sources import folder, gridded, wps

LEVELS = (("TT", 100.0), ("TT", 50.0), ("UU", 1.0))


def values(day: int, k: int) -> np.ndarray:
    return (np.arange(6 * 9).reshape(6, 9) + 1000 * day + 100 * k).astype(np.float32)


def content(day: int) -> bytes:
    return b"".join(wps.encode(f"2001-01-0{day}_00", name, level, values(day, k), 10.0, 250.0, 1.0, 1.0) for k, (name, level) in enumerate(LEVELS))


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    to = f"{tmp_path_factory.mktemp('gridded')}/record"
    made = [(f"y{d % 2}/F.{d}", content(d)) for d in range(1, 6)] + [("cut", content(9)[:-7]), ("lambert", wps.encode("2001-01-07_00", "TT", 1.0, values(1, 1), code=3)), ("empty", None)]
    folder.write(spark.createDataFrame(made, "path string, content binary").repartition(3), to)
    return to


def test_all_cells(spark, at):
    rows = gridded.read(spark, at).collect()
    good = [r for r in rows if r["error"] is None]
    assert len(good) == 54 * (5 * 3 + 2)  # the cut file has two whole fields
    for r in good:
        day, k = int(r["date"][9]), LEVELS.index((r["field"], r["level"]))
        assert r["value"] == values(day, k)[r["j"], r["i"]]
    bad = {os.path.basename(r["path"]): r["error"] for r in rows if r["error"] is not None}
    assert bad.keys() == {"cut", "lambert"} and bad["lambert"].startswith("projection") and "cut short" in bad["cut"]


def pushed(df) -> str:
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return next((line for line in plan.splitlines() if "PushedFilters" in line), "")


@pytest.mark.parametrize(
    ("condition", "inside"),
    [
        ("field = 'UU'", "EqualTo(field,UU)"),
        ("field = 'TT' AND level = 50.0", "EqualTo(level,50.0)"),
        ("field = 'TT' AND i IN (2, 5, 99) AND j = 3", "In(i, [2,5,99])"),
        ("j = 4", "EqualTo(j,4)"),
        ("date IN ('2001-01-02_00', 'x') AND value > 2010", "In(date"),
        ("error IS NOT NULL", "IsNotNull(error)"),
        ("error IS NULL AND i = 0", "IsNull(error)"),
        ("field = 'TT' AND field = 'UU'", ""),
        ("field = 'TT' OR i = 3", ""),
    ],
)
def test_filters_go_into_the_reader(spark, at, condition, inside):
    got = gridded.read(spark, at).where(condition)
    assert inside in pushed(got)
    every = spark.createDataFrame(gridded.read(spark, at).collect(), wps.KINDS)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.where(condition).collect()))


def test_what_a_filter_leaves_out():
    reader = gridded._Reader({"path": "/x"})
    left = list(reader.pushFilters([EqualTo(("field",), "TT"), In(("field",), ["TT", None, "UU"]), GreaterThan(("value",), 3), IsNotNull(("i",)), IsNull(("error",)), IsNull(("level",)), EqualTo(("error",), "x")]))
    assert [type(f) for f in left] == [GreaterThan, IsNull, EqualTo]
    assert reader.wanted.values == {"field": {"TT"}} and not reader.wanted.errors and reader.wanted.cells


def test_bytes_read(spark, at):
    """A point of one field costs the records' lengths, the headers, one grid and one number; a whole read costs all data."""
    found = {os.path.basename(r["path"]): r for r in gridded.read(spark, at, rows="files", fields="UU", lat=12.2, lon=253.4).collect()}
    whole = {os.path.basename(r["path"]): r for r in gridded.read(spark, at, rows="files").collect()}
    assert found["F.1"]["bytes"] == len(content(1)) and found["F.1"]["bytes_read"] == 15 * 4 + 3 * 156 + 16 + 4
    assert whole["F.1"]["bytes_read"] == 15 * 4 + 3 * (156 + 16 + 54 * 4)
    assert (whole["F.1"]["fields"], whole["cut"]["fields"], whole["empty"]["fields"], whole["empty"]["bytes"]) == (3, 2, 0, 0)
    assert whole["cut"]["error"] and whole["lambert"]["error"] and whole["empty"]["error"] is None


def test_nearest_cell(spark, at):
    got = gridded.read(spark, at, lat=12.2, lon=-106.6).where("field = 'UU' AND error IS NULL").collect()
    assert {(r["i"], r["j"]) for r in got} == {(3, 2)}
    assert {r["value"] for r in got} == {float(values(d, 2)[2, 3]) for d in range(1, 6)}


def test_tasks_by_size(spark, at):
    files = [("a", 10), ("b", 70 << 20), ("c", 1 << 20), ("d", 1 << 20), ("e", 0)]
    assert [[p for p, _ in s.files] for s in gridded.planned(files, 64 << 20)] == [["a"], ["b"], ["c", "d", "e"]]
    assert gridded.planned([], 1) == []
    assert len(gridded.planned([(str(k), 1000) for k in range(75_488)], 64 << 20)) == -(-75_488 // 63)
    assert gridded.read(spark, at).rdd.getNumPartitions() == 1
    assert gridded.read(spark, at, bytes_a_task=1).rdd.getNumPartitions() == 8


def test_one_file_and_an_empty_folder(spark, at, tmp_path):
    assert gridded.read(spark, f"{at}/y1/F.1").count() == 3 * 54
    assert gridded.read(spark, str(tmp_path)).count() == 0


def test_sink_repeats_safely(spark, tmp_path):
    """A failed task leaves whole files only; the next attempt replaces them; names of attempts are gone."""
    to = tmp_path / "tree"
    rows = [(f"run{k % 3}/part/{k}", bytes([k]) * 1000) for k in range(30)]
    with pytest.raises(Exception, match="without a path"):
        folder.write(spark.createDataFrame([*rows[:20], (None, b"x")], "path string, content binary").coalesce(1), str(to))
    assert all(p.stat().st_size == 1000 for p in to.rglob("*") if p.is_file())
    for _ in range(2):
        folder.write(spark.createDataFrame(rows, "path string, content binary").repartition(4), f"file://{to}")
    held = {str(p.relative_to(to)): p.read_bytes() for p in to.rglob("*") if p.is_file()}
    assert held == dict(rows)
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame(rows, "path string, content binary").write.format(folder.FORMAT).mode("overwrite").save(str(to))


def test_cells_through_sql(spark, at):
    gridded.register(spark)
    spark.read.format(gridded.FORMAT).load(at).createOrReplaceTempView("gridded_cells")
    got = spark.sql("SELECT field, count(*) AS n, max(value) AS top FROM gridded_cells WHERE field IN ('TT', 'UU') AND date = '2001-01-03_00' GROUP BY field ORDER BY field").collect()
    assert [tuple(r) for r in got] == [("TT", 108, 3153.0), ("UU", 54, 3253.0)]
    spark.catalog.dropTempView("gridded_cells")
    assert gridded.read(spark, at).where(F.col("field") == "none").count() == 0
