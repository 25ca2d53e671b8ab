"""The jobs on small copies: growing input, reruns, failures half-way, odd rows, and the command line."""

from __future__ import annotations

import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import jobs
from jobs import resource_grid, text_profile
from windgrid.operators.weibull import solve
from windgrid.sources import wrg

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, feature string"


def rows_of(df) -> list[str]:
    return sorted(map(str, df.collect()))


def some_docs(first: int, n: int) -> list[tuple]:
    texts = ["", None, "one two three\nfour 5 66", "word " * 50, "a long line of text " * 30, "7 8 9 10", "\n\n\n"]
    return [(k, texts[k * 7 % 5 + k % 3], ["en", "de", None][k % 3], [None, "a", "b", "a"][k % 4], 0, "clash") for k in range(first, first + n)]


def add(spark, rows: list[tuple], folder) -> None:
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def plain_report(rows: list[tuple]) -> set[tuple]:
    """feature, source, bin, n and tv of the features lang and words, in plain Python."""
    found = [(source or "(none)", {"lang": lang or "(none)", "words": str(sum(len((text or "").split()) >= e for e in (20, 100, 300, 1000, 3000)))}) for _, text, lang, source, *_ in rows]
    out = set()
    for feature in ("lang", "words"):
        whole = Counter(f[feature] for _, f in found)
        for source in {s for s, _ in found}:
            own = Counter(f[feature] for s, f in found if s == source)
            tv = round(50 * sum(abs(own[b] / own.total() - n / whole.total()) for b, n in whole.items()), 6)
            out |= {(feature, source, b, own[b], tv) for b in whole}
    return out


def read_report(spark, out) -> set[tuple]:
    df = spark.read.schema(text_profile.REPORT).parquet(str(out))
    return {(r["feature"], r["source"], r["bin"], r["n"], r["tv"]) for r in df.where("feature IN ('lang', 'words')").collect()}


def test_profile_takes_only_what_is_new(spark, tmp_path):
    docs, out, state = (str(tmp_path / n) for n in ("docs", "out", "state"))
    add(spark, some_docs(0, 40), docs)
    first = text_profile.run(spark, docs, out, state)
    assert (first["documents"], first["batches"]) == (40, 1)
    assert read_report(spark, out) == plain_report(some_docs(0, 40))
    same = rows_of(spark.read.parquet(out))
    again = text_profile.run(spark, docs, out, state)  # nothing new: nothing read, the same report
    assert (again["documents"], again["batches"], again["rows"]) == (0, 0, first["rows"])
    assert rows_of(spark.read.parquet(out)) == same
    add(spark, some_docs(40, 25), docs)
    add(spark, [(900, "neu " * 400, "fr", "new source", 0, "x")], docs)
    grown = text_profile.run(spark, docs, out, state)
    assert grown["documents"] == 26
    every = [*some_docs(0, 65), (900, "neu " * 400, "fr", "new source")]
    assert read_report(spark, out) == plain_report(every)
    whole = str(tmp_path / "at once")
    text_profile.run(spark, docs, whole, str(tmp_path / "other state"))
    assert rows_of(spark.read.parquet(whole)) == rows_of(spark.read.parquet(out))


def test_profile_in_small_batches(spark, tmp_path):
    docs = str(tmp_path / "docs")
    for k in range(5):
        add(spark, some_docs(10 * k, 10), docs)
    done = text_profile.run(spark, docs, str(tmp_path / "out"), str(tmp_path / "state"), text_profile.Settings(files_a_batch=2))
    assert (done["documents"], done["batches"]) == (50, 3)
    assert read_report(spark, tmp_path / "out") == plain_report(some_docs(0, 50))


def test_profile_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that failed after its counts were written is counted once."""
    docs, out, state = (str(tmp_path / n) for n in ("docs", "out", "state"))
    add(spark, some_docs(0, 30), docs)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(text_profile.log, "info", fails)  # the first thing after a batch's counts are written
        with pytest.raises(Exception, match="lost"):
            text_profile.run(spark, docs, out, state)
    assert list((tmp_path / "state" / "counts" / "batch=0").glob("*.parquet"))
    add(spark, some_docs(30, 10), docs)
    text_profile.run(spark, docs, out, state)
    assert read_report(spark, out) == plain_report(some_docs(0, 40))


def test_profile_of_nothing(spark, tmp_path):
    docs, out, state = (str(tmp_path / n) for n in ("docs", "out", "state"))
    spark.createDataFrame([], DOCS).write.parquet(docs)
    for _ in range(2):
        assert text_profile.run(spark, docs, out, state)["rows"] == 0
    add(spark, some_docs(0, 8), docs)
    text_profile.run(spark, docs, out, state)
    assert read_report(spark, out) == plain_report(some_docs(0, 8))


RECORD = "l_orderkey long, l_quantity double, l_partkey long, l_suppkey long, l_tax double, height string"


def record(n: int) -> list[tuple]:
    rng = np.random.default_rng(4)
    rows = [(k % 5, float(rng.integers(1, 51)), int(rng.integers(0, 90)), int(rng.integers(0, 90)), int(rng.integers(0, 9)) / 100, "clash") for k in range(n)]
    return [*rows, (0, float("nan"), 1, 1, 0.0, "x"), (1, None, 1, 1, 0.0, "x"), (None, 5.0, 1, 1, 0.0, "x"), (2, 5.0, 1, 1, -0.5, "x"), (3, 5.0, None, 1, 0.0, "x"), rows[0], rows[0]]


def test_grid_is_the_weighted_fit(spark, tmp_path):
    at, out = str(tmp_path / "record"), str(tmp_path / "out")
    spark.createDataFrame(record(400), RECORD).write.parquet(at)
    done = resource_grid.run(spark, at, out)
    assert done == {"rows": 407, "left_out": 5, "cells": 20, "lines": 20}
    grid = spark.read.parquet(f"{out}/grid").collect()
    good = [r for r in record(400) if None not in r[:5] and math.isfinite(r[1]) and r[4] >= 0]
    for r in grid:
        own = [x for x in good if x[0] % 64 == r["pixel"]]
        k, a = solve(np.array([x[1] / 2 for x in own]), np.array([1 + x[4] * 10 for x in own]))
        f = (r["height"] / 100) ** 0.14
        assert math.isclose(r["k"], k, rel_tol=1e-9) and math.isclose(r["a"], a * f, rel_tol=1e-9)
        assert len(r["sectors"]) == 16 and math.isclose(sum(s["freq"] for s in r["sectors"]), 1000)
    text = wrg.parse(spark.read.text(f"{out}/text"), "value").collect()
    want = {(r["height"], r["pixel"]): r for r in grid}
    for t in text:
        r = want[int(t["height"]), int(t["e"] / 100 + 8 * t["n"] / 100)]
        assert math.isclose(t["k"], r["k"], abs_tol=1e-4) and math.isclose(t["pd"], r["pd"], abs_tol=1e-4)
        assert all(math.isclose(a["a"], (b["a"] or 0) / 10, abs_tol=1e-4) for a, b in zip(t["sectors"], r["sectors"], strict=True))
    assert [tuple(h) for h in wrg.header(spark.read.text(f"{out}/header").where("height = 80"), "value").collect()] == [(8, 1, 0.0, 0.0, 100.0)]


def test_grid_again_and_other_heights(spark, tmp_path):
    at, out = str(tmp_path / "record"), str(tmp_path / "out")
    spark.createDataFrame(record(200), RECORD).write.parquet(at)
    first = resource_grid.run(spark, at, out)
    same = {d: rows_of(spark.read.format("parquet" if d == "grid" else "text").load(f"{out}/{d}")) for d in ("grid", "text", "header")}
    assert resource_grid.run(spark, at, out) == first
    assert {d: rows_of(spark.read.format("parquet" if d == "grid" else "text").load(f"{out}/{d}")) for d in same} == same
    more = resource_grid.run(spark, at, out, resource_grid.Settings(heights="100, 200"))
    assert more["cells"] == 10
    assert {r["height"]: r["count"] for r in spark.read.parquet(f"{out}/grid").groupBy("height").count().collect()} == dict.fromkeys((80, 100, 120, 160, 200), 5)
    assert not spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower().startswith("dynamic")


def test_grid_of_nothing(spark, tmp_path):
    at = str(tmp_path / "record")
    spark.createDataFrame([], RECORD).write.parquet(at)
    assert resource_grid.run(spark, at, str(tmp_path / "out")) == {"rows": 0, "left_out": 0, "cells": 0, "lines": 0}


def test_settings(spark):
    for module, name in ((resource_grid, "resource_grid"), (text_profile, "text_profile")):
        found = jobs.common.settings(spark, f"file://{ROOT}/jobs/{name}.conf")
        assert module.Settings.of(found) == module.Settings()  # the files hold the values of the registered queries
        with pytest.raises(KeyError):
            module.Settings.of({"no such": "1"})


def test_command_line(spark, tmp_path):
    add(spark, some_docs(0, 20), tmp_path / "docs")
    conf = tmp_path / "my.conf"
    conf.write_text("words=2, 40\nfar=10\n")
    call = [sys.executable, "-m", "jobs.text_profile", "--config", str(conf), "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "--state", str(tmp_path / "state")]
    for documents in (20, 0):
        got = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert got.returncode == 0, got.stderr[-2000:]
        assert f"read {documents} new documents" in got.stderr
    assert {r["bin"] for r in spark.read.parquet(str(tmp_path / "out")).where("feature = 'words'").collect()} <= {"0", "1", "2"}


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_registered_runs_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tests.conftest import DATA

    sf = DATA / "sf0.001"
    if not sf.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in sf.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = c.execute(jobs.SQL[name])
    place = {d[0]: k for k, d in enumerate(cursor.description)}
    df = jobs.QUERIES[name](spark, str(sf))
    assert sorted(df.columns) == sorted(place)
    want = sorted(str(tuple(r[place[n]] for n in df.columns)) for r in cursor.fetchall())
    assert want and sorted(str(tuple(r)) for r in df.collect()) == want
