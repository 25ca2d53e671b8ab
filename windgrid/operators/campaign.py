"""Bookkeeping of simulation campaigns: plans are DataFrames, nothing is submitted or deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.campaign import block_window


def number_runs(blocks: DataFrame, order: list) -> DataFrame:
    """run (b001, b002, ...) before the columns of blocks. A campaign is some hundred runs, so one ordering is fine."""
    n = F.row_number().over(Window.orderBy(*order))
    return blocks.select(F.concat(F.lit("b"), F.lpad(n.cast("string"), 3, "0")).alias("run"), *blocks.columns)


def stage_plan(manifest: DataFrame, frames: DataFrame, force: bool = False) -> DataFrame:
    """manifest with its window and action: a run that has output is kept ("skip") unless forced. frames: run, frames."""
    begin, end, last = block_window(F.col("sample_start").cast("timestamp_ntz"), F.col("days"))
    both = manifest.join(frames, "run", "left")
    keep = (F.coalesce("frames", F.lit(0)) > 0) & F.lit(not force)
    return both.select("run", begin.alias("begin"), end.alias("end"), last.alias("wrf_end"), F.when(keep, "skip").otherwise("stage").alias("action"))


def status(frames: Column, expected: int, queued: Column, failed: Column) -> Column:
    return F.when(frames >= expected, "complete").when(failed, "fail").when(queued, "running").otherwise("pending")


def incomplete(facts: DataFrame, queue: DataFrame, expected: int) -> DataFrame:
    """Runs with some but not all frames that aren't queued. facts: run, frames."""
    return facts.where((F.col("frames") > 0) & (F.col("frames") < expected)).join(queue.select("run"), "run", "left_anti")


def rewrite_setting(line: Column, key: str, value: str, repeat: int = 5) -> Column:
    """A namelist line `key = ...` with the value once for each domain; other lines unchanged."""
    return F.regexp_replace(line, rf"^(\s*{key}\s*=).*$", "$1 " + ", ".join([value] * repeat) + ",")


def job_chain(runs: DataFrame, steps: list[str]) -> DataFrame:
    """run, step, job, after: each run's jobs in order, each after the one before."""
    names = F.array(*map(F.lit, steps))
    each = runs.select("run", F.posexplode(names).alias("position", "step"))
    job = F.concat_ws("-", "run", "step")
    return each.select("run", "step", job.alias("job"), F.when(F.col("position") > 0, F.concat_ws("-", "run", F.get(names, F.col("position") - 1))).alias("after"))


def block_lines(lines: DataFrame, marker: str, order: str = "n", column: str = "line") -> DataFrame:
    """lines with block: the text after the last marker line at or before each. A table file is small and ordered as one."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col(column).rlike(marker), F.regexp_extract(column, marker, 1))
    return lines.withColumn("block", F.last(named, ignorenulls=True).over(w))


def to_fetch(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """key, reason: what isn't there yet ("missing") or is there without content ("empty"). have: key, bytes."""
    held = have.groupBy(key).agg(F.max("bytes").alias("_bytes"))
    both = want.select(key).join(held, key, "left")
    return both.where("_bytes IS NULL OR _bytes <= 0").select(key, F.when(F.col("_bytes").isNull(), "missing").otherwise("empty").alias("reason"))


def fetch_log(attempts: DataFrame, key: str) -> DataFrame:
    """key, tries, failures, last: a row for each thing that was tried; last is its latest outcome ("ok" or the failure). attempts: key, at, bytes, error."""
    failed = F.col("error").isNotNull() | (F.coalesce("bytes", F.lit(0)) <= 0)
    outcome = F.when(F.col("error").isNotNull(), F.col("error")).when(failed, "empty").otherwise("ok")
    return attempts.groupBy(key).agg(F.count(F.lit(1)).alias("tries"), F.count_if(failed).alias("failures"), F.max_by(outcome, "at").alias("last"))


def run_tree(plan: DataFrame, settings: Column, inputs: Column, fields: str) -> DataFrame:
    """path, content of every file of the runs that a plan (run, action) stages: the settings, the list of inputs to link, the list of output fields.

    settings: the run's namelist text. inputs: array of the names of its input files; they stay where they are, and the list names each with
    its place relative to the run.
    """
    links = F.array_join(F.transform(inputs, lambda f: F.concat(f, F.lit(" -> ../../met/"), F.col("run"), F.lit("/"), f)), "\n")
    made = {"namelist.input": settings, "links.txt": F.concat(links, F.lit("\n")), "fields.txt": F.lit(fields)}
    each = F.array(*[F.struct(F.lit(name).alias("name"), text.alias("text")) for name, text in made.items()])
    return plan.where("action = 'stage'").select("run", F.inline(each)).select(F.concat_ws("/", "run", "name").alias("path"), F.encode("text", "UTF-8").alias("content"))
