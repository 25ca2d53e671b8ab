"""What the jobs share: settings, a session for the command line, folders for registered runs, the log."""

from __future__ import annotations

import logging
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from windgrid.scratch import shared_dir
from windgrid.sources.config import parse

log = logging.getLogger("windgrid.jobs")


def settings(spark: SparkSession, path: str | None) -> dict[str, str]:
    """KEY=VALUE settings of a file that Spark can read; none without a path."""
    if not path:
        return {}
    return parse("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # a small file


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


def main(name: str, work: Callable[[SparkSession], object]) -> None:
    """Runs a job from the command line, in a session of its own."""
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark)
    finally:
        spark.stop()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one registered run, beside the cluster's checkpoints; its files stay."""
    return f"{shared_dir(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"
