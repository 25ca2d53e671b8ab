"""Gives this package to the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the workers' path, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="windgrid-")) / "windgrid_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(to))
    _SHIPPED.add(context.applicationId)
