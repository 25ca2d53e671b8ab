"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship  # noqa: F401
from ..scratch import durable  # noqa: F401

#: ASCII white space of the word contract: 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from stage to stage, and what each keeps would add up."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; F.lower would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(rows: int | None, each: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many buckets of about `each` hold `rows`."""
    return max(least, min(most, -(-int(rows or 0) // each)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixer (splitmix64 finaliser) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
