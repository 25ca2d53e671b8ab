"""Maps of a raster as a pyramid of image tiles: each level has half the cells of the one below a side.

A level is made of the one below by adding up sums and counts, so a mean is that of all cells with a value
that it covers. Tiles are 8-bit grey images (PNG) with an alpha channel, 0 where no cell has a
value; a task holds one tile. They are rows of path and content, written by `folder`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
TILE = 256


def levels(raster: DataFrame, value: str, n: int) -> DataFrame:
    """level, i, j, mean, cells of levels 0 (the raster's own cells) to n - 1. raster: i, j from 0, value; cells without one count nowhere."""
    known = raster.select("i", "j", F.col(value).cast("double").alias("sum")).where("sum IS NOT NULL AND NOT isnan(sum)")
    level = known.groupBy("i", "j").agg(F.sum("sum").alias("sum"), F.count("*").alias("cells")).withColumn("level", F.lit(0))
    out = level
    for k in range(1, n):
        half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
        level = level.groupBy(half("i"), half("j")).agg(F.sum("sum").alias("sum"), F.sum("cells").alias("cells")).withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out.select("level", "i", "j", (F.col("sum") / F.col("cells")).alias("mean"), "cells")


def grey(value: Column, low: float, high: float) -> Column:
    """0 to 255 from low to high, clipped."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))) * 255 + 0.5).cast("int")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(grey: np.ndarray, alpha: np.ndarray) -> bytes:
    """An image of 8-bit grey and alpha, north row first."""
    rows = np.zeros((grey.shape[0], 1 + 2 * grey.shape[1]), np.uint8)
    rows[:, 1::2], rows[:, 2::2] = grey, alpha
    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 4, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def pixels(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Grey and alpha of an image that png() made."""
    width, height = struct.unpack_from(">II", content, 16)
    at, data = 8, b""
    while at < len(content):
        (n,), kind = struct.unpack_from(">I", content, at), content[at + 4 : at + 8]
        data += content[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 2 * width)
    return rows[:, 1::2], rows[:, 2::2]


def images(pyramid: DataFrame, low: float, high: float, size: int = TILE) -> DataFrame:
    """path (level/column/row.png), content of a pyramid's tiles (level, i, j, mean); rows of images run from north (greatest j) to south."""
    ship(pyramid.sparkSession)
    cells = pyramid.select("level", "i", "j", grey(F.col("mean"), low, high).alias("grey"))
    cells = cells.withColumns({"tx": F.floor(F.col("i") / size), "ty": F.floor(F.col("j") / size)})

    def run(x: pa.Table) -> pa.Table:
        level, tx, ty = (x[c][0].as_py() for c in ("level", "tx", "ty"))
        i, j = x["i"].to_numpy() - tx * size, x["j"].to_numpy() - ty * size
        shade, alpha = np.zeros((2, size, size), np.uint8)
        shade[size - 1 - j, i], alpha[size - 1 - j, i] = x["grey"].to_numpy(), 255
        return pa.table({"path": [f"{level}/{tx}/{ty}.png"], "content": pa.array([png(shade, alpha)], pa.binary())})

    return cells.groupBy("level", "tx", "ty").applyInArrow(run, "path string, content binary")


def parse(files: DataFrame, size: int = TILE) -> DataFrame:
    """level, i, j, grey of every cell with a value of images (path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                level, tx, ty = (int(p) for p in path.removesuffix(".png").split("/")[-3:])
                shade, alpha = pixels(content.as_py())
                row, column = np.nonzero(alpha)
                i, j = column + tx * size, size - 1 - row + ty * size
                arrays = [np.full(len(i), level), i, j, shade[row, column]]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in arrays], names=["level", "i", "j", "grey"])

    return files.select("path", "content").mapInArrow(run, "level int, i int, j int, grey int")
