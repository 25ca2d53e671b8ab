"""Windows of a raster that is stored as tiles: each window is joined to the tiles it touches, and of a tile only the rows' parts inside are read.

Tiles are the files of `tiles` (their names tell which cells they hold). A window may reach
beyond the raster on any side or over tiles that were never made: all its cells are returned, those
without data with a null value. A window that touches many tiles is read by many tasks, a tile by as
many as there are windows over it; nothing but window bounds and file names is shuffled.

Windows with a null bound, or whose end lies before their begin, have no cells. Repeated windows
are read once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .folder import opened
from .tiles import BORDER, NO_DATA, SIZE

CELL = 2  # bytes


def index(files: DataFrame, size: int = SIZE) -> DataFrame:
    """tx, ty, path of tiles' files (path)."""
    name = F.substring_index("path", "/", -1)
    first = lambda k: F.regexp_extract(name, r"^(\d+)-\d+\.(\d+)-\d+$", k).try_cast("int")
    rows = files.select("path", first(1).alias("x"), first(2).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return rows.select(F.floor((F.col("x") - 1) / size).cast("int").alias("tx"), F.floor((F.col("y") - 1) / size).cast("int").alias("ty"), "path")


def parts(windows: DataFrame, size: int = SIZE) -> DataFrame:
    """window, tx, ty, x0, y0, x1, y1: the part of a window (ends included) that lies in each tile's place."""
    places = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    whole = windows.select("window", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]).where("x0 <= x1 AND y0 <= y1")
    each = whole.withColumn("tx", places("x0", "x1")).withColumn("ty", places("y0", "y1"))
    low = lambda c, t: F.greatest(F.col(c), F.col(t) * size).cast("int").alias(c)
    high = lambda c, t: F.least(F.col(c), F.col(t) * size + size - 1).cast("int").alias(c)
    return each.select("window", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), low("x0", "tx"), low("y0", "ty"), high("x1", "tx"), high("y1", "ty"))


def cut(file, tx: int, ty: int, x0: int, y0: int, x1: int, y1: int, size: int, border: int) -> np.ndarray:
    """A part of a tile, read row by row."""
    side = size + 2 * border
    out = np.empty((y1 - y0 + 1, x1 - x0 + 1), ">i2")
    for k in range(len(out)):
        file.seek(CELL * ((y0 + k - ty * size + border) * side + x0 - tx * size + border))
        out[k] = np.frombuffer(file.read(CELL * out.shape[1]), ">i2")
    return out


def read(windows: DataFrame, files: DataFrame, size: int = SIZE, border: int = BORDER, no_data: int = NO_DATA) -> DataFrame:
    """window, i, j, value of every cell of the windows (window, x0, y0, x1, y1: first and last column and row). files: path of the tiles."""
    ship(windows.sparkSession)
    asked = parts(windows, size).join(index(files, size), ["tx", "ty"], "left").select("window", "tx", "ty", "x0", "y0", "x1", "y1", "path")
    kind = windows.schema["window"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, (tx, ty, x0, y0, x1, y1, path) in enumerate(zip(*[b.column(k).to_pylist() for k in range(1, 8)], strict=True)):
                if path is None:
                    values = np.full((y1 - y0 + 1, x1 - x0 + 1), no_data)
                else:
                    store, inside = opened(path)
                    with store.open_input_file(inside) as f:
                        values = cut(f, tx, ty, x0, y0, x1, y1, size, border)
                j, i = np.divmod(np.arange(values.size), values.shape[1])
                flat = values.ravel().astype(float)
                window = b.column(0).take(pa.array(np.full(values.size, n)))
                yield pa.RecordBatch.from_arrays([window, pa.array((i + x0).astype(np.int32)), pa.array((j + y0).astype(np.int32)), pa.array(flat, mask=flat == no_data)], names=["window", "i", "j", "value"])

    return asked.mapInArrow(run, f"window {kind}, i int, j int, value double")
