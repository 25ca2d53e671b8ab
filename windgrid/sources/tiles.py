"""Terrain tiles: flat files of big-endian 16-bit numbers, south row first, with a border of neighbouring cells, beside an index text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

# Fixed values of the format.
SIZE, BORDER, NO_DATA = 1200, 3, -9999
NAME = "%05d-%05d.%05d-%05d"


def name(tx: int, ty: int, size: int = SIZE) -> str:
    """The cells that a tile covers without its border, counted from 1."""
    return NAME % (tx * size + 1, (tx + 1) * size, ty * size + 1, (ty + 1) * size)


def contents(raster: DataFrame, value: str, size: int = SIZE, border: int = BORDER, no_data: int = NO_DATA) -> DataFrame:
    """path, content of every tile that has a cell with a value in its own part. raster: i, j from 0, value.

    A cell goes to the tiles in whose border it lies, too; values are rounded to whole numbers, halves to even, and
    clipped to 16 bits; cells without a value, also those beyond the raster, hold no_data. A task holds one tile.
    """
    ship(raster.sparkSession)
    reach = lambda v: F.explode(F.sequence(F.floor((F.col(v) - border) / size), F.floor((F.col(v) + border) / size)))
    known = raster.select("i", "j", F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    placed = known.withColumn("tx", reach("i")).withColumn("ty", reach("j"))
    side = size + 2 * border

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        tx, ty = (int(k) for k in key)
        out = np.full((side, side), no_data, ">i2")
        i, j = x["i"].to_numpy() - tx * size, x["j"].to_numpy() - ty * size
        out[j + border, i + border] = np.clip(np.rint(x["v"].to_numpy()), -32768, 32767)
        own = int(((i >= 0) & (i < size) & (j >= 0) & (j < size)).any())
        return pd.DataFrame({"path": [name(tx, ty, size)] * own, "content": [out.tobytes()] * own}, dtype=object)

    return placed.groupBy("tx", "ty").applyInPandas(run, "path string, content binary")


def index_text(dx: float, dy: float, lat0: float, lon0: float, description: str, size: int = SIZE, border: int = BORDER, no_data: int = NO_DATA) -> str:
    """The index beside the tiles: how they are stored, and the centre of the south-west cell (lat0, lon0 is its corner)."""
    entries = {
        "type": "continuous", "signed": "yes", "projection": "regular_ll", "dx": f"{dx:.12f}", "dy": f"{dy:.12f}", "known_x": "1.0", "known_y": "1.0",
        "known_lat": f"{lat0 + dy / 2:.12f}", "known_lon": f"{lon0 + dx / 2:.12f}", "wordsize": "2", "endian": "big", "row_order": "bottom_top",
        "tile_x": size, "tile_y": size, "tile_z": 1, "tile_bdr": border, "missing_value": f"{no_data}.", "scale_factor": "1.0", "units": '"meters MSL"', "description": f'"{description}"',
    }
    return "".join(f"{k} = {v}\n" for k, v in entries.items())


def parse(files: DataFrame, size: int = SIZE, border: int = BORDER, no_data: int = NO_DATA) -> DataFrame:
    """path, i, j, value (null for no_data) of every cell of tiles (path, content), with the borders' cells."""
    ship(files.sparkSession)
    side = size + 2 * border

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path, content in zip(x["path"], x["content"], strict=True):
                west, south = (int(part.split("-")[0]) - 1 - border for part in path.rsplit("/", 1)[-1].split("."))
                v = np.frombuffer(content, ">i2", side * side).astype(float)
                row, column = np.divmod(np.arange(len(v)), side)
                yield pd.DataFrame({"path": path, "i": west + column, "j": south + row, "value": np.where(v == no_data, np.nan, v)})

    rows = files.select("path", "content").mapInPandas(run, "path string, i int, j int, value double")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
