"""Sectors, speed bins, stability classes and calendar keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define results.
SPEED_EDGES = (0, 3, 6, 9, 12, 15)  # the last bin is open
SPEED_EDGES_V1 = (0, 3, 6, 9, 12, 15, 20, 100)
SPEED_MIDPOINTS = (1.5, 4.5, 7.5, 10.5, 13.5, 18.0)
STABILITY_EDGES = (-0.1, -0.01, 0.01, 0.1)
SELECTION_SECTORS = 12
WRG_BIN_DEGREES = 22.5


def digitize(x: Column, edges: tuple, lowest: int = 0) -> Column:
    """How many edges are at or below x, from `lowest`: bins closed on the left."""
    out = F.lit(lowest)
    for i, e in enumerate(edges):
        out = F.when(x >= F.lit(float(e)), F.lit(lowest + i + 1)).otherwise(out)
    return out


def sector_left(wd: Column, n: int = SELECTION_SECTORS) -> Column:
    """Sector 0 is centred on north; sectors are closed on the left."""
    return F.floor(F.pmod(wd + F.lit(180.0 / n), F.lit(360.0)) / F.lit(360.0 / n)).cast("int")


def sector_right(wd: Column, width: float = WRG_BIN_DEGREES) -> Column:
    """Sector 0 is (-width/2, width/2]; sectors are closed on the right. Null outside 0 to 360."""
    turned = F.when(wd > 360 - width / 2, wd - 360).otherwise(wd)
    return F.when((wd >= 0) & (wd <= 360), (F.ceil((turned + width / 2) / width) - 1).cast("int"))


def speed_bin(ws: Column, edges: tuple = SPEED_EDGES) -> Column:
    """Bin of a speed, clipped to the first and last bin. edges[0] is the lower end of bin 0."""
    return digitize(ws, edges[1:] if edges == SPEED_EDGES else edges[1:-1])


def stability_class(ri: Column) -> Column:
    return digitize(ri, STABILITY_EDGES)


def month0(t: Column) -> Column:
    return F.month(t) - 1


def slot3(t: Column) -> Column:
    return F.floor(F.hour(t) / 3).cast("int")


def hour6(t: Column) -> Column:
    return F.floor(F.hour(t) / 6).cast("int")


def season(t: Column) -> Column:
    """0 is December to February."""
    return F.floor((F.month(t) % 12) / 3).cast("int")
