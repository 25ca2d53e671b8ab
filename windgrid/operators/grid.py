"""Rasters as rows (i, j, value): neighbours, resampling, tiles, terrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import durable
from .quantiles import literals


def _along(axis: str) -> Window:
    """Rows along an axis: of one j for axis i, of one i for axis j."""
    return Window.partitionBy("j" if axis == "i" else "i").orderBy(axis)


def unstagger(raster: DataFrame, value: str, axis: str = "i") -> DataFrame:
    """Means of adjacent faces; the last face goes."""
    w = _along(axis)
    return raster.withColumn(value, (F.col(value) + F.lead(value).over(w)) / 2).where(F.col(value).isNotNull())


def gradient(raster: DataFrame, value: str, dx: float = 1.0) -> DataFrame:
    """raster with gi and gj: central differences inside, one-sided at the edges."""
    out = raster
    for axis in ("i", "j"):
        w = _along(axis)
        before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        g = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)
        out = out.withColumn(f"g{axis}", g / dx)
    return out


def slope(raster: DataFrame, value: str, dx: float = 1.0) -> DataFrame:
    return gradient(raster, value, dx).withColumn("slope", F.hypot("gi", "gj"))


def difference_pairs(raster: DataFrame, value: str, axis: str = "i") -> DataFrame:
    """a, b: first differences along an axis and the next ones."""
    w = _along(axis)
    pairs = raster.select("i", "j", (F.lead(value).over(w) - F.col(value)).alias("a"), (F.lead(value, 2).over(w) - F.lead(value).over(w)).alias("b"))
    return pairs.where("b IS NOT NULL")


def neighbours(raster: DataFrame, value: str) -> DataFrame:
    """Interior cells with the four neighbours' values: west, east, south, north."""
    wi, wj = _along("i"), _along("j")
    out = raster.withColumns({"west": F.lag(value).over(wi), "east": F.lead(value).over(wi), "south": F.lag(value).over(wj), "north": F.lead(value).over(wj)})
    return out.where("west IS NOT NULL AND east IS NOT NULL AND south IS NOT NULL AND north IS NOT NULL")


def plateau(value: str, eps: float = 1e-6) -> Column:
    near = lambda n: F.abs(F.col(value) - F.col(n)) < eps
    return near("west") & near("east") & near("south") & near("north")


def isolated(value: str) -> Column:
    differs = lambda n: F.col(value) != F.col(n)
    return differs("west") & differs("east") & differs("south") & differs("north")


def boundary(value: str) -> Column:
    differs = lambda n: F.col(value) != F.col(n)
    return differs("west") | differs("east") | differs("south") | differs("north")


def terrain_statistics(raster: DataFrame, value: str, dx: float = 1.0) -> DataFrame:
    """One row: slope quantiles (m per km), lag-1 correlation of differences, plateau share, sd (population) and range."""
    s = slope(raster, value, dx).select((F.col("slope") * 1000).alias("s"))
    s = s.agg(*literals(s, F.col("s"), {"slope_p50": 0.5, "slope_p99": 0.99}), F.max("s").alias("slope_max"))
    d = difference_pairs(raster, value).agg(F.corr("a", "b").alias("diff_lag1"))
    p = neighbours(raster, value).agg(F.avg(plateau(value).cast("double")).alias("plateau_share"))
    v = raster.agg(F.stddev_pop(value).alias("sd"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return s.crossJoin(d).crossJoin(p).crossJoin(v)  # one row each


def coarse_cell(x: Column, y: Column, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Cell of a coarse grid whose edges start at (x0, y0); with the first centre as origin the cells are shifted by half a cell."""
    return F.floor((x - x0) / dx).cast("int"), F.floor((y - y0) / dy).cast("int")


def bilinear(points: DataFrame, raster: DataFrame, point_id: str, value: str) -> DataFrame:
    """point_id, value at (x, y) in cell units: null where a corner is missing. An equi-join on four corners."""
    fx, fy = F.floor("x"), F.floor("y")
    ax, ay = F.col("x") - fx, F.col("y") - fy
    corners = F.array(*[F.struct((fx + a).cast("int").alias("i"), (fy + b).cast("int").alias("j"), ((ax if a else 1 - ax) * (ay if b else 1 - ay)).alias("w")) for a in (0, 1) for b in (0, 1)])
    four = points.select(point_id, F.explode(corners).alias("c")).select(point_id, "c.i", "c.j", "c.w")
    got = four.join(raster.select("i", "j", value), ["i", "j"]).groupBy(point_id).agg(F.sum(F.col("w") * F.col(value)).alias("value"), F.count(F.lit(1)).alias("_n"))
    return points.select(point_id).join(got.where("_n = 4"), point_id, "left").select(point_id, "value")


def to_grid(points: DataFrame, value: str, res: float, x: str = "x", y: str = "y") -> DataFrame:
    """Scattered points to a dense grid by rounding to the nearest index; null where there is none."""
    low = points.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    index = lambda v, o: F.rint((F.col(v) - F.col(o)) / res).cast("int")
    at = points.crossJoin(F.broadcast(low)).select(index(x, "x0").alias("i"), index(y, "y0").alias("j"), value)
    spine = low.select(F.explode(F.sequence(F.lit(0), index("x1", "x0"))).alias("i"), "y0", "y1").select("i", F.explode(F.sequence(F.lit(0), index("y1", "y0"))).alias("j"))
    return spine.join(at, ["i", "j"], "left")


def fill_nearest(raster: DataFrame, value: str) -> DataFrame:
    """Nulls take the value of the nearest cell that has one (ties: smaller i, then j).

    First every row's nearest cell along i, by a window over the row; then each gap looks along j in its
    column, at rows up to a distance that grows until no nearer cell can be further out.
    """
    todo, known = raster.where(F.col(value).isNull()).select("i", "j"), raster.where(F.col(value).isNotNull()).select("i", "j", value)
    rows = known.agg(F.min("j").alias("j0"), F.max("j").alias("j1"))
    if rows.first()["j0"] is None:
        return raster
    # the columns that hold gaps, over the rows that hold values
    spine = todo.select("i").distinct().crossJoin(rows).select("i", F.explode(F.sequence("j0", "j1")).alias("j"))  # one row of rows
    asked = spine.join(known, ["i", "j"], "left_anti").select("i", "j", F.lit(None).cast(dict(known.dtypes)[value]).alias("v"), F.lit(True).alias("asks"))
    every = known.select("i", "j", F.col(value).alias("v"), F.lit(False).alias("asks")).unionByName(asked)
    line = Window.partitionBy("j").orderBy("i")
    here = F.when(F.col("v").isNotNull(), F.struct("i", "v"))
    every = every.withColumns({"left": F.last(here, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "right": F.first(here, True).over(line.rowsBetween(0, Window.unboundedFollowing))})
    nearer = F.when(F.col("right").isNull() | (F.col("i") - F.col("left.i") <= F.col("right.i") - F.col("i")), F.col("left")).otherwise(F.col("right"))
    along = every.where("asks").select("i", "j", nearer.alias("n")).where("n IS NOT NULL").select("i", "j", F.col("n.i").alias("ni"), F.col("n.v").alias("v"))
    along = along.unionByName(known.join(todo.select("i").distinct(), "i", "left_semi").select("i", "j", F.col("i").alias("ni"), F.col(value).alias("v")))
    along = durable(along)
    span = raster.agg(F.max("j") - F.min("j")).first()[0]
    done, radius = known, 1
    while True:
        probes = todo.select("i", F.col("j").alias("_j"), F.explode(F.sequence(F.col("j") - radius, F.col("j") + radius)).alias("j"))
        d2 = (F.col("i") - F.col("ni")) ** 2 + (F.col("j") - F.col("_j")) ** 2
        best = probes.join(along, ["i", "j"]).groupBy("i", "_j").agg(F.min(F.struct(d2.alias("d2"), "ni", "j", "v")).alias("b"))
        last = radius >= span
        sure = best if last else best.where(F.col("b.d2") <= radius * radius)
        part = sure.select("i", F.col("_j").alias("j"), F.col("b.v").alias(value))
        part = part if last else durable(part)
        done = done.unionByName(part)
        if last:
            return done
        todo = durable(todo.join(part, ["i", "j"], "left_anti"))
        if todo.isEmpty():
            return done
        radius *= 4


def crop_centre(raster: DataFrame, ni: int, nj: int, size: int) -> DataFrame:
    """The central size by size window of an ni by nj raster."""
    i0, j0 = (ni - size) // 2, (nj - size) // 2
    return raster.where(F.col("i").between(i0, i0 + size - 1) & F.col("j").between(j0, j0 + size - 1))


def tiles(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """tx, ty of nx by ny tiles."""
    return spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("tx"), F.floor(F.col("id") / nx).cast("int").alias("ty"))


def tile_windows(tile: DataFrame, size: int = 1200, halo: int = 3) -> DataFrame:
    """Cell range of each tile with its halo, and its name: five digits each, first cell counted from 1."""
    low = lambda t: F.col(t) * size
    name = F.format_string("%05d-%05d.%05d-%05d", low("tx") + 1, low("tx") + size, low("ty") + 1, low("ty") + size)
    return tile.select("tx", "ty", (low("tx") - halo).alias("x0"), (low("tx") + size + halo - 1).alias("x1"), (low("ty") - halo).alias("y0"), (low("ty") + size + halo - 1).alias("y1"), name.alias("name"))


def tiles_touching(tile: DataFrame, cells: DataFrame, tile_size: float, cell_size: float) -> DataFrame:
    """Tiles of which one of 3 by 3 probes (edges and middle) lies in a source cell (cx, cy)."""
    three = F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))
    at = lambda t, u: F.floor((F.col(t) + F.col(u)) * tile_size / cell_size).cast("int")
    probes = tile.withColumn("_u", F.explode(three)).withColumn("_v", F.explode(three)).select("tx", "ty", at("tx", "_u").alias("cx"), at("ty", "_v").alias("cy"))
    return probes.join(cells, ["cx", "cy"], "left_semi").select("tx", "ty").distinct()


def gradient_p99(raster: DataFrame, value: str, dx: float = 1.0) -> DataFrame:
    return raster.sparkSession.range(1).select(*literals(slope(raster, value, dx), F.col("slope"), {"p99": 0.99}))


def robust_limits(df: DataFrame, value: str) -> DataFrame:
    """p1 and p99, nulls left out."""
    return df.sparkSession.range(1).select(*literals(df, F.col(value), {"p1": 0.01, "p99": 0.99}))
