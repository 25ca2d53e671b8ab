"""Key-correspondence operators: blocks, weights, nearest neighbours, bookkeeping sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import durable


def block_members(days: DataFrame, day: str, length: int) -> DataFrame:
    """days with `start`: each day once for every block of `length` days that it may belong to."""
    return days.withColumn("start", F.explode(F.sequence(F.date_sub(day, length - 1), F.col(day))))


def weights_by_day(steps: DataFrame, manifest: DataFrame, time: str = "time") -> DataFrame:
    """steps on a run's calendar day, with run and weight: the run's weight shared by its steps."""
    runs = manifest.select("run", F.col("sample_start").alias("_day"), F.col("weight").alias("_w"))
    both = steps.withColumn("_day", F.to_date(time)).join(runs, "_day")
    n = both.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    return both.join(n, "run").withColumn("weight", F.col("_w") / F.col("_n")).drop("_day", "_w", "_n")


def unmatched_steps(steps: DataFrame, manifest: DataFrame, time: str = "time") -> DataFrame:
    """Steps of no run: these must be none before weights are used."""
    return steps.withColumn("_day", F.to_date(time)).join(manifest.select(F.col("sample_start").alias("_day")), "_day", "left_anti").drop("_day")


def files_per_run(manifest: DataFrame, steps: DataFrame, expected: int) -> DataFrame:
    """run, files (found on its day), complete. steps: time, day."""
    found = steps.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    both = manifest.join(found, manifest["sample_start"] == found["day"], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return both.select("run", n.alias("files"), (n == expected).alias("complete"))


def _within(todo: DataFrame, sites: DataFrame, point_id: str, node_key: list[str]) -> DataFrame:
    """point_id, b (d2, node_key): the nearest of the sites that share a cell with a point's probes. Both: _cx, _cy."""
    d2 = (F.col("_x") - F.col("x")) ** 2 + (F.col("_y") - F.col("y")) ** 2
    return todo.join(sites, ["_cx", "_cy"]).groupBy(point_id).agg(F.min(F.struct(d2.alias("d2"), *node_key)).alias("b"))


def _cell(v: str, width: float) -> Column:
    return F.floor(F.col(v) / F.lit(width)).cast("long")


def _descend(todo: DataFrame, nodes: DataFrame, point_id: str, node_key: list[str], cell: float, width: float) -> DataFrame:
    """_within() for points far from all nodes: from the cells of the widest level down, a point keeps those cells that may hold its
    nearest node, as their nearest corner is no further than the furthest corner of some other one. A level's cells are half as wide."""
    cells = nodes.select(_cell("x", width).alias("_cx"), _cell("y", width).alias("_cy")).distinct()
    kept = todo.select(point_id, "x", "y").crossJoin(F.broadcast(cells))  # width exceeds all distances: at most 2 by 2 cells
    while True:
        edge = lambda v, c: (F.col(c) * F.lit(width) - F.col(v), F.col(v) - (F.col(c) + 1) * F.lit(width))  # noqa: E731, B023
        near = sum(F.pow(F.greatest(F.lit(0.0), *edge(v, c)), F.lit(2.0)) for v, c in (("x", "_cx"), ("y", "_cy")))
        far = sum(F.pow(F.greatest(*[F.abs(e) for e in edge(v, c)]), F.lit(2.0)) for v, c in (("x", "_cx"), ("y", "_cy")))
        kept = kept.withColumns({"_near": near, "_far": far})
        most = kept.groupBy(point_id).agg((F.min("_far") * (1 + 1e-9)).alias("_most"))
        kept = durable(kept.join(most, point_id).where(F.col("_near") <= F.col("_most")).select(point_id, "x", "y", "_cx", "_cy"))
        if width <= cell:
            sites = nodes.select(*node_key, F.col("x").alias("_x"), F.col("y").alias("_y"), _cell("x", width).alias("_cx"), _cell("y", width).alias("_cy"))
            return _within(kept, sites, point_id, node_key)
        width /= 2
        four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
        kept = kept.select(point_id, "x", "y", "_cx", "_cy", F.inline(four)).select(point_id, "x", "y", (F.col("_cx") * 2 + F.col("i")).alias("_cx"), (F.col("_cy") * 2 + F.col("j")).alias("_cy"))
        held = nodes.select(_cell("x", width).alias("_cx"), _cell("y", width).alias("_cy")).distinct()
        kept = kept.join(held, ["_cx", "_cy"], "left_semi").select(point_id, "x", "y", "_cx", "_cy")


def nearest_node(points: DataFrame, nodes: DataFrame, point_id: str, node_key: list[str], cell: float, max_dist: float | None = None) -> DataFrame:
    """point_id, node_key, dist: the nearest node (x, y) of each point (x, y), ties to the smaller key.

    Nodes are looked up in square cells around the point, 3 by 3; points that find none within a cell's width descend
    from wide cells to narrow ones. With max_dist, a point whose nearest node lies further away fails the query.
    """
    todo = points.select(point_id, "x", "y")
    around = F.array(*map(F.lit, (-1, 0, 1)))
    sites = nodes.select(*node_key, F.col("x").alias("_x"), F.col("y").alias("_y"), _cell("x", cell).alias("_cx"), _cell("y", cell).alias("_cy"))
    probes = todo.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    probes = probes.withColumns({"_cx": _cell("x", cell) + F.col("_dx"), "_cy": _cell("y", cell) + F.col("_dy")})
    taken = lambda best: best.select(point_id, *[F.col(f"b.{k}").alias(k) for k in node_key], F.sqrt("b.d2").alias("dist"))
    found = durable(taken(_within(probes, sites, point_id, node_key).where(F.col("b.d2") <= cell * cell)))
    left = durable(todo.join(found, point_id, "left_anti"))
    if not left.isEmpty():
        box = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if box[0] is not None:
            width = cell
            while width < max(*map(abs, box), cell):  # then all nodes lie in the 2 by 2 cells around the origin
                width *= 2
            found = found.unionByName(taken(_descend(left, nodes, point_id, node_key, cell, width)))
    if max_dist is not None:
        ok = F.assert_true(F.col("dist") <= max_dist, F.concat(F.lit("nearest node too far from point "), F.col(point_id).cast("string")))
        found = found.where(ok.isNull())
    return found


def nearest_index(x: Column, start: float, step: float, n: int) -> Column:
    """Index of the nearest of n regular positions, ties to the lower one."""
    return F.least(F.greatest(F.ceil((x - start) / step - 0.5), F.lit(0)), F.lit(n - 1)).cast("int")


def normalise_longitude(lon: Column, grid_max: float) -> Column:
    return F.pmod(lon, F.lit(360.0)) if grid_max > 180 else lon


def common_times(series: list[DataFrame], time: str = "time") -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [s.select(time) for s in series])


def pending(staged: DataFrame, *done: DataFrame, key: str = "run") -> DataFrame:
    """Staged keys that none of the others hold."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_anti"), done, staged)


def merge_manifest(new: DataFrame, old: DataFrame, skipped: DataFrame, key: str = "run") -> DataFrame:
    """The new rows, and the old rows of skipped runs."""
    return new.unionByName(old.join(skipped.select(key), key, "left_semi"), allowMissingColumns=True)


def present_for_all(have: DataFrame, key: str, member: str, n: int) -> DataFrame:
    """Keys that have all n members."""
    return have.groupBy(key).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == n).select(key)


def within_days(a: DataFrame, b: DataFrame, day_a: str, day_b: str, days: int) -> DataFrame:
    """Pairs whose dates differ by at most `days`, through an equi-join on periods of that length."""
    period = lambda d: F.floor(F.unix_date(F.col(d)) / days)
    left = a.withColumn("_p", F.explode(F.sequence(period(day_a) - 1, period(day_a) + 1)))
    both = left.join(b.withColumn("_p", period(day_b)), "_p").drop("_p")
    return both.where(F.abs(F.datediff(day_a, day_b)) <= days)
