"""Running sums and predecessors over any number of rows a key, in two levels.

Rows are dealt to ranges of (keys, order) and written; each range gives its total and its
last row a key; these few rows (at most one a range and key) are added up along a key, and
each row gets what lies before its range beside its running value within it. So a key with
all rows is as many tasks as there are ranges, where a window by the key alone would be one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import durable


def running(
    df: DataFrame, keys: list[str], order: list[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, lags: Mapping[str, Column] | None = None, ranges: int | None = None
) -> DataFrame:
    """df with, in the order within its keys: sums up to and with a row, the last values that aren't null up to and with it, and the values of the row before it.

    A key's rows are ordered by columns of the table that have no two equal rows; equal ones stand in either order. sums start at 0; nulls
    add nothing. ranges: how many the rows are dealt to (Spark's number of shuffle partitions if none). Names that begin with _r_ are reserved.
    """
    sums, lasts, lags = sums or {}, lasts or {}, lags or {}
    given = df.columns
    made = {f"_r_v_{n}": c for part in (sums, lasts, lags) for n, c in part.items()}
    made |= {f"_r_v_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()}
    by = [*keys, *order]
    rows = df.withColumns(made)
    rows = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    rows = durable(rows.withColumn("_r_part", F.spark_partition_id()))  # written: sampled ranges are cut once

    inner = Window.partitionBy("_r_part", *keys).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_r_row", F.row_number().over(inner))
    rows = rows.withColumns({f"_r_in_{n}": F.sum(f"_r_v_{n}").over(upto) for n in sums} | {f"_r_in_{n}": F.last(f"_r_v_{n}", True).over(upto) for n in lasts} | {f"_r_in_{n}": F.lag(f"_r_v_{n}").over(inner) for n in lags})

    place = F.struct(*order)
    known = lambda n: F.when(F.col(f"_r_v_{n}").isNotNull(), place)
    totals = [F.sum(f"_r_v_{n}").alias(f"_r_to_{n}") for n in sums] + [F.max_by(f"_r_v_{n}", known(n)).alias(f"_r_to_{n}") for n in lasts] + [F.max_by(F.struct(f"_r_v_{n}"), F.struct(place, "_r_row")).alias(f"_r_to_{n}") for n in lags]
    parts = rows.groupBy("_r_part", *keys).agg(*totals)
    before = Window.partitionBy(*keys).orderBy("_r_part").rowsBetween(Window.unboundedPreceding, -1)
    over = {f"_r_to_{n}": F.sum(f"_r_to_{n}").over(before) for n in sums} | {f"_r_to_{n}": F.last(f"_r_to_{n}", True).over(before) for n in [*lasts, *lags]}
    parts = parts.withColumns(over)
    parts = parts.select(F.col("_r_part").alias("_r_p"), *[F.col(k).alias(f"_r_key{n}") for n, k in enumerate(keys)], *over)

    same = rows["_r_part"] == F.col("_r_p")
    for n, k in enumerate(keys):
        same &= rows[k].eqNullSafe(F.col(f"_r_key{n}"))
    rows = rows.join(parts, same)
    out = {n: F.col(f"_r_in_{n}") + F.coalesce(f"_r_to_{n}", F.lit(0.0)) for n in sums} | {n: F.coalesce(f"_r_in_{n}", f"_r_to_{n}") for n in lasts}
    out |= {n: F.when(F.col("_r_row") > 1, F.col(f"_r_in_{n}")).otherwise(F.col(f"_r_to_{n}")[f"_r_v_{n}"]) for n in lags}
    return rows.select(*[c for c in given if c not in out], *[c.alias(n) for n, c in out.items()])


def with_halo(df: DataFrame, by: list[str], place: str, reach: int, rows: int) -> DataFrame:
    """df once for each block of `rows` places that a row lies in or is at most `reach` places after, with block and own (whether it lies in it).

    by, place: a key and a row's number in it, from 0. reach must be less than rows.
    """
    at = F.floor(F.col(place) / rows).cast("long")
    blocks = F.when((F.col(place) % rows < reach) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    return df.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == at)
