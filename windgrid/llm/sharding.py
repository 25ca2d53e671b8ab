"""Sharding by the longest-processing-time rule over groups that stay together.

Groups (rows with equal keys) are taken by falling size; each goes to the
least-loaded shard, which a heap yields. Groups of one size are interchangeable,
so the driver schedules a histogram of group sizes: there are at most
sqrt(2 * total size) distinct sizes, whatever the number of groups. A size with
many groups is placed by the closed form of the same heap order. Groups then
find their shard by their rank within their size, rows by a join on the key.

Nulls: a null text is an empty one; rows without a doc_id are documents like others.
Repeated rows each get a slot of their own, and are numbered in parts by their place
in the table, so that a row repeated often is no hot group. Ties: equal groups are
ranked by their key, equal loads go to the lower shard. Long texts are read whole. An
empty table gives an empty result. Columns named as the results (shard, slot) are
replaced, names that begin with _s_ are reserved, others are kept. The driver holds a
row for each distinct size and its places in `shards` numbers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pieces_of


def place(sizes: list[tuple[int, int]], shards: int) -> list[np.ndarray]:
    """sizes: (size, number of groups) by falling size. Returns, for each, how many go to every shard."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, n in sizes:
        took = np.zeros(shards, dtype=np.int64)
        if n > 4 * shards:
            load = np.zeros(shards, dtype=np.int64)
            for at, s in heap:
                load[s] = at
            took = _many(load, size, n)
            heap = [(int(load[s] + took[s] * size), s) for s in range(shards)]
            heapq.heapify(heap)
        else:
            for _ in range(n):
                at, s = heap[0]
                took[s] += 1
                heapq.heapreplace(heap, (at + size, s))
        out.append(took)
    return out


def _many(load: np.ndarray, size: int, n: int) -> np.ndarray:
    """What n pops of the heap give when every item has this size: the n smallest of load + k * size, ties to the lower shard."""
    low, high = int(load.min()), int(load.min()) + size * n
    below = lambda level: np.maximum(0, -(-(level - load) // size))  # noqa: E731  pops with a key under level
    while low < high:  # the largest level that n pops don't exceed
        mid = (low + high + 1) // 2
        if below(mid).sum() <= n:
            low = mid
        else:
            high = mid - 1
    took = below(low)
    for s in np.flatnonzero((load + took * size) == low)[: n - int(took.sum())]:
        took[s] += 1
    return took


def shard_groups(df: DataFrame, key: str, size: str, order: list[str], shards: int = 16) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 within a shard). Rows with equal keys share a shard."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    rows = durable(df.withColumn("_s_row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    buckets = pieces_of(rows.count(), 20_000)
    groups = rows.groupBy(key).agg(F.sum(size).alias("_s_size"))
    groups = durable(groups.withColumn("_s_part", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    sizes = groups.groupBy("_s_size").count().toPandas().sort_values("_s_size", ascending=False)
    took = place([(int(s), int(n)) for s, n in zip(sizes["_s_size"], sizes["count"], strict=True)], shards)
    plan = spark.createDataFrame(
        pd.DataFrame({"_s_size": sizes["_s_size"].astype("int64"), "_s_ends": [np.cumsum(x).tolist() for x in took]}), "_s_size long, _s_ends array<long>"
    )
    counts = groups.groupBy("_s_size", "_s_part").count()
    before = Window.partitionBy("_s_size").orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_s_size", "_s_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s_before"))
    rank = F.row_number().over(Window.partitionBy("_s_size", "_s_part").orderBy(key)) - 1
    placed = groups.withColumn("_s_rank", rank).join(counts, ["_s_size", "_s_part"]).withColumn("_s_rank", F.col("_s_rank") + F.col("_s_before")).join(plan, "_s_size")
    placed = placed.select(key, F.size(F.filter("_s_ends", lambda end: end <= F.col("_s_rank"))).cast("int").alias("shard"))
    out = durable(rows.join(placed, key).withColumn("_s_part", F.pmod(F.xxhash64("_s_row"), F.lit(buckets)).cast("int")).drop("_s_row"))
    before = Window.partitionBy("shard").orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy("shard", "_s_part").count()
    counts = counts.select("shard", "_s_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s_before"))
    slot = F.row_number().over(Window.partitionBy("shard", "_s_part").orderBy(*order)) - 1
    out = out.withColumn("_s_slot", slot).join(counts, ["shard", "_s_part"])
    return out.withColumn("slot", (F.col("_s_slot") + F.col("_s_before")).cast("long")).select(*df.columns, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, key (digest of the text), shard, slot: copies of a text share a shard, shards are near equal in bytes."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"],
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    return shard_groups(rows, "key", "size", ["doc_id", "key"], shards)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
