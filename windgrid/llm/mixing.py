"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: a weight that changes along the training, as knots (t,
weight) with straight lines between them, t from 0 to 1. The schedule's integral is
the source's share of the mix; shares are targets in words, held to `most` times the
source's size, and what is above goes to the others by their integrals until none is
above. At time t a source has been asked for target * (integral to t) / (whole
integral) words. Its documents, in the order of a digest, are taken one after another,
again from the first when all are through; the inverse of that demand gives each one
its time, and the mix is the documents sorted by it. A document in progress when the
training ends is taken up to there, so a source's words are its target, rounded.

Running sums of a source are a scan in two levels: documents fall into parts by their
digest, parts are added up by source, and each part is numbered by itself. A document
that is repeated more often than a part has rows has parts of its own, dealt by the
row's place in the table, so no source and no document is one task. Targets are found
in rounds of grouped sums over a row a source; sources are numbered by ranges.

Nulls: rows without a source are a source, the last; a null text is an empty one, of
size 0, of which nothing is taken and which has a place in the order all the same.
Rows with equal digests are alike and may change places; each counts by itself. A
source whose schedule has no integral, or that has no words, has target 0. A target is
never above most * size, so small sources end there. An empty table gives an empty
result. Names that begin with _m_ are reserved and the columns named as results are
replaced; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, pieces_of

#: Rows of a part: about as many as there are parts, within these bounds.
LEAST_ROWS, MOST_ROWS = 200, 20_000
RESULTS = ("source_size", "target", "taken", "takes", "position")


def integral(knots: Column) -> Column:
    """Of a schedule: array of (t, weight), by rising t."""
    return F.aggregate(_segments(knots), F.lit(0.0), lambda total, s: total + s["area"])


def _segments(knots: Column) -> Column:
    pairs = F.zip_with(F.slice(knots, 1, F.size(knots) - 1), F.slice(knots, 2, F.size(knots) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda s: F.struct(
        s["a"]["t"].alias("t"), (s["b"]["t"] - s["a"]["t"]).alias("dt"), s["a"]["weight"].alias("w"), (s["b"]["weight"] - s["a"]["weight"]).alias("dw"),
        ((s["a"]["weight"] + s["b"]["weight"]) / 2 * (s["b"]["t"] - s["a"]["t"])).alias("area"),
    ))


def time_of(knots: Column, share: Column) -> Column:
    """When a schedule has reached this share of its integral."""
    asked = share * integral(knots)
    start = F.struct(asked.alias("left"), F.lit(None).cast("double").alias("t"))

    def step(state: Column, s: Column) -> Column:
        r, dt = state["left"], s["dt"]
        slope = F.when(dt > 0, s["dw"] / dt).otherwise(0.0)
        root = F.sqrt(F.greatest(s["w"] * s["w"] + 2 * slope * r, F.lit(0.0)))
        inside = s["t"] + F.least(dt, F.when(s["w"] + root > 0, 2 * r / (s["w"] + root)).otherwise(0.0))
        ends = state["t"].isNull() & (r <= s["area"]) & (s["area"] > 0)
        return F.struct((r - s["area"]).alias("left"), F.when(ends, inside).otherwise(state["t"]).alias("t"))

    return F.aggregate(_segments(knots), start, step, lambda s: F.coalesce(s["t"], F.lit(1.0)))


def numbered_sources(rows: DataFrame, source: str, size: str) -> DataFrame:
    """A row a source: its size, rows and number (from 0) by code point, null last."""
    sources = rows.groupBy(F.col(source).alias("_m_source")).agg(F.sum(size).cast("long").alias("source_size"), F.count("*").alias("_m_rows"))
    order = [F.col("_m_source").isNull(), F.col("_m_source")]
    ranged = durable(sources.repartitionByRange(*order).withColumn("_m_range", F.spark_partition_id()))
    counts = ranged.groupBy("_m_range").count()  # at most a row each partition
    before = Window.orderBy("_m_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_m_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_m_before"))
    place = F.row_number().over(Window.partitionBy("_m_range").orderBy(*order)) - 1
    return ranged.withColumn("_m_place", place).join(counts, "_m_range").withColumn("number", F.col("_m_place") + F.col("_m_before")).drop("_m_range", "_m_place", "_m_before")


def with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (source_size, schedule) with target: together share * all sizes, none above most * its size.

    Rounds: whoever is above its limit at the present rate stays at the limit, the others share what is left. Each round is one row of sums on the driver.
    """
    sources = durable(sources.withColumn("_m_weight", F.coalesce(integral(F.col("schedule")), F.lit(0.0))).withColumn("_m_limit", F.col("source_size") * most))
    rate, held = 0.0, -1
    while True:
        full = F.col("_m_limit") < F.col("_m_weight") * rate
        got = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("held"), F.sum(F.when(~full, F.col("_m_weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")
        ).first()
        if got["n"] == held or not got["all"] or not got["weight"]:
            break
        held = got["n"]
        rate = (got["all"] * share - (got["held"] or 0) * most) / got["weight"]
    return sources.withColumn("target", F.least(F.col("_m_limit"), F.col("_m_weight") * rate))


def mix(rows: DataFrame, source: str, size: str, digest: str, schedules: Callable[[Column], Column], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """rows with source_size, target, taken (long), takes (array of epoch, start, words, position) and position (0 to 1; of its place in the first epoch), sorted by position.

    digest: a hex string that orders a source's documents. schedules: from a source's
    number (by code point, from 0) to its knots.
    """
    names = [c for c in rows.columns if c not in RESULTS]
    rows = durable(rows.select(*names).withColumn("_m_row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    sources = numbered_sources(rows, source, size)
    sources = durable(with_targets(sources.withColumn("schedule", schedules(F.col("number"))), share, most))
    each = min(MOST_ROWS, max(LEAST_ROWS, int(rows.count() ** 0.5)))
    sources = sources.select("_m_source", F.ceil(F.col("_m_rows") / each).alias("_m_parts"), *[F.col(c).alias(f"_m_{c}") for c in ("source_size", "target", "schedule")])
    rows = rows.join(sources, rows[source].eqNullSafe(F.col("_m_source"))).drop("_m_source")
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    rows = _split_repeated(rows.withColumn("_m_bucket", F.floor(head * F.col("_m_parts") / 2**32).cast("long")), source, digest, each)

    part = ["_m_bucket", "_m_part", "_m_salt"]
    sums = rows.groupBy(F.col(source).alias("_m_s"), *[F.col(c).alias(f"{c}_of") for c in part]).agg(F.sum(size).alias("_m_sum"))
    before = Window.partitionBy("_m_s").orderBy(*[f"{c}_of" for c in part]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_m_before", F.coalesce(F.sum("_m_sum").over(before), F.lit(0))).drop("_m_sum")
    within = Window.partitionBy(source, *part).orderBy(digest, "_m_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_m_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    at = rows[source].eqNullSafe(F.col("_m_s"))
    for c in part:
        at &= rows[c] == F.col(f"{c}_of")
    rows = rows.join(sums, at).withColumn("_m_start", F.col("_m_within") + F.col("_m_before"))

    knots, target = F.col("_m_schedule"), F.col("_m_target")
    goal = F.floor(target + 0.5)
    passes = F.when(F.col("_m_source_size") > 0, F.ceil(goal / F.col("_m_source_size"))).otherwise(0)

    def take(epoch: Column) -> Column:
        start = epoch * F.col("_m_source_size") + F.col("_m_start")
        words = F.least(F.col(size), F.greatest(goal - start, F.lit(0)))
        return F.struct(epoch.cast("int").alias("epoch"), start.cast("long").alias("start"), words.cast("long").alias("words"), time_of(knots, start / target).alias("position"))

    takes = F.when(passes > 0, F.filter(F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), take), lambda x: x["words"] > 0))
    takes = F.coalesce(takes, F.array().cast("array<struct<epoch:int,start:bigint,words:bigint,position:double>>"))
    place = F.when((target > 0) & (F.col("_m_start") <= target), time_of(knots, F.col("_m_start") / target))
    placed = rows.select(*names, F.col("_m_source_size").alias("source_size"), target.alias("target"), takes.alias("takes"), place.alias("position"), "_m_row")
    placed = durable(placed.withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda total, x: total + x["words"])))  # sorting looks at its input twice
    return placed.orderBy(F.col("position").asc_nulls_last(), F.xxhash64(digest, "_m_row")).drop("_m_row")


def _split_repeated(rows: DataFrame, source: str, digest: str, each: int) -> DataFrame:
    """rows with _m_part and _m_salt, which cut a bucket so that a digest of more than `each` rows has parts of its own; digests keep their order."""
    by_bucket = [F.col(source).alias("_m_s"), F.col("_m_bucket").alias("_m_b")]
    large = rows.groupBy(*by_bucket).count().where(F.col("count") > 2 * each).drop("count")  # only these can hold such digests
    same = rows[source].eqNullSafe(F.col("_m_s")) & (rows["_m_bucket"] == F.col("_m_b"))
    often = rows.join(large, same, "left_semi").groupBy(*by_bucket, F.col(digest).alias("_m_key")).count().where(F.col("count") > each)
    often = often.groupBy("_m_s", "_m_b").agg(F.array_sort(F.collect_list(F.struct("_m_key", F.ceil(F.col("count") / each).alias("parts")))).alias("_m_often"))
    rows = rows.join(often, same, "left").drop("_m_s", "_m_b")
    mine = F.filter("_m_often", lambda x: x["_m_key"] == F.col(digest))
    ahead = F.size(F.filter("_m_often", lambda x: x["_m_key"] < F.col(digest)))
    is_one = F.coalesce(F.size(mine) > 0, F.lit(False)) & F.col("_m_often").isNotNull()
    return rows.withColumns({
        "_m_part": F.when(F.col("_m_often").isNull(), 0).otherwise(2 * ahead + is_one.cast("int")),
        "_m_salt": F.when(is_one, F.pmod(F.xxhash64("_m_row"), F.get(mine, F.lit(0))["parts"])).otherwise(0).cast("long"),
    }).drop("_m_often")


def stream(mixed: DataFrame) -> DataFrame:
    """The training order: a row for each time that a document is taken, sorted by position, with epoch, position and words (how many of its words, from the first)."""
    names = [c for c in mixed.columns if c not in ("takes", "position", "epoch", "words")]
    out = mixed.select(*names, F.explode("takes").alias("_m_take")).select(*names, "_m_take.epoch", "_m_take.position", "_m_take.words")
    return durable(out).orderBy("position", "epoch", F.xxhash64(*names))


#: The query's weights by number of the source, repeating, and how each changes along the training: (at the start, at the end), of mean 1.
WEIGHTS: Sequence[float] = (5.0, 2.0, 1.0)
SHAPES: Sequence[tuple[float, float]] = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))


def repeating(number: Column) -> Column:
    """Schedules of WEIGHTS and SHAPES."""
    kinds = [
        F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(w * s).alias("weight")) for t, s in enumerate(shape)]) for w, shape in zip(WEIGHTS, SHAPES, strict=True)
    ]
    return F.get(F.array(*kinds), F.pmod(number, F.lit(len(kinds))).cast("int"))


def mix_documents(docs: DataFrame, schedules=repeating, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, digest, source_size, target, taken, takes, position of documents (doc_id, text, source); sizes in words."""
    text = F.coalesce(docs["text"], F.lit(""))
    key = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("|"), text)
    rows = docs.select(docs["doc_id"], docs["source"], F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(key.cast("binary")).alias("digest"))
    return mix(rows, "source", "size", "digest", schedules, share, most)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS digest FROM documents),
s AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
r AS (SELECT *, source_size * 2.0::DOUBLE AS most, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST) AS k FROM s),
h AS (SELECT *, CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS held, coalesce(sum(w) OVER b, 0) AS gone, CAST(sum(source_size) OVER () AS BIGINT) AS every, sum(w) OVER () AS weights
      FROM r WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (every * 1.5::DOUBLE - held * 2.0::DOUBLE) / (weights - gone) AS rate FROM h WHERE most >= w * ((every * 1.5::DOUBLE - held * 2.0::DOUBLE) / (weights - gone)) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(most, w * rate) AS target FROM h, l),
c AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CAST(least(size, greatest(goal - start, 0)) + least(size, greatest(goal - source_size - start, 0)) AS BIGINT) AS taken FROM c
"""
