"""The corpus pipeline: toxic documents go, poor ones go, one of each group of near-copies stays, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and, but for
the last, returns rows of docs with their columns as they came. Decisions are
made where the rows are; only the near-copies' ids are joined back, by a number
of the row. Rows that share a doc_id but not a text are documents of their own,
and so are rows without a doc_id; of a group of near-copies the row with the
least doc_id stays (one without only if all are). Texts without words are no
copies, but a repeated row with a doc_id is one document. Columns that clash with an operator's results are
set aside and come back unchanged. Empty tables pass through. Near-copies are
linked from a shingle Jaccard index of 0.80 on; op4_neardup's threshold is 0.85.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windgrid.llm import neardup, packing, quality, toxicity
from windgrid.llm.common import durable

#: The classifiers' model file and capacity are parameters of these functions; these are the production values.
TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Near-copies: a Jaccard index of 80 / 100 at least, met by bands of 3 minhashes.
ALIKE, BAND = (80, 100), 3


def _filtered(docs: DataFrame, results: set[str], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """apply(docs), with columns named as results set aside meanwhile."""
    aside = {c: f"_aside_{c}" for c in docs.columns if c in results}
    out = apply(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return _filtered(docs, {"p_grade", "severity", "toxic"}, lambda d: toxicity.score(d, toxicity.fit(d, labels)).where("NOT toxic"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    names = {"p_text", "p_site", "quality", "keep", *(c for c in docs.columns if c.startswith("_q_"))}
    return _filtered(docs, names, lambda d: quality.classify(d, labels).where("keep"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, {"_row"}, _first_of_copies)


def _first_of_copies(docs: DataFrame) -> DataFrame:
    rows = durable(docs.withColumn("_row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    found = neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), *ALIKE, BAND).withColumnRenamed("doc_id", "_row").drop("kept")
    found = found.join(rows.select("_row", "doc_id", F.xxhash64("text").alias("hash")), "_row")
    bare = F.col("n_shingles") == 0
    group = [F.when(~bare | F.col("doc_id").isNull(), F.col("component_id")), F.when(bare, F.col("doc_id")), F.when(bare, F.col("hash"))]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    kept = found.groupBy(*[g.alias(f"g{k}") for k, g in enumerate(group)]).agg(first.alias("_row"))
    copies = durable(found.select("_row").join(kept.select("_row"), "_row", "left_anti"))  # fewer than what stays, and of a known size
    return rows.join(copies, "_row", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), CAPACITY)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("MinHash near-dedup", drop_copies), ("best-fit packing", pack)]

#: Classifiers and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each one's rows written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
