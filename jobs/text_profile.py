"""How far the texts of each source are from those of the whole archive; kept up as files arrive.

    python -m jobs.text_profile --config jobs/text_profile.conf --documents FOLDER --out FOLDER --state FOLDER

The question of representative periods, put to texts: parts (sources) of a record are
held against the whole by the histograms of some features, and their distance is the
total variation in percent, 0 for a part like the whole and 100 for one that shares nothing
with it. Features are the language, classes of the number of words, of letters a word, of
lines, and of digits in a thousand characters, and language and length together.

New files of the folder are taken by a file stream that ends when all are read
(availableNow); its checkpoint lies under FOLDER/checkpoint of the state. Each batch adds
its counts, one row a source, feature and class, to the state's counts, in a folder named by
the batch, so a batch that is repeated after a failure replaces its own counts. Then the report is made
of all counts, without reading a text again, and replaces the one before:

* FOLDER: source, bin, n, share, whole, tv, far; partitioned by feature, Parquet.

A run without new files writes the same report again. A file is taken once, under its name;
files are to be added, not changed. Null texts are empty ones, a null source or language
is named (none). Without documents the report is empty. Sources that share most rows are
counted where the rows are; counts, not texts, are shuffled.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windgrid.functions.binning import digitize
from windgrid.operators import histograms as H

from .common import log, main, new_folder, numbers, settings

NONE = "(none)"
WORD, SPACE, DIGIT = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[0-9]"


@dataclass
class Settings:
    """What text_profile.conf may set; these are the values of the registered query."""

    words: str = "20, 100, 300, 1000, 3000"
    letters_a_word: str = "3, 4, 5, 6, 8"
    lines: str = "2, 5, 20, 100"
    digits_a_thousand: str = "1, 10, 50"
    far: float = 25.0
    files_a_batch: int = 1000

    @classmethod
    def of(cls, found: dict[str, str]) -> Settings:
        kinds = {f.name: type(getattr(cls, f.name)) for f in fields(cls)}
        if unknown := found.keys() - kinds.keys():
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: kinds[k](v) for k, v in found.items()})

    def edges(self, feature: str) -> tuple[float, ...]:
        return tuple(sorted(numbers(getattr(self, feature))))


COUNTS = "source string, feature string, bin string, n long"
CLASSES = ("words", "letters_a_word", "lines", "digits_a_thousand")
FEATURES = ("lang", *CLASSES, "lang_words")


def classified(docs: DataFrame, s: Settings) -> DataFrame:
    """source, lang and the class of each feature of documents (source, lang, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), F.length(text).alias("_all"),
        F.regexp_count(text, F.lit(WORD)).alias("_words"), F.length(F.regexp_replace(text, SPACE, "")).alias("_letters"),
        F.regexp_count(text, F.lit("\n")).alias("_breaks"), F.regexp_count(text, F.lit(DIGIT)).alias("_digits"),
    )
    value = {
        "words": F.col("_words"),
        "letters_a_word": F.try_divide("_letters", "_words"),
        "lines": F.when(F.col("_all") > 0, F.col("_breaks") + 1).otherwise(0),
        "digits_a_thousand": F.try_divide(1000 * F.col("_digits"), F.col("_all")),
    }
    return rows.select("source", "lang", *[digitize(value[f], s.edges(f)).alias(f) for f in CLASSES])


def _bin(feature: str) -> Column:
    if feature == "lang_words":
        return F.concat_ws(":", "lang", "words")
    return F.col(feature).cast("string")


def counted(docs: DataFrame, s: Settings) -> DataFrame:
    """source, feature, bin, n: joint classes first, so that each row is counted once, then each feature of these."""
    joint = classified(docs, s).groupBy("source", "lang", *CLASSES).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(f).alias("feature"), _bin(f).alias("bin")) for f in FEATURES])
    return joint.select("source", F.inline(each), "n").groupBy("source", "feature", "bin").agg(F.sum("n").cast("long").alias("n"))


def report(counts: DataFrame, s: Settings) -> DataFrame:
    """feature, source, bin, n, share, whole, tv, far of counts (added up over batches); every bin of a feature for every source."""
    counts = counts.groupBy("source", F.col("feature").alias("grp"), "bin").agg(F.sum("n").cast("double").alias("value"))
    rows = counts.where("grp = 'lang'").groupBy("source").agg(F.sum("value").alias("_n"))
    share = H.shares(counts, rows, ["source"])
    every = counts.groupBy("grp", "bin").agg(F.sum("value").alias("value"))
    whole = H.shares(every, rows.agg(F.sum("_n").alias("_n")), [])
    spine = counts.select("source", "grp").distinct().join(whole, "grp")  # sources x bins
    distance = H.total_variation(share, spine, ["source", "grp"])
    out = spine.withColumnRenamed("value", "whole").join(share.withColumnRenamed("value", "share"), ["source", "grp", "bin"], "left").join(counts, ["source", "grp", "bin"], "left").join(distance, ["source", "grp"])
    value = lambda c: F.coalesce(c, F.lit(0.0))
    tv = F.round("tv", 6) + F.lit(0.0)
    return out.select("source", "bin", value("value").cast("long").alias("n"), F.round(value("share"), 9).alias("share"), F.round("whole", 9).alias("whole"), tv.alias("tv"), (tv > s.far).alias("far"), F.col("grp").alias("feature"))


def take_new(spark: SparkSession, documents: str, state: str, s: Settings) -> tuple[int, int]:
    """Counts the files that no run before has taken, into the state. Documents and batches that were read."""
    empty = spark.createDataFrame([], COUNTS)
    empty.write.mode("ignore").parquet(f"{state}/counts/batch=-1")  # so that there are counts to read
    read = []

    def keep(batch: DataFrame, number: int) -> None:
        to = f"{state}/counts/batch={number}"
        counted(batch, s).write.mode("overwrite").parquet(to)
        n = spark.read.schema(COUNTS).parquet(to).where("feature = 'lang'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        log.info("batch %d: counted %d documents into %s", number, n, to)
        read.append(n)

    schema = "doc_id long, text string, lang string, source string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", s.files_a_batch).parquet(documents)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(read), len(read)


def run(spark: SparkSession, documents: str, out: str, state: str, s: Settings | None = None) -> dict[str, int]:
    """The job. Returns what it read and wrote, which it also logs."""
    s = s or Settings()
    new, batches = take_new(spark, documents, state, s)
    counts = spark.read.schema(f"{COUNTS}, batch long").parquet(f"{state}/counts")
    made = report(counts, s)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature").parquet(out)
    written = spark.read.schema(REPORT).parquet(out).count()
    log.info("read %d new documents of %s in %d batches; wrote %d rows to %s", new, documents, batches, written, out)
    return {"documents": new, "batches": batches, "rows": written}


REPORT = "source string, bin string, n long, share double, whole double, tv double, far boolean, feature string"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job run twice over documents, with one state; its report."""
    folder = new_folder(spark, "text_profile")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/report", f"{folder}/state")  # a file or a folder
    return spark.read.schema(REPORT).parquet(f"{folder}/report")


def _class(value: str, feature: str) -> str:
    return "CAST(" + " + ".join(f"CAST(coalesce({value} >= {e!r}::DOUBLE, false) AS INTEGER)" for e in Settings().edges(feature)) + " AS VARCHAR)"


SQL = rf"""
WITH t AS (SELECT coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text FROM documents),
m AS (SELECT source, lang, length(text) AS chars, len(regexp_extract_all(text, '{WORD}')) AS words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS letters,
             length(text) - length(replace(text, chr(10), '')) AS breaks, len(regexp_extract_all(text, '{DIGIT}')) AS digits FROM t),
k AS (SELECT source, lang, {_class("words", "words")} AS words, {_class("letters::DOUBLE / nullif(words, 0)", "letters_a_word")} AS letters_a_word,
             {_class("CASE WHEN chars > 0 THEN breaks + 1 ELSE 0 END", "lines")} AS lines, {_class("(1000 * digits)::DOUBLE / nullif(chars, 0)", "digits_a_thousand")} AS digits_a_thousand FROM m),
e AS (SELECT source, unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS feature, unnest([lang, words, letters_a_word, lines, digits_a_thousand, lang || ':' || words]) AS bin FROM k),
c AS (SELECT source, feature, bin, count(*) AS n FROM e GROUP BY ALL),
w AS (SELECT feature, bin, sum(n) / (SELECT count(*) FROM t)::DOUBLE AS whole FROM c GROUP BY ALL),
d AS (SELECT source, count(*) AS docs FROM t GROUP BY 1),
p AS (SELECT d.source, w.feature, w.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n, coalesce(c.n, 0) / docs::DOUBLE AS share, whole FROM d CROSS JOIN w LEFT JOIN c ON c.source = d.source AND c.feature = w.feature AND c.bin = w.bin),
v AS (SELECT source, feature, round(50 * sum(abs(share - whole)), 6) AS tv FROM p GROUP BY ALL)
SELECT source, bin, n, round(share, 9) AS share, round(whole, 9) AS whole, tv, tv > {Settings.far!r}::DOUBLE AS far, feature FROM p JOIN v USING (source, feature)
"""


if __name__ == "__main__":
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--config", help="settings, KEY=VALUE")
    for name, what in (("documents", "folder of Parquet files with source, lang and text, or a pattern of such"), ("out", "folder for the report"), ("state", "folder for the checkpoint and the counts")):
        args.add_argument(f"--{name}", required=True, help=what)
    a = args.parse_args()
    main("text profile", lambda spark: run(spark, a.documents, a.out, a.state, Settings.of(settings(spark, a.config))))
