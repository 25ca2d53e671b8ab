"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic classifier over the form of a text (symbols, case, repetition, word
shapes) gives each document's evidence p. Grouped sums of p give every host and
every path of a host a posterior mean: a path's is shrunk to its host's, a
host's to the global mean, the stronger the fewer documents it has. The strength
of each level's prior is estimated from the spread of its groups (method of
moments). A document's odds are then its evidence with the global prior replaced
by its path's posterior:  odds(p) * odds(path) / odds(global).

A source is a host or a URL; its path is the first segment, or the language
where it has none. The classifier is fitted on at most `sample` labelled
documents, by hash of their id; the site statistics cover all documents.

Nulls: a null text is an empty one; null hosts and paths are groups of their
own; null labels are ignored. Without labels of both kinds p is 1 for all.
Repeated rows count as often as they stand; in the sample a repeated doc_id stands
once, with its greatest text and the least of its labels. Ties: a quality of exactly a half is kept. Long texts
are read whole. Columns named as the results (p_text, p_site, quality, keep) are
replaced; others are kept (but for names that begin with _q_). An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, release, ship
from .words import SPACE, buffer, word_hashes

SAMPLE = 6000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[list(b"!?")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:")] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row of shares for each text: symbols, bars, capitals, digits, exclamations, stops, repeated words, word length, length."""
    raw, offsets = buffer(texts)
    n = np.diff(offsets)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[raw])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)

    hashes, ends = word_hashes(texts)
    words = np.diff(ends)

    def repeats(gap: int) -> np.ndarray:
        same = np.zeros(len(hashes) + 1, dtype=np.int64)
        if len(hashes) > gap:
            same[1 + gap :] = hashes[gap:] == hashes[:-gap]
        total = np.cumsum(same)
        first = np.minimum(ends[:-1] + gap, ends[1:])  # a pair lies within one text
        return (total[ends[1:]] - total[first]) / np.maximum(words, 1)

    bar = np.zeros(256, dtype=bool)
    bar[ord("|")] = True
    letters = np.maximum(1e-9, 1 - share(SPACE) - share(_SYMBOL) - share(_DIGIT))
    upper = share(_UPPER) / letters
    cap = lambda a, most: np.minimum(a, most) / most
    return np.column_stack([
        cap(share(_SYMBOL), 0.1), cap(share(_SYMBOL), 0.5), cap(share(bar), 0.05), cap(upper, 0.3), cap(np.maximum(0, upper - 0.3), 0.5), cap(share(_DIGIT), 0.2),
        cap(share(_BANG), 0.05), cap(share(_STOP), 0.05), cap(repeats(1), 0.1), cap(repeats(1), 0.5), cap(repeats(2), 0.2), cap(n / np.maximum(words, 1), 15), np.log1p(n) / 12,
    ])


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def p(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> Logistic:
    """Ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Logistic | None:
    """The text classifier, from at most `sample` labelled documents."""
    ship(docs.sparkSession)
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").cast("int").alias("label"))
    rows = rows.select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([pa.array(list(features(part.column(0))), pa.list_(pa.float64())), part.column(1)], names=["x", "label"])

    got = rows.mapInArrow(run, "x array<double>, label int").toPandas()
    y = got["label"].to_numpy() > 0
    if not len(y) or y.all() or not y.any():
        return None
    x = np.stack(got["x"])
    order = np.lexsort(np.column_stack([x, y]).T)  # rows arrive in any order; sums must not depend on it
    return fit_logistic(x[order], y[order].astype(float))


def evidence(docs: DataFrame, model: Logistic | None, with_text: bool = True) -> DataFrame:
    """docs with p_text, the classifier's probability of good quality; without the text, if it isn't wanted."""
    docs = docs.drop("p_text")
    if model is None:
        return (docs if with_text else docs.drop("text")).withColumn("p_text", F.lit(1.0))
    ship(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c != "text"], "text")
    place, out = len(docs.columns) - 1, len(docs.columns) - (not with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*b.columns[:out], pa.array(model.p(features(b.column(place))))], names=[*b.schema.names[:out], "p_text"])
            release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:out], T.StructField("p_text", T.DoubleType())]))


def site(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path of a source."""
    bare = F.regexp_replace(source, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parts = F.split(bare, "[/?#]", 3)
    return F.lower(parts[0]), F.coalesce(F.when(F.size(parts) > 1, parts[1]), lang)


def _strength(groups: DataFrame, base) -> float:
    """The prior's weight in documents: within-group against between-group variance, by moments. groups: n, sum_p, sum_v and the mean they shrink to."""
    between = (F.col("sum_p") - F.col("n") * base) ** 2 / F.col("n")
    r = groups.agg(F.sum(between).alias("ss"), F.sum("sum_v").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not r["k"] or r["k"] < 2:
        return 50.0
    within = max(r["within"] / r["n"], 1e-6)
    spread = (r["ss"] - r["k"] * within) / max(r["n"] - r["n2"] / r["n"], 1.0)
    return float(min(1000.0, max(5.0, within / max(spread, 1e-9))))


def rate_sites(scored: DataFrame) -> DataFrame:
    """host, path, p_site (posterior mean of the path) and p_all (global mean). scored: host, path, p_text."""
    paths = durable(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_text").alias("sum_p"), F.sum(F.col("p_text") * F.col("p_text")).alias("sum_pp")))
    total = paths.agg(F.sum("n"), F.sum("sum_p")).first()
    overall = (total[1] or 0.0) / max(1, total[0] or 0)
    own = F.col("sum_pp") - F.col("sum_p") * F.col("sum_p") / F.col("n")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum_p").alias("sum_p"), F.sum("sum_pp").alias("sum_pp")).withColumn("sum_v", own)
    k = _strength(hosts, F.lit(overall))
    hosts = hosts.select("host", ((F.col("sum_p") + k * overall) / (F.col("n") + k)).alias("p_host"))
    paths = paths.withColumn("sum_v", own).join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k = _strength(paths, F.col("p_host"))
    return paths.select("host", "path", ((F.col("sum_p") + k * F.col("p_host")) / (F.col("n") + k)).alias("p_site"), F.lit(overall).alias("p_all"))


def classify(docs: DataFrame, labels: DataFrame, with_text: bool = True) -> DataFrame:
    """docs (without the text, if it isn't wanted) with p_text, p_site, quality (posterior probability) and keep (quality of a half or more)."""
    docs = docs.drop("p_text", "p_site", "quality", "keep")
    columns = [c for c in docs.columns if with_text or c != "text"]
    host, path = site(F.col("source"), F.col("lang"))
    named = docs.withColumns({"_q_host": host, "_q_path": path})
    scored = durable(evidence(named, fit(docs, labels), with_text))  # texts are scored once; the sites' sums and the decisions read this
    sites = rate_sites(scored.select(F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), "p_text")).toDF("_q_site_host", "_q_site_path", "p_site", "_q_all")
    # a host or path may hold a third of all rows: the sites' side is one row each, and Spark may split the documents' side
    same = F.col("_q_host").eqNullSafe(F.col("_q_site_host")) & F.col("_q_path").eqNullSafe(F.col("_q_site_path"))
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = lambda p: clip(p) / (1 - clip(p))
    ratio = odds(F.col("p_text")) * odds(F.col("p_site")) / odds(F.col("_q_all"))
    out = scored.join(sites, same).withColumn("_q_posterior", ratio / (1 + ratio))
    return out.select(*columns, "p_text", "p_site", F.col("_q_posterior").alias("quality"), (F.col("_q_posterior") >= 0.5).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"), with_text=False)
    return out.select("doc_id", "p_text", "p_site", "quality", "keep")
