"""Severity of toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector for all ordered cuts.
x counts the chosen words and word beginnings of a document (sparse). They are
chosen by their association with the label over a bounded sample of labelled documents, in which
near-copies count once. Grades come from the labels alone: 0 is clean, and each greater value
that the sample holds is a grade of severity, in order. By default (graded) a toxic document
that is also labelled as poor is a grade worse than one that is not: labels of 0 and 1
for toxic and quality have three grades, and so two cuts. Without a label of quality the grades
are those of toxic.
A document is rejected if its score w.x reaches the value that parts toxic from
clean documents of the sample with the least sum of both error rates.

The sample is at most `sample` labelled documents, by hash of their id. All
documents are scored on their whole texts, inside one pass without a shuffle.

Nulls: a null text is an empty one; labels that are null are ignored. Without
labels of both kinds nothing is rejected (severity 0). Repeated rows are scored
alike; in the sample a repeated doc_id stands once, with its greatest text and label. Ties: a score that
equals the least rejected one is rejected. Columns named as the results (severity, toxic, p_grade) are replaced;
others are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, release, ship
from .words import shingle_sets

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»„“”…–—"
SAMPLE, FEATURES = 4000, 256
#: Words in a unit of length; words at which a count weighs half (a parameter of fit: all words are counted whatever it is).
UNIT, LONG = 50, 1000


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words without punctuation around them, and the n + 1 offsets of the texts in them."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    offsets = split.offsets.to_numpy()
    return pc.utf8_trim(split.flatten(), characters=PUNCTUATION), offsets - offsets[0]


#: A word's features: itself, and its first code points where it is longer.
PREFIXES = (3, 4, 5, 6)


def word_features(found: pa.Array) -> Iterator[pa.Array]:
    """An array a kind of feature, null where a word has none; one at a time."""
    yield found
    size = pc.utf8_length(found)
    for n in PREFIXES:
        stem = pc.binary_join_element_wise(pc.utf8_slice_codeunits(found, 0, n), "", "*")
        yield pc.if_else(pc.greater(size, n), stem, pa.scalar(None, pa.string()))


def counts(texts: pa.Array, vocabulary: pa.Array, long: int = LONG) -> np.ndarray:
    """How often each feature of the vocabulary stands in each text, and last the number of its words / UNIT.

    Every number of a text of n words is multiplied by long / (long + n): in short texts it stays nearly the
    count, in long ones it nears `long` times the rate, by one rule at all lengths.
    """
    found, offsets = words(texts)
    n = len(vocabulary)
    out = np.zeros(len(texts) * n, dtype=np.int64)
    for kind in word_features(found):
        code = pc.index_in(kind, value_set=vocabulary, skip_nulls=True)
        at = np.flatnonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))
        code = pc.take(code, pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.searchsorted(offsets, at, side="right") - 1
        out += np.bincount(row * n + code, minlength=len(out))
    size = np.diff(offsets)
    out = np.column_stack([out.reshape(len(texts), n), size / UNIT])
    return out * (long / (long + size))[:, None]


@dataclass
class Ordinal:
    words: list[str]
    weights: np.ndarray
    cuts: np.ndarray  # ascending
    reject: float  # the least score w.x of a rejected document
    long: int = LONG

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - self.scores(x)[:, None], -50, 50)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 0.003, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts of the proportional-odds model, by Adam on the penalised mean log-likelihood."""
    n, k = x.shape
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 0.01, 0.99)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(k), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, steps = p[:k], np.exp(p[k + 1 :])
        cuts = p[k] + np.concatenate([[0], np.cumsum(steps)])
        edge = np.concatenate([[-1e9], cuts, [1e9]])
        score = x @ w
        high, low = (1 / (1 + np.exp(np.clip(score - edge[grade + d], -40, 40))) for d in (1, 0))
        mass = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
        d_score = (d_high - d_low) / n
        d_cut = np.zeros(grades - 1)
        np.add.at(d_cut, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -d_high, 0) / n)
        np.add.at(d_cut, np.maximum(grade - 1, 0), np.where(grade > 0, d_low, 0) / n)
        later = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate([x.T @ d_score + ridge * w / np.sqrt(n), [later[0]], later[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:k], p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))])


def _once(texts: pa.Array) -> list[int]:
    """Places of the texts that aren't near-copies of an earlier one: none of four minhashes of their word shingles is shared."""
    seen: set[tuple[int, int]] = set()
    out = []
    parts = (shingle_sets(texts.slice(at, 100)) for at in range(0, len(texts), 100))
    for i, s in enumerate(chain.from_iterable(parts)):
        mine = {(k, int(mix64(s * np.uint64(2 * k + 1) + np.uint64(k)).min())) for k in range(4)} if len(s) else {(-1, 0)}
        if not mine & seen:
            out.append(i)
        seen |= mine
    return out


def choose_words(texts: list[str], toxic: np.ndarray, most: int = FEATURES) -> list[str]:
    """Features whose rate among the words of toxic texts exceeds that of clean ones most surely (root of the log-likelihood ratio). A text counts a feature at most 3 times."""
    texts = pa.array(texts, pa.string())
    keep = np.array(_once(texts), dtype=np.int64)
    found, offsets = words(pc.take(texts, pa.array(keep)))
    label, size = toxic[keep], np.diff(offsets)
    total = [int(size[~label].sum()), int(size[label].sum())]
    if not min(total):
        return []
    doc = np.repeat(np.arange(len(keep)), size)
    del texts
    score: dict[str, float] = {}
    for kind in word_features(found):
        coded = pc.dictionary_encode(pc.fill_null(kind, ""))
        del kind
        names, pair = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        n = len(names)
        pair += doc * n
        pair, times = np.unique(pair, return_counts=True)
        owner, code = np.divmod(pair, n)
        times, bad = np.minimum(times, 3), label[owner]
        a, b = np.bincount(code, weights=times * bad, minlength=n), np.bincount(code, weights=times * ~bad, minlength=n)
        docs = np.bincount(code, weights=bad, minlength=n)
        e = np.maximum((a + b) * total[1] / sum(total), 1e-9)
        g = np.sqrt(np.maximum(0, 2 * (a * np.log(np.maximum(a, 1e-9) / e) + b * np.log(np.maximum(b, 1e-9) / np.maximum(a + b - e, 1e-9)))))
        best = np.flatnonzero((docs >= 3) & (a > e))
        best = best[np.argsort(-g[best], kind="stable")][: 4 * most]
        score |= {f: float(x) for f, x in zip(pc.take(names, pa.array(best)).to_pylist(), g[best], strict=True) if f}
    least = max([3.0, *(0.2 * x for x in score.values())])
    return sorted((f for f, x in score.items() if x >= least), key=lambda f: (-score[f], f))[:most]


def fit_sample(texts: list[str], label: np.ndarray, long: int = LONG) -> Ordinal | None:
    """The model of labelled texts; none without clean and toxic ones or telling features."""
    toxic = label > 0
    vocabulary = choose_words(texts, toxic) if toxic.any() and not toxic.all() else []
    if not vocabulary:
        return None
    x = counts(pa.array(texts, pa.string()), pa.array(vocabulary, pa.string()), long)
    severe = np.unique(label[toxic])
    grade = np.where(toxic, 1 + np.searchsorted(severe, label), 0)
    weights, cuts = fit_ordinal(x, grade, 1 + len(severe))
    return Ordinal(vocabulary, weights, cuts, least_error(x @ weights, toxic), long)


def graded(labels: DataFrame) -> Column:
    """Severity grade of a row of labels: 0 for clean; a toxic document of poor quality stands above one of the same label that isn't poor."""
    toxic = F.col("toxic").cast("int")
    if "quality" not in labels.columns:
        return toxic
    return F.when(toxic > 0, 2 * toxic - F.when(F.col("quality") == 0, 0).otherwise(1)).otherwise(toxic)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, long: int = LONG, grade: Column | None = None) -> Ordinal | None:
    """The model, from at most `sample` labelled documents. One task fits it on that bounded sample; the driver gets its numbers alone. grade: of a row of labels; graded() if none."""
    ship(docs.sparkSession)
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(graded(labels) if grade is None else grade).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        if model := fit_sample(t["text"].to_pylist(), t["label"].to_numpy(), long):
            columns = [model.words, model.weights.tolist(), model.cuts.tolist(), model.reject]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=["words", "weights", "cuts", "reject"])

    got = rows.repartition(1).mapInArrow(run, "words array<string>, weights array<double>, cuts array<double>, reject double").collect()
    return Ordinal(list(got[0]["words"]), np.array(got[0]["weights"]), np.array(got[0]["cuts"]), got[0]["reject"], long) if got else None


def least_error(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score that parts the labels with the least sum of both classes' error rates, in the middle of its gap."""
    order = np.argsort(score, kind="stable")
    s, t = score[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(t)]) / t.sum()  # toxic ones below place i
    wrong = np.concatenate([[0], np.cumsum(~t)])
    wrong = (wrong[-1] - wrong) / (~t).sum()
    cost = missed + wrong
    cost[1:-1][s[1:] == s[:-1]] = 3  # no cut between equal scores
    i = len(cost) - 1 - int(cost[::-1].argmin())
    return float(s[0] - 1 if i == 0 else s[-1] + 1 if i == len(s) else (s[i - 1] + s[i]) / 2)


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """docs with p_grade (array: P(grade >= k)), severity (expected grade) and toxic (boolean)."""
    docs = docs.drop("p_grade", "severity", "toxic")
    if model is None:
        return docs.withColumns({"p_grade": F.lit(None).cast("array<double>"), "severity": F.lit(0.0), "toxic": F.lit(False)})
    ship(docs.sparkSession)
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("p_grade", T.ArrayType(T.DoubleType())), T.StructField("severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(model.words, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                x = counts(batch.column(place), vocabulary, model.long)
                p = model.probabilities(x)
                more = [pa.array(list(p), pa.list_(pa.float64())), pa.array(p.sum(1)), pa.array(model.scores(x) >= model.reject)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "p_grade", "severity", "toxic"])
            release()

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "severity", "toxic", "p_grade")
