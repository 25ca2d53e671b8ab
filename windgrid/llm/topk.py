"""Exact top-k inner products with a pivot-distance index.

|q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so an inner product is bounded by the largest norm
and the least distance that are possible, and the triangle inequality bounds
distances. Every vector is keyed by its nearest pivot and its distance to it; the
distances of a pivot are cut into annuli, and an annulus also knows its largest norm
and the span of its vectors' distances to every other pivot: the widest gap between a
query's distance and a span is the least distance to any of them.
A query sorts the annuli by their bound: the first ones give it a threshold (its k-th
best score so far), and of the rest only those are opened whose bound reaches the
threshold. So results are exact, whatever the bounds can save: on vectors without
structure in many dimensions all distances are alike and nearly all annuli are opened
(opened_share() tells).

Pivots are a bounded sample (at most 64 vectors, by hash of the id), the catalogue
of annuli has at most pivots * rings rows and pivots^2 * rings spans; these go to the
driver. All rows are indexed. An annulus is stored in blocks of about 2,048 vectors,
dealt to tasks a few at a time, so many equal vectors are many blocks and many tasks.
Queries meet blocks as matrices.

Left out: vectors that are null, or hold null or non-finite components, or whose
squared norm overflows. Shorter vectors are filled up with zeros. Ties go to the
smaller id. Rows that repeat a query's id are not its candidates; a repeated query id
is asked once, with its least vector; other repeated ids are candidates as often as
they stand. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pieces_of, ship

RINGS, BLOCK, QUERY_BLOCK = 8, 2048, 256
#: Blocks of an annulus that meet their queries in one task.
TASK_BLOCKS = 8


def _matrix(blobs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(-1, dim)


def _to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots], axis=1)


def best(scores: np.ndarray, ids: np.ndarray, k: int, least: float) -> np.ndarray:
    """Places of the k highest scores not under least, ties to the smaller id."""
    if len(scores) > k:
        least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
    at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def best_of_rows(scores: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of best() of every row, for thresholds of its own."""
    n = scores.shape[1]
    if n > k and not np.isfinite(least).all():
        least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
    row, at = np.nonzero(scores >= np.maximum(least, -1e300)[:, None])
    many = np.bincount(row, minlength=len(scores)) > k
    if many.any():  # ties at the threshold, or a block of many good ones
        few = ~many[row]
        found = [(i, best(scores[i], ids, k, least[i])) for i in np.flatnonzero(many).tolist()]
        row = np.concatenate([row[few], *[np.full(len(a), i) for i, a in found]])
        at = np.concatenate([at[few], *[a for _, a in found]])
    return row, at


def finite(vector_col: str) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN nor infinities."""
    return F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Index:
    """The index over a table: see the module. df: vectors are arrays of numbers; is_query: a condition on id_col."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, is_query) -> None:
        self.spark = df.sparkSession
        ship(self.spark)
        vector = F.transform(vector_col, lambda x: x.cast("double"))
        raw = df.where(F.col(id_col).isNotNull() & finite(vector_col)).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        raw = raw.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) < float("inf"))
        self.count, self.dim = raw.agg(F.count("*"), F.max(F.size("v"))).first()
        if self.count and self.dim:
            self._build(raw)

    def _build(self, raw: DataFrame) -> None:
        spark, dim = self.spark, self.dim
        filled = lambda v: np.pad(np.asarray(v, dtype=np.float64), (0, dim - len(v)))
        n_pivots = max(1, min(64, int(self.count**0.5) // 8))
        sample = raw.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").collect()
        pivots = np.array([filled(r["v"]) for r in sample])

        def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    v = np.stack([filled(a) for a in x["v"]])
                    d = _to_pivots(v, pivots)
                    near = d.argmin(1)
                    yield pd.DataFrame({"id": x["id"], "row": x["row"], "v": [a.astype("<f8").tobytes() for a in v], "asks": x["asks"], "pivot": near, "dist": d[np.arange(len(d)), near]})

        keyed = durable(raw.withColumn("row", F.monotonically_increasing_id()).mapInPandas(key, "id long, row long, v binary, asks boolean, pivot int, dist double"))
        at = [i / RINGS for i in range(1, RINGS)]
        cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", at, 1000).alias("cuts"))
        keyed = keyed.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
        catalogue = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n")).toPandas()
        catalogue = catalogue.sort_values(["pivot", "ring"], ignore_index=True)
        catalogue["annulus"], catalogue["blocks"] = np.arange(len(catalogue)), -(-catalogue["n"] // BLOCK)
        known = F.broadcast(spark.createDataFrame(catalogue[["pivot", "ring", "annulus", "blocks"]]))  # at most pivots * rings rows
        placed = keyed.join(known, ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))

        def bundle(x: pd.DataFrame) -> pd.DataFrame:
            v = _matrix(x["v"], dim)
            d = _to_pivots(v, pivots)
            return pd.DataFrame({
                "annulus": x["annulus"][:1], "task": x["block"][:1] // TASK_BLOCKS, "ids": [x["id"].to_numpy().astype("<i8").tobytes()], "vs": [b"".join(x["v"])],
                "n": [len(x)], "top": [(v**2).sum(1).max()], "low": [d.min(0)], "high": [d.max(0)],
            })

        self.blocks = durable(placed.groupBy("annulus", "block").applyInPandas(bundle, "annulus long, task long, ids binary, vs binary, n long, top double, low array<double>, high array<double>"))
        spans = self.blocks.select("annulus", F.posexplode(F.arrays_zip("low", "high")).alias("p", "s")).groupBy("annulus", "p")
        spans = spans.agg(F.min("s.low").alias("low"), F.max("s.high").alias("high")).orderBy("annulus", "p").toPandas()  # at most pivots^2 * rings rows
        self.low, self.high = (spans[c].to_numpy().reshape(len(catalogue), len(pivots)) for c in ("low", "high"))
        self.top = self.blocks.groupBy("annulus").agg(F.max("top").alias("top")).orderBy("annulus").toPandas()["top"].to_numpy()
        self.size, self.tasks = catalogue["n"].to_numpy(), -(-catalogue["blocks"].to_numpy() // TASK_BLOCKS)
        self.pivots = pivots
        self.n_asked = keyed.where("asks").count()
        asked = keyed.where("asks").groupBy("id").agg(F.min("v").alias("v"))
        self.asked = durable(asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(pieces_of(self.n_asked, QUERY_BLOCK)))))

    def _visits(self, k: int, with_least: bool):
        """Of a group of queries, those that open an annulus, a row each of its tasks."""
        dim, pivots, top, low, high, size, tasks = self.dim, self.pivots, self.top, self.low, self.high, self.size, self.tasks

        def bounds(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of each annulus for each query: the most that a score can be; whether the query opens it first."""
            n2 = (v**2).sum(1)
            d = _to_pivots(v, pivots)
            gap = np.zeros((len(v), len(size)))
            for p in range(len(pivots)):
                np.maximum(gap, np.maximum(d[:, p, None] - high[None, :, p], low[None, :, p] - d[:, p, None]), out=gap)
            gap *= 1 - 1e-9
            both = n2[:, None] + top[None, :]
            most = (both - gap**2) / 2 + 1e-9 * both
            order = np.argsort(-most, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.zeros(most.shape, dtype=bool)
            np.put_along_axis(first, order, before < 8 * k, axis=1)
            return most, first

        def run(x: pd.DataFrame) -> pd.DataFrame:
            ids, v = x["id"].to_numpy(), _matrix(x["v"], dim)
            most, first = bounds(v)
            least = x["least"].fillna(-np.inf).to_numpy() if with_least else np.full(len(x), -np.inf)
            opens = ~first & (most >= least[:, None]) if with_least else first
            rows = []
            for a in np.flatnonzero(opens.any(0)).tolist():
                q = np.flatnonzero(opens[:, a])
                rows += [(a, t, ids[q].astype("<i8").tobytes(), v[q].tobytes(), least[q].astype("<f8").tobytes(), len(q)) for t in range(tasks[a])]
            return pd.DataFrame(rows, columns=["annulus", "task", "qids", "qs", "leasts", "asking"])

        return run

    def _opened(self, queries: DataFrame, k: int, with_least: bool) -> DataFrame:
        """Blocks beside the queries that open them. Never a broadcast: sizes are told as compressed, and copies of vectors compress to nearly nothing, so the driver would get far more than it was told."""
        to = queries.groupBy("group").applyInPandas(self._visits(k, with_least), "annulus long, task long, qids binary, qs binary, leasts binary, asking long")
        return self.blocks.drop("top", "low", "high").join(to.hint("merge"), ["annulus", "task"])

    def _scored(self, opened: DataFrame, k: int) -> DataFrame:
        dim = self.dim

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for ids, vs, qids, qs, leasts in zip(x["ids"], x["vs"], x["qids"], x["qs"], x["leasts"], strict=True):
                    ids, qids, leasts = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8"), np.frombuffer(leasts, "<f8")
                    s = np.frombuffer(qs, "<f8").reshape(-1, dim) @ np.frombuffer(vs, "<f8").reshape(-1, dim).T
                    s[qids[:, None] == ids[None, :]] = -np.inf
                    q, at = best_of_rows(s, ids, k, leasts)
                    yield pd.DataFrame({"query_id": qids[q], "vec_id": ids[at], "score": s[q, at]})

        return opened.select("ids", "vs", "qids", "qs", "leasts").mapInPandas(score, "query_id long, vec_id long, score double")

    def _rounds(self, k: int) -> tuple[DataFrame, DataFrame]:
        """The best of the annuli that queries open first, and the queries with their thresholds."""
        first = durable(self._scored(self._opened(self.asked, k, False), k).withColumn("rank", _rank()).where(F.col("rank") <= k))
        least = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        return first, self.asked.join(least, "id", "left")

    def top_k(self, k: int = 5) -> DataFrame:
        """query_id, rank (from 1), vec_id, score."""
        if not self.count or not self.dim:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        first, asked = self._rounds(k)
        both = first.drop("rank").unionByName(self._scored(self._opened(asked, k, True), k))
        return both.withColumn("rank", _rank()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def opened_share(self, k: int = 5) -> float:
        """The share of all pairs of a query and a row that top_k looks at."""
        if not self.count or not self.dim or not self.n_asked:
            return 0.0
        _, asked = self._rounds(k)
        pairs = [self._opened(q, k, with_least).agg(F.sum(F.col("n") * F.col("asking"))).first()[0] or 0 for q, with_least in ((self.asked, False), (asked, True))]
        return sum(pairs) / (self.count * self.asked.count())


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))


def top_k(df: DataFrame, id_col: str, vector_col: str, is_query, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with is_query, the k highest inner products with all other rows."""
    return Index(df, id_col, vector_col, is_query).top_k(k)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    # floor makes longs of NaN and infinities, so they are looked for before it
    floored = F.when(finite("embedding"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", floored.alias("v"))
    return top_k(vectors, "vec_id", "v", F.col("vec_id") % 50 == 0).withColumn("score", F.col("score").cast("long"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
