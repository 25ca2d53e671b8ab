r"""Winnowing fingerprints with Spark functions only.

Tokens are words; a run of more than LONG_RUN characters without white space gives
single characters, so texts without spaces are fingerprinted too (a parameter; every
character is read either way). Every run of k tokens has a 64-bit rolling hash, a
cyclic polynomial over its tokens' hashes: with t joining and u leaving after k steps,
h' = rot(h, 1) ^ rot(u, k) ^ t. It is evaluated by its closed form, since k is small and
Spark's higher-order functions have no running state. Of every w hashes in a row the
least is chosen, the rightmost of equal ones, and kept with its position. Two texts that
share a run of w + k - 1 tokens share a fingerprint, and none shorter than k tokens is
noticed.

A text of fewer than k tokens is one gram; one of fewer than w hashes is one
window. The likeness of two fingerprints is the Jaccard index of their hashes;
two empty ones are alike (1).

Nulls: a null text is an empty one, with an empty fingerprint; a null doc_id
sorts below all others. Repeated ids are taken in the order of their text's
hash, and repeated rows in any order (they are alike). Long texts are read whole.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of

K, W, LONG_RUN = 5, 4, 24


def tokens(text: Column, long_run: int = LONG_RUN) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?<!\S)\S{{1,{long_run}}}(?!\S)|\S"), F.lit(0))


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def grams(text: Column, k: int = K, long_run: int = LONG_RUN) -> Column:
    """The rolling hash of every run of k tokens; of all tokens, if they are fewer."""
    words = F.transform(tokens(text, long_run), lambda t: F.xxhash64(t))

    def of(a: Column) -> Column:
        # Horner's form of the sum of rotated hashes would name each step twice: rotations are written out
        every = F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: reduce(Column.bitwiseXOR, [_rotated(F.get(a, i + d), (k - 1 - d) % 64) for d in range(k)]))
        return F.when(F.size(a) >= k, every).when(F.size(a) > 0, F.array(F.xxhash64(a))).otherwise(F.array().cast("array<long>"))

    return _let(words, of)


def choose(gram_hashes: Column, w: int = W) -> Column:
    """array<struct<hash, position>>: the least hash of every window, the rightmost of equal ones, once each, in their order."""

    def of(h: Column) -> Column:
        least = F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda j: F.least(*[F.get(h, j + d) for d in range(w)]))

        def place(m: Column, j: Column) -> Column:
            return reduce(lambda rest, d: F.when(F.get(h, j + d) == m, j + d).otherwise(rest), range(1, w), j)

        windows = F.array_distinct(F.transform(least, place))
        last = F.size(h) - F.lit(1) - (F.array_position(F.reverse(h), F.array_min(h)) - 1).cast("int")
        at = F.when(F.size(h) >= w, windows).when(F.size(h) > 0, F.array(last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.get(h, i).alias("hash"), i.alias("position")))

    return _let(gram_hashes, of)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def fingerprint(text: Column, k: int = K, w: int = W, long_run: int = LONG_RUN) -> Column:
    """array<struct<hash: long, position: int>>; hashes() and positions() take it apart."""
    return choose(grams(F.coalesce(text, F.lit("")), k, long_run), w)


def hashes(print_: Column) -> Column:
    return F.array_distinct(print_["hash"])


def positions(print_: Column) -> Column:
    return print_["position"]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1.0)))


#: Ranges of a table at most; each is sorted by itself, on disk where it is large.
RANGES = 1 << 16


def _halve(bounds: Column, n: int, step: int):
    """One step of the binary search for the number of bounds under the key."""
    return lambda low: F.when((low + step <= n) & (F.get(bounds, low + step - 1) < F.col("_n_key")), low + step).otherwise(low)


def _longs(values: list[int]) -> Column:
    """An array of longs that Spark folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(df: DataFrame, key: str, columns: list[str], tie: Column, rows_each: int = 1000) -> DataFrame:
    """df with next_<column>: the columns of the next row by falling key; after the last row, the first.

    Ranges of the key, cut at quantiles, are ordered one by one; the top row of a
    range is also sent to the range above, where it follows the last row. Rows of
    one key are in one range. Names that begin with _n_ are reserved.
    """
    df = df.withColumn("_n_key", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")))
    n = df.count()
    if not n:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("_n_key")
    parts = pieces_of(n, rows_each, most=RANGES)
    at = [(i + 1) / parts for i in range(parts - 1)]
    cuts = df.agg(F.percentile_approx("_n_key", at, max(20_000, 4 * parts)).alias("c")).first()["c"] if at else []
    cuts = sorted({int(c) for c in cuts})  # range i holds keys over cuts[i - 1], up to cuts[i]
    range_of = F.lit(0)
    step = 1 << len(cuts).bit_length() >> 1
    while step:  # binary search: the number of cuts under the key
        range_of = _let(range_of, _halve(_longs(cuts), len(cuts), step))
        step //= 2
    tops = df.groupBy(range_of.alias("r")).agg(F.max("_n_key").alias("top")).orderBy("r").collect()  # a row a range
    place, top = _longs([r["r"] for r in tops]), _longs([r["top"] for r in tops])
    number = (F.array_position(place, F.col("_n_range").cast("long")) - 1).cast("int")
    if len(tops) == len(cuts) + 1:  # no range is empty
        number = F.col("_n_range")
    df = df.withColumn("_n_range", range_of).withColumn("_n_range", number)
    last = F.get(top, F.col("_n_range")) == F.col("_n_key")
    sent = F.array(F.struct(F.col("_n_range").alias("r"), F.lit(0).alias("x")), F.struct(((F.col("_n_range") + 1) % len(tops)).alias("r"), F.lit(1).alias("x")))
    df = df.withColumn("_n_to", F.explode(F.when(last, sent).otherwise(F.slice(sent, 1, 1))))
    order = Window.partitionBy(F.col("_n_to.r")).orderBy(F.col("_n_to.x"), F.desc("_n_key"), tie)
    out = df.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("_n_to.x = 0")
    return out.drop("_n_key", "_n_range", "_n_to")


def compare_edits(docs: DataFrame, k: int = K, w: int = W, long_run: int = LONG_RUN) -> DataFrame:
    """doc_id, n_chars, edited (text), print, edited_print (chosen hashes with positions), near_edited, near_next."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"], F.xxhash64("text"))
    n = F.length("text")
    half = F.floor(n / 2)
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half.cast("int")))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "text", "next_text")
    # only texts are moved: a third fingerprint is cheaper than shuffling two
    rows = rows.withColumns({name: fingerprint(F.col(of), k, w, long_run) for name, of in (("print", "text"), ("edited_print", "edited"), ("_next_print", "next_text"))})
    rows = rows.withColumns({"_own": hashes(F.col("print")), "_edited": hashes(F.col("edited_print")), "_next": hashes(F.col("_next_print"))})
    near = {"near_edited": likeness(F.col("_own"), F.col("_edited")), "near_next": likeness(F.col("_own"), F.col("_next"))}
    return rows.select("doc_id", "n_chars", "edited", "print", "edited_print", *[c.alias(a) for a, c in near.items()])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    digest = lambda p: F.concat(F.lower(F.hex(F.xxhash64(p))), F.lit("-"), F.lower(F.hex(F.xxhash64(F.lit(1), p))))
    out = compare_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("print")).alias("fingerprint"),
        digest(F.col("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
