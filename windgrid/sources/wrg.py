"""Wind resource grid text: reader (both dialects) and writer.

A file begins with  nx ny x0 y0 dx ; a row is  [label] E N elevation height A k PD nsect  and for
each sector  freq * 1000, A * 10, k * 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import gamma_fn
from .modellog import once

LABEL = "GridPoint"
# Fixed values that define results: the row of a cell without data.
NODATA_A, NODATA_K, NODATA_ELEVATION = 1.0, 1.5, 0.0
NAMES = ("e", "n", "elev", "height", "a", "k", "pd", "nsect")


def parse(lines: DataFrame, column: str = "line", dialect: str = "any") -> DataFrame:
    """e, n, elev, height, a, k, pd, nsect, sectors (array of freq, a, k in natural units).

    dialect "any": a first token that isn't a number is dropped. "labelled": only LABEL is dropped, and
    cells without data have null values. Rows that are short or hold other text are skipped.
    """
    t = F.col("t")
    first = F.try_element_at(t, F.lit(1))
    drop = first.try_cast("double").isNull() if dialect == "any" else first == LABEL
    rows = once(lines, t=F.split(F.trim(column), r"\s+"))
    rows = once(rows, v=F.transform(F.when(drop, F.slice(t, F.lit(2), F.size(t))).otherwise(t), lambda x: x.try_cast("double")))
    rows = rows.where(F.size("v") >= 8).withColumn("ns", F.get("v", 7).cast("int"))
    rows = rows.where((F.size("v") >= 8 + 3 * F.col("ns")) & F.col("ns").isNotNull() & (F.col("ns") >= 0))
    rows = rows.where(F.forall(F.slice("v", F.lit(1), 8 + 3 * F.col("ns")), lambda x: x.isNotNull()))
    at = lambda s, k: F.get("v", 8 + 3 * s + k)
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.col("ns") - 1, F.lit(0))), lambda s: F.struct((at(s, 0) / 1000).alias("freq"), (at(s, 1) / 10).alias("a"), (at(s, 2) / 100).alias("k")))
    out = rows.select(*[F.get("v", i).alias(n) for i, n in enumerate(NAMES[:-1])], F.col("ns").alias("nsect"), F.when(F.col("ns") > 0, each).otherwise(F.slice(each, 1, 0)).alias("sectors"))
    if dialect == "labelled":
        bad = no_data(F.col("elev"), F.col("a"), F.col("k"))
        out = out.withColumns({n: F.when(~bad, F.col(n)) for n in ("elev", "a", "k", "pd", "sectors")})
    return out


def masked(a: Column, k: Column) -> Column:
    """Predicate on the fit alone: A at most 1 and k of exactly 1.5."""
    return (a <= NODATA_A) & (F.abs(k - NODATA_K) < 1e-9)


def no_data(elev: Column, a: Column, k: Column) -> Column:
    """Predicate on all three values."""
    return (elev == NODATA_ELEVATION) & (a == NODATA_A) & (k == NODATA_K)


def sector_mean(sectors: Column) -> Column:
    """Mean speed as the sum over sectors of freq * A * Gamma(1 + 1/k)."""
    return F.aggregate(sectors, F.lit(0.0), lambda s, x: s + x["freq"] * x["a"] * gamma_fn(1 + 1 / x["k"]))


def header(lines: DataFrame, column: str = "line") -> DataFrame:
    """nx, ny, x0, y0, dx of lines with five numbers."""
    v = F.transform(F.split(F.trim(column), r"\s+"), lambda x: x.try_cast("double"))
    five = lines.select(v.alias("v")).where((F.size("v") == 5) & F.forall("v", lambda x: x.isNotNull()))
    return five.select(*[F.get("v", i).cast("int").alias(n) for i, n in enumerate(("nx", "ny"))], *[F.get("v", i + 2).alias(n) for i, n in enumerate(("x0", "y0", "dx"))])


def format_rows(grid: DataFrame, label: str | None = LABEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """line: rows of the text form, and the columns to keep beside it; null sector values are written as 0."""
    num = lambda x, d: F.format_string(f"%.{d}f", F.coalesce(x, F.lit(0.0)))
    sect = F.flatten(F.transform("sectors", lambda s: F.array(num(s["freq"] * 1000, 3), num(s["a"] * 10, 4), num(s["k"] * 100, 4))))
    head = [num(F.col(c), 4) for c in ("e", "n", "elev", "height", "a", "k", "pd")]
    parts = [F.lit(label)] * bool(label) + [*head, F.size("sectors").cast("string"), F.array_join(sect, " ")]
    return grid.select(F.concat_ws(" ", *parts).alias("line"), *keep)


def read(spark: SparkSession, path: str, dialect: str = "any") -> DataFrame:
    return parse(spark.read.text(path), "value", dialect)


def write(grid: DataFrame, path: str, label: str | None = LABEL) -> None:
    format_rows(grid, label).write.text(path)
