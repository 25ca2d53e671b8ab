"""KEY=VALUE settings: comments and quotes are taken off, the environment wins, required keys must be there."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(text: str) -> dict[str, str]:
    out = {}
    for raw in text.splitlines():
        line = raw.strip().removeprefix("export ")
        key, eq, value = line.partition("=")
        if not eq or line.startswith("#"):
            continue
        value = value.strip()
        if value[:1] in ("'", '"'):
            value = value[1:].partition(value[0])[0]
        else:
            value = value.partition(" #")[0].strip()
        out[key.strip()] = value
    return out


def load(path: str, required: tuple[str, ...] = (), env: Mapping[str, str] = os.environ) -> dict[str, str]:
    with open(path, encoding="utf-8") as f:
        out = parse(f.read())
    out |= {k: env[k] for k in {*out, *required} if k in env}
    if missing := [k for k in required if not out.get(k)]:
        raise KeyError(f"missing settings: {', '.join(missing)}")
    return out


def settings(lines: DataFrame, env: DataFrame | None = None, by: str = "site", column: str = "line") -> DataFrame:
    """by, key, value of many sites' settings held as lines (by, n, line): the last line of a key counts, and env (by, key, value) wins."""
    bare = F.regexp_replace(F.trim(column), r"^export ", "")
    key, value = F.trim(F.regexp_extract(bare, r"^([^=#][^=]*)=(.*)$", 1)), F.trim(F.regexp_extract(bare, r"^([^=#][^=]*)=(.*)$", 2))
    quoted = F.regexp_extract(value, r"""^(['"])(.*?)(\1|$)""", 2)
    plain = F.trim(F.regexp_replace(value, r" #.*$", ""))
    found = lines.select(by, "n", key.alias("key"), F.when(value.rlike("""^['"]"""), quoted).otherwise(plain).alias("value")).where("key <> ''")
    last = found.groupBy(by, "key").agg(F.max_by("value", "n").alias("value"))
    if env is None:
        return last
    both = last.join(env.select(by, "key", F.col("value").alias("_env")), [by, "key"], "left")
    return both.select(by, "key", F.coalesce("_env", "value").alias("value"))


def missing(found: DataFrame, required: list[str], by: str = "site") -> DataFrame:
    """by, key: required settings that a site lacks or leaves empty."""
    every = found.select(by).distinct().withColumn("key", F.explode(F.array(*map(F.lit, required))))
    return every.join(found.where("value <> ''"), [by, "key"], "left_anti")
