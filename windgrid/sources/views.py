"""Stand-in views over the driver's tables: each is one text with the dialects' few differences filled in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "hours": lambda x: f"make_dt_interval(0, CAST({x} AS INT))", "k": "CAST(get_json_object(props, '$.k') AS INT)", "div": "DIV", "text": "STRING",
    "day": "to_date(l_shipdate)", "days": "unix_date(day)", "stamp": "date_format(l_shipdate, 'yyyy-MM-dd_HH:mm:ss')", "int": lambda x: f"CAST(CAST({x} AS INT) AS STRING)",
}
_DUCK = {
    "hours": lambda x: f"to_hours(CAST({x} AS INT))", "k": "CAST(props::JSON->>'k' AS INT)", "div": "//", "text": "VARCHAR",
    "day": "CAST(l_shipdate AS DATE)", "days": "(day - DATE '1970-01-01')", "stamp": "strftime(l_shipdate, '%Y-%m-%d_%H:%M:%S')", "int": lambda x: f"CAST(CAST(floor({x}) AS INT) AS VARCHAR)",
}


def _texts(d: dict) -> dict[str, str]:
    t = d["text"]
    return {
        "forcing_v": f"""SELECT l_shipdate + {d["hours"]("((l_orderkey * 7 + l_linenumber) % 8) * 3")} AS time, l_quantity / 2 AS ws,
            CAST((l_partkey * 37 + l_suppkey * 11) % 360 AS DOUBLE) AS wd, (l_discount - CAST(0.05 AS DOUBLE)) * 4 AS ri_b,
            1 + l_tax * 10 AS weight, l_orderkey % 64 AS pixel FROM lineitem""",
        "obs_v": f"SELECT event_id, ts AS time, user_id AS pixel, value / 10 AS ws, {d['k']} * CAST(3.6 AS DOUBLE) AS wd, event_type FROM events",
        "raster_v": f"SELECT CAST(p_partkey % 40 AS INT) AS i, CAST(p_partkey {d['div']} 40 AS INT) AS j, p_retailprice AS hgt, p_size AS lu FROM part",
        "modellog_v": f"""SELECT concat('Timing for main', CASE WHEN l_linenumber % 2 = 0 THEN ' (dt=  1.33)' ELSE '' END, ': time ',
            CASE WHEN l_orderkey % 50 = 0 THEN 'BAD-STAMP' ELSE {d["stamp"]} END, ' on domain   ', CAST(1 + l_linenumber % 5 AS {t}), ':   ',
            {d["int"]("l_quantity")}, '.5 elapsed seconds') AS line FROM lineitem""",
        "manifest_v": f"""SELECT concat('b', lpad(CAST(n AS {t}), 3, '0')) AS run, day AS sample_start, 1 AS days, (1 + n % 7) / CAST(sum(1 + n % 7) OVER () AS DOUBLE) AS weight
            FROM (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT {d["day"]} AS day FROM lineitem) AS d WHERE {d["days"]} % 61 = 0) AS k WHERE n <= 40""",
        "points_v": "SELECT s_suppkey AS point_id, CAST((s_suppkey * 137) % 4000 AS DOUBLE) / 100 AS x, CAST((s_suppkey * 271) % 5000 AS DOUBLE) / 100 AS y FROM supplier",
        "wrg_text_v": f"""SELECT concat(CASE WHEN i % 2 = 0 THEN 'GridPoint ' ELSE '' END, concat_ws(' ', CAST(i * 100 AS {t}), CAST(j * 100 AS {t}),
            CASE WHEN (i + j) % 17 = 0 THEN '0' ELSE {d["int"]("hgt")} END, '100',
            CASE WHEN (i + j) % 17 = 0 THEN '1.0 1.50' ELSE concat(CAST(5 + lu % 5 AS {t}), '.5 2.1') END, '300', '2',
            concat('500 ', CAST(50 + lu AS {t}), ' 210'), CASE WHEN i = 7 THEN '' ELSE concat('500 ', CAST(60 + lu AS {t}), ' 190') END)) AS line FROM raster_v""",
    }


SPARK_VIEWS, DUCK_VIEWS = _texts(_SPARK), _texts(_DUCK)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table of the driver."""
    if name not in SPARK_VIEWS:
        return table(spark, sf_dir, name)
    text = SPARK_VIEWS[name]
    used = {w for w in re.findall(r"FROM (\w+)", text) if w in TABLES or w in SPARK_VIEWS}
    for w in used:
        text = re.sub(rf"FROM {w}\b", f"FROM {{{w}}}", text)
    return spark.sql(text, **{w: view(spark, sf_dir, w) for w in used})


def with_views(sql: str) -> str:
    """sql with the views that it names put before it, for DuckDB."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in DUCK_VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(DUCK_VIEWS[name])
                need.append(name)

    add(sql)
    head = ", ".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in need)
    if not head:
        return sql
    body = sql.strip()
    if (m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)) is not None:
        return f"WITH {m[1] or ''}{head}, {body[m.end() :]}"
    return f"WITH {head} {body}"
