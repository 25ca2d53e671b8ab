"""Namelist text: groups of settings, a value a domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(v: object) -> str:
    if isinstance(v, bool):
        return f".{str(v).lower()}."
    return f"'{v}'" if isinstance(v, str) else str(v)


def render(groups: dict[str, dict[str, object]]) -> str:
    """&group, a line `key = a, b, c,` for each setting (a list is one value a domain), and / ."""
    lines = []
    for group, settings in groups.items():
        lines.append(f"&{group}")
        for key, v in settings.items():
            lines.append(f" {key} = " + ", ".join(_text(x) for x in (v if isinstance(v, (list, tuple)) else [v])) + ",")
        lines.append("/")
    return "\n".join(lines) + "\n"


def text(groups: dict[str, dict[str, Column | object]]) -> Column:
    """render() for every row: settings may be columns (text is quoted, a timestamp takes the form 2001-02-03_04:05:06, an array is one value a domain)."""

    def one(v: object) -> Column:
        return v if isinstance(v, Column) else F.lit(_text(v))

    lines = []
    for group, settings in groups.items():
        lines.append(F.lit(f"&{group}"))
        for key, v in settings.items():
            values = F.concat_ws(", ", v) if isinstance(v, Column) else F.concat_ws(", ", *[one(x) for x in (v if isinstance(v, (list, tuple)) else [v])])
            lines.append(F.concat(F.lit(f" {key} = "), values, F.lit(",")))
        lines.append(F.lit("/"))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def stamp(t: Column, domains: int = 1) -> Column:
    """A quoted time for each domain."""
    return F.array_repeat(F.concat(F.lit("'"), F.date_format(t, "yyyy-MM-dd_HH:mm:ss"), F.lit("'")), domains)
