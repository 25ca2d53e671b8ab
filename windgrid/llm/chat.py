r"""Chat formatting with Spark functions only.

A declarative Template names the control strings, the roles under the loss mask
and the turn order. Every turn becomes  open role sep text close ; the text of
a trained role follows `trained` in place of `sep`, so the output alone tells
what is under the loss mask. A finite-state machine over roles validates the
order of turns; a conversation that breaks it is formatted all the same, with
valid = false. A control string inside a text or role gets one more backslash
after its first character; reading takes one away, so both ways are exact.

Nulls: a null text or role is an empty one; a null turn sorts first. Rows of one
conversation are ordered by turn, role, text; repeated rows are turns of their
own. Ties: turns that are equal in all three are alike. Empty texts are turns without
text; very long ones are formatted whole. A conversation is one output row and so is
gathered, whatever its length; rows without a conv_id are one conversation. Only
conv_id, turn, role and text are read, so other columns can't clash. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<s>"
    sep: str = "[INST]"
    trained: str = "[/INST]"
    close: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; an absent move is an error.
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.sep, self.trained, self.close)


def _any(template: Template, backslashes: str) -> str:
    by_first: dict[str, list[str]] = {}
    for c in template.controls:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(rf"(?<={re.escape(a)}){backslashes}(?=\\*(?:{'|'.join(rest)}))" for a, rest in by_first.items())


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, _any(template, ""), r"\\")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, _any(template, r"\\"), "")


def next_state(template: Template, state: Column, role: Column) -> Column:
    out = F.lit("error")
    for a, moves in template.moves.items():
        for r, b in moves.items():
            out = F.when((state == a) & (role == r), F.lit(b)).otherwise(out)
    return out


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted (string), segments (array of text and loss flag, whose texts concatenate to formatted), valid."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    trained = lambda t: t["role"].isin(*template.loss_roles)
    mark = lambda t: F.concat(F.lit(template.open), escape(t["role"], template), F.when(trained(t), F.lit(template.trained)).otherwise(F.lit(template.sep)))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(mark(t).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"], template).alias("text"), trained(t).alias("loss")),
                F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    state = F.aggregate("turns", F.lit("start"), lambda s, t: next_state(template, s, t["role"]))
    out = convs.select("conv_id", segments.alias("segments"), (state != "error").alias("valid"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: array of role, text, loss."""
    parts = F.split(formatted, re.escape(template.close))
    mark = f"{re.escape(template.sep)}|{re.escape(template.trained)}"

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(template.open) + 1), F.length(part))
        two = F.split(body, mark, 2)
        loss = F.locate(template.trained, part) == F.length(two[0]) + len(template.open) + 1
        return F.struct(unescape(two[0], template).alias("role"), unescape(two[1], template).alias("text"), loss.alias("loss"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.sql(f"SELECT -7L conv_id, turn, role, '{said}' text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)"))
    out = format_conversations(turns)
    out = out.select("conv_id", "formatted", "valid", read_back(F.col("formatted")).alias("back"))
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]), "")
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
e AS (SELECT *, regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS r,
             regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS x FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             CAST(sum(length(r) + length(x) + CASE WHEN role = 'assistant' THEN 14 ELSE 13 END) AS BIGINT) AS formatted_chars,
             string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       regexp_full_match(roles, 's?(ua)*u?') AS valid FROM g
"""
