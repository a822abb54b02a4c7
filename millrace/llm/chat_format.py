"""Chat formatting, in DataFrame functions alone: a finite-state machine over roles checks the order of turns, and a
declarative template gives text segments with a loss flag each.

Control strings inside texts are escaped reversibly: every backslash is doubled, then a backslash goes after the first
character of each control string. `read_back` takes the formatted text apart again.

Defined cases: turns are ordered by turn, then role and text; a null text or role is empty; a role that the template doesn't
know has its name written in the header and no loss, and makes the conversation invalid; repeated rows are turns each; an
invalid conversation is formatted like any other; an empty table gives no rows; other columns are ignored. A conversation is
one row of the result, so it has to fit one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """For each role: opening and closing control strings and whether its text bears loss. steps: (state, role) to state."""

    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)}
    )
    other: tuple[str, str, str] = ("[TURN]", "[/TURN]", "[/END]")
    start: str = "start"
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "open", ("start", "user"): "asked", ("open", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked", ("answered", "system"): "open",
        }
    )
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        return [*(c for a, b, _ in self.roles.values() for c in (a, b)), *self.other]

    @property
    def closing(self) -> list[str]:
        return [*(b for _, b, _ in self.roles.values()), self.other[2]]


TEMPLATE = Template()


def _any(strings: list[str]) -> str:
    return "|".join(map(re.escape, sorted(strings, key=len, reverse=True)))


def escape(text: Column, t: Template = TEMPLATE) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    firsts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.controls)
    return F.regexp_replace(doubled, f"({firsts})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _segments(x: Column, t: Template) -> Column:
    def three(a: Column, b: Column, c: Column, loss: bool) -> Column:
        return F.array(*(F.struct(s.alias("text"), F.lit(flag).alias("loss")) for s, flag in ((a, False), (b, loss), (c, False))))

    body = escape(x["text"], t)
    header = F.concat(F.lit(t.other[0]), escape(x["role"], t), F.lit(t.other[1]))
    out = None
    for role, (a, b, loss) in t.roles.items():
        case = three(F.lit(a), body, F.lit(b), loss)
        out = F.when(x["role"] == role, case) if out is None else out.when(x["role"] == role, case)
    return out.otherwise(three(header, body, F.lit(t.other[2]), False))


def format_chats(turns: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """conv_id, valid, formatted, segments (text, loss) of conversations (conv_id, turn, role, text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    steps = F.create_map(*(F.lit(x) for (s, r), to in t.steps.items() for x in (f"{s}\t{r}", to)))
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(steps[F.concat_ws("\t", s, x["role"])], F.lit("none")))
    by = by.select("conv_id", state.isin(*t.final).alias("valid"), F.flatten(F.transform("turns", lambda x: _segments(x, t))).alias("segments"))
    return by.select("conv_id", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted text."""
    pieces = F.split(formatted, _any(t.closing), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        role, text = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (a, _, _) in t.roles.items():
            role = F.when(p.startswith(a), F.lit(name)).otherwise(role)
            text = F.when(p.startswith(a), F.substring(p, F.lit(len(a) + 1), F.length(p))).otherwise(text)
        a, b = t.other[:2]
        rest = F.substring(p, F.lit(len(a) + 1), F.length(p))
        at = F.instr(rest, b)
        role = F.coalesce(role, F.when(p.startswith(a), unescape(F.substring(rest, F.lit(1), at - 1))))
        text = F.coalesce(text, F.substring(rest, at + len(b), F.length(rest)))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(turns: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and valid, read back from the output."""
    out = format_chats(turns, t).select("conv_id", "valid", "formatted", read_back(F.col("formatted"), t).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
