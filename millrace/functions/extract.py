"""What answers of models hold: verdicts, code, tool calls, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How judges write their verdict.
VERDICT_TAG, VERDICT_SIDE, VERDICT_TIE = r"\[\[(A|B|TIE)\]\]", r"assistant (a|b)\b[^.\n]*\b(?:better|wins|superior|preferred)", r"\b(tie|equal|equally)\b"


def verdict(text: Column) -> Column:
    """A, B or TIE: the first tag in double brackets, else what the first line says, else null."""
    tag = F.regexp_extract(text, VERDICT_TAG, 1)
    line = F.lower(F.get(F.split(F.trim(text, F.lit(" \n\t\r")), "\n"), F.lit(0)))
    side = F.upper(F.regexp_extract(line, VERDICT_SIDE, 1))
    return F.when(tag != "", tag).when(side != "", side).when(line.rlike(VERDICT_TIE), "TIE")


def last_code(text: Column, language: str = "bash") -> Column:
    """The content of the last fenced block of a language, trimmed; null without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\s*\n(.*?)```"), F.lit(1)), F.lit(-1)), F.lit(" \n\t"))


def tool_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of calls between tags, each a JSON object with name and arguments; broken ones are left out."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    parsed = F.transform(bodies, lambda b: F.from_json(b, "struct<name:string,arguments:string>"))
    return F.filter(parsed, lambda c: c["name"].isNotNull())


def without_tags(text: Column, *tags: str) -> Column:
    """Text without tagged passages."""
    for t in tags:
        text = F.regexp_replace(text, rf"(?s)<{t}>.*?</{t}>\s*", "")
    return text


def variants(text: Column) -> Column:
    """An answer as it is and without its first line, its last line, both, and each of these without asterisks."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    cut = lambda a, b: F.trim(F.array_join(F.slice(lines, F.lit(1 + a), F.greatest(n - a - b, F.lit(0))), "\n"))
    plain = F.array(text, cut(1, 0), cut(0, 1), cut(1, 1))
    return F.concat(plain, F.transform(plain, lambda x: F.replace(x, F.lit("*"), F.lit(""))))
