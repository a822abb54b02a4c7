"""Text expressions: all are Columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: Fixed values of the decontamination rules.
SEGMENT_SPLIT, WORD, SEGMENT_WORDS, GRAM_WORDS = r"[.?!:;\n]+", "[a-z0-9]+", 5, 13
# Elements whose content is no text.
SILENT_TAGS = ("script", "style", "noscript", "svg", "head")
# How answers write their final number, and words of a query that say nothing about its topic.
MARKED_NUMBER, NUMBER = r"####\s*\$?\s*(-?[\d,]*\.?\d+)", r"-?\d[\d,]*\.?\d*"
STOP_WORDS = tuple(
    "a an the of in on at to for and or is are was were be by with what which who whom whose when where why how did do does from as that this it its into about than then".split()
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: ColumnOrName) -> Column:
    """Lower-case runs of a-z and 0-9; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD), F.lit(0))


def letters(text: ColumnOrName) -> Column:
    """Distinct lower-case runs of a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0)))


def grams(tokens: ColumnOrName, n: int = GRAM_WORDS) -> Column:
    """Windows of n words joined by spaces, repeats included; none for shorter texts."""
    w = _c(tokens)
    made = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))


def gram_hashes(tokens: ColumnOrName, n: int = GRAM_WORDS) -> Column:
    """64-bit hashes of the windows of n words, repeats included: of the words themselves, no text is put together."""
    w = _c(tokens)
    made = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
    return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<bigint>"))


def segments(text: ColumnOrName, least: int = SEGMENT_WORDS) -> Column:
    """Segments between sentence marks, as their words joined by spaces, of `least` words or more."""
    parts = F.transform(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), SEGMENT_SPLIT), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    return F.transform(F.filter(parts, lambda w: F.size(w) >= least), lambda w: F.array_join(w, " "))


def prefix_key(text: ColumnOrName, n: int = 300) -> Column:
    """The first n characters of the words joined by spaces."""
    return F.substring(F.array_join(words(text), " "), 1, n)


def clip(text: ColumnOrName, n: int) -> Column:
    """The trimmed text's first n characters, with the number of those left out."""
    t = F.trim(F.coalesce(_c(text), F.lit("")), F.lit(" \n\t\r"))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit(" ...(+"), (F.length(t) - n).cast("string"), F.lit(" chars)")))


def strip_html(page: ColumnOrName) -> Column:
    """Text of a page: silent elements and tags gone, common character references decoded, white space squeezed."""
    x = F.coalesce(_c(page), F.lit(""))
    for tag in SILENT_TAGS:
        x = F.regexp_replace(x, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    x = F.regexp_replace(x, "(?s)<[^>]+>", " ")
    for ref, char in ENTITIES:
        x = F.replace(x, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " "))


def mask_numbers(text: ColumnOrName, n: int = 160) -> Column:
    """Log template of a line: hexadecimal runs of six or more and numbers become #."""
    return F.substring(F.regexp_replace(_c(text), "[0-9a-f]{6,}|[0-9]+", "#"), 1, n)


def normal_answer(text: ColumnOrName) -> Column:
    """Words without articles, joined by spaces."""
    kept = F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin("a", "an", "the"))
    return F.array_join(kept, " ")


def contains_words(text: Column, answer: Column) -> Column:
    """Whether the answer's words stand in the text's, in a row; both normalised."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), answer, F.lit(" ")))


def final_number(text: ColumnOrName) -> Column:
    """The number after ####, else the last number; separators of thousands and a closing point dropped."""
    marked = F.regexp_extract(_c(text), MARKED_NUMBER, 1)
    every = F.regexp_extract_all(_c(text), F.lit(NUMBER), F.lit(0))
    found = F.coalesce(F.nullif(marked, F.lit("")), F.try_element_at(every, F.lit(-1)))
    return F.rtrim(F.replace(found, F.lit(","), F.lit("")), F.lit(".")).try_cast("double")


def content_words(query: ColumnOrName) -> Column:
    """Distinct words of three characters or more that say something about a query's topic."""
    return F.filter(F.array_distinct(words(query)), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2))


def relevant(query: ColumnOrName, results: Column, k: int = 3, need: float = 0.5) -> Column:
    """Whether one of the first k results (texts) holds at least so many of the query's content words, anywhere in it; true for a
    query without any."""
    content = content_words(query)
    enough = lambda r: F.size(F.filter(content, lambda w: F.contains(F.lower(r), w))) >= need * F.size(content)
    return (F.size(content) == 0) | F.exists(F.slice(results, 1, k), enough)


def last_match(text: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """The pattern's last match, null without one."""
    return F.try_element_at(F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group)), F.lit(-1))


def template_pattern(template: ColumnOrName) -> Column:
    """A log template with <*> as a regular expression: fixed parts quoted, wildcards lazy."""
    parts = F.transform(F.split(_c(template), r"<\*>", -1), lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E")))
    return F.array_join(parts, ".*?")


def host(url: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[a-z]+://([^/?#:]*)", 1))


def in_domain(url: ColumnOrName, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or under one."""
    h, out = host(url), F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def capital(text: ColumnOrName) -> Column:
    """First character upper-case, the rest as it is."""
    return F.concat(F.upper(F.substring(_c(text), 1, 1)), F.substring(_c(text), 2, 1_000_000_000))


def hex_colour(*parts: Column) -> Column:
    """#rrggbb of three shares of 1."""
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.bround(p * 255, 0).cast("int")), 2, "0")) for p in parts))
