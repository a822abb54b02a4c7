"""Source builders: tables of any shape to decision questions. A builder is a scan, a filter and one of these projections; a
registry runs them by name, each on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R

Builder = Callable[[SparkSession, float], DataFrame]


class Registry:
    """Builders by name. `build` unions those asked for; one that fails leaves the others alone and is reported."""

    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}

    def add(self, f: Builder) -> Builder:
        self.builders[f.__name__] = f
        return f

    def build(self, spark: SparkSession, only: list[str] | None = None, scale: float = 1.0) -> tuple[DataFrame | None, dict[str, str]]:
        out, failed = None, {}
        for name, f in self.builders.items():
            if only and name not in only:
                continue
            try:
                df = f(spark, scale)
                df.schema  # noqa: B018  analysis errors show here
            except Exception as e:
                failed[name] = str(e)
                continue
            out = df if out is None else out.unionByName(df)
        return out, failed


def options(keys: Column, descs: Column | None = None) -> Column:
    """Criteria of an array of keys, with descriptions or none."""
    if descs is None:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("desc")))
    return F.zip_with(keys, descs, lambda k, d: F.struct(k.alias("key"), d.alias("desc")))


def positional(values: Column, prefix: str = "option_") -> Column:
    """Criteria with keys by position, from 0."""
    return F.transform(values, lambda v, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("key"), v.alias("desc")))


def lettered(values: Column) -> Column:
    """Criteria of strings such as "A) text": the letter and the text."""
    part = lambda v, i: F.trim(F.get(F.split(v, r"\)", 2), F.lit(i)))
    return F.transform(values, lambda v: F.struct(part(v, 0).alias("key"), part(v, 1).alias("desc")))


def without_empty(criteria: Column) -> Column:
    return F.filter(criteria, lambda o: F.coalesce(o["desc"], F.lit("")) != "")


def class_name(label: Column, names: list[str]) -> Column:
    """The name of a class number, from 0; null outside."""
    return F.get(F.array(*map(F.lit, names)), label.cast("int"))


def choices(df: DataFrame, source: str, key: Column, state: Column, instructions: Column | str, criteria: Column, gold: Column, qkey: str = "choice") -> DataFrame:
    """record_id, source, state, qkey, kind, instructions, criteria, gold: rows whose gold is among 2 to 255 options."""
    text = F.lit(instructions) if isinstance(instructions, str) else instructions
    out = df.select(
        F.concat_ws(":", F.lit(source), key.cast("string")).alias("record_id"), F.lit(source).alias("source"), state.alias("state"), F.lit(qkey).alias("qkey"),
        F.lit("choice").alias("kind"), text.alias("instructions"), criteria.alias("criteria"), gold.alias("gold"),
    )
    return out.filter(F.size("criteria").between(R.LEAST_OPTIONS, R.MOST_OPTIONS) & F.exists("criteria", lambda o: o["key"] == F.col("gold")))


def yes_no(df: DataFrame, source: str, key: Column, state: Column, instructions: Column | str, gold: Column, qkey: str = "noul") -> DataFrame:
    """The same for yes/no questions; rows without gold go."""
    text = F.lit(instructions) if isinstance(instructions, str) else instructions
    out = df.select(
        F.concat_ws(":", F.lit(source), key.cast("string")).alias("record_id"), F.lit(source).alias("source"), state.alias("state"), F.lit(qkey).alias("qkey"),
        F.lit("noul").alias("kind"), text.alias("instructions"), R.yes_no().alias("criteria"), R.normal_gold(gold.cast("string")).alias("gold"),
    )
    return out.filter(F.col("gold").isNotNull())


def number_options(text: Column, answer: Column, k: int, order: Column) -> Column:
    """The answer and k - 1 other numbers of a text, in the order of md5(order:number)."""
    others = F.filter(F.array_distinct(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"\d+"), F.lit(0))), lambda n: n != answer)
    hashed = lambda xs: F.array_sort(F.transform(xs, lambda n: F.struct(F.md5(F.concat_ws(":", order, n)).alias("h"), n.alias("n"))))
    picked = F.transform(F.slice(hashed(others), 1, k - 1), lambda s: s["n"])
    return F.transform(hashed(F.array_append(picked, answer)), lambda s: s["n"])


def literal_json(text: Column) -> Column:
    """JSON of a Python literal: quotes and constants changed. For literals without quotes inside strings."""
    x = F.replace(text, F.lit("'"), F.lit('"'))
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        x = F.regexp_replace(x, rf"\b{a}\b", b)
    return x


def clean_code(text: Column, most: int = 6000) -> Column:
    """Source text without comments, marker lines and runs of empty lines, at most so many characters."""
    x = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    x = F.regexp_replace(x, r"(?m)//[^\n]*$", "")
    x = F.regexp_replace(x, r"(?m)^[^\n]*@(?:vulnerable|source|author)[^\n]*\n?", "")
    return F.substring(F.trim(F.regexp_replace(x, r"\n\s*\n+", "\n")), 1, most)


def inject(body: Column, claim: Column, where: Column, most: int = 400) -> Column:
    """A claim put before (where < 0.5) or after a body, clipped."""
    return F.substring(F.when(where < 0.5, F.concat(claim, F.lit(" "), body)).otherwise(F.concat(body, F.lit(" "), claim)), 1, most)


def top_entries(entries: Column, field: str, k: int) -> Column:
    """The k entries of an array of structs with the largest field, ties in their order."""
    ranked = F.array_sort(F.transform(entries, lambda e, i: F.struct((-e[field]).alias("v"), i.alias("i"), e.alias("e"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["e"])


def section(text: Column, begin: str, end: str, most: int = 2000) -> Column:
    """What stands between two markers, else all, clipped."""
    found = F.regexp_extract(text, rf"(?s)\Q{begin}\E(.*?)\Q{end}\E", 1)
    return F.substring(F.trim(F.coalesce(F.nullif(found, F.lit("")), text)), 1, most)
