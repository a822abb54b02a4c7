"""Decision records: options in order, prompts, labels. Criteria are array<struct<key, desc>>: their order has meaning."""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two options of a yes/no question, and keys that say nothing.
YES_NO = (("true", "Yes, the statement is true."), ("false", "No, the statement is false."))
GENERIC_KEY = r"^([A-Za-z]+_?\d+|[A-Z]|k_[0-9a-f]+)$"
NO_LABELS = ("GZ",)  # left out of the alphabet
LEAST_OPTIONS, MOST_OPTIONS, FEW_OPTIONS = 2, 255, 10


def label(i: int) -> str:
    """The i-th name of the alphabet, from 0: A to Z, AA, AB and so on."""
    return string.ascii_uppercase[i] if i < 26 else label(i // 26 - 1) + string.ascii_uppercase[i % 26]


def labels(n: int = MOST_OPTIONS) -> Column:
    every = (x for x in map(label, itertools.count()) if x not in NO_LABELS)
    return F.array(*map(F.lit, itertools.islice(every, n)))


def yes_no() -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(d).alias("desc")) for k, d in YES_NO))


def criteria_of(kind: Column, criteria: Column) -> Column:
    return F.when(kind == "choice", criteria).otherwise(yes_no())


def json_text(x: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def option_value(key: Column, desc: Column) -> Column:
    """What an option shows, as JSON: the key where there is no description or the description would give nothing, the
    description where the key says nothing or is in it, else both."""
    hidden = key.rlike(GENERIC_KEY) | (key == desc) | F.contains(desc, key)
    both = F.concat(F.lit('{"key":'), json_text(key), F.lit(',"description":'), json_text(desc), F.lit("}"))
    return F.when(desc.isNull(), json_text(key)).when(hidden, json_text(desc)).otherwise(both)


def decision_prompt(state: Column, instructions: Column, options: Column, names: Column) -> Column:
    """Compact JSON of a state (JSON already), a question and its options by label, in order."""
    shown = F.transform(options, lambda o, i: F.concat(json_text(F.get(names, i)), F.lit(":"), option_value(o["key"], o["desc"])))
    return F.concat(F.lit('{"state":'), state, F.lit(',"question":'), json_text(instructions), F.lit(',"options":{'), F.array_join(shown, ","), F.lit("}}"))


def normal_gold(gold: Column) -> Column:
    """Gold of a yes/no question: true for true, yes and 1, false for anything else; null stays null."""
    return F.when(gold.isNull(), None).when(gold.isin("true", "yes", "1"), "true").otherwise("false")


def shuffled(options: Column, seed: Column) -> Column:
    """Options in the order of md5(seed:key)."""
    keyed = F.transform(options, lambda o: F.struct(F.md5(F.concat_ws(":", seed, o["key"])).alias("h"), o["key"].alias("key"), o["desc"].alias("desc")))
    return F.transform(F.array_sort(keyed), lambda o: F.struct(o["key"].alias("key"), o["desc"].alias("desc")))


def record_id(example_id: Column) -> Column:
    """An example's id without question and copy."""
    return F.regexp_replace(example_id, "#[^#]*#[^#]*$", "")


def plain_number(x: Column) -> Column:
    """A whole double without .0, others as they are."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
