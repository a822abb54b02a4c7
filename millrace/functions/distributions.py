"""Expressions over option distributions (map<string,double>) and arrays of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)


def normalised(m: Column) -> Column:
    """Values over their sum; left as they are where that is 0."""
    z = total(m)
    return F.transform_values(m, lambda _, v: v / F.when(z == 0, 1.0).otherwise(z))


def blend(a: Column, b: Column, weight: float) -> Column:
    """weight * a + (1 - weight) * b over the keys of either, normalised; one alone where the other is null."""
    mixed = F.map_zip_with(a, b, lambda _, x, y: weight * F.coalesce(x, F.lit(0.0)) + (1 - weight) * F.coalesce(y, F.lit(0.0)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(normalised(mixed))


def argmax(options: Column, probs: Column) -> Column:
    """The first option, in the order given, of the highest probability."""
    best = F.array_max(F.transform(options, lambda k: F.coalesce(probs[k], F.lit(0.0))))
    return F.get(F.filter(options, lambda k: F.coalesce(probs[k], F.lit(0.0)) == best), F.lit(0))


def picked(options: Column, probs: Column, yes_no: Column) -> Column:
    """The answer: of a yes/no question whether true has half or more, else the best option."""
    half = F.coalesce(probs["true"], F.lit(0.0)) >= 0.5
    return F.when(yes_no, F.when(half, "true").otherwise("false")).otherwise(argmax(options, probs))


def to_probs(top: Column, labels: Column, least_mass: float = 0.5) -> Column:
    """Probabilities of labels from top tokens (array<struct<token, p>>): the first of each trimmed token counts, the labels
    that aren't there share what is left of 1, and the result is normalised; null if the labels' own mass is below least_mass."""
    first = lambda k: F.get(F.filter(top, lambda t: F.trim(t["token"]) == k), F.lit(0))["p"]
    own = F.transform(labels, first)
    mass = F.aggregate(own, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    rest = F.greatest(F.lit(0.0), 1 - mass) / F.size(F.filter(own, lambda x: x.isNull()))
    filled = F.transform(own, lambda x: F.coalesce(x, rest))
    z = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x)
    return F.when(mass >= least_mass, F.map_from_arrays(labels, F.transform(filled, lambda x: x / z)))


def remapped(probs: Column, order: Column, labels: Column) -> Column:
    """Probabilities by label of options in the order shown."""
    return F.map_from_arrays(F.slice(labels, F.lit(1), F.size(order)), F.transform(order, lambda k: F.coalesce(probs[k], F.lit(0.0))))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def softcap(x: Column, cap: float) -> Column:
    return F.tanh(x / cap) * cap


def cross_entropy(teacher: Column, student: Column) -> Column:
    """-sum t log s of two arrays in the same order."""
    return -F.aggregate(F.zip_with(teacher, student, lambda t, s: t * F.log(s)), F.lit(0.0), lambda a, x: a + x)


def top_alternatives(m: Column, n: int) -> Column:
    """The n most likely entries, ties by key, normalised."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("key")))
    best = F.slice(F.array_sort(entries), 1, n)
    return normalised(F.map_from_arrays(F.transform(best, lambda e: e["key"]), F.transform(best, lambda e: -e["v"])))
