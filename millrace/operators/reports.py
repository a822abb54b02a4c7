"""Evaluation reports and audits: routing by a score, cascades, parity, stability, overlaps, points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def routing(rows: DataFrame, score: str, costly: str, thresholds: list[float]) -> DataFrame:
    """threshold, n, n_cheap, share_cheap, n_missed, miss_rate, accuracy: rows whose score is below a threshold go the cheap way;
    missed are those of them that are costly (boolean). Rows without a score or label don't count. One pass for all thresholds."""
    ok = rows.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(costly).isNotNull()).select(F.col(score).alias("s"), F.col(costly).alias("c"))
    each = ok.select("s", "c", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    cheap = F.col("s") < F.col("threshold")
    count = lambda x: F.sum(x.cast("long"))
    by = each.groupBy("threshold").agg(F.count("*").alias("n"), count(cheap).alias("n_cheap"), count(cheap & F.col("c")).alias("n_missed"), count(F.col("c")).alias("n_costly"), count(cheap != F.col("c")).alias("right"))
    miss = F.when(F.col("n_costly") > 0, F.col("n_missed") / F.col("n_costly"))
    return by.select("threshold", "n", "n_cheap", (F.col("n_cheap") / F.col("n")).alias("share_cheap"), "n_missed", miss.alias("miss_rate"), (F.col("right") / F.col("n")).alias("accuracy"))


def cascade(first: Column, second: Column, low: float, high: float) -> Column:
    """The first score where it is sure, the second between low and high (high excluded), if there is one."""
    return F.when((first >= low) & (first < high), F.coalesce(second, first)).otherwise(first)


def parity(left: DataFrame, right: DataFrame, keys: list[str], text: str) -> DataFrame:
    """n, n_same, n_differ, n_only_left, n_only_right: whether two renderings of the same rows are the same, character by character."""
    a, b = left.select(*keys, F.col(text).alias("a"), F.lit(1).alias("l")), right.select(*keys, F.col(text).alias("b"), F.lit(1).alias("r"))
    both = a.join(b, keys, "full")
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count("*").alias("n"), count(there & same).alias("n_same"), count(there & ~same).alias("n_differ"), count(F.col("r").isNull()).alias("n_only_left"), count(F.col("l").isNull()).alias("n_only_right"))


def order_stability(answers: DataFrame, keys: list[str], group: str) -> DataFrame:
    """group, n, n_stable, share: of questions asked in several orders of their options, those that got one answer (an option's
    key, not its place) in all of them. answers: keys, group, answer."""
    each = answers.groupBy(*keys, group).agg(F.min("answer").alias("lo"), F.max("answer").alias("hi"), F.count("*").alias("k")).filter("k > 1")
    by = each.groupBy(group).agg(F.count("*").alias("n"), F.sum((F.col("lo") == F.col("hi")).cast("long")).alias("n_stable"))
    return by.withColumn("share", F.col("n_stable") / F.col("n"))


def in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, slot: float) -> DataFrame:
    """Points (keys, at) with the columns of the intervals (keys, start, end, end excluded) that they lie in, one row for each. Points
    and intervals meet on keys and a slot of the line, so none meets all; slot is about an interval's length."""
    wide = intervals.filter(F.col("start") < F.col("end")).withColumn("__slot", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor(F.col("end") / slot))))
    met = points.withColumn("__slot", F.floor(F.col(at) / slot)).join(wide, [*keys, "__slot"])
    return met.filter((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("__slot")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """n_left, n_right, n_both, equal: distinct keys of two tables, for audits of splits."""
    each = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    by = each.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return by.agg(total(F.col("l")).alias("n_left"), total(F.col("r")).alias("n_right"), total(F.col("l") * F.col("r")).alias("n_both"), (total(F.col("l")) == total(F.col("r"))).alias("same_size")).select("n_left", "n_right", "n_both", (F.col("same_size") & (F.col("n_left") == F.col("n_both"))).alias("equal"))


def distinct_lines(lines: DataFrame, keys: list[str], line: str, order: str) -> DataFrame:
    """keys, line, order: each different line of a group once, where it first stands."""
    return lines.groupBy(*keys, line).agg(F.min(order).alias(order))


def span_mask(tokens: Column, spans: Column) -> Column:
    """For each token (its place, from 0) 1 inside one of the spans (array<struct<start, end>>, end excluded), else 0: what a loss
    counts."""
    return F.transform(tokens, lambda _, i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])).cast("int"))


def preference_pairs(checked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chosen, rejected: of answers (keys, answer, status) to one question, the first consistent one against each that
    contradicts, by the answers' order."""
    good = checked.filter("status = 'consistent'").groupBy(*keys).agg(F.min("answer").alias("chosen"))
    return checked.filter("status = 'contradicts'").select(*keys, F.col("answer").alias("rejected")).distinct().join(good, keys).select(*keys, "chosen", "rejected")
