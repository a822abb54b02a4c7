"""Evaluation: ranks, AUC, gates, order statistics. One pass or one shuffle each; no pair is ever made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def auc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """by, n_pos, n_neg, auc: ties count half; null where a class is empty. Rows are first counted by score, so ranks run over
    distinct scores."""
    by = by or []
    counts = df.groupBy(*by, score).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(1)).alias("m"))
    won = running(counts, by, [score], m=F.col("m")).withColumn("won", F.col("p") * (F.col("m_before") + F.col("m") / 2))
    out = won.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("m").alias("n_neg"), F.sum("won").alias("won"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return out.select(*by, "n_pos", "n_neg", F.when(pairs > 0, F.col("won") / pairs).alias("auc"))


def miss_at_share(df: DataFrame, score: str, positive: str, key: str, share: float, by: list[str]) -> DataFrame:
    """by, n, picked, missed: share of all positives that are among the bround(share * n) rows of lowest score."""
    ranked = running(df, by, [score, key], __n=F.lit(1))
    cheap, hit = F.col("__n_before") < F.bround(share * F.col("__n_all"), 0), F.col(positive).cast("int")
    missed = F.sum(F.when(cheap, hit).otherwise(0)) / F.nullif(F.sum(hit), F.lit(0))
    return ranked.groupBy(*by).agg(F.max("__n_all").alias("n"), F.sum(cheap.cast("int")).alias("picked"), missed.alias("missed"))


def balanced_accuracy(truth: Column, guess: Column) -> Column:
    """An aggregate: the mean of the two classes' accuracies."""
    return (F.avg(F.when(truth, guess.cast("int"))) + F.avg(F.when(~truth, (~guess).cast("int")))) / 2


def spearman(df: DataFrame, a: str, b: str, key: str, by: list[str]) -> DataFrame:
    """by, n, rho: from ordinal ranks (ties by key), closed form."""
    r = running(running(df, by, [a, key], __a=F.lit(1)), by, [b, key], __b=F.lit(1)).withColumn("__d", F.col("__a_before") - F.col("__b_before"))
    n = F.count("*").cast("double")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.when(n > 1, 1 - 6 * F.sum(F.col("__d").cast("double") * F.col("__d")) / (n * (n * n - 1))).alias("rho"))


def _stirling(n: Column) -> Column:
    """ln n! less Stirling's formula, for n of a thousand and more."""
    return 1 / (12 * n) - 1 / (360 * n * n * n)


def mcnemar(loss: Column, win: Column) -> Column:
    """Exact two-sided p of a paired sign test: twice the binomial tail at 1/2, at most 1. The terms follow by recurrence: from 0
    up for tails of a thousand terms, else from the largest, by Loader's saddle-point form, down to where they no longer count."""
    n, k = loss + win, F.least(loss, win)
    few = k <= 1000
    start = F.struct((n * F.lit(-1.0) * F.log(F.lit(2.0))).alias("term"), F.exp(n * F.lit(-1.0) * F.log(F.lit(2.0))).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    none = F.array().cast("array<bigint>")
    up = F.aggregate(F.when(few & (k > 0), F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(none), start, step, lambda acc: acc["total"])
    x, y, m = k.cast("double"), (n - k).cast("double"), n.cast("double")
    largest = F.exp(_stirling(m) - _stirling(x) - _stirling(y) - x * F.log(2 * x / m) - y * F.log(2 * y / m)) / F.sqrt(F.lit(2 * math.pi) * x * y / m)

    def down(acc: Column, i: Column) -> Column:
        term = acc["term"] * (x - i + 1) / (y + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    # 5 sqrt(n) terms below the largest, one is e^-50 of it or less.
    far = F.least(k.cast("bigint"), F.ceil(5 * F.sqrt(m)))
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    below = F.aggregate(F.when(~few, F.sequence(F.lit(1).cast("bigint"), far)).otherwise(none), one, down, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(few, up).otherwise(largest * below)))


def gate(pairs: DataFrame, by: str, key_old: str, key_new: str, protected: list[str], p_fail: float = 0.2, net_warn: int = 5) -> DataFrame:
    """by, kept, loss, win, p, verdict of paired runs (correct before, correct after)."""
    old, new = F.col(key_old), F.col(key_new)
    counts = pairs.groupBy(by).agg(F.sum((old & new).cast("int")).alias("kept"), F.sum((old & ~new).cast("int")).alias("loss"), F.sum((~old & new).cast("int")).alias("win"))
    counts = counts.withColumn("p", mcnemar(F.col("loss"), F.col("win")))
    guarded = F.lit(False)
    for name in protected:
        guarded = guarded | F.col(by).startswith(name) | F.lit(name).startswith(F.substring_index(by, " ", 1))
    worse = F.col("loss") > F.col("win")
    return counts.withColumn("verdict", F.when(guarded & worse & (F.col("p") < p_fail), "FAIL").when(guarded & (F.col("loss") - F.col("win") >= net_warn), "warn").otherwise("ok"))


def order_statistics(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, median, p50, p90, p95: the exact median, and values at int(q (n - 1)) for .5 and .9 and at min(n - 1, int(.95 n)),
    found by rank within counts of distinct values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__k"))
    upto = running(counts, by, [value], __n=F.col("__k"))
    at = lambda i: F.max(F.when((F.col("__n_before") + F.col("__k") > i) & (F.col("__n_before") <= i), F.col(value)))
    n = F.col("__n_all")
    return upto.groupBy(*by).agg(
        F.max("__n_all").alias("n"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), at(F.floor(0.5 * (n - 1))).alias("p50"),
        at(F.floor(0.9 * (n - 1))).alias("p90"), at(F.least(n - 1, F.floor(0.95 * n))).alias("p95"),
    )


def accuracy(df: DataFrame, correct: str, by: list[str]) -> DataFrame:
    """by (null: all), n, correct, acc for each group and over all, in one pass."""
    return df.rollup(*by).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("correct"), F.avg(F.col(correct).cast("int")).alias("acc"))


def best_per_row(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A pivot, a column for each of columns, and best: the left-most of the highest value."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.first(value))
    top = F.greatest(*columns)
    best = None
    for c in columns:
        best = F.when(F.col(c) == top, c) if best is None else best.when(F.col(c) == top, c)
    return wide.withColumn("best", best)


def swapped_verdicts(ab: Column, ba: Column) -> Column:
    """win, loss or tie of verdicts (A, B or tie) in both orders: a win needs both."""
    return F.when((ab == "A") & (ba == "B"), "win").when((ab == "B") & (ba == "A"), "loss").otherwise("tie")


def unique_winner(ranks: DataFrame, group: list[str], candidate: str, rank: str) -> DataFrame:
    """group, candidate, total: the candidate of the lowest rank sum, where only one has it."""
    sums = ranks.groupBy(*group, candidate).agg(F.sum(rank).alias("total"))
    w = Window.partitionBy(*group)
    low = sums.withColumn("__low", F.min("total").over(w)).filter("total = __low").withColumn("__k", F.count("*").over(w))
    return low.filter("__k = 1").drop("__low", "__k")


def conflict_free(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value: keys that have only one value."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__hi")).filter(F.col(value) == F.col("__hi")).drop("__hi")
