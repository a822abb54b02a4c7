"""The border to models: a scorer is a function over pandas frames, run over Arrow batches; models themselves are outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def scored(df: DataFrame, make: Callable[[], Scorer], schema: str, retries: int = 2) -> DataFrame:
    """Rows of a scorer for each batch. The scorer is made once a task (a client, a model); a batch that fails is tried again,
    then halved, until single rows fail, which raise."""

    def attempt(scorer: Scorer, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for k in range(retries + 1):
            try:
                yield scorer(pdf)
                return
            except Exception:
                if k == retries and len(pdf) <= 1:
                    raise
        half = len(pdf) // 2
        yield from attempt(scorer, pdf.iloc[:half])
        yield from attempt(scorer, pdf.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in batches:
            if len(pdf):
                yield from attempt(scorer, pdf)

    return df.mapInPandas(run, schema)


def cached(df: DataFrame, cache: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached results where there are, new ones for the rest."""
    new = score(df.join(cache.select(key), key, "left_anti"))
    return cache.join(df.select(key), key, "left_semi").unionByName(new)


def first_hit(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value, priority: each key's value from the first table that has it."""
    out = None
    for i, t in enumerate(tables):
        t = t.select(key, value, F.lit(i).alias("priority"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy(key).agg(F.min(F.struct("priority", value)).alias("__s")).select(key, F.col(f"__s.{value}").alias(value), F.col("__s.priority").alias("priority"))


def zipped(a: DataFrame, b: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Rows of two tables side by side, by their rank within groups."""
    rank = lambda df, name: df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).withColumnRenamed(order, name)
    return rank(a, "a").join(rank(b, "b"), [*by, "__k"]).select(*by, F.col("__k").alias("k"), "a", "b")


def most_common(df: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """by, value, n: the most frequent value of a group, ties to the one seen first."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    best = n.groupBy(*by).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), value)).alias("s"))
    return best.select(*by, F.col(f"s.{value}").alias(value), F.col("s.n").alias("n"))


def common_prefix(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, prefix: the longest common prefix of a group's strings: that of its smallest and its largest."""
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    upto = F.least(F.length("lo"), F.length("hi"))
    same = F.filter(F.sequence(F.lit(0), upto), lambda i: F.substring(F.col("lo"), F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i))
    return ends.select(*by, F.substring(F.col("lo"), F.lit(1), F.array_max(same)).alias("prefix"))


def weighted_choice(share: Column, options: list[tuple[str, float]]) -> Column:
    """The option in whose part of [0, 1) the share lies; parts are as long as the weights."""
    total, below = sum(w for _, w in options), 0.0
    out = None
    for name, w in options[:-1]:
        below += w / total
        out = F.when(share < below, name) if out is None else out.when(share < below, name)
    return out.otherwise(options[-1][0]) if out is not None else F.lit(options[-1][0])


def bootstrap(df: DataFrame, cluster: str, value: Column, rounds: int, seed: str) -> DataFrame:
    """low, high: the 95 % interval of a mean by a Poisson bootstrap over clusters: each cluster has a Poisson weight in each
    round, from a hash, so no row is drawn or copied. Sums are first made by cluster."""
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    each = sums.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(cluster).cast("string"), F.col("round").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # Poisson of mean 1 by inversion.
    weight, term, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        total += term
        weight = weight + F.when(u >= total, 1).otherwise(0)
        term /= k + 1
    means = each.withColumn("w", weight).groupBy("round").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def logistic(df: DataFrame, features: list[str], label: str, l2: float = 0.01) -> DataFrame:
    """feature, weight of a logistic regression on standardised features, the bias first."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.select(*(F.col(f).cast("double") for f in features), F.col(label).cast("double").alias("label")))
    m = LogisticRegression(regParam=l2, standardization=True, maxIter=100).fit(rows)
    return df.sparkSession.createDataFrame([("bias", float(m.intercept)), *zip(features, map(float, m.coefficients), strict=True)], "feature string, weight double")


def fact_status(answer: Column, reference: Column, supported: Column, contradicted: Column) -> Column:
    """skipped, no_reference, contradicted, consistent or unsupported."""
    return F.when(F.coalesce(F.trim(answer), F.lit("")) == "", "skipped").when(reference.isNull(), "no_reference").when(contradicted, "contradicted").when(supported, "consistent").otherwise("unsupported")
