"""De-duplication, seeded order, quotas, class balance and splits.

Random choice is order by md5(seed:key): the same on every run, whatever the partitions. Global limits stay a top-k; ranks
are per group, so windows have group keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def draw(seed: str | int, *key: Column | str) -> Column:
    """An order key: md5 of the seed and the row's key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k for k in key)))


def fraction(seed: str | int, *key: Column | str) -> Column:
    """A number in [0, 1) that looks uniform, from the draw's first 8 hexadecimal digits."""
    return F.conv(F.substring(draw(seed, *key), 1, 8), 16, 10).cast("double") / 4294967296.0


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def last_of(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of each key with the highest position: later rows win."""
    return first_of(df, keys, [F.desc(position)])


def sample(df: DataFrame, n: int, seed: str | int, key: str) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(draw(seed, key), key).limit(n)


def per_group(df: DataFrame, groups: list[str], k: int | Column, order: list[Column | str], rank: str = "rn") -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= k)


def round_robin(df: DataFrame, groups: list[str], n: int, seed: str | int, key: str, within: list[str] | None = None) -> DataFrame:
    """n rows (of each `within` group, if any) taken from the groups in turn, as balanced as their sizes allow: rn, pos."""
    rn = F.row_number().over(Window.partitionBy(*(within or []), *groups).orderBy(draw(seed, key), key))
    df = df.withColumn("rn", rn)
    order = [F.col("rn"), draw(seed, *groups), F.col(key)]
    # Whatever stands beyond n in its own group can't be among the first n of all; the limit is taken before the exchange too.
    df = df.filter(F.col("rn") <= n)
    if not within:
        return df.orderBy(*order).limit(n)
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col("pos") <= n)


def first_bucket(source: Column, prefixes: list[str], other: str = "other") -> Column:
    """The first prefix, in order, that the source starts with."""
    out = None
    for p in prefixes:
        out = F.when(source.startswith(p), p) if out is None else out.when(source.startswith(p), p)
    return out.otherwise(other) if out is not None else F.lit(other)


def head_rest(df: DataFrame, groups: list[str], seed: str | int, key: str, most: int = 80, per: int = 10) -> DataFrame:
    """split: the first min(most, n / per) rows of each group are valid, the rest train."""
    ranked = running(df.withColumn("__draw", draw(seed, key)), groups, ["__draw", key], __n=F.lit(1)).drop("__draw")
    valid = F.col("__n_before") < F.least(F.lit(most), F.floor(F.col("__n_all") / per))
    return ranked.withColumn("split", F.when(valid, "valid").otherwise("train")).drop("__n_before", "__n_all")


def group_split(df: DataFrame, group: str, seed: str | int, test: float = 0.15, valid: float = 0.1) -> DataFrame:
    """group, split: whole groups go to test, valid or train, by shuffled rank. One row a group."""
    groups = df.select(group).distinct()
    # Ranks over groups: as many rows as groups, not as rows.
    rn = F.row_number().over(Window.orderBy(draw(seed, group), group)) - 1
    n = F.count("*").over(Window.partitionBy())
    n_test, n_valid = F.floor(n * test), F.floor(n * valid)
    return groups.withColumn("__rn", rn).withColumn("split", F.when(F.col("__rn") < n_test, "test").when(F.col("__rn") < n_test + n_valid, "valid").otherwise("train")).drop("__rn")


def md5_mod10(key: Column) -> Column:
    """md5 of the key, as a number, modulo 10. 16 to any power is 6 modulo 10, so digits fold without a 128-bit number."""
    digits = F.transform(F.split(F.md5(key.cast("string")), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    every = F.aggregate(F.slice(digits, 1, 31), F.lit(0), lambda a, x: a + x)
    return F.pmod(6 * every + F.element_at(digits, 32), F.lit(10))


def proportional(df: DataFrame, label: str, n: int, seed: str | int, key: str) -> DataFrame:
    """About n rows, each class by its share of all (half-even)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    # The count is one row: a broadcast of fixed size.
    quotas = counts.join(F.broadcast(df.agg(F.count("*").alias("__all")))).select(F.col(label).alias("__l"), F.bround(n * F.col("__c") / F.col("__all"), 0).alias("__q"))
    # No quota is above n, so a class sends n rows a task and no more.
    first = per_group(df, [label], n, [draw(seed, key), key], "__rn")
    return first.join(quotas, F.col(label).eqNullSafe(F.col("__l"))).filter("__rn <= __q").drop("__q", "__rn", "__l")


def balanced(df: DataFrame, label: str, n: int, seed: str | int, key: str) -> DataFrame:
    """n / 2 rows of either class, as far as there are."""
    return per_group(df, [label], n // 2, [draw(seed, key), key], "__rn").drop("__rn")


def repeated(df: DataFrame, times: Column, name: str = "copy") -> DataFrame:
    """Each row so many times, numbered from 0."""
    return df.withColumn(name, F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
