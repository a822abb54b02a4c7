"""Running sums over an order within groups, where a group may hold most of the rows.

A window by group alone is one task a group. Groups of up to WHOLE rows are counted first and, if none is larger, get just that.
Else each group is cut at a bounded, fixed set of its own rows, windows run within the pieces, and the pieces' totals are summed on
the side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cuts a group: the rows of smallest hash, so they are the same on every run. They decide how work is split, never results.
CUTS = 63

#: Rows of a group that one task takes; they are light, without what the caller doesn't select.
WHOLE = 1_000_000


def running(df: DataFrame, by: list[str], order: list[str], **weights: Column) -> DataFrame:
    """df with <name>_before, the sum of each weight over the group's rows that stand before this one in rising order (nulls
    first; rows equal in order stand in any order), and <name>_all, its sum over the group. Weights of null count as 0; null
    is a group. Rows of one position share a piece: end the order with a key, or count rows by position first."""
    df = df.select("*", *(F.coalesce(w, F.lit(0)).alias(f"__w_{n}") for n, w in weights.items()))
    at = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    # A struct of the group's columns: fields of null are equal in it, so groups of null join.
    rows = df.withColumn("__g", F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).withColumn("__at", at)
    own = Window.partitionBy("__g")
    if (rows.groupBy("__g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= WHOLE:
        so_far = own.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        sums = {f"{n}_before": F.coalesce(F.sum(f"__w_{n}").over(so_far), F.lit(0)) for n in weights} | {f"{n}_all": F.sum(f"__w_{n}").over(own) for n in weights}
        return rows.withColumns(sums).drop("__g", "__at", *(f"__w_{n}" for n in weights))
    picked = own.orderBy(F.xxhash64("__at"), "__at")
    cuts = rows.select("__g", "__at").distinct().withColumn("__k", F.row_number().over(picked)).filter(F.col("__k") <= CUTS)
    cuts = cuts.groupBy("__g").agg(F.array_sort(F.collect_list("__at")).alias("__cuts"))
    # One row a group, of at most CUTS positions; the planner broadcasts it where its size allows.
    pieces = rows.join(cuts, "__g").withColumn("__piece", F.size(F.filter("__cuts", lambda c: c < F.col("__at")))).drop("__cuts")
    sums = pieces.groupBy("__g", "__piece").agg(*(F.sum(f"__w_{n}").alias(f"__s_{n}") for n in weights))
    before = Window.partitionBy("__g").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "__g", "__piece", *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in weights),
        *(F.sum(f"__s_{n}").over(Window.partitionBy("__g")).alias(f"{n}_all") for n in weights),
    )
    inside = Window.partitionBy("__g", "__piece").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.join(offsets, ["__g", "__piece"])
    for n in weights:
        out = out.withColumn(f"{n}_before", F.col(f"__o_{n}") + F.coalesce(F.sum(f"__w_{n}").over(inside), F.lit(0)))
    return out.drop("__g", "__at", "__piece", *(f"__{p}_{n}" for n in weights for p in ("w", "o")))
