"""Log lines, sessions, step budgets of conversations, batches by length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import running


def count_windows(lines: DataFrame, position: str, alert: Column, size: int, by: list[str]) -> DataFrame:
    """by, win, start, has_alert, first_alert: windows of `size` lines by position from 0. A window counts only if a line stands
    after it: the last full one is dropped where the number of lines is a multiple of size."""
    rows = lines.withColumn("win", F.floor(F.col(position) / size)).withColumn("__a", alert)
    n = rows.groupBy(*by).agg((F.max(position) + 1).alias("__n")) if by else None
    got = rows.groupBy(*by, "win").agg(F.bool_or("__a").alias("has_alert"), F.min(F.when(F.col("__a"), F.col(position))).alias("first_alert"))
    if n is None:
        got = got.withColumn("__n", F.lit(rows.agg(F.max(position)).first()[0] or 0) + 1)
    else:
        got = got.join(n, by)
    return got.withColumn("start", F.col("win") * size).filter(F.col("start") < F.col("__n") - size).drop("__n")


def sessions(lines: DataFrame, keys: Column, position: str, line: str, most: int) -> DataFrame:
    """key, n, lines: all lines, in order, that mention a key, for keys with at most `most` lines. Longer ones go before their
    lines are gathered, so no list is longer."""
    each = lines.select(F.explode(F.array_distinct(keys)).alias("key"), position, line)
    short = each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    lists = each.join(short, "key").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct(position, line))).alias("s"))
    return lists.select("key", "n", F.transform("s", lambda x: x[line]).alias("lines"))


def fit_tail(steps: DataFrame, key: str, position: str, size: Column, head: int, budget: int, marker: int = 80) -> DataFrame:
    """steps with kept: all where they fit the budget; else the first `head` steps and as many of the last as fit what these and a
    marker leave of it."""
    w = Window.partitionBy(key)
    rows = steps.withColumn("__s", size).withColumn("__rn", F.row_number().over(w.orderBy(position)))
    first = F.col("__rn") <= head
    tail = F.sum(F.when(first, 0).otherwise(F.col("__s"))).over(w.orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = budget - F.sum(F.when(first, F.col("__s")).otherwise(0)).over(w) - marker
    return rows.withColumn("kept", (F.sum("__s").over(w) <= budget) | first | (tail <= left)).drop("__s", "__rn")


def step_numbers(turns: DataFrame, key: str, position: str, is_step: Column, last: int) -> DataFrame:
    """turns with step (its number among the steps so far) and late: among the last `last` steps."""
    w = Window.partitionBy(key)
    n = is_step.cast("int")
    step = F.sum(n).over(w.orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("step", step).withColumn("late", is_step & (F.col("step") > F.sum(n).over(w) - last))


def with_header(lines: DataFrame, position: str, header: Column, by: list[str]) -> DataFrame:
    """Lines that are no header, with the last header before them."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("__h", header).withColumn("header", F.last("__h", ignorenulls=True).over(w)).filter("__h is null").drop("__h")


def ema(values: DataFrame, by: list[str], position: str, value: str, alpha: float, spike: float) -> DataFrame:
    """by, n, ema, skipped: exponential mean in order of position; values above spike times it are skipped. Null values count in n
    alone. The mean is sequential within a group, so groups are what runs in parallel, but a group is a stream of sorted rows and
    never held."""
    rows = values.select(*by, position, F.col(value).cast("double").alias("__v"))
    rows = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, position, "__v").select(*by, "__v")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("ema", T.DoubleType()), T.StructField("skipped", T.IntegerType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, mean, skipped, done, kinds = None, 0, None, 0, [], None

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.int64(), pa.float64(), pa.int32()], strict=True)], schema.names)

        for batch in parts:
            kinds = [f.type for f in batch.schema][:-1]
            columns = [c.to_pylist() for c in batch.columns]
            for *now, v in zip(*columns, strict=True):
                if now != key:
                    if key is not None:
                        done.append((*key, n, mean, skipped))
                    key, n, mean, skipped = now, 0, None, 0
                n += 1
                if v is None:
                    continue
                if mean is None:
                    mean = v
                elif v > spike * mean:
                    skipped += 1
                else:
                    mean = (1 - alpha) * mean + alpha * v
            if len(done) >= 10_000:
                yield out()
                done = []
        if key is not None:
            done.append((*key, n, mean, skipped))
            yield out()

    return rows.mapInArrow(run, schema)


def batches(rows: DataFrame, by: list[str], key: str, length: str, budget: int) -> DataFrame:
    """rows with batch and place (both from 0): a group's rows by rising length, then key, in batches whose padded size, longest times
    number, stays within the budget. A null length counts as 0; a row longer than the budget is a batch.

    Batches are planned on the counts of lengths alone, and a row finds its own by its rank among the rows of its length, so no list
    of a group's rows is made; what is planned at a time is as long as there are lengths in a group. Rows of one length and key stand
    in any order."""
    rows = rows.withColumn("__l", F.coalesce(F.col(length).cast("long"), F.lit(0)))
    groups = [f"__g{i}" for i in range(len(by))]
    counts = rows.groupBy(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), "__l").agg(F.count("*").alias("__n"))
    own = "".join(f"{g} {counts.schema[g].dataType.simpleString()}, " for g in groups)

    def plan(lengths: pd.DataFrame) -> pd.DataFrame:
        """For each length: the batch where its first row goes if there is room, how many rows that has and still takes, and how many
        go into each batch after it."""
        lengths = lengths.sort_values("__l")
        found, batch, held = [], 0, 0
        for size, n in zip(lengths["__l"].tolist(), lengths["__n"].tolist(), strict=True):
            whole = n + held if size <= 0 else max(1, budget // size)
            takes = min(n, max(0, whole - held))
            found.append((batch, held, takes, whole))
            rest = n - takes
            if rest:
                batch, held = batch + -(-rest // whole), (rest - 1) % whole + 1
            else:
                held += takes
        return lengths[[*groups, "__l"]].assign(**{c: list(x) for c, x in zip(("__batch", "__held", "__takes", "__whole"), zip(*found, strict=True), strict=True)})

    schema = f"{own}__l long, __batch long, __held long, __takes long, __whole long"
    planned = counts.groupBy(*groups).applyInPandas(plan, schema).withColumnRenamed("__l", "__m")
    ranked = running(rows, [*by, "__l"], [key], __r=F.lit(1)).drop("__r_all")
    same = F.col("__l") == F.col("__m")
    for c, g in zip(by, groups, strict=True):
        same &= ranked[c].eqNullSafe(F.col(g))
    late = F.col("__r_before") - F.col("__takes")
    at = F.when(late < 0, F.col("__batch")).otherwise(F.col("__batch") + 1 + F.floor(late / F.col("__whole")))
    place = F.when(late < 0, F.col("__held") + F.col("__r_before")).otherwise(late % F.col("__whole"))
    return ranked.join(planned, same).withColumns({"batch": at, "place": place}).drop(*groups, "__l", "__m", "__r_before", "__batch", "__held", "__takes", "__whole")
