"""Windows before and after an event: rates, new messages, shifts of metrics, and the summary of an incident.

A case looks up running totals and never meets an event. Time is cut into slots as long as the longer window, so a window touches
two slots at most. Events are first added up by second, so a slot of a group has no more rows than it has seconds, however many
events there are; cases are looked up by second too. What is shuffled grows with seconds and groups, not with events times cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what tells an error message.
ERROR = r"(?i)error|exception|fail|timeout|timed out|refused|panic|unavailable|denied|reset|50[0-9]"


def around(events: DataFrame, cases: DataFrame, time: str, before: int, after: int, by: list[str], example: Column | None = None, **measures: Column) -> DataFrame:
    """case, by, and for each measure <name>_before and <name>_after: its sums over the events of [t - before, t) and of [t, t + after)
    of each case (case, at), to the second. Pairs without an event in either window have no row. Null measures count as 0; events
    and cases without a time have no part; null is a group. example: a string; the least of those of the earliest events at or
    after the case, within its window."""
    step, sums = max(before, after), [*measures, "rows"]
    slot = F.floor(F.col("s") / step)
    # Groups are one struct: its nulls are equal in joins, and columns of any name have room beside it.
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    each = events.select(group.alias("g"), F.unix_timestamp(time).alias("s"), *(F.coalesce(m, F.lit(0)).alias(n) for n, m in measures.items()), F.lit(1).alias("rows"), (F.lit(None).cast("string") if example is None else example).alias("x"))
    each = each.filter("s is not null").groupBy("g", "s").agg(*(F.sum(n).alias(n) for n in sums), F.min("x").alias("x")).withColumn("slot", slot)
    times = cases.select("case", F.unix_timestamp("at").alias("t")).filter("t is not null")
    # Groups with an event in a slot that a window touches.
    touched = times.select("t").distinct().withColumn("slot", F.explode(F.sequence(F.floor((F.col("t") - before) / step), F.floor((F.col("t") + after - 1) / step))))
    pairs = touched.join(each.select("g", "slot").distinct(), "slot").select("g", "t").distinct()
    edges = F.array(*(F.struct((F.col("t") + d).alias("s"), F.lit(k).alias("edge")) for k, d in enumerate((-before, 0, after))))
    asked = pairs.select("g", "t", F.inline(edges)).withColumn("slot", slot)
    rows = each.unionByName(asked, allowMissingColumns=True)
    # Within a slot, a question stands before the events of its second.
    own = Window.partitionBy("g", "slot")
    upto = own.orderBy("s", F.col("edge").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select("g", "t", "edge", "s", "slot", *(F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"u_{n}") for n in sums), *(F.coalesce(F.sum(n).over(own), F.lit(0)).alias(f"a_{n}") for n in sums), "x")
    if example is not None:
        first = F.when(F.col("x").isNotNull(), F.struct("s", "x"))
        ahead = own.orderBy(F.desc("s"), F.col("edge").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumn("rest", F.min(first).over(ahead)).withColumn("head", F.min(first).over(upto))
    else:
        none = F.lit(None).cast("struct<s:bigint,x:string>")
        found = found.withColumn("rest", none).withColumn("head", none)
    at = lambda k, c: F.max(F.when(F.col("edge") == k, F.col(c)))
    kept = [f"{p}_{n}" for p in "ua" for n in sums]
    wide = found.filter("edge is not null").groupBy("g", "t").agg(*(at(k, c).alias(f"e{k}_{c}") for k in range(3) for c in [*kept, "slot", "rest", "head"]))

    def between(lo: int, hi: int, n: str) -> Column:
        same = F.col(f"e{lo}_slot") == F.col(f"e{hi}_slot")
        return F.when(same, F.col(f"e{hi}_u_{n}") - F.col(f"e{lo}_u_{n}")).otherwise(F.col(f"e{lo}_a_{n}") - F.col(f"e{lo}_u_{n}") + F.col(f"e{hi}_u_{n}"))

    first = F.coalesce(F.col("e1_rest"), F.when(F.col("e1_slot") != F.col("e2_slot"), F.col("e2_head")))
    out = wide.select("g", "t", *(between(k, k + 1, n).alias(f"{n}_{side}") for n in sums for k, side in enumerate(("before", "after"))), F.when(first["s"] < F.col("t") + after, first["x"]).alias("example"))
    out = times.join(out.filter("rows_before + rows_after > 0"), "t")
    return out.select("case", *(F.col("g")[c].alias(c) for c in by), *(f"{n}_{side}" for n in measures for side in ("before", "after")), *(["example"] if example is not None else []))


def rates(events: DataFrame, cases: DataFrame, time: str, before: int, after: int, by: list[str], error: Column | None = None) -> DataFrame:
    """case, by, n_before, n_after, rate_before, rate_after (a minute); with `error`, the same of its rows as errors_before, ...,
    error_rate_before, ..."""
    counted = {"n": F.lit(1)} | ({} if error is None else {"errors": error.cast("int")})
    out = around(events, cases, time, before, after, by, **counted)
    for n, rate in (("n", "rate"), ("errors", "error_rate"))[: len(counted)]:
        out = out.withColumn(f"{rate}_before", F.col(f"{n}_before") * 60.0 / before).withColumn(f"{rate}_after", F.col(f"{n}_after") * 60.0 / after)
    return out


def new_messages(events: DataFrame, cases: DataFrame, time: str, before: int, after: int, service: str, message: str, per_service: int, total: int, example: Column | None = None) -> DataFrame:
    """case, service, message, n, rank (and example): messages seen after the event and never before it; the most frequent ones of
    each service, then of the case, those that look like errors first."""
    got = around(events, cases, time, before, after, [service, message], example, n=F.lit(1)).filter("n_before = 0").withColumnRenamed("n_after", "n").drop("n_before")
    order = [F.desc(F.col(message).rlike(ERROR)), F.desc("n"), F.col(service), F.col(message)]
    got = got.withColumn("__k", F.row_number().over(Window.partitionBy("case", service).orderBy(F.desc("n"), message))).filter(F.col("__k") <= per_service).drop("__k")
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(*order))).filter(F.col("rank") <= total)


def metric_shift(events: DataFrame, cases: DataFrame, time: str, before: int, after: int, metric: str, value: str, k: int, least: int = 10) -> DataFrame:
    """case, metric, mean_before, mean_after, z, rank: change over the spread before (and a hundredth of the mean), the k largest of
    a case, of metrics with `least` values or more on either side."""
    v = F.col(value).cast("double")
    got = around(events, cases, time, before, after, [metric], n=v.isNotNull().cast("int"), v=v, vv=v * v)
    got = got.filter((F.col("n_before") >= least) & (F.col("n_after") >= least))
    got = got.withColumn("mean_before", F.col("v_before") / F.col("n_before")).withColumn("mean_after", F.col("v_after") / F.col("n_after"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("vv_before") / F.col("n_before") - F.col("mean_before") * F.col("mean_before")))
    got = got.select("case", metric, "mean_before", "mean_after", ((F.col("mean_after") - F.col("mean_before")) / (spread + 1e-9 + 0.01 * F.abs("mean_before"))).alias("z"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.desc(F.abs("z")), metric))).filter(F.col("rank") <= k)


def summaries(cases: DataFrame, metrics: DataFrame, services: DataFrame, messages: DataFrame, metric: str, service: str) -> DataFrame:
    """case, biggest_metric_changes, logs_per_service, new_log_messages, services: what is said of each case (case), from
    `metric_shift`, from `rates` with errors, and from `new_messages` with examples; services in order of name."""
    gather = lambda df, key, what, name: df.groupBy("case").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), what.alias("v")))).alias("l")).select("case", F.transform("l", lambda x: x["v"]).alias(name))
    minute = lambda c: F.round(F.col(c), 1).alias(c)
    name = F.col(service).cast("string")
    moved = gather(metrics, F.col("rank"), F.struct(F.col(metric).alias("metric"), "mean_before", "mean_after"), "biggest_metric_changes")
    logs = gather(services, name, F.struct(name.alias("service"), *map(minute, ("rate_before", "rate_after", "error_rate_before", "error_rate_after"))), "logs_per_service")
    said = gather(messages, F.col("rank"), F.struct(name.alias("service"), "n", F.col("example").alias("message")), "new_log_messages")
    out = cases.select("case").distinct()
    for df in (moved, logs, said):
        out = out.join(df, "case", "left")
    return out.withColumn("services", F.transform("logs_per_service", lambda x: x["service"]))
