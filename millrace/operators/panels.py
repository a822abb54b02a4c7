"""Groups looked at whole without gathering them: resampled views, complete panels, pairs within and across groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import unique_winner
from .sampling import draw, per_group
from .similarity import fits, similar

#: Parts that a group's rows are dealt over before the smallest draws of all meet.
PARTS = 64


def smallest(df: DataFrame, groups: list[str], k: int, order: list[Column | str], rank: str = "rn") -> DataFrame:
    """The first k rows of each group with their rank, as `per_group`, for groups of any size: first of each of PARTS parts, which
    Spark cuts down before rows are exchanged, then of what is left, PARTS * k rows a group at most."""
    part = F.pmod(F.xxhash64(*(F.col(c) if isinstance(c, str) else c for c in order)), F.lit(PARTS))
    some = per_group(df.withColumn("__part", part), [*groups, "__part"], k, order, "__rn")
    return per_group(some.drop("__part", "__rn"), groups, k, order, rank)


def views(lines: DataFrame, by: list[str], position: str, line: str, key: str, n_views: int, k: int, seed: str | int) -> DataFrame:
    """by, view (from 0), lines, total: `n_views` samples without replacement of `k` of a group's lines (all, if fewer) in the order of
    position, and how many the group has. A group with lines is never one task; its samples are lists of k."""
    # A struct of the group's columns: nulls are equal in it.
    rows = lines.select(F.struct(*by, F.lit(0).alias("__all")).alias("__g"), position, line, key)
    drawn = rows.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n_views - 1)))).withColumn("__draw", draw(seed, "view", key))
    picked = smallest(drawn, ["__g", "view"], k, ["__draw", key])
    lists = picked.groupBy("__g", "view").agg(F.array_sort(F.collect_list(F.struct(position, key, line))).alias("__s"))
    total = rows.groupBy("__g").agg(F.count("*").alias("total"))
    return lists.join(total, "__g").select(*(F.col("__g")[c].alias(c) for c in by), "view", F.transform("__s", lambda x: x[line]).alias("lines"), "total")


def set_hash(item: Column) -> list[Column]:
    """Aggregates that are equal for equal sets of distinct items, in any order: their number and two digests."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(item)).alias("h1"), F.bit_xor(F.xxhash64(item, F.lit(1))).alias("h2")]


def panel_winners(ballots: DataFrame, panels: DataFrame, least: int = 2, most: int = 255) -> DataFrame:
    """round, members, options, winner of ballots (round, member, candidate, rank) and panels (round, member). A round counts once for
    each set of candidates that all of its panel's members, and nobody else, have ranked whole, of `least` to `most`; its winner is the
    candidate of the lowest rank sum, if only one has it. options: the candidates by sha256 of round and candidate; winner: option_<i>
    by that order. A member who ranks a candidate twice counts with the least rank."""
    one = ballots.groupBy("round", "member", "candidate").agg(F.min("rank").alias("rank"))
    sets = one.groupBy("round", "member").agg(*set_hash(F.col("candidate")))
    # Division: of each round and set of candidates, the members that ranked it are the panel.
    who = sets.groupBy("round", "n", "h1", "h2").agg(*(c.alias(f"m_{x}") for c, x in zip(set_hash(F.col("member")), ("n", "h1", "h2"), strict=True)))
    asked = panels.select("round", "member").distinct().groupBy("round").agg(*(c.alias(f"m_{x}") for c, x in zip(set_hash(F.col("member")), ("n", "h1", "h2"), strict=True)))
    whole = who.filter(F.col("n").between(least, most)).join(asked, ["round", "m_n", "m_h1", "m_h2"]).select("round", "n", "h1", "h2", F.col("m_n").alias("members"))
    voted = one.join(sets.join(whole, ["round", "n", "h1", "h2"]).drop("n"), ["round", "member"])
    group = ["round", "h1", "h2"]
    winner = unique_winner(voted, group, "candidate", "rank").select(*group, F.col("candidate").alias("best"))
    order = F.struct(F.sha2(F.concat(F.col("round").cast("string"), F.col("candidate").cast("string")), 256).alias("k"), F.col("candidate").alias("c"))
    options = voted.groupBy(*group, "members").agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["c"]).alias("options"))
    key = F.concat(F.lit("option_"), (F.array_position("options", F.col("best")) - 1).cast("string"))
    return options.join(winner, group).select("round", "members", "options", key.alias("winner"))


def same_event_pairs(lines: DataFrame, templates: DataFrame, n: int, seed: str | int, near: int = 3) -> DataFrame:
    """k, event, other, line_a, line_b, same: up to n pairs of lines (event, line), one after the other of the same event and of two events
    with similar templates (event, template). Events with fewer than two distinct lines don't take part.

    Pairs come from ranks, and none is enumerated: event i, in a drawn order, has the questions i, i + E, ...; its t-th one takes its
    distinct lines of rank 2t and 2t + 1, or line 2t and that of rank t of its t-th nearest event, all going round. A pair of two events
    goes where the template of one also fits the other's line."""
    known = lines.filter("line is not null").select("event", "line").distinct()
    counts = known.groupBy("event").agg(F.count("*").alias("m")).filter("m >= 2").join(templates.select("event", "template"), "event")
    events = counts.withColumn("__d", draw(seed, "event"))
    n_events = events.count()
    if not n_events:
        return lines.sparkSession.createDataFrame([], "k bigint, event string, other string, line_a string, line_b string, same boolean")
    # At most n events are asked, so their order is a top-n.
    order = events.orderBy("__d", "event").limit(n).select("event", "m", "template")
    ranked = order.sparkSession.createDataFrame([(r.event, i) for i, r in enumerate(order.select("event").collect())], "event string, i bigint")
    rounds = -(-n // n_events)
    drawn = smallest(known.join(counts.select("event"), "event"), ["event"], 2 * rounds, [draw(seed, "event", "line"), "line"]).select("event", "line", (F.col("rn") - 1).alias("r"))
    asked = order.join(ranked, "event").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("k", F.col("i") + F.col("t") * n_events).filter(F.col("k") < n)
    asked = asked.withColumn("same", F.col("k") % 2 == 0)
    words = counts.select(F.col("event").alias("id"), F.array_distinct(F.regexp_extract_all(F.lower("template"), F.lit("[a-z]+"), F.lit(0))).alias("tokens"))
    close = similar(words.join(order.select(F.col("event").alias("id")), "id"), words, near).select(F.col("a").alias("event"), F.col("b").alias("other"), (F.col("rank") - 1).alias("place"))
    has = close.groupBy("event").agg(F.count("*").alias("close"))

    def line_of(df: DataFrame, event: str, rank: Column, name: str) -> DataFrame:
        some = drawn.select(F.col("event").alias(event), F.col("r").alias("__r"), F.col("line").alias(name))
        return df.withColumn("__r", rank.cast("int")).join(some, [event, "__r"]).drop("__r")

    asked = line_of(asked, "event", (2 * F.col("t")) % F.col("m"), "line_a")
    yes = line_of(asked.filter("same"), "event", (2 * F.col("t") + 1) % F.col("m"), "line_b").withColumn("other", F.col("event"))
    no = asked.filter("not same").join(has, "event").withColumn("place", (F.col("t") % F.col("close")).cast("int")).join(close, ["event", "place"])
    no = no.join(counts.select(F.col("event").alias("other"), F.col("m").alias("m2"), F.col("template").alias("template2")), "other")
    no = line_of(no, "other", F.col("t") % F.col("m2"), "line_b")
    no = no.filter(~fits(F.col("line_b"), F.col("template")) & ~fits(F.col("line_a"), F.col("template2")))
    cols = ["k", "event", "other", "line_a", "line_b", "same"]
    return yes.select(*cols).unionByName(no.select(*cols))
