"""Queries on evaluation reports and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as O
from .base import Catalog, table

C = Catalog()


@C.query("""
WITH x AS (SELECT o_totalprice / 500000 AS s, o_orderpriority IN ('1-URGENT', '2-HIGH') AS c FROM orders), t AS (SELECT unnest([0.15, 0.3, 0.5]) AS threshold)
SELECT threshold::DOUBLE AS threshold, count(*) AS n, sum((s < threshold)::INT)::BIGINT AS n_cheap, round(avg((s < threshold)::INT), 9) AS share_cheap, sum((s < threshold AND c)::INT)::BIGINT AS n_missed,
  round(sum((s < threshold AND c)::INT) / sum(c::INT), 9) AS miss_rate, round(avg(((s < threshold) <> c)::INT), 9) AS accuracy FROM x, t GROUP BY threshold""")
def routing_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_totalprice") / 500000).alias("score"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("costly"))
    got = O.routing(rows, "score", "costly", [0.15, 0.3, 0.5])
    return got.select("threshold", "n", "n_cheap", F.round("share_cheap", 9).alias("share_cheap"), "n_missed", F.round("miss_rate", 9).alias("miss_rate"), F.round("accuracy", 9).alias("accuracy"))


@C.query("""
SELECT o_orderkey, CASE WHEN o_custkey % 100 / 100.0 >= 0.15 AND o_custkey % 100 / 100.0 < 0.5 AND o_orderkey % 7 > 0 THEN o_orderkey % 10 / 10.0 ELSE o_custkey % 100 / 100.0 END AS score FROM orders""")
def cascade_band(spark: SparkSession, d: str) -> DataFrame:
    second = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 10 / 10.0)
    return table(spark, d, "orders").select("o_orderkey", O.cascade(F.col("o_custkey") % 100 / 100.0, second, 0.15, 0.5).alias("score"))


@C.query("""
SELECT (SELECT count(*) FROM part) AS n, sum((p_size % 9 > 0 AND p_partkey % 10 > 0)::INT)::BIGINT AS n_same, sum((p_size % 9 = 0 AND p_partkey % 10 > 0)::INT)::BIGINT AS n_differ, sum((p_partkey % 10 = 0)::INT)::BIGINT AS n_only_left, 0::BIGINT AS n_only_right FROM part""")
def template_parity(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    one = part.select("p_partkey", F.format_string("%s of %s", "p_name", "p_brand").alias("text"))
    two = part.filter("p_partkey % 10 > 0").select("p_partkey", F.concat("p_name", F.lit(" of "), "p_brand", F.when(F.col("p_size") % 9 == 0, " ").otherwise("")).alias("text"))
    return O.parity(one, two, ["p_partkey"], "text")


@C.query("""
WITH e AS (SELECT l_orderkey, l_suppkey % 5 AS source, min(l_quantity > 25) AS lo, max(l_quantity > 25) AS hi, count(*) AS k FROM lineitem GROUP BY ALL HAVING count(*) > 1)
SELECT source, count(*) AS n, sum((lo = hi)::INT)::BIGINT AS n_stable, round(avg((lo = hi)::INT), 9) AS share FROM e GROUP BY source""")
def order_stability(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("source"), (F.col("l_quantity") > 25).alias("answer"))
    return O.order_stability(answers, ["l_orderkey"], "source").withColumn("share", F.round("share", 9))


@C.query("""
WITH i AS (SELECT user_id, event_id AS chord, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 AS b FROM events WHERE event_type = 'error'),
p AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type <> 'error')
SELECT p.event_id, i.chord FROM p JOIN i ON p.user_id = i.user_id AND p.t >= i.a AND p.t < i.b""")
def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    intervals = events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("chord"), F.col("t").alias("start"), (F.col("t") + 3600).alias("end"))
    points = events.filter("event_type <> 'error'").select("user_id", "event_id", "t")
    return O.in_interval(points, intervals, ["user_id"], "t", 3600.0).select("event_id", "chord")


@C.query("""
SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 = 0) AS n_left, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 = 1) AS n_right,
  (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)) AS n_both,
  NOT EXISTS (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1) AND NOT EXISTS (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) AS equal""")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether two of three splits of the orders share customers: the splits are what is audited."""
    orders = table(spark, d, "orders")
    return O.overlap(orders.filter("o_orderkey % 3 = 0"), orders.filter("o_orderkey % 3 = 1"), "o_custkey")


@C.query("SELECT user_id, event_type || ' ' || props AS line, min(event_id) AS event_id FROM events GROUP BY ALL")
def distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select("user_id", F.concat_ws(" ", "event_type", "props").alias("line"), "event_id")
    return O.distinct_lines(lines, ["user_id"], "line", "event_id")


@C.query("""
SELECT conv_id, turn, array_to_string(list_transform(range(0, len(string_split(text, ' '))), lambda i: CASE WHEN role = 'assistant' AND i >= 1 THEN 1 ELSE 0 END), '') AS mask FROM conversations WHERE text IS NOT NULL""")
def span_mask(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ", -1)
    spans = F.when(F.col("role") == "assistant", F.array(F.struct(F.lit(1).alias("start"), F.size(words).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    chats = table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", words.alias("w"), spans.alias("spans"))
    return chats.select("conv_id", "turn", F.array_join(F.transform(O.span_mask(F.col("w"), F.col("spans")), lambda x: x.cast("string")), "").alias("mask"))


@C.query("""
WITH x AS (SELECT l_orderkey, l_partkey::VARCHAR AS answer, ['consistent', 'contradicts', 'skipped'][l_suppkey % 3 + 1] AS status FROM lineitem),
g AS (SELECT l_orderkey, min(answer) AS chosen FROM x WHERE status = 'consistent' GROUP BY l_orderkey)
SELECT DISTINCT l_orderkey, chosen, answer AS rejected FROM x JOIN g USING (l_orderkey) WHERE status = 'contradicts'""")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(F.lit("consistent"), F.lit("contradicts"), F.lit("skipped")), (F.col("l_suppkey") % 3).cast("int"))
    return O.preference_pairs(table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("answer"), status.alias("status")), ["l_orderkey"])
