"""Queries on extraction from answers, enrichment, probes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import extract as E
from ..functions import json_text as J
from ..operators import puzzles as Z
from ..operators import scoring as X
from ..operators.sampling import fraction
from ..sources import pages
from ..sources.shared import shared_dir
from .base import Catalog, table

C = Catalog()


@C.query("""SELECT event_id, '{"kind":"' || event_type || '","props":{"a":' || user_id || ',"k":' || (props::JSON ->> 'k') || '},"user":' || user_id || '}' AS canonical FROM events""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects whose keys stand in another order at two depths."""
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"user": '), user, F.lit(', "props": {"k": '), k, F.lit(', "a": '), user, F.lit('}, "kind": "'), "event_type", F.lit('"}'))
    return table(spark, d, "events").select("event_id", J.canonical(doc).alias("canonical"))


@C.query("SELECT p_partkey, p_type || '|' || p_brand AS leaves FROM part")
def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.struct(F.col("p_type").alias("z"), F.col("p_size").alias("n")).alias("b"), F.array("p_brand").alias("a")))
    return table(spark, d, "part").select("p_partkey", F.array_join(J.leaves(doc), "|").alias("leaves"))


@C.query(r"""
WITH c AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text || ' First [[B]] but in the end [[A]]' WHEN 1 THEN 'They are equally good. ' || text WHEN 2 THEN 'I say assistant b is much better' || chr(10) || text ELSE text END AS said,
  text || chr(10) || '```bash' || chr(10) || 'pwd' || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```bash' || chr(10) || text || chr(10) || '```' || chr(10) || text AS code,
  '<think>' || text || '<tool_call>{"name":"bad"}</tool_call></think> <tool_call>{"name":"get_' || role || '","arguments":{"turn":' || turn || '}}</tool_call><tool_call>{broken}</tool_call>' AS call FROM conversations),
l AS (SELECT *, regexp_extract(said, '\[\[(A|B|TIE)\]\]', 1) AS tag, lower(string_split(trim(said, chr(32) || chr(10) || chr(9) || chr(13)), chr(10))[1]) AS line FROM c),
s AS (SELECT *, upper(regexp_extract(line, 'assistant (a|b)\b[^.\n]*\b(?:better|wins|superior|preferred)', 1)) AS side FROM l)
SELECT conv_id, turn, CASE WHEN tag <> '' THEN tag WHEN side <> '' THEN side WHEN regexp_matches(line, '\b(tie|equal|equally)\b') THEN 'TIE' END AS verdict,
  md5(trim(regexp_extract_all(code, '(?s)```bash\s*\n(.*?)```', 1)[-1], chr(32) || chr(10) || chr(9))) AS code, regexp_extract(regexp_replace(call, '(?s)<think>.*?</think>\s*', '', 'g'), '"name":"([^"]*)"', 1) AS tool FROM s""")
def answer_parts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers: with verdicts of several kinds, in code blocks, and in thoughts before a call."""
    k, text = F.col("conv_id") % 4, F.col("text")
    said = F.when(k == 0, F.concat(text, F.lit(" First [[B]] but in the end [[A]]"))).when(k == 1, F.concat(F.lit("They are equally good. "), text)).when(k == 2, F.concat(F.lit("I say assistant b is much better\n"), text)).otherwise(text)
    code = F.concat(text, F.lit("\n```bash\npwd\n```\nthen\n```bash\n"), text, F.lit("\n```\n"), text)
    call = F.concat(F.lit("<think>"), text, F.lit('<tool_call>{"name":"bad"}</tool_call></think> <tool_call>{"name":"get_'), "role", F.lit('","arguments":{"turn":'), F.col("turn").cast("string"), F.lit("}}</tool_call><tool_call>{broken}</tool_call>"))
    tool = F.get(E.tool_calls(E.without_tags(call, "think")), F.lit(0))["name"]
    return table(spark, d, "conversations").select("conv_id", "turn", E.verdict(said).alias("verdict"), F.md5(E.last_code(code)).alias("code"), tool.alias("tool"))


@C.query("""
WITH c AS (SELECT conv_id, turn, '*' || text || '*' AS text, string_split('*' || text || '*', chr(10)) AS w FROM conversations),
v AS (SELECT conv_id, turn, [text, trim(array_to_string(w[2:], chr(10))), trim(array_to_string(w[:len(w) - 1], chr(10))), CASE WHEN len(w) > 2 THEN trim(array_to_string(w[2:len(w) - 1], chr(10))) ELSE '' END] AS v FROM c)
SELECT conv_id, turn, md5(array_to_string(list_concat(v, list_transform(v, lambda x: replace(x, '*', ''))), '|')) AS variants FROM v""")
def answer_variants(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("*"), "text", F.lit("*"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.array_join(E.variants(text), "|")).alias("variants"))


@C.query("""
WITH t AS (SELECT o_custkey AS k, max(o_totalprice) AS v, 0 AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey UNION ALL SELECT o_custkey, min(o_totalprice), 1 FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL SELECT c_custkey, c_acctbal, 2 FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS rn FROM t)
SELECT k, v, p::INT AS priority FROM r WHERE rn = 1""")
def teacher_fallback(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    a = orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    b = orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("v"))
    return X.first_hit([a, b, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))], "k", "v")


@C.query("""
WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f) AS rn FROM n)
SELECT l_suppkey, l_returnflag, n FROM r WHERE rn = 1""")
def most_common_value(spark: SparkSession, d: str) -> DataFrame:
    return X.most_common(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_orderkey")


@C.query("""
WITH e AS (SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY p_brand)
SELECT p_brand, substr(lo, 1, list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda i: substr(lo, 1, i) = substr(hi, 1, i)))) AS prefix FROM e""")
def shared_prefix(spark: SparkSession, d: str) -> DataFrame:
    return X.common_prefix(table(spark, d, "part"), ["p_brand"], "p_name")


@C.query("""
WITH u AS (SELECT o_orderkey, ('0x' || md5('w:' || o_orderkey)[1:8])::UBIGINT / 4294967296.0 AS u FROM orders)
SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'major' WHEN u < 0.8 THEN 'minor' ELSE 'other' END AS kind FROM u""")
def weighted_choices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.weighted_choice(fraction("w", "o_orderkey"), [("major", 5), ("minor", 3), ("other", 2)]).alias("kind"))


@C.query("""
WITH a AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation), b AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT n_regionkey, k::INT AS k, n_name AS a, n_nationkey AS b FROM a JOIN b USING (n_regionkey, k)""")
def zip_by_position(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    a = nation.select("n_regionkey", F.col("n_name").alias("o"))
    b = nation.select("n_regionkey", F.col("n_nationkey").alias("o"))
    return X.zipped(a, b, "o", ["n_regionkey"])


@C.query("""
WITH x AS (SELECT l_orderkey AS id, max(CASE WHEN l_linenumber = 1 THEN l_discount END) AS clean, max(CASE WHEN l_linenumber = 2 THEN l_discount END) AS injected FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS n, round(avg(injected - clean), 9) AS shift, sum(((injected >= 0.05) <> (clean >= 0.05))::INT)::BIGINT AS flips FROM x WHERE clean IS NOT NULL AND injected IS NOT NULL""")
def injection_shift(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_discount")))
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(at(1).alias("clean"), at(2).alias("injected")).filter("clean is not null and injected is not null")
    return x.agg(F.count("*").alias("n"), F.round(F.avg(F.col("injected") - F.col("clean")), 9).alias("shift"), F.sum(((F.col("injected") >= 0.05) != (F.col("clean") >= 0.05)).cast("int")).alias("flips"))


@C.query("""
WITH x AS (SELECT o_orderpriority, ['A', 'B', 'C'][o_orderkey % 3 + 1] AS picked, ['A', 'B', 'C'][o_custkey % 3 + 1] AS gold FROM orders)
SELECT picked, count(*) AS n, sum((picked = gold)::INT)::BIGINT AS correct, round(count(*) / (SELECT count(*) FROM x), 9) AS share FROM x GROUP BY picked""")
def position_bias(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, "ABC"))
    x = table(spark, d, "orders").select(F.get(names, (F.col("o_orderkey") % 3).cast("int")).alias("picked"), F.get(names, (F.col("o_custkey") % 3).cast("int")).alias("gold"))
    by = x.groupBy("picked").agg(F.count("*").alias("n"), F.sum((F.col("picked") == F.col("gold")).cast("int")).alias("correct"))
    return by.join(F.broadcast(x.agg(F.count("*").alias("__all")))).select("picked", "n", "correct", F.round(F.col("n") / F.col("__all"), 9).alias("share"))


@C.query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'skipped' WHEN s_suppkey % 5 = 1 THEN 'no_reference' WHEN s_nationkey % 3 = 0 THEN 'contradicted' WHEN s_acctbal > 5000 THEN 'consistent' ELSE 'unsupported' END AS status FROM supplier""")
def fact_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    return table(spark, d, "supplier").select("s_suppkey", X.fact_status(F.when(k == 0, " ").otherwise("x"), F.when(k != 1, "r"), F.col("s_acctbal") > 5000, F.col("s_nationkey") % 3 == 0).alias("status"))


@C.query("""
WITH n AS (SELECT o_custkey % 50 AS k, o_orderpriority AS o, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, o) AS rn FROM n)
SELECT k, o, round(n / sum(n) OVER (PARTITION BY k), 9) AS p FROM r WHERE rn <= 2""")
def top_alternatives(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), "o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    by = n.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return by.select("k", F.explode(D.top_alternatives(F.col("m"), 2)).alias("o", "p")).withColumn("p", F.round("p", 9))


@C.query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return X.bootstrap(table(spark, d, "orders"), "o_custkey", F.col("o_totalprice"), 200, "b")


@C.query()
def logistic_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = rows.select(F.log1p("n_chars").alias("length"), F.length(F.regexp_replace("text", r"[^|#*$%&<>!]", "")).alias("marks"), F.col("quality").alias("good"))
    return X.logistic(rows, ["length", "marks"], "good")


@C.query()
def stub_scores(spark: SparkSession, d: str) -> DataFrame:
    def make():
        return lambda pdf: pdf.assign(p=pdf["text"].str.len() % 100 / 100)[["item_id", "p"]]

    return X.scored(table(spark, d, "benchmark").select("item_id", "text"), make, "item_id bigint, p double")


@C.query("SELECT o_orderstatus AS dataset, count(*) AS n, round(exp(avg(ln(0.1 + o_custkey % 10 / 20.0))), 9) AS g FROM orders GROUP BY o_orderstatus")
def mean_likelihood(spark: SparkSession, d: str) -> DataFrame:
    p = 0.1 + F.col("o_custkey") % 10 / 20.0
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.count("*").alias("n"), F.round(F.exp(F.avg(F.log(p))), 9).alias("g"))


@C.query("SELECT o_orderpriority, round(avg((o_totalprice > 150000)::INT), 9) AS acc, round(avg(CASE WHEN o_totalprice > 150000 THEN (o_custkey % 2 = 0)::INT END), 9) AS tool_rate FROM orders GROUP BY o_orderpriority")
def agent_rates(spark: SparkSession, d: str) -> DataFrame:
    right = F.col("o_totalprice") > 150000
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(right.cast("int")), 9).alias("acc"), F.round(F.avg(F.when(right, (F.col("o_custkey") % 2 == 0).cast("int"))), 9).alias("tool_rate"))


@C.query()
def gen_puzzles(spark: SparkSession, d: str) -> DataFrame:
    return Z.puzzles(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@C.query("""
WITH r AS (SELECT 'c' || o_custkey % 16 AS key, o_orderdate::VARCHAR AS created, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS position FROM orders)
SELECT key, position, created, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM r WHERE position < 5000 AND created >= '1995-06-01'""")
def cursor_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders landed as pages of sixteen keys, newest first, and read back by their cursors down to a date."""
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    pages.land(orders, path, F.concat(F.lit("c"), (F.col("o_custkey") % 16).cast("string")), F.col("o_orderdate"), ["o_orderkey"], 500)
    pages.register(spark)
    rows = spark.read.format("cursor_pages").option("path", path).option("most", 5000).option("since", "1995-06-01").load()
    node = F.from_json("node", "o_orderkey bigint, o_totalprice double")
    return rows.select("key", "position", "created", node["o_orderkey"].alias("o_orderkey"), F.round(node["o_totalprice"], 2).alias("o_totalprice"))
