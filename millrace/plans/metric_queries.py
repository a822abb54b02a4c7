"""Queries on evaluation, gates, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import reviews as V
from .base import Catalog, table

C = Catalog()


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)


LABELLED = "WITH x AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


@C.query(LABELLED + """
, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM x),
s AS (SELECT lang, sum(quality) AS p, sum(1 - quality) AS m, sum(CASE WHEN quality = 1 THEN r ELSE 0 END) AS r FROM r GROUP BY lang)
SELECT lang, p::BIGINT AS n_pos, m::BIGINT AS n_neg, round(CASE WHEN p * m > 0 THEN (r - p * (p + 1) / 2) / (p * m) END, 9) AS auc FROM s""")
def auc_midrank(spark: SparkSession, d: str) -> DataFrame:
    return M.auc(_labelled(spark, d), "n_chars", "good", ["lang"]).withColumn("auc", F.round("auc", 9))


@C.query(LABELLED + """
, r AS (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM x)
SELECT lang, max(n) AS n, sum((rn <= round_even(0.59 * n, 0))::INT)::BIGINT AS picked, round(sum(CASE WHEN rn <= round_even(0.59 * n, 0) THEN quality ELSE 0 END) / sum(quality), 9) AS missed FROM r GROUP BY lang""")
def miss_at_share(spark: SparkSession, d: str) -> DataFrame:
    return M.miss_at_share(_labelled(spark, d), "n_chars", "good", "doc_id", 0.59, ["lang"]).withColumn("missed", F.round("missed", 9))


@C.query(LABELLED + """
SELECT lang, round((avg(CASE WHEN quality = 1 THEN (n_chars > 1000)::INT END) + avg(CASE WHEN quality <> 1 THEN (n_chars <= 1000)::INT END)) / 2, 9) AS balanced FROM x GROUP BY lang""")
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("lang").agg(F.round(M.balanced_accuracy(F.col("good"), F.col("n_chars") > 1000), 9).alias("balanced"))


@C.query("""
WITH r AS (SELECT o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS d FROM orders)
SELECT p AS o_orderpriority, count(*) AS n, round(1 - 6 * sum(d::DOUBLE * d) / (count(*) * (count(*)::DOUBLE * count(*) - 1)), 9) AS rho FROM r GROUP BY p""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return M.spearman(table(spark, d, "orders"), "o_totalprice", "o_orderdate", "o_orderkey", ["o_orderpriority"]).withColumn("rho", F.round("rho", 9))


@C.query("SELECT o_orderpriority, count(*) AS n, sum(((o_totalprice >= 150000) = (o_custkey % 100 >= 50))::INT)::BIGINT AS n_same FROM orders GROUP BY o_orderpriority")
def same_decision(spark: SparkSession, d: str) -> DataFrame:
    same = (F.col("o_totalprice") >= 150000) == (F.col("o_custkey") % 100 >= 50)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(same.cast("int")).alias("n_same"))


@C.query("""
WITH x AS (SELECT 'task' || (l_suppkey % 50) AS task, l_quantity > 25 AS old, l_quantity + l_linenumber * (l_suppkey % 5 - 2) > 25 AS new FROM lineitem),
c AS (SELECT task, sum((old AND new)::INT) AS kept, sum((old AND NOT new)::INT) AS loss, sum((NOT old AND new)::INT) AS win FROM x GROUP BY task),
p AS (SELECT *, CASE WHEN loss + win = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(loss, win)::BIGINT + 1), lambda i: exp(lgamma(loss + win + 1) - lgamma(i + 1) - lgamma(loss + win - i + 1) - (loss + win) * ln(2))))) END AS p FROM c)
SELECT task, kept::BIGINT AS kept, loss::BIGINT AS loss, win::BIGINT AS win, round(p, 6) AS p, CASE WHEN (task LIKE 'task1%' OR task LIKE 'task2%') AND loss > win AND p < 0.2 THEN 'FAIL' WHEN (task LIKE 'task1%' OR task LIKE 'task2%') AND loss - win >= 5 THEN 'warn' ELSE 'ok' END AS verdict FROM p""")
def mcnemar_gate(spark: SparkSession, d: str) -> DataFrame:
    q, k = F.col("l_quantity"), F.col("l_suppkey")
    pairs = table(spark, d, "lineitem").select(F.concat(F.lit("task"), (k % 50).cast("string")).alias("task"), (q > 25).alias("old"), (q + F.col("l_linenumber") * (k % 5 - 2) > 25).alias("new"))
    return M.gate(pairs, "task", "old", "new", ["task1", "task2"]).withColumn("p", F.round("p", 6))


@C.query("""
WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, n, round((v[((n - 1) // 2 + 1)::BIGINT] + v[(n // 2 + 1)::BIGINT]) / 2, 6) AS median, v[floor(0.5 * (n - 1))::BIGINT + 1] AS p50, v[floor(0.9 * (n - 1))::BIGINT + 1] AS p90, v[least(n - 1, floor(0.95 * n))::BIGINT + 1] AS p95 FROM s""")
def order_stat_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return M.order_statistics(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]).withColumn("median", F.round("median", 6))


@C.query(LABELLED + """
SELECT lang, source, count(*) AS n, sum((quality = 1)::INT)::BIGINT AS correct, round(avg((quality = 1)::INT), 9) AS acc FROM x GROUP BY ROLLUP (lang, source)""")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.accuracy(_labelled(spark, d), "good", ["lang", "source"]).withColumn("acc", F.round("acc", 9))


@C.query("""
WITH x AS (SELECT o_orderpriority AS bench, o_orderstatus AS model, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY ALL),
w AS (SELECT bench, max(CASE model WHEN 'F' THEN v END) AS F, max(CASE model WHEN 'O' THEN v END) AS O, max(CASE model WHEN 'P' THEN v END) AS P FROM x GROUP BY bench)
SELECT bench, F, O, P, CASE greatest(F, O, P) WHEN F THEN 'F' WHEN O THEN 'O' WHEN P THEN 'P' END AS best FROM w""")
def board_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("bench"), F.col("o_orderstatus").alias("model")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return M.best_per_row(x, "bench", "model", "v", ["F", "O", "P"])


@C.query("""
WITH x AS (SELECT o_orderpriority, ['A', 'B', 'tie'][o_orderkey % 3 + 1] AS ab, ['A', 'B', 'tie'][o_custkey % 3 + 1] AS ba FROM orders),
v AS (SELECT o_orderpriority, CASE WHEN ab = 'A' AND ba = 'B' THEN 'win' WHEN ab = 'B' AND ba = 'A' THEN 'loss' ELSE 'tie' END AS v FROM x)
SELECT o_orderpriority, sum((v = 'win')::INT)::BIGINT AS win, sum((v = 'tie')::INT)::BIGINT AS tie, sum((v = 'loss')::INT)::BIGINT AS loss, round((sum((v = 'win')::INT) + sum((v = 'tie')::INT) / 2) / count(*), 9) AS rate FROM v GROUP BY o_orderpriority""")
def swapped_judging(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("A", "B", "tie")))
    v = table(spark, d, "orders").select("o_orderpriority", M.swapped_verdicts(F.get(names, (F.col("o_orderkey") % 3).cast("int")), F.get(names, (F.col("o_custkey") % 3).cast("int"))).alias("v"))
    n = lambda x: F.sum((F.col("v") == x).cast("int"))
    return v.groupBy("o_orderpriority").agg(n("win").alias("win"), n("tie").alias("tie"), n("loss").alias("loss"), F.round((n("win") + n("tie") / 2) / F.count("*"), 9).alias("rate"))


@C.query("""
WITH r AS (SELECT o_custkey, o_orderpriority AS c, rank() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice) AS r FROM orders),
s AS (SELECT o_custkey, c, sum(r) AS total FROM r GROUP BY ALL), m AS (SELECT *, min(total) OVER (PARTITION BY o_custkey) AS low FROM s),
k AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS k FROM m WHERE total = low)
SELECT o_custkey, c AS o_orderpriority, total::BIGINT AS total FROM k WHERE k = 1""")
def rank_sum_winner(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    r = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.rank().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_totalprice")).alias("r"))
    return M.unique_winner(r, ["o_custkey"], "o_orderpriority", "r")


@C.query("SELECT l_suppkey, l_partkey, min(l_returnflag) AS flag FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(DISTINCT l_returnflag) = 1")
def conflict_free(spark: SparkSession, d: str) -> DataFrame:
    return M.conflict_free(table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_returnflag").alias("flag")), ["l_suppkey", "l_partkey"], "flag")


@C.query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'snyk-bot' ELSE 'u' || o_custkey % 5 END AS author, count(*) AS n,
  sum(CASE WHEN 'u' || l_linenumber <> coalesce('u' || o_custkey % 5, '') OR o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS dummy FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey),
h AS (SELECT x.o_orderkey, x.author, l.l_returnflag AS f, l.l_shipdate AS t FROM x JOIN lineitem l ON l.l_orderkey = x.o_orderkey WHERE 'u' || l.l_linenumber IS DISTINCT FROM x.author),
s AS (SELECT o_orderkey, bool_or(f = 'R') AS asked, bool_or(f = 'A') AS approved, min(t) AS t0 FROM h GROUP BY o_orderkey),
w AS (SELECT x.o_orderkey, x.author, s.asked, s.approved, s.t0, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = x.o_orderkey AND l.l_shipdate + INTERVAL 10 DAY > s.t0) AS rework, x.o_orderkey % 6 AS threads, x.o_orderkey % 17 = 0 AS rev FROM x LEFT JOIN s USING (o_orderkey))
SELECT o_orderkey, CASE WHEN author IS NULL OR author LIKE '%snyk%' THEN 'bot_author' WHEN t0 IS NULL THEN 'no_human_review' WHEN asked OR (rework >= 1 AND threads >= 2) OR threads >= 4 OR rev THEN 'yes' WHEN approved AND threads <= 1 AND rework = 0 THEN 'no' ELSE 'ambiguous' END AS outcome FROM w""")
def review_outcome(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("login"), F.when(F.col("l_returnflag") == "R", "CHANGES_REQUESTED").when(F.col("l_returnflag") == "A", "APPROVED").otherwise("COMMENTED").alias("state"), F.col("l_shipdate").alias("at"))).alias("reviews"),
        F.collect_list(F.col("l_shipdate") + F.expr("INTERVAL 10 DAYS")).alias("commits"),
    )
    k = F.col("o_orderkey")
    author = F.when(k % 11 == 0, None).when(k % 13 == 0, "snyk-bot").otherwise(F.concat(F.lit("u"), (F.col("o_custkey") % 5).cast("string")))
    changes = table(spark, d, "orders").join(lines, k == F.col("l_orderkey"))
    return changes.select("o_orderkey", V.outcome(author, F.col("reviews"), F.col("commits"), k % 6, k % 17 == 0).alias("outcome"))


@C.query("""
WITH x AS (SELECT o_custkey % 20 AS repo, o_orderkey AS number, CASE WHEN o_orderkey % 5 = 0 THEN 'Revert "Fix ' || (o_orderkey % 300) || '"' ELSE 'Fix ' || o_orderkey % 300 END AS title,
  CASE WHEN o_orderkey % 7 = 0 THEN 'This reverts a/b#' || (o_orderkey - 20) END AS body FROM orders)
SELECT DISTINCT repo, number FROM x a WHERE (EXISTS (SELECT 1 FROM x b WHERE b.repo = a.repo AND b.title = 'Revert "' || a.title || '"') AND number = (SELECT max(number) FROM x c WHERE c.repo = a.repo AND c.title = a.title)) OR EXISTS (SELECT 1 FROM x b WHERE b.repo = a.repo AND b.title LIKE 'Revert%' AND regexp_extract(b.body, '#(\\d+)', 1) = a.number::VARCHAR)""")
def reverted_changes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 300).cast("string")
    title = F.when(k % 5 == 0, F.concat(F.lit('Revert "Fix '), n, F.lit('"'))).otherwise(F.concat(F.lit("Fix "), n))
    body = F.when(k % 7 == 0, F.concat(F.lit("This reverts a/b#"), (k - 20).cast("string")))
    return V.reverted(table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("repo"), k.alias("number"), title.alias("title"), body.alias("body")))


@C.query("""
WITH x AS (SELECT o_custkey % 20 AS repo, o_orderstatus <> 'P' AS merged, CASE WHEN o_orderkey % 9 = 0 THEN 'ci[bot]' ELSE 'u' END AS author, o_totalprice > 120000 AS reviewed FROM orders),
g AS (SELECT repo, sum(merged::INT) AS n_merged, sum((author = 'u')::INT) AS n_human, avg(CASE WHEN author = 'u' THEN reviewed::INT END) AS rate FROM x GROUP BY repo)
SELECT repo, n_merged::BIGINT AS n_merged, n_human::BIGINT AS n_human, round(rate, 9) AS rate FROM g WHERE n_merged >= 150 AND n_human >= 10 AND rate >= 0.4""")
def eligible_repos(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("repo"), (F.col("o_orderstatus") != "P").alias("merged"), F.when(F.col("o_orderkey") % 9 == 0, "ci[bot]").otherwise("u").alias("author"), (F.col("o_totalprice") > 120000).alias("reviewed"))
    return V.eligible(rows).withColumn("rate", F.round("rate", 9))


@C.query("""
SELECT l_returnflag, round(avg(CASE WHEN l_linestatus <> 'O' THEN l_discount END), 9) AS wrong_confidence, round(max(abs(l_discount - l_tax)), 9) AS max_gap, round(avg(((l_discount >= 0.05) = (l_tax >= 0.05))::INT), 9) AS same FROM lineitem GROUP BY l_returnflag""")
def engine_comparison(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.col("l_linestatus") != "O", a)), 9).alias("wrong_confidence"), F.round(F.max(F.abs(a - b)), 9).alias("max_gap"), F.round(F.avg(((a >= 0.05) == (b >= 0.05)).cast("int")), 9).alias("same"))


@C.query("""
SELECT '#' || list_aggregate(list_transform([s_nationkey / 25.0, s_suppkey % 7 / 7.0, 0.5], lambda x: lpad(lower(to_hex(round_even(x * 255, 0)::INT)), 2, '0')), 'string_agg', '') AS colour, s_suppkey FROM supplier""")
def hex_colours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(T.hex_colour(F.col("s_nationkey") / 25.0, F.col("s_suppkey") % 7 / 7.0, F.lit(0.5)).alias("colour"), "s_suppkey")
