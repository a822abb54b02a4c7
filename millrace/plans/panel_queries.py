"""Queries on resampled views, panels, pairs of lines and teachers' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panels as P
from ..operators import teachers as O
from .base import Catalog, table
from .text_queries import MADE

C = Catalog()


@C.query("""
WITH v AS (SELECT event_type, event_id, unnest(range(3)) AS view FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, view ORDER BY md5('views:' || view || ':' || event_id), event_id) AS k, count(*) OVER (PARTITION BY event_type, view) AS total FROM v)
SELECT event_type, view::INT AS view, string_agg(event_type || ' ' || event_id, '|' ORDER BY event_id) AS lines, total FROM r WHERE k <= 40 GROUP BY ALL""")
def resampled_views(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select("event_type", "event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("line"))
    return P.views(lines, ["event_type"], "event_id", "line", "event_id", 3, 40, "views").withColumn("lines", F.array_join("lines", "|"))


@C.query("""
WITH b AS (SELECT o_custkey AS round, o_orderstatus AS member, o_orderpriority AS candidate, rank() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY sum(o_totalprice)) AS rank FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority),
s AS (SELECT round, member, list(candidate ORDER BY candidate) AS cands FROM b GROUP BY ALL),
w AS (SELECT round, cands, count(*) AS members FROM s WHERE len(cands) BETWEEN 2 AND 255 GROUP BY ALL),
p AS (SELECT round, count(*) AS panel FROM s GROUP BY ALL),
v AS (SELECT w.round, w.members, candidate, sum(rank) AS total FROM w JOIN p ON p.round = w.round AND p.panel = w.members JOIN b ON b.round = w.round GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY sha256(round || candidate), candidate) - 1 AS i, min(total) OVER (PARTITION BY round) AS low FROM v)
SELECT round, members, string_agg(candidate, '|' ORDER BY i) AS options, 'option_' || min(i) FILTER (total = low) AS winner FROM o GROUP BY round, members HAVING count(*) FILTER (total = low) = 1""")
def panel_winners(spark: SparkSession, d: str) -> DataFrame:
    """Customers are rounds, statuses members, priorities candidates, ranked by what was spent."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("round"), F.col("o_orderstatus").alias("member"), F.col("o_orderpriority").alias("candidate"), "o_totalprice")
    sums = orders.groupBy("round", "member", "candidate").agg(F.sum("o_totalprice").alias("spent"))
    ballots = sums.withColumn("rank", F.rank().over(Window.partitionBy("round", "member").orderBy("spent"))).drop("spent")
    return P.panel_winners(ballots, orders.select("round", "member")).withColumn("options", F.array_join("options", "|"))


@C.query(f"""
WITH l AS (SELECT DISTINCT {MADE} AS line, regexp_replace({MADE}, '[0-9]+(\\.[0-9]+)?', '<*>', 'g') AS event FROM part),
e AS (SELECT event, count(*) AS m, list_distinct(regexp_extract_all(lower(event), '[a-z]+')) AS w FROM l GROUP BY event HAVING count(*) >= 2),
o AS (SELECT *, row_number() OVER (ORDER BY md5('pairs:' || event), event) - 1 AS i, count(*) OVER () AS n FROM e),
r AS (SELECT event, line, row_number() OVER (PARTITION BY event ORDER BY md5('pairs:' || event || ':' || line), line) - 1 AS r FROM l JOIN e USING (event)),
q AS (SELECT event, m, i + t * n AS k, t FROM o, range(300) x(t) WHERE i + t * n < 300),
c AS (SELECT a.event, b.event AS other, b.m AS m2, row_number() OVER (PARTITION BY a.event ORDER BY len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) DESC, b.event) - 1 AS place FROM e a, e b WHERE a.event <> b.event AND len(list_intersect(a.w, b.w)) > 0),
h AS (SELECT *, count(*) OVER (PARTITION BY event) AS n FROM c WHERE place < 3)
SELECT k, q.event, q.event AS other, a.line AS line_a, b.line AS line_b, true AS same FROM q JOIN r a ON a.event = q.event AND a.r = (2 * t) % m JOIN r b ON b.event = q.event AND b.r = (2 * t + 1) % m WHERE k % 2 = 0
UNION ALL SELECT k, q.event, h.other, a.line, b.line, false FROM q JOIN h ON h.event = q.event AND h.place = t % h.n JOIN r a ON a.event = q.event AND a.r = (2 * t) % m JOIN r b ON b.event = h.other AND b.r = t % m2
WHERE k % 2 = 1 AND NOT regexp_matches(b.line, replace(q.event, '<*>', '.*?')) AND NOT regexp_matches(a.line, replace(h.other, '<*>', '.*?'))""")
def same_event_pairs(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("made "), "p_name", F.lit(" of "), "p_brand", F.lit(" in "), "p_size", F.lit(" parts at "), F.col("p_retailprice").cast("decimal(15,2)").cast("string"))
    lines = table(spark, d, "part").select(line.alias("line"), F.regexp_replace(line, r"[0-9]+(\.[0-9]+)?", "<*>").alias("event"))
    return P.same_event_pairs(lines, lines.select("event", F.col("event").alias("template")).distinct(), 300, "pairs")


#: Orders are questions from a source of three parts; lines are teachers' answers, options being return flags.
LABELS = """
WITH q AS (SELECT o_orderkey AS qid, ['hf/', 'synthetic/', 'tev1/'][o_orderkey % 3 + 1] || o_orderpriority AS source, o_orderstatus FROM orders),
l AS (SELECT 't' || l_linenumber % 5 AS teacher, l_orderkey AS qid, l_returnflag AS option, sum(l_quantity) AS p FROM lineitem WHERE l_orderkey % 4 > 0 OR l_linenumber % 5 > 1 GROUP BY ALL),
p AS (SELECT teacher, qid, option, p / sum(p) OVER (PARTITION BY teacher, qid) AS p FROM l),
u(prefix, teacher) AS (VALUES ('', 't1'), ('hf/', 't2'), ('hf/5', 't0'), ('hf/5-LOW', 't2')), f(teacher, priority) AS (VALUES ('t3', 0), ('t4', 1)),
"""
RULES, FALLBACKS = [("", "t1"), ("hf/", "t2"), ("hf/5", "t0"), ("hf/5-LOW", "t2")], [("t3", 0), ("t4", 1)]


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = F.array(*map(F.lit, ("hf/", "synthetic/", "tev1/")))
    source = F.concat(F.element_at(parts, (F.col("o_orderkey") % 3 + 1).cast("int")), F.col("o_orderpriority"))
    questions = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), source.alias("source"), "o_orderstatus")
    teacher = F.col("l_linenumber") % 5
    lines = table(spark, d, "lineitem").filter((F.col("l_orderkey") % 4 > 0) | (teacher > 1))
    sums = lines.groupBy(F.concat(F.lit("t"), teacher.cast("string")).alias("teacher"), F.col("l_orderkey").alias("qid"), "l_returnflag").agg(F.sum("l_quantity").alias("p"))
    entry = F.collect_list(F.struct("l_returnflag", "p"))
    return questions, sums.groupBy("teacher", "qid").agg(O.D.normalised(F.map_from_entries(F.array_sort(entry))).alias("probs"))


ATTACHED = LABELS + """
w AS (SELECT q.qid, u.teacher FROM q JOIN u ON starts_with(q.source, u.prefix)),
m AS (SELECT w.qid, p.teacher, p.option, p.p FROM w JOIN p ON p.qid = w.qid AND p.teacher = w.teacher),
c AS (SELECT w.qid, count(*) AS n FROM w JOIN (SELECT DISTINCT qid, teacher FROM p) t ON t.qid = w.qid AND t.teacher = w.teacher GROUP BY ALL),
a AS (SELECT qid, option, sum(p) / sum(sum(p)) OVER (PARTITION BY qid) AS p FROM m GROUP BY qid, option),
b AS (SELECT qid, teacher, row_number() OVER (PARTITION BY qid ORDER BY priority) AS k FROM (SELECT DISTINCT qid, teacher FROM p) JOIN f USING (teacher) WHERE qid NOT IN (SELECT qid FROM c)),
x AS (SELECT qid, c.n || '_teachers' AS status, option, p FROM a JOIN c USING (qid) UNION ALL SELECT b.qid, 'fallback', option, p FROM b JOIN p ON p.qid = b.qid AND p.teacher = b.teacher WHERE k = 1),
"""


def _attached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    questions, labels = _labels(spark, d)
    rules = spark.createDataFrame(RULES, "prefix string, teacher string")
    return questions, labels, O.attached(questions, labels, rules, spark.createDataFrame(FALLBACKS, "teacher string, priority int"))


@C.query(ATTACHED + """
g AS (SELECT qid, any_value(status) AS status, string_agg(option || '=' || printf('%.6f', round(p, 6)), ' ' ORDER BY option) AS probs FROM x GROUP BY qid)
SELECT q.qid, coalesce(status, 'none') AS status, coalesce(probs, '') AS probs FROM q LEFT JOIN g USING (qid)""")
def attached_teachers(spark: SparkSession, d: str) -> DataFrame:
    # Millionths are rounded as binary numbers, as in the SQL; round(p, 6) would round the shortest decimal that stands for p.
    shown = lambda e: F.concat(e["key"], F.lit("="), (F.round(e["value"] * 1e6) / 1e6).cast("decimal(10,6)").cast("string"))
    return _attached(spark, d)[2].select("qid", "status", F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("probs")), shown), " "), F.lit("")).alias("probs"))


@C.query(ATTACHED + """
e AS (SELECT qid::VARCHAR AS id, qid AS base, o_orderstatus = 'P' AS replay FROM q UNION ALL SELECT qid || '~2', qid, o_orderstatus = 'P' FROM q WHERE starts_with(source, 'hf/')),
t AS (SELECT qid, option, p FROM p WHERE teacher = 't2'),
k AS (SELECT e.id, e.base, CASE WHEN e.base NOT IN (SELECT qid FROM t) THEN 'missing' WHEN replay OR e.base NOT IN (SELECT qid FROM x) THEN 'own' ELSE 'blend' END AS how FROM e),
z AS (SELECT id, how, option, sum(0.5 * p) * 2 AS p FROM (SELECT id, how, option, p FROM k JOIN t ON t.qid = k.base WHERE how <> 'missing' UNION ALL SELECT id, how, option, p FROM k JOIN x ON x.qid = k.base WHERE how = 'blend') GROUP BY ALL),
y AS (SELECT id, how, option, p / sum(p) OVER (PARTITION BY id) AS p FROM z),
s AS (SELECT id, how, arg_max(option, round(p, 9) * 1000 - ascii(option) * 0.000001) AS best FROM y GROUP BY ALL)
SELECT k.how, count(*) AS n, count(*) FILTER (best = 'R') AS agree, count(*) FILTER (best <> 'R') AS disagree FROM k LEFT JOIN s USING (id) GROUP BY k.how""")
def student_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many targets are blends, the own teacher's or missing, and how many of them say R."""
    questions, labels, attached = _attached(spark, d)
    rows = questions.join(attached, "qid").select(F.col("qid").cast("string").alias("id"), "source", (F.col("o_orderstatus") == "P").alias("replay"), "probs")
    again = rows.filter(F.col("source").startswith("hf/")).withColumn("id", F.concat("id", F.lit("~2")))
    own = labels.filter("teacher = 't2'").select(F.col("qid").cast("string").alias("id"), "probs")
    targets = O.student_targets(rows.unionByName(again), own)
    targets = targets.withColumn("probs", F.transform_values("probs", lambda _, p: F.round(p, 9)))
    counts = targets.groupBy("how").agg(F.count("*").alias("n"))
    agree = O.agreement(targets, targets.select("id", F.lit("R").alias("gold")), "how")
    return counts.join(agree, "how", "left").fillna(0, ["agree", "disagree"])
