"""Queries on mixes, splits, records and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import records as R
from ..operators import records as O
from ..operators import sampling as S
from ..sources import io
from .base import Catalog, table

C = Catalog()


@C.query("""
WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('mix:' || doc_id), doc_id) AS rn FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn, md5('mix:' || lang), doc_id) AS pos FROM r)
SELECT doc_id, source, lang, rn::INT AS rn, pos::INT AS pos FROM p WHERE pos <= 20""")
def round_robin_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return S.round_robin(docs, ["lang"], 20, "mix", "doc_id", ["source"])


QUOTAS = {"src1": 150, "src0": 20, "other": 100}


@C.query("""
WITH b AS (SELECT doc_id, lang, CASE WHEN source LIKE 'src1%' THEN 'src1' WHEN source LIKE 'src0%' THEN 'src0' ELSE 'other' END AS bucket FROM documents),
h AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('hold:' || doc_id), doc_id) AS hold FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, lang ORDER BY md5('quota:' || doc_id), doc_id) AS rn FROM h WHERE hold > 10),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY rn, md5('quota:' || lang), doc_id) AS pos FROM r)
SELECT doc_id, bucket, 'valid' AS split FROM h WHERE hold <= 10 UNION ALL
SELECT doc_id, bucket, 'train' FROM p WHERE pos <= CASE bucket WHEN 'src1' THEN 150 WHEN 'src0' THEN 20 ELSE 100 END""")
def quota_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", S.first_bucket(F.col("source"), ["src1", "src0"]).alias("bucket"))
    held = S.per_group(docs, ["bucket"], 10, [S.draw("hold", "doc_id"), "doc_id"], "hold")
    rest = docs.join(held.select("doc_id"), "doc_id", "left_anti")
    quota = F.lit(None).cast("int")
    for name, n in QUOTAS.items():
        quota = F.when(F.col("bucket") == name, n).otherwise(quota)
    mixed = S.round_robin(rest, ["lang"], max(QUOTAS.values()), "quota", "doc_id", ["bucket"]).filter(F.col("pos") <= quota)
    return held.select("doc_id", "bucket", F.lit("valid").alias("split")).unionByName(mixed.select("doc_id", "bucket", F.lit("train").alias("split")))


@C.query("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('repo:' || source), source) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT source, CASE WHEN rn < floor(n * 0.15) THEN 'test' WHEN rn < floor(n * 0.15) + floor(n * 0.1) THEN 'valid' ELSE 'train' END AS split FROM g""")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return S.group_split(table(spark, d, "documents"), "source", "repo")


@C.query("""
WITH h AS (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents)
SELECT doc_id, CASE WHEN (6 * (('0x' || h[1:8])::UBIGINT + ('0x' || h[9:16])::UBIGINT + ('0x' || h[17:24])::UBIGINT) + ('0x' || h[25:32])::UBIGINT) % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM h""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(S.md5_mod10(F.col("doc_id")) == 0, "test").otherwise("train").alias("split"))


@C.query("SELECT doc_id, quality, rn::INT AS rn FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('cap:' || doc_id), doc_id) AS rn FROM labels) WHERE rn <= 30")
def class_cap(spark: SparkSession, d: str) -> DataFrame:
    return S.per_group(table(spark, d, "labels").select("doc_id", "quality"), ["quality"], 30, [S.draw("cap", "doc_id"), "doc_id"])


@C.query("""
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('head:' || doc_id), doc_id) <= least(80, floor(count(*) OVER (PARTITION BY lang) / 10)) THEN 'valid' ELSE 'train' END AS split FROM documents""")
def head_rest_split(spark: SparkSession, d: str) -> DataFrame:
    return S.head_rest(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "head", "doc_id")


@C.query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('prop:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS k, count(*) OVER () AS n FROM labels)
SELECT doc_id, quality FROM r WHERE rn <= round_even(100 * k / n, 0)""")
def proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.proportional(table(spark, d, "labels").select("doc_id", "quality"), "quality", 100, "prop", "doc_id")


@C.query("SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('bal:' || doc_id), doc_id) AS rn FROM labels) WHERE rn <= 20")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", 40, "bal", "doc_id")


@C.query("SELECT o_orderkey FROM orders ORDER BY md5('take:' || o_orderkey), o_orderkey LIMIT 200")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.sample(table(spark, d, "orders").select("o_orderkey"), 200, "take", "o_orderkey")


@C.query("SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || md5('coin:' || o_orderkey)[1:8])::UBIGINT / 4294967296.0 < 0.3")
def bernoulli_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").filter(S.fraction("coin", "o_orderkey") < 0.3)


@C.query("SELECT doc_id, unnest(range(0, CASE WHEN quality = 0 THEN 3 ELSE 1 END))::INT AS copy FROM labels")
def minority_repeat(spark: SparkSession, d: str) -> DataFrame:
    return S.repeated(table(spark, d, "labels").select("doc_id", "quality"), F.when(F.col("quality") == 0, 3).otherwise(1)).select("doc_id", "copy")


@C.query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('line:' || l_linenumber), l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 2""")
def lines_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return S.per_group(rows, ["l_orderkey"], 2, [S.draw("line", "l_linenumber"), "l_linenumber", "l_partkey"]).drop("rn")


@C.query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_used(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    more = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(used, "o_custkey", "left_anti").join(more, "o_orderkey", "left_anti").select("o_orderkey")


@C.query("""
WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b), "all": a.unionByName(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@C.query("""
WITH p AS (SELECT o_orderkey::VARCHAR AS id, 0 AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey::VARCHAR, 1 FROM orders WHERE o_totalprice > 200000),
k AS (SELECT id, part FROM p WHERE id NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_quantity > 48)),
f AS (SELECT id, min(part)::INT AS part FROM k GROUP BY id)
SELECT id, CASE part WHEN 0 THEN 'hf/a' ELSE 'tev/b' END AS source FROM f UNION ALL SELECT id || '~2', 'hf/a' FROM f WHERE part = 0""")
def assembled_mix(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    ident = F.col("o_orderkey").cast("string").alias("id")
    parts = [orders.filter("o_orderstatus = 'F'").select(ident, F.lit("hf/a").alias("source")), orders.filter("o_totalprice > 200000").select(ident, F.lit("tev/b").alias("source"))]
    used = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").cast("string").alias("id"))
    return O.second_pass(O.assembled(parts, [used]), "^(hf|synthetic)/").select("id", "source")


@C.query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS z FROM orders)
SELECT c_custkey, f.o_orderstatus AS first_status, l.o_orderstatus AS last_status FROM customer LEFT JOIN (SELECT * FROM r WHERE a = 1) f ON c_custkey = f.o_custkey LEFT JOIN (SELECT * FROM r WHERE z = 1) l ON c_custkey = l.o_custkey""")
def first_last_wins(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    by = orders.groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))
    return table(spark, d, "customer").select("c_custkey").join(by, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "first_status", "last_status")


SHARES = """
WITH n AS (SELECT o_custkey % 200 AS k, o_orderkey % 2 AS side, o_orderstatus AS option, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT k, side, option, n / sum(n) OVER (PARTITION BY k, side) AS p FROM n),
"""


def _shares(spark: SparkSession, d: str, side: int) -> DataFrame:
    """k, probs: shares of order statuses, of odd or even orders."""
    rows = table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == side).groupBy((F.col("o_custkey") % 200).alias("k"), "o_orderstatus").agg(F.count("*").alias("n"))
    by = rows.groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", F.col("n").cast("double"))))).alias("n"))
    return by.select("k", D.normalised(F.col("n")).alias("probs"))


@C.query(SHARES + """
a AS (SELECT k, option, p FROM p WHERE side = 0), b AS (SELECT k, option, p FROM p WHERE side = 1),
m AS (SELECT k, option, 0.8 * coalesce(a.p, 0) + 0.2 * coalesce(b.p, 0) AS p FROM a FULL JOIN b USING (k, option))
SELECT k, option, round(CASE WHEN k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) THEN p / sum(p) OVER (PARTITION BY k) WHEN k IN (SELECT k FROM a) THEN p / 0.8 ELSE p / 0.2 END, 9) AS p FROM m""")
def blend_distributions(spark: SparkSession, d: str) -> DataFrame:
    return O.blended(_shares(spark, d, 0), _shares(spark, d, 1), 0.8, ["k"]).select("k", F.explode("probs").alias("option", "p")).select("k", "option", F.round("p", 9).alias("p"))


@C.query(SHARES + """
r AS (SELECT k, side, option, row_number() OVER (PARTITION BY k, side ORDER BY p DESC, CASE option WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS rn FROM p)
SELECT a.k, a.option AS choice FROM r a JOIN r b USING (k, option) WHERE a.side = 0 AND b.side = 1 AND a.rn = 1 AND b.rn = 1 AND a.k % 7 <> 0""")
def agreement_filter(spark: SparkSession, d: str) -> DataFrame:
    pairs = _shares(spark, d, 0).withColumnRenamed("probs", "a").join(_shares(spark, d, 1).withColumnRenamed("probs", "b"), "k")
    return O.agreed(pairs, F.array(*map(F.lit, ("F", "O", "P"))), F.col("a"), F.col("b"), F.col("k") % 7 == 0).select("k", "choice")


@C.query("""
WITH n AS (SELECT o_custkey % 100 AS k, o_orderpriority AS teacher, o_orderstatus AS option, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT k, teacher, option, n / sum(n) OVER (PARTITION BY k, teacher) AS p FROM n)
SELECT k, option, round(sum(p) / (SELECT sum(p) FROM p q WHERE q.k = p.k), 9) AS p FROM p GROUP BY k, option""")
def average_distributions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("k"), F.col("o_orderpriority").alias("teacher"), F.col("o_orderstatus").alias("option")).agg(F.count("*").alias("n"))
    z = n.groupBy("k", "teacher").agg(F.sum("n").alias("z"))
    labels = n.join(z, ["k", "teacher"]).select("k", "teacher", "option", (F.col("n") / F.col("z")).alias("p"))
    return O.averaged(labels, ["k"]).select("k", "option", F.round("p", 9).alias("p"))


@C.query("""
WITH x AS (SELECT s_suppkey, 0.1 + (s_suppkey % 8) / 10.0 AS a, (s_suppkey % 3) / 20.0 AS b FROM supplier),
m AS (SELECT s_suppkey, a, b, a + b AS mass, greatest(0, 1 - a - b) AS rest FROM x)
SELECT s_suppkey, round(a / (mass + rest), 9) AS p_a, round(b / (mass + rest), 9) AS p_b, round(rest / (mass + rest), 9) AS p_c FROM m WHERE mass >= 0.5""")
def top_token_probs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    a, b = 0.1 + (k % 8) / 10.0, (k % 3) / 20.0
    top = F.array(F.struct(F.lit(" A").alias("token"), a.alias("p")), F.struct(F.lit("B").alias("token"), b.alias("p")), F.struct(F.lit("A ").alias("token"), F.lit(0.01).alias("p")), F.struct(F.lit("zz").alias("token"), F.lit(0.05).alias("p")))
    got = table(spark, d, "supplier").select("s_suppkey", D.to_probs(top, F.array(*map(F.lit, "ABC"))).alias("probs")).filter("probs is not null")
    return got.select("s_suppkey", *(F.round(F.col("probs")[x], 9).alias(f"p_{x.lower()}") for x in "ABC"))


CRITERIA = "[{'key': p_brand, 'desc': NULL}, {'key': 'option_1', 'desc': p_type}, {'key': 'size', 'desc': 'Size ' || p_size}]"


@C.query("""
WITH c AS (SELECT p_partkey, p_brand, unnest([0, 1]) AS copy FROM part),
o AS (SELECT p_partkey, copy, p_brand, list_transform(list_sort([{'h': md5('0:' || p_partkey || '#pick#' || copy || ':' || k), 'key': k} FOR k IN [p_brand, 'option_1', 'size']]), lambda s: s.key) AS o FROM c)
SELECT p_partkey || '#pick#' || copy AS id, array_to_string(o, '|') AS shown, chr((64 + list_position(o, p_brand))::INT) AS gold FROM o""")
def expand_examples(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d).select("id", F.array_join("order", "|").alias("shown"), "gold")


def _examples(spark: SparkSession, d: str) -> DataFrame:
    option = lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("desc"))
    criteria = F.array(option(F.col("p_brand"), F.lit(None)), option(F.lit("option_1"), F.col("p_type")), option(F.lit("size"), F.concat(F.lit("Size "), F.col("p_size").cast("string"))))
    q = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("record_id"), F.lit("pick").alias("qkey"), F.lit("choice").alias("kind"), criteria.alias("criteria"), F.col("p_brand").alias("gold"))
    return O.expand(q)


@C.query("""
WITH x AS (SELECT p_partkey, p_type, p_size, p_brand FROM part)
SELECT p_partkey, '{"state":{"size":' || p_size || '},"question":"Which one?","options":{"A":"' || p_brand || '","B":"' || p_type || '","C":{"key":"size","description":"Size ' || p_size || '"}}}' AS prompt FROM x""")
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    option = lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("desc"))
    options = F.array(option(F.col("p_brand"), F.lit(None)), option(F.lit("option_1"), F.col("p_type")), option(F.lit("size"), F.concat(F.lit("Size "), F.col("p_size").cast("string"))))
    state = F.to_json(F.struct(F.col("p_size").alias("size")))
    return table(spark, d, "part").select("p_partkey", R.decision_prompt(state, F.lit("Which one?"), options, R.labels()).alias("prompt"))


@C.query("""
WITH c AS (SELECT p_partkey, p_brand, unnest([0, 1]) AS copy FROM part),
o AS (SELECT p_partkey, copy, p_brand, list_transform(list_sort([{'h': md5('0:' || p_partkey || '#pick#' || copy || ':' || k), 'key': k} FOR k IN [p_brand, 'option_1', 'size']]), lambda s: s.key) AS o FROM c)
SELECT p_partkey || '#pick#' || copy AS id, CASE WHEN p_partkey % 2 = 0 THEN round(CASE o[1] WHEN p_brand THEN 0.7 WHEN 'size' THEN 0.3 ELSE 0 END, 6) END AS p_first FROM o""")
def teacher_remap(spark: SparkSession, d: str) -> DataFrame:
    teacher = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("record_id"), F.lit("pick").alias("qkey"), F.create_map("p_brand", F.lit(0.7), F.lit("size"), F.lit(0.3)).alias("probs"))
    return O.attach(_examples(spark, d), teacher).select("id", F.round(F.col("probs")["A"], 6).alias("p_first"))


@C.query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 2 THEN 'true' ELSE 'false' END AS gold FROM supplier""")
def normal_gold(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.get(F.array(*map(F.lit, ("yes", "1", "No", "FALSE", "other"))), (F.col("s_suppkey") % 5).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", R.normal_gold(spelled).alias("gold"))


@C.query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS t FROM e),
s AS (SELECT vec_id, list_transform(v, lambda x: exp(x - t)) AS e FROM m)
SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS p_max, round(-ln(e[1] / list_sum(e)), 9) AS nll FROM s""")
def softmax_nll(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select("vec_id", D.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 9).alias("p_max"), F.round(-F.log(F.get("p", F.lit(0))), 9).alias("nll"))


@C.query("""
WITH x AS (SELECT p_partkey, 0.1 + (p_size % 5) / 10.0 AS a, 0.2 + (p_size % 3) / 10.0 AS b FROM part)
SELECT p_partkey, round(-(0.02 * ln(a / (a + b + 0.3)) + 0.06 * ln(b / (a + b + 0.3)) + 0.92 * ln(0.3 / (a + b + 0.3))), 9) AS loss, round(tanh((a * 50) / 30.0) * 30.0, 9) AS capped FROM x""")
def distillation_loss(spark: SparkSession, d: str) -> DataFrame:
    a, b = 0.1 + (F.col("p_size") % 5) / 10.0, 0.2 + (F.col("p_size") % 3) / 10.0
    student = F.array(a / (a + b + 0.3), b / (a + b + 0.3), F.lit(0.3) / (a + b + 0.3))
    teacher = F.array(F.lit(0.02), F.lit(0.06), F.lit(0.92))
    return table(spark, d, "part").select("p_partkey", F.round(D.cross_entropy(teacher, student), 9).alias("loss"), F.round(D.softcap(a * 50, 30.0), 9).alias("capped"))


@C.query("SELECT event_id, event_type FROM events WHERE value > 5 ORDER BY md5('early:' || event_id), event_id LIMIT 400")
def early_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample from a pool of files that is filled no further than it needs; a table of one file is the pool."""
    return io.early_sample(spark, f"{d}/events.parquet", 400, "early", "event_id", 2_000, "value > 5").select("event_id", "event_type")
