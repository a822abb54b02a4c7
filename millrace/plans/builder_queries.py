"""Queries on builders and whole chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import builders as B
from ..operators.sampling import fraction
from . import training_mix as P
from .base import Catalog, table

C = Catalog()

LANGUAGES = ("en", "de", "fr", "es")


def _language_questions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return B.choices(docs, "lang", F.col("doc_id"), R.json_text(F.col("text")), "Which language?", B.options(F.array(*map(F.lit, LANGUAGES))), F.col("lang"))


@C.query("SELECT 'lang:' || doc_id AS record_id, lang AS gold FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')")
def build_choices(spark: SparkSession, d: str) -> DataFrame:
    return _language_questions(spark, d).select("record_id", "gold")


@C.query("SELECT 'toxic:' || doc_id AS record_id, CASE toxic WHEN 1 THEN 'true' ELSE 'false' END AS gold FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL")
def build_yes_no(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return B.yes_no(rows, "toxic", F.col("doc_id"), R.json_text(F.col("text")), "Is it toxic?", F.col("toxic")).select("record_id", "gold")


@C.query("""
WITH x AS (SELECT p_partkey, p_size::VARCHAR AS a, list_distinct(list_filter([(p_size * 2)::VARCHAR, (p_size + 1)::VARCHAR, (p_partkey % 50)::VARCHAR, '7'], lambda n: n <> p_size::VARCHAR)) AS o FROM part),
p AS (SELECT p_partkey, a, list_append(list_transform(list_sort(list_transform(o, lambda n: {'h': md5(p_partkey || ':' || n), 'n': n}))[1:3], lambda s: s.n), a) AS o FROM x)
SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(o, lambda n: {'h': md5(p_partkey || ':' || n), 'n': n})), lambda s: s.n), '|') AS options FROM p""")
def number_options(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    text = F.concat_ws(" and ", (s * 2).cast("string"), (s + 1).cast("string"), (k % 50).cast("string"), F.lit("7"))
    return table(spark, d, "part").select("p_partkey", F.array_join(B.number_options(text, s.cast("string"), 4, k.cast("string")), "|").alias("options"))


@C.query("""
SELECT page_id, substr(CASE WHEN ('0x' || md5('claim:' || page_id)[1:8])::UBIGINT / 4294967296.0 < 0.5 THEN 'It is safe. ' || url ELSE url || ' It is safe.' END, 1, 40) AS body FROM pages""")
def inject_claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", B.inject(F.col("url"), F.lit("It is safe."), fraction("claim", "page_id"), 40).alias("body"))


@C.query(r"""
WITH c AS (SELECT doc_id, '/* by' || chr(10) || lang || ' */' || text || ' // end' || chr(10) || '// @author x' || chr(10) || chr(10) || chr(10) || text AS code, replace('{~id~: ' || doc_id || ', ~lang~: ~' || lang || '~, ~ok~: True, ~no~: None}', '~', chr(39)) AS literal FROM documents),
x AS (SELECT doc_id, literal, regexp_replace(regexp_replace(regexp_replace(code, '(?s)/\*.*?\*/', '', 'g'), '(?m)//[^\n]*$', '', 'g'), '(?m)^[^\n]*@(?:vulnerable|source|author)[^\n]*\n?', '', 'g') AS code FROM c),
j AS (SELECT doc_id, code, regexp_replace(regexp_replace(replace(literal, chr(39), '"'), '\bNone\b', 'null', 'g'), '\bTrue\b', 'true', 'g')::JSON AS j FROM x)
SELECT doc_id, j ->> 'lang' AS lang, j ->> 'ok' AS ok, j ->> 'no' AS no, md5(trim(regexp_replace(code, '\n\s*\n+', chr(10), 'g'))) AS code FROM j""")
def cleaned_literals(spark: SparkSession, d: str) -> DataFrame:
    """Documents as commented code, and their fields as a literal."""
    literal = F.concat(F.lit("{'id': "), F.col("doc_id").cast("string"), F.lit(", 'lang': '"), "lang", F.lit("', 'ok': True, 'no': None}"))
    code = F.concat(F.lit("/* by\n"), "lang", F.lit(" */"), "text", F.lit(" // end\n// @author x\n\n\n"), "text")
    field = lambda c: F.get_json_object(B.literal_json(literal), f"$.{c}").alias(c)
    return table(spark, d, "documents").select("doc_id", field("lang"), field("ok"), field("no"), F.md5(B.clean_code(code, 1 << 30)).alias("code"))


@C.query("""
WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rn FROM lineitem)
SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY rn), ',') AS top FROM r WHERE rn <= 3 GROUP BY l_orderkey""")
def top_entries(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_extendedprice"))).alias("e"))
    return lists.select("l_orderkey", F.array_join(F.transform(B.top_entries(F.col("e"), "l_extendedprice", 3), lambda e: e["l_partkey"].cast("string")), ",").alias("top"))


@C.query()
def training_mix(spark: SparkSession, d: str) -> DataFrame:
    questions = _language_questions(spark, d)
    teacher = questions.select("record_id", "qkey", F.create_map("gold", F.lit(0.9)).alias("probs"))
    return P.training_mix(questions, table(spark, d, "benchmark"), teacher, {"lang": 200}, "7")


@C.query("""
WITH x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS run_id, 'set' || l_suppkey % 20 AS dataset, l_quantity > 25 AS a, l_quantity + l_linenumber * (l_suppkey % 5 - 2) > 25 AS b, l_tax > 0.04 AS g FROM lineitem),
y AS (SELECT run_id, any_value(dataset) AS dataset, bool_or(a) AS a, bool_or(b) AS b, bool_or(g) AS g FROM x GROUP BY run_id)
SELECT dataset, sum((a = g AND b = g)::INT)::BIGINT AS kept, sum((a = g AND b <> g)::INT)::BIGINT AS loss, sum((a <> g AND b = g)::INT)::BIGINT AS win FROM y GROUP BY dataset""")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"), F.concat(F.lit("set"), (F.col("l_suppkey") % 20).cast("string")).alias("dataset"))
    q = F.col("l_quantity")
    rows = rows.agg(F.bool_or(q > 25).alias("a"), F.bool_or(q + F.col("l_linenumber") * (F.col("l_suppkey") % 5 - 2) > 25).alias("b"), F.bool_or(F.col("l_tax") > 0.04).alias("g")).withColumn("qkey", F.lit("q"))
    spelled = lambda c: F.when(F.col(c), "yes").otherwise("False")
    run = lambda c: rows.select("run_id", "dataset", "qkey", spelled(c).alias("answer"), F.lit(0).alias("position"))
    gold = rows.select("run_id", "qkey", F.col("g").cast("string").alias("gold"))
    return P.regression_gate(run("a"), run("b"), gold, ["set1"]).select("dataset", "kept", "loss", "win")
