"""Queries on the builders of held-out tasks, over parts and documents under each dataset's column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import held_out as H
from .base import Catalog, table
from .dataset_queries import shown

C = Catalog()

ASK = {k: v.replace("'", "''") for k, v in H.ASKS.items()}
NAMES = ["pay_in", "ask_help", "close_it", "move_on", "zero_out"]
YES_NO = "'true=Yes, the statement is true.|false=No, the statement is false.'"


def fixed(classes: dict[str, str]) -> str:
    """SQL of options that all rows share."""
    return "'" + "|".join(f"{k}={v}" for k, v in classes.items()).replace("'", "''") + "'"


def nth(names: list[str], i: str) -> str:
    """SQL of the name of number i, from 0."""
    return f"({names!r})[({i}) + 1]"


def sql(name: str, gold: str, ask: str, state: str, options: str, where: str = "true") -> str:
    return f"SELECT '{name}:' || p_partkey AS record_id, {gold} AS gold, {ask} AS instructions, {state} AS state, {options} AS options FROM part WHERE {where}"


def told(field: str, text: str = "p_name") -> str:
    """SQL of a state with one field."""
    return f"""'{{"{field}":"' || {text} || '"}}'"""


def parts(spark: SparkSession, d: str, **columns: Column | str) -> DataFrame:
    """Parts with an id and columns of these names."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


FOUR = "'1=' || p_brand || '|2=' || p_type || '|3=' || p_name || '|4=none'"
NONE = "'{}'"


def size() -> Column:
    return F.col("p_size")


def words() -> Column:
    """Four texts of a part."""
    return F.array("p_brand", "p_type", "p_name", F.lit("none"))


@C.query(sql("trec", nth(list(H.ANSWERS), "p_size % 6"), f"'{ASK['trec']}'", told("question"), fixed(H.ANSWERS)))
def build_trec(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.trec(parts(spark, d, text="p_name", coarse_label=size() % 6)))


@C.query(sql("emotion", nth(H.EMOTIONS, "p_size % 7"), f"'{ASK['emotion']}'", told("text"), fixed({e: e for e in H.EMOTIONS}), "p_size % 7 < 6"))
def build_emotion(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.emotion(parts(spark, d, text="p_name", label=size() % 7)))


@C.query(sql("siqa", "(p_size % 3 + 1)::VARCHAR", "p_name", told("context", "p_type"), "'1=' || p_brand || '|2=' || p_type || '|3=none'"))
def build_siqa(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit(" "), (size() % 3 + 1).cast("string"))
    return shown(H.siqa(parts(spark, d, context="p_type", question="p_name", answerA="p_brand", answerB="p_type", answerC=F.lit("none"), label=label)))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    key = F.get(F.array(*map(F.lit, "ABCDE")), size() % 5)
    return parts(spark, d, question="p_name", choices=F.struct(F.array(*map(F.lit, "ABCD")).alias("label"), words().alias("text")), answerKey=key)


KEYED = (nth(list("ABCDE"), "p_size % 5"), "p_name", NONE, "'A=' || p_brand || '|B=' || p_type || '|C=' || p_name || '|D=none'", "p_size % 5 < 4")


@C.query(sql("csqa", *KEYED))
def build_csqa(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.keyed(_keyed(spark, d), "csqa"))


@C.query(sql("qasc", *KEYED))
def build_qasc(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.keyed(_keyed(spark, d), "qasc"))


@C.query(sql("support_intent", nth(NAMES, "p_size % 5"), f"'{ASK['support_intent']}'", told("customer_message"), fixed({n: n.replace("_", " ") for n in sorted(NAMES)})))
def build_bitext(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.bitext(parts(spark, d, instruction="p_name", intent=F.get(F.array(*map(F.lit, NAMES)), size() % 5)), NAMES))


@C.query(sql("ledgar", nth(NAMES, "p_size % 5"), f"'{ASK['ledgar']}'", told("contract_clause"), fixed({n: n for n in NAMES})))
def build_ledgar(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.ledgar(parts(spark, d, text="p_name", label=size() % 5), NAMES))


@C.query(sql("logiqa", "(p_size % 4 + 1)::VARCHAR", "p_type", told("passage"), FOUR))
def build_logiqa(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.logiqa(parts(spark, d, context="p_name", query="p_type", options=words(), correct_option=size() % 4)))


@C.query(sql("medmcqa", "(p_size % 4 + 1)::VARCHAR", "p_type", NONE, FOUR))
def build_medmcqa(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.medmcqa(parts(spark, d, question="p_type", opa="p_brand", opb="p_type", opc="p_name", opd=F.lit("none"), cop=size() % 4)))


@C.query(sql("offensive", nth(list(H.OFFENCE), "p_size % 2"), f"'{ASK['offensive']}'", told("tweet"), fixed(H.OFFENCE)))
def build_offensive(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.offensive(parts(spark, d, text="p_name", label=size() % 2)))


@C.query(sql("truthfulqa", "(p_size % 5 + 1)::VARCHAR", "p_type", NONE, FOUR, "p_size % 5 < 4"))
def build_truthfulqa(spark: SparkSession, d: str) -> DataFrame:
    labels = F.transform(F.array(*map(F.lit, range(4))), lambda i: (i == F.col("p_size") % 5).cast("int"))
    return shown(H.truthfulqa(parts(spark, d, question="p_type", mc1_targets=F.struct(words().alias("choices"), labels.alias("labels")))))


@C.query(sql("strategyqa", "CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END", "p_name", NONE, YES_NO))
def build_strategyqa(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.strategyqa(parts(spark, d, question="p_name", answer=size() % 2 == 1)))


@C.query("""
WITH o AS (SELECT p_partkey, p_type, unnest([{'i': 0, 'v': p_brand}, {'i': 1, 'v': p_type}, {'i': 2, 'v': p_name}, {'i': 3, 'v': 'none'}]) AS o FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY md5('sciq:' || p_partkey || ':' || o.i)) AS k FROM o)
SELECT 'sciq:' || p_partkey AS record_id, (max(k) FILTER (o.i = 0))::VARCHAR AS gold, p_type AS instructions, '{}' AS state, string_agg(k || '=' || o.v, '|' ORDER BY k) AS options FROM r GROUP BY p_partkey, p_type""")
def build_sciq(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.sciq(parts(spark, d, question="p_type", correct_answer="p_brand", distractor1="p_type", distractor2="p_name", distractor3=F.lit("none"))))


@C.query(sql("piqa", "(p_size % 2 + 1)::VARCHAR", f"'{ASK['piqa']}'", told("goal"), "'1=' || p_brand || '|2=' || p_type"))
def build_piqa(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.piqa(parts(spark, d, goal="p_name", sol1="p_brand", sol2="p_type", label=(size() % 2).cast("string"))))


@C.query(sql("aqua", nth(["A", "B", "C"], "p_size % 3"), "p_name", NONE, "'A=' || p_brand || '|B=' || p_type || ' (x)|C=none'", "p_size % 3 < 2"))
def build_aqua(spark: SparkSession, d: str) -> DataFrame:
    options = F.array(F.concat(F.lit("A)"), "p_brand"), F.concat(F.lit("B) "), "p_type", F.lit(" (x)")), F.lit("C)none"))
    return shown(H.aqua(parts(spark, d, question="p_name", options=options, correct=F.get(F.array(*map(F.lit, ["A ", "B", "E"])), size() % 3))))


@C.query(sql("casehold", "(p_size % 4 + 1)::VARCHAR", f"'{ASK['casehold']}'", told("citing_context"), FOUR))
def build_casehold(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.casehold(parts(spark, d, context="p_name", endings=words(), label=size() % 4)))


@C.query(sql("ethics", "CASE WHEN p_size % 3 = 1 THEN 'true' ELSE 'false' END", f"'{ASK['ethics']}'", told("scenario", "repeat(p_name, p_size::INT * 2)"), YES_NO, "length(p_name) * p_size * 2 < 1200"))
def build_ethics(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.ethics(parts(spark, d, input=F.expr("repeat(p_name, cast(p_size as int) * 2)"), label=(size() % 3).cast("string"))))


@C.query(f"""
SELECT 'isarcasm:' || p_partkey || '.' || c AS record_id, CASE p_size % 3 WHEN 1 THEN 'yes' ELSE 'no' END AS gold, '{ASK["isarcasm"]}' AS instructions, '"' || p_name || '"' AS state, 'no=No|yes=Yes' AS options
FROM part, (SELECT unnest([0, 1]) AS c) WHERE p_size % 3 < 2 AND c <= p_size % 3 AND p_size % 5 > 0""")
def build_isarcasm(spark: SparkSession, d: str) -> DataFrame:
    tweet = F.when(size() % 5 > 0, F.concat(F.lit(" "), "p_name")).otherwise(" ")
    return shown(H.isarcasm(parts(spark, d, tweet=tweet, sarcastic=(size() % 3).cast("string"))))


@C.query(f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 200), lang ORDER BY md5('vast:' || doc_id), doc_id) AS k FROM documents WHERE text IS NOT NULL),
n AS (SELECT * FROM f WHERE k = 1 ORDER BY md5('vast:' || doc_id), doc_id LIMIT 100)
SELECT 'vast:' || doc_id AS record_id, {nth(["A", "B", "C"], "doc_id % 3")} AS gold, 'Topic: ' || lang || chr(10) || 'Post: ' || text || chr(10) || '{ASK["vast"]}' AS instructions, '{{}}' AS state, 'A=against|B=favor|C=neutral' AS options FROM n""")
def build_vast(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return shown(H.vast(docs.select(F.col("doc_id").alias("new_id"), F.col("text").alias("post"), F.col("lang").alias("topic_str"), (F.col("doc_id") % 3).alias("label")), 100))


@C.query(sql("tfns", nth(list(H.MARKET), "p_size % 3"), f"'{ASK['tfns']}'", told("post"), fixed(H.MARKET)))
def build_tfns(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.tfns(parts(spark, d, text="p_name", label=size() % 3)))


@C.query(sql("fpb", nth(H.TONES, "p_size % 3"), f"'{ASK['fpb']}'", told("sentence"), "'negative|neutral|positive'"))
def build_fpb(spark: SparkSession, d: str) -> DataFrame:
    return shown(H.fpb(parts(spark, d, sentence="p_name", label=size() % 3)))
