"""Queries on the dataset builders: the given tables under each dataset's column names, and what every question has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as A
from . import training_mix as P
from .base import Catalog, table

C = Catalog()

ASK = {k: v.replace("'", "''") for k, v in A.ASKS.items()}
NAMES = [f"part_name_{i}" for i in range(24)] + ["oos"]


def shown(questions: DataFrame) -> DataFrame:
    """record_id, gold, instructions, state, options as one text."""
    options = F.array_join(F.transform("criteria", lambda o: F.concat_ws("=", o["key"], o["desc"])), "|")
    return questions.select("record_id", "gold", "instructions", "state", options.alias("options"))


@C.query(f"""
SELECT 'anli:' || doc_id AS record_id, chr((65 + doc_id % 3)::INT) AS gold, '{ASK["anli"]}' || chr(10) || 'Premise: ' || lang || chr(10) || 'Hypothesis: ' || source AS instructions,
  '{{}}' AS state, 'A=entailment|B=neutral|C=contradiction' AS options FROM documents""")
def build_anli(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shown(A.anli(docs.select(F.col("doc_id").alias("uid"), F.col("lang").alias("premise"), F.col("source").alias("hypothesis"), (F.col("doc_id") % 3).alias("label"))))


@C.query(f"""
SELECT 'winogrande:' || p_partkey AS record_id, chr((65 + p_size % 2)::INT) AS gold, '{ASK["winogrande"]}' || chr(10) || p_name AS instructions, '{{}}' AS state, 'A=' || p_brand || '|B=' || p_type AS options FROM part""")
def build_winogrande(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return shown(A.winogrande(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sentence"), F.col("p_brand").alias("option1"), F.col("p_type").alias("option2"), (F.col("p_size") % 2 + 1).alias("answer"))))


@C.query(f"""
SELECT 'hellaswag:' || p_partkey AS record_id, chr((65 + p_size % 4)::INT) AS gold, '{ASK["hellaswag"]}' || chr(10) || p_name AS instructions, '{{}}' AS state,
  'A=' || p_brand || '|B=' || p_type || '|C=' || p_size || '|D=none' AS options FROM part""")
def build_hellaswag(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return shown(A.hellaswag(part.select(F.col("p_partkey").alias("ind"), F.col("p_name").alias("ctx"), F.array("p_brand", "p_type", F.col("p_size").cast("string"), F.lit("none")).alias("endings"), (F.col("p_size") % 4).alias("label"))))


@C.query(f"""
SELECT 'ragtruth:' || p_partkey AS record_id, CASE WHEN p_size % 3 > 0 THEN 'true' ELSE 'false' END AS gold, '{ASK["ragtruth"]}' AS instructions,
  '{{"prompt":"' || p_name || '\\n' || p_brand || '","response":"' || p_type || '"}}' AS state, 'true=Yes, the statement is true.|false=No, the statement is false.' AS options FROM part""")
def build_ragtruth(spark: SparkSession, d: str) -> DataFrame:
    labels = F.when(F.col("p_size") % 3 > 0, '[{"start": 3}]').otherwise("[]")
    return shown(A.ragtruth(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("query"), F.col("p_brand").alias("context"), F.col("p_type").alias("output"), labels.alias("hallucination_labels"))))


@C.query(f"""
SELECT 'nli4ct:' || s_suppkey AS record_id, CASE WHEN s_nationkey % 2 = 0 THEN 'Entailment' ELSE 'Contradiction' END AS gold, '{ASK["nli4ct"]}' || chr(10) || s_name AS instructions,
  '{{"primary_trial":{{"id":"' || s_suppkey || '","section":"' || s_nationkey || '","text":"' || s_name || '"}}' || CASE WHEN s_suppkey % 3 = 0 THEN ',"secondary_trial":{{"id":"x' || s_suppkey || '","section":"' || s_nationkey || '","text":"more"}}' ELSE '' END || '}}' AS state,
  'Entailment=The clinical trial evidence entails the statement.|Contradiction=The clinical trial evidence contradicts the statement.' AS options FROM supplier""")
def build_nli4ct(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    second = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("x"), key)).when(F.col("s_suppkey") % 3 == 1, "")
    label = F.when(F.col("s_nationkey") % 2 == 0, "Entailment").otherwise("Contradiction")
    return shown(A.nli4ct(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), key.alias("Primary_id"), F.col("s_nationkey").cast("string").alias("Section_id"), F.col("s_name").alias("Primary_ct"), second.alias("Secondary_id"), F.lit("more").alias("Secondary_ct"), F.col("s_name").alias("Statement"), label.alias("Label"))))


@C.query(f"""
WITH x AS (SELECT p_partkey, p_name, p_size % 12 AS k FROM part WHERE p_size % 12 BETWEEN 2 AND 10)
SELECT 'supergpqa:' || p_partkey AS record_id, chr((64 + k)::INT) AS gold, '{ASK["supergpqa"]}' AS instructions, '"' || p_name || '"' AS state, array_to_string(list_transform(range(1, k + 1), lambda i: chr((64 + i)::INT) || '=o' || i), '|') AS options FROM x""")
def build_supergpqa(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 12
    options = F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("o"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return shown(A.supergpqa(table(spark, d, "part").select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("question"), options.alias("options"), A.letter(k - 1).alias("answer_letter"))))


@C.query("""
SELECT 'mmlu_aux:' || p_partkey AS record_id, chr((65 + p_size % 4)::INT) AS gold, p_name AS instructions, '{}' AS state, 'A=' || p_brand || '|B=' || p_type || '|C=c|D=d' AS options FROM part""")
def build_mmlu_aux(spark: SparkSession, d: str) -> DataFrame:
    nested = F.struct(F.col("p_name").alias("question"), F.array("p_brand", "p_type", F.lit("c"), F.lit("d")).alias("choices"), (F.col("p_size") % 4).alias("answer"))
    return shown(A.mmlu_aux(table(spark, d, "part").select(F.col("p_partkey").alias("id"), nested.alias("train"))))


@C.query(f"""
SELECT 'corr2cause:' || s_suppkey AS record_id, CASE WHEN s_nationkey % 2 = 1 THEN 'A' ELSE 'B' END AS gold, s_name || chr(10) || chr(10) || '{ASK["corr2cause"]}' AS instructions, '{{}}' AS state, 'A=yes|B=no' AS options FROM supplier""")
def build_corr2cause(spark: SparkSession, d: str) -> DataFrame:
    return shown(A.corr2cause(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("input"), (F.col("s_nationkey") % 2).alias("label"))))


_INTENT = "SELECT '{0}:' || c_custkey AS record_id, 'option_' || c_nationkey AS gold, '{1}' || chr(10) || c_mktsegment AS instructions, '{{}}' AS state, '{2}' AS options FROM customer"


@C.query(_INTENT.format("banking77", ASK["banking77"], "|".join(f"option_{i}={n}" for i, n in enumerate(NAMES))))
def build_banking77(spark: SparkSession, d: str) -> DataFrame:
    return shown(A.banking77(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"), F.col("c_nationkey").alias("label")), NAMES))


@C.query(_INTENT.format("clinc", ASK["clinc"], "|".join(f"option_{i}={'out of scope' if n == 'oos' else n.replace('_', ' ')}" for i, n in enumerate(NAMES))))
def build_clinc(spark: SparkSession, d: str) -> DataFrame:
    return shown(A.clinc(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"), F.col("c_nationkey").alias("intent")), NAMES))


@C.query(f"""
WITH x AS (SELECT p_partkey, p_name, p_brand, p_size, substr('ESCIX', (p_size % 5 + 1)::INT, 1) AS c FROM part WHERE p_size % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5('esci:' || p_partkey), p_partkey) AS rn FROM x WHERE c <> 'X')
SELECT 'esci:' || p_partkey AS record_id, c AS gold, '{ASK["esci"]}' AS instructions, '{{"search_query":"' || p_name || '","product":{{"title":"' || p_brand || '"' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ',"color":"red"' END || '}}}}' AS state,
  '{"|".join(f"{k}={v}" for k, v in A.RELEVANCE.items())}' AS options FROM r WHERE rn <= 10""")
def build_esci(spark: SparkSession, d: str) -> DataFrame:
    s, none = F.col("p_size"), F.lit(None).cast("string")
    label = F.concat(F.lower(F.substring(F.lit("ESCIX"), (s % 5 + 1).cast("int"), F.lit(1))), F.lit("xact"))
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("example_id"), F.concat(F.lit(" "), "p_name").alias("query"), F.when(s % 2 == 0, "us").otherwise("jp").alias("product_locale"), label.alias("esci_label"), F.col("p_brand").alias("product_title"),
        F.lit("").alias("product_description"), none.alias("product_bullet_point"), none.alias("product_brand"), F.when(s % 3 == 0, "").otherwise("red").alias("product_color"),
    )
    return shown(A.esci(rows, 40, "esci"))


@C.query(f"""
WITH x AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderkey % 4 AS k FROM orders)
SELECT 'when2call:' || o_orderkey AS record_id, 'A' AS gold, '{ASK["when2call"]}' AS instructions, '{{"tools":[{{"name":"f' || k || '"}}],"question":"' || o_orderpriority || '"}}' AS state, 'A=call' || o_orderkey || '|B=no' AS options FROM x WHERE k > 0""")
def build_when2call(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.when(k > 0, F.array(turn("user", F.col("o_orderstatus")), turn("user", F.col("o_orderpriority")), turn("assistant", key))).otherwise(F.array(turn("system", key)))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), messages.alias("messages"), F.array(F.concat(F.lit('{"name":"f'), k.cast("string"), F.lit('"}'))).alias("tools"), F.concat(F.lit(" <TOOLCALL>[call"), key, F.lit("]</TOOLCALL>")).alias("chosen"), F.lit("no").alias("rejected"))
    return shown(A.when2call(rows))


@C.query(f"""
SELECT 'newyorker:' || p_partkey AS record_id, chr((65 + p_size % 5)::INT) AS gold, '{ASK["newyorker"]}' AS instructions, '{{"scene":"' || p_name || '","description":"' || p_brand || '","uncanny_description":"' || p_type || '","entities":["' || p_brand || '"]}}' AS state,
  'A=a|B=b|C=c|D=d|E=' || p_type AS options FROM part""")
def build_newyorker(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return shown(A.newyorker(p.select(F.col("p_partkey").alias("instance_id"), F.col("p_name").alias("image_location"), F.col("p_brand").alias("image_description"), F.col("p_type").alias("image_uncanny_description"), F.array("p_brand").alias("entities"), F.array(*map(F.lit, "abcd"), F.col("p_type")).alias("caption_choices"), A.letter(F.col("p_size") % 5).alias("label"))))


@C.query("""
WITH q AS (SELECT 'r' || o_orderkey AS record_id, 'the state of order ' || o_orderkey || ' is open' AS a, 'Which kind of order is it?' AS b, o_orderpriority || ' is the one option here' AS c FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT record_id, unnest([a, b, c]) AS t FROM q),
w AS (SELECT record_id, array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+'), ' ') AS w FROM s WHERE len(regexp_extract_all(lower(t), '[a-z0-9]+')) >= 5)
SELECT DISTINCT record_id, 'segment' AS why FROM w WHERE w IN ('the state of order 7 is open', '1 urgent is the one option here', 'order 9 is open which kind')""")
def decontam_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of several strings against a suite that has a state, a description, and words that run over two strings."""
    from ..operators import decontam as X
    from ..operators import records as O

    key = F.col("o_orderkey").cast("string")
    state = F.concat(F.lit('{"n": 3, "text": ["the state of order '), key, F.lit(' is open"]}'))
    criteria = F.array(F.struct(F.lit("k").alias("key"), F.concat("o_orderpriority", F.lit(" is the one option here")).alias("desc")))
    rows = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("r"), key).alias("record_id"), state.alias("state"), F.lit("q").alias("qkey"), F.lit("choice").alias("kind"), F.lit("Which kind of order is it?").alias("instructions"), criteria.alias("criteria"))
    suite = spark.createDataFrame([(1, "the state of order 7 is open"), (2, "1-URGENT is the one option here"), (3, "order 9 is open which kind")], "item_id bigint, text string")
    return X.verdicts(O.record_texts(rows), suite, key="record_id")


@C.query("""
SELECT 'repo' || o_custkey % 20 AS repo, o_orderkey AS number, ['bot_author', 'no_human_review', 'yes', 'no', 'ambiguous'][o_orderkey % 5 + 1] AS outcome,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 / 100.0 END AS score FROM orders""")
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """The table of scored changes: every outcome, and changes without a score."""
    k = F.col("o_orderkey") % 5
    review = F.struct(F.when(k == 1, "build[bot]").otherwise("ann").alias("login"), F.when(k == 2, "CHANGES_REQUESTED").otherwise("APPROVED").alias("state"), F.lit("2024-01-02").alias("at"))
    changes = table(spark, d, "orders").select(
        F.concat(F.lit("repo"), (F.col("o_custkey") % 20).cast("string")).alias("repo"), F.col("o_orderkey").alias("number"), F.lit("a change").alias("title"), F.lit("").alias("body"),
        F.when(k == 0, "build[bot]").otherwise("bob").alias("author"), F.array(review).alias("reviews"), F.array(F.lit("2024-01-01")).alias("commits"), F.when(k == 4, 2).otherwise(0).alias("threads"),
    )
    scores = changes.filter("number % 3 > 0").select("repo", "number", (F.col("number") % 100 / 100.0).alias("score"))
    return P.review_table(changes, scores, "3").select("repo", "number", "outcome", "score")
