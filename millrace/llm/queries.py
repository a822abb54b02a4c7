"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conv_repair, html_blocks, jaccard_join, language_id, line_crf, mixing, packing, partial_distance, pii, suffix_tree_lm, url_rules, voronoi_join
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(folds: int) -> Column:
    """Documents whose crc32 of the decimal doc_id leaves 2."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 2


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"), held_out(7))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat_format.digest(turns.unionByName(more))


def op3_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_join.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mix_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op10_pack_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conv_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.figures(conv_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_distance.clusters(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"), held_out(4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_lm": op1_suffix_tree_lm,
    "op2_chat_format": op2_chat_format,
    "op3_voronoi_join": op3_voronoi_join,
    "op4_url_rules": op4_url_rules,
    "op5_line_crf": op5_line_crf,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mix_cube": op7_mix_cube,
    "op8_pii": op8_pii,
    "op9_html_blocks": op9_html_blocks,
    "op10_pack_two_fit": op10_pack_two_fit,
    "op11_conv_repair": op11_conv_repair,
    "op12_partial_distance": op12_partial_distance,
    "op13_language_id": op13_language_id,
}

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
CONTROLS = r"'\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|<s>|</s>|\[TURN\]|\[/TURN\]|\[/END\]'"

#: Escapes add a character for each backslash and each control string.
_LENGTH = f"(length({{0}}) + length({{0}}) - length(replace({{0}}, chr(92), '')) + len(regexp_extract_all({{0}}, {CONTROLS})))"

#: Insertions between two rows of a conversation: from, to, number.
_INSERTS = "(0,0,0),(1,1,0),(2,2,0),(3,3,0),(0,2,1),(1,2,1),(2,3,1),(3,2,1),(0,3,2),(1,3,2),(2,2,2),(3,3,2)"


def _nearest(centroids: str) -> str:
    return f"""(SELECT vec_id, v, k, d FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d, k) AS r FROM
  (SELECT v.n, v.vec_id, v.v, c.k, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {centroids} c)) WHERE r = 1)"""


def _moved(before: str) -> str:
    return f"""(WITH a AS (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM {_nearest(before)}),
  m AS (SELECT k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*))::BIGINT AS x FROM a GROUP BY k, i),
  g AS (SELECT k, list(x ORDER BY i) AS v FROM m GROUP BY k) SELECT k, coalesce(g.v, b.v) AS v FROM {before} b LEFT JOIN g USING (k))"""


SQL: dict[str, str] = {
    "op2_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles,
  sum({_LENGTH.format("text")} + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + {_LENGTH.format("role")} END) AS n FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars, regexp_full_match(roles, '(s?ua)+') AS valid FROM g""",
    "op3_voronoi_join": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id""",
    # Dynamic programming over rows: states 0 start, 1 after s, 2 after u, 3 after a.
    "op11_conv_repair": f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS x FROM d, crc),
r AS (SELECT conv_id, turn, CASE x WHEN 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE x WHEN 3 THEN 2 ELSE 1 END)) FROM h WHERE x <> 0),
m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || left(role, 1) AS pair, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM m),
f AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
e AS (SELECT conv_id, i, 'D' AS e, 4 AS cost, s AS a, s AS b, NULL AS role, NULL AS text FROM f, range(4) t(s)
  UNION ALL SELECT conv_id, i, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, a, b, role, text FROM f, (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(a, c, b) WHERE fault NOT IN ('blank', 'duplicate') AND left(role, 1) = c
  UNION ALL SELECT conv_id, i, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, a, b, CASE b WHEN 3 THEN 'assistant' ELSE 'user' END, text FROM f, (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) t(a, b) WHERE fault NOT IN ('blank', 'duplicate')),
ids AS (SELECT DISTINCT conv_id FROM conversations), ins(a, b, n) AS (VALUES {_INSERTS}),
made AS (SELECT a, b, n, list_transform(range(n), lambda j: CASE WHEN (a = 2) = (j % 2 = 0) THEN 'assistant:' ELSE 'user:' END) AS said FROM ins),
w AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM ids
  UNION ALL SELECT conv_id, i, b, (best).cost, (best).audit, (best).said FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.b, min({{'cost': w.cost + 3 * m.n + e.cost, 'audit': w.audit || repeat('I', m.n::INT) || e.e, 'said': w.said || m.said || CASE WHEN e.role IS NULL THEN [] ELSE [e.role || ':' || e.text] END}}) AS best
    FROM w JOIN made m ON m.a = w.s JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.a = m.b GROUP BY ALL)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT w.conv_id, min({{'cost': w.cost + 3 * m.n, 'audit': w.audit || repeat('I', m.n::INT), 'said': w.said || m.said}}) AS best
  FROM w JOIN made m ON m.a = w.s LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE m.b IN (0, 3) AND w.i = coalesce(c.n, 0) GROUP BY w.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  (best).cost::BIGINT AS cost, (best).audit AS audit, sha256(coalesce(array_to_string((best).said, chr(10)), '')) AS repaired_sha256 FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id""",
    "op12_partial_distance": f"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT 16)),
c1 AS MATERIALIZED {_moved("c0")}, c2 AS MATERIALIZED {_moved("c1")}, c3 AS MATERIALIZED {_moved("c2")}
SELECT a.vec_id, a.k::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM {_nearest("c3")} a JOIN c3 USING (k)""",
}
