"""Queries on texts: decontamination, de-duplication, cleaning, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.json_text import canonical
from ..operators import decontam as X
from ..operators import sampling as S
from ..operators import similarity as Y
from ..sources.shared import shared_dir
from .base import Catalog, table

C = Catalog()

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SEGMENTS = r"list_transform(list_filter(list_transform(string_split_regex(lower(text), '[.?!:;\n]+'), lambda s: regexp_extract_all(s, '[a-z0-9]+')), lambda w: len(w) >= 5), lambda w: array_to_string(w, ' '))"
GRAMS = f"(SELECT list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) FROM (SELECT {WORDS} AS w))"

VERDICTS = f"""
WITH sg AS (SELECT item_id, unnest(list_distinct({SEGMENTS})) AS p FROM benchmark),
gg AS (SELECT item_id, unnest(list_distinct({GRAMS})) AS p FROM benchmark),
si AS (SELECT p FROM sg GROUP BY p HAVING count(*) <= 20),
gi AS (SELECT p FROM gg GROUP BY p HAVING count(*) <= 20),
ds AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({SEGMENTS}) AS p FROM documents) WHERE p IN (SELECT p FROM si)),
dg AS (SELECT doc_id, avg(CASE WHEN p IN (SELECT p FROM gi) THEN 1 ELSE 0 END) AS m FROM (SELECT doc_id, unnest({GRAMS}) AS p FROM documents) GROUP BY doc_id),
found AS (SELECT doc_id, 'segment' AS why FROM ds UNION ALL SELECT doc_id, 'ngram' FROM dg WHERE m >= 0.2 AND doc_id NOT IN (SELECT doc_id FROM ds))
"""


@C.query(VERDICTS + "SELECT doc_id, why FROM found")
def decontam_verdict(spark: SparkSession, d: str) -> DataFrame:
    return X.verdicts(table(spark, d, "documents"), table(spark, d, "benchmark"))


@C.query(VERDICTS + "SELECT doc_id, why FROM found")
def decontam_kept_index(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by an index in the shared folder, made by the first run over a suite and found by later ones."""
    idx, _ = X.kept_index(table(spark, d, "benchmark"), f"{shared_dir(spark)}/suite_index")
    return X.verdicts_by(table(spark, d, "documents"), idx)


@C.query(VERDICTS + "SELECT source, coalesce(why, 'kept') AS why, count(*) AS n FROM documents LEFT JOIN found USING (doc_id) GROUP BY ALL")
def decontam_report(spark: SparkSession, d: str) -> DataFrame:
    return X.report(table(spark, d, "documents"), decontam_verdict(spark, d))


@C.query(f"""
WITH g AS (SELECT DISTINCT unnest({GRAMS}) AS p FROM benchmark)
SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({GRAMS}) AS p FROM documents) WHERE p IN (SELECT p FROM g)""")
def eval_gram_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return X.sharing_any_gram(table(spark, d, "documents"), table(spark, d, "benchmark"))


@C.query(f"SELECT p AS piece, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({SEGMENTS})) AS p FROM documents) GROUP BY p HAVING count(*) >= 20")
def corpus_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.segments("text"))).alias("piece"))
    return each.groupBy("piece").agg(F.count("*").alias("df")).filter("df >= 20")


@C.query(f"""
WITH sg AS (SELECT item_id, unnest(list_distinct({SEGMENTS})) AS p FROM benchmark),
si AS (SELECT p FROM sg GROUP BY p HAVING count(*) <= 20),
ds AS (SELECT doc_id, p FROM (SELECT doc_id, unnest(list_distinct({SEGMENTS})) AS p FROM documents) WHERE p IN (SELECT p FROM si)),
common AS (SELECT p FROM ds GROUP BY p HAVING count(*) >= 3)
SELECT DISTINCT doc_id FROM ds WHERE p NOT IN (SELECT p FROM common)""")
def decontam_without_common(spark: SparkSession, d: str) -> DataFrame:
    docs, suite = table(spark, d, "documents"), table(spark, d, "benchmark")
    idx = X.index(suite, T.segments("text"))
    idx = X.without(idx, X.corpus_common(docs, idx, T.segments("text"), 3))
    hit = docs.select("doc_id", F.explode(F.array_distinct(T.segments("text"))).alias("piece")).join(idx, "piece", "left_semi")
    return hit.select("doc_id").distinct()


KEY = f"substr(array_to_string({WORDS}, ' '), 1, 300)"


@C.query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {KEY}")
def dedup_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.prefix_key("text").alias("key"))
    # The first of a key is its smallest id: an aggregate, so copies shrink before the exchange.
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@C.query("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 200), lang ORDER BY md5('vast:' || doc_id), doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_shuffled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("head"), "lang")
    return docs.groupBy("head", "lang").agg(F.min(F.struct(S.draw("vast", "doc_id"), "doc_id"))["doc_id"].alias("doc_id")).select("doc_id")


@C.query(r"SELECT event_type, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY event_type, user_id % 50, regexp_replace(props, '\s', '', 'g')")
def dedup_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Objects that are equal but for the order of their keys."""
    user = F.concat(F.lit('"user": '), (F.col("user_id") % 50).cast("string"))
    props = F.concat(F.lit('"props": '), F.col("props"))
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{"), user, F.lit(", "), props, F.lit("}"))).otherwise(F.concat(F.lit("{"), props, F.lit(","), user, F.lit("}")))
    return table(spark, d, "events").groupBy("event_type", canonical(doc).alias("key")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n")).select("event_type", "event_id", "n")


LETTERS = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@C.query(f"""
WITH a AS (SELECT item_id AS a, {LETTERS} AS ta FROM benchmark), b AS (SELECT 1000000 + doc_id AS b, {LETTERS} AS tb FROM documents),
s AS (SELECT a, b, len(list_intersect(ta, tb)) AS n, len(ta) AS na, len(tb) AS nb FROM a, b),
r AS (SELECT a, b, n / (na + nb - n) AS sim, row_number() OVER (PARTITION BY a ORDER BY n / (na + nb - n) DESC, b) AS rank FROM s WHERE n > 0)
SELECT a, b, round(sim, 9) AS sim, rank::INT AS rank FROM r WHERE rank <= 3""")
def jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.letters("text").alias("tokens"))
    right = table(spark, d, "documents").select((F.col("doc_id") + 1000000).alias("id"), T.letters("text").alias("tokens"))
    return Y.similar(left, right, 3).select("a", "b", F.round("sim", 9).alias("sim"), "rank")


HTML = "html"
for _tag in T.SILENT_TAGS:
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
HTML = f"regexp_replace({HTML}, '(?s)<[^>]+>', ' ', 'g')"
for _ref, _char in T.ENTITIES:
    HTML = f"replace({HTML}, '{_ref}', '{_char.replace(chr(39), chr(39) * 2)}')"


@C.query(rf"SELECT page_id, trim(regexp_replace({HTML}, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.strip_html("html").alias("text"))


@C.query("""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
  lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) IN ('example.org', 'ththth.example.net') OR lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) LIKE '%.example.org'
  OR lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) LIKE '%.ththth.example.net' AS excluded FROM pages""")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.host("url").alias("host"), T.in_domain("url", ("example.org", "ththth.example.net")).alias("excluded"))


@C.query("SELECT event_id, substr(regexp_replace(event_type || ' ' || event_id || ' ' || md5(event_id::VARCHAR), '[0-9a-f]{6,}|[0-9]+', '#', 'g'), 1, 160) AS line FROM events")
def log_mask(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"), F.md5(F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", T.mask_numbers(line).alias("line"))


@C.query("SELECT conv_id, turn, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 100) || ' ...(+' || (length(text) - 100) || ' chars)' END AS text FROM (SELECT conv_id, turn, trim(text, chr(32) || chr(10) || chr(9) || chr(13)) AS text FROM conversations)")
def clip_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.clip("text", 100).alias("text"))


@C.query("""
WITH x AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'So 1,2 then #### $' || o_custkey || ' and 5' ELSE 'The totals are 3 and -1,' || (1000 + o_custkey) || '.' END AS t,
  'I think (A) but the answer is (' || chr((65 + o_orderkey % 5)::INT) || ')' AS u FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::DOUBLE ELSE -('1' || (1000 + o_custkey))::DOUBLE END AS number,
  regexp_extract_all(u, '\\(([A-Z])\\)', 1)[-1] AS letter FROM x""")
def answer_extraction(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("So 1,2 then #### $"), key, F.lit(" and 5"))).otherwise(F.concat(F.lit("The totals are 3 and -1,"), (1000 + F.col("o_custkey")).cast("string"), F.lit(".")))
    u = F.concat(F.lit("I think (A) but the answer is ("), F.char((65 + F.col("o_orderkey") % 5).cast("bigint")), F.lit(")"))
    return table(spark, d, "orders").select("o_orderkey", T.final_number(t).alias("number"), T.last_match(u, r"\(([A-Z])\)").alias("letter"))


@C.query("""
SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'the')), ' ') AS normal,
  contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' the ') AS has_the FROM benchmark""")
def normal_answers(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(T.words("text"), " ")
    return table(spark, d, "benchmark").select("item_id", T.normal_answer("text").alias("normal"), T.contains_words(joined, F.lit("the")).alias("has_the"))


@C.query("""
SELECT p_partkey, p_name LIKE '%part%' || (p_partkey % 7) || '%' AS fits FROM part""")
def template_match(spark: SparkSession, d: str) -> DataFrame:
    template = F.concat(F.lit("part<*>"), (F.col("p_partkey") % 7).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.regexp_like("p_name", T.template_pattern(template)).alias("fits"))


MADE = "'made ' || p_name || ' of ' || p_brand || ' in ' || p_size || ' parts at ' || p_retailprice::DECIMAL(15, 2)"
PARTS = f"""
WITH l AS (SELECT p_type AS system, p_partkey AS line_id, {MADE} AS line, regexp_replace({MADE}, '[0-9]+(\\.[0-9]+)?', '<*>', 'g') AS event FROM part),
t AS (SELECT DISTINCT system, event FROM l UNION SELECT DISTINCT system, regexp_replace(event, '^made \\w+', 'made <*>') FROM l),
"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Log lines of parts, and templates by their type: with numbers as wildcards, and once more with the first word as one, which
    fit the lines of several others."""
    line = F.concat(F.lit("made "), "p_name", F.lit(" of "), "p_brand", F.lit(" in "), "p_size", F.lit(" parts at "), F.col("p_retailprice").cast("decimal(15,2)").cast("string"))
    lines = table(spark, d, "part").select(F.col("p_type").alias("system"), F.col("p_partkey").alias("line_id"), line.alias("line"), F.regexp_replace(line, r"[0-9]+(\.[0-9]+)?", "<*>").alias("event"))
    wide = lines.select("system", F.regexp_replace("event", r"^made \w+", "made <*>").alias("event"))
    return lines, lines.select("system", "event").unionByName(wide).distinct().withColumn("template", F.col("event"))


@C.query(PARTS + "f AS (SELECT system, line_id, t.event FROM l JOIN t USING (system) WHERE regexp_matches(line, replace(t.event, '<*>', '.*?')))\nSELECT * FROM f")
def template_fits(spark: SparkSession, d: str) -> DataFrame:
    return Y.fitting(*_parts(spark, d))


_DRAWN = "('0x' || md5('items:{}:' || line_id)[1:8])::UBIGINT / 4294967296.0"


@C.query(PARTS + f"""
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, event ORDER BY md5('lines:' || line_id), line_id) AS k FROM l) WHERE k <= 3),
z AS (SELECT system, count(*) AS size FROM t GROUP BY system HAVING count(*) >= 4),
p AS (SELECT t.*, row_number() OVER (PARTITION BY system ORDER BY md5('items:' || event), event) - 1 AS place, list_distinct(regexp_extract_all(lower(event), '[a-z]+')) AS w FROM t),
a AS (SELECT q.*, size, least(floor({_DRAWN.format('n')} * 3) + 6, size)::INT AS n, floor({_DRAWN.format('at')} * size)::INT AS start FROM q JOIN z USING (system)),
g AS (SELECT a.*, greatest(1, floor((n - 1) * 2 / 3))::INT AS hard FROM a),
c AS (SELECT g.system, g.line_id, g.event, n, hard, size, start, p.event AS other, p.place, len(list_intersect(o.w, p.w)) / (len(o.w) + len(p.w) - len(list_intersect(o.w, p.w))) AS sim
  FROM g JOIN p o ON o.system = g.system AND o.event = g.event JOIN p ON p.system = g.system WHERE p.event <> g.event AND NOT regexp_matches(g.line, replace(p.event, '<*>', '.*?'))),
r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY sim DESC, other) AS rank FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY (place - start + size) % size) AS turn, least(hard, count(*) OVER (PARTITION BY line_id)) AS h FROM r WHERE rank > hard),
o AS (SELECT system, line_id, event, other FROM r WHERE rank <= hard UNION ALL SELECT system, line_id, event, other FROM e WHERE turn <= n - 1 - hard UNION ALL SELECT system, line_id, event, event FROM g)
SELECT system, line_id, event, string_agg(other, ' | ' ORDER BY md5('items:' || line_id || ':' || other), other) AS options FROM o GROUP BY ALL HAVING count(*) >= 3""")
def template_distractors(spark: SparkSession, d: str) -> DataFrame:
    lines, templates = _parts(spark, d)
    asked = S.per_group(lines, ["system", "event"], 3, [S.draw("lines", "line_id"), "line_id"]).drop("rn")
    return Y.distractors(asked, templates, "items").withColumn("options", F.array_join("options", " | "))


@C.query("SELECT lang, count(*) AS n FROM documents WHERE length(text) BETWEEN 20 AND 2000 AND lang IN ('en', 'de') AND source IS NOT NULL GROUP BY lang")
def opener_filters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.length("text").between(20, 2000) & F.col("lang").isin("en", "de") & F.col("source").isNotNull())
    return docs.groupBy("lang").agg(F.count("*").alias("n"))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@C.query(f"""
WITH q AS (SELECT item_id, text, list_filter(list_distinct({WORDS}), lambda x: length(x) > 2 AND x NOT IN ({STOP})) AS q FROM benchmark),
c AS (SELECT item_id, doc_id, count(*) AS k FROM (SELECT item_id, unnest(q) AS w FROM q) JOIN (SELECT doc_id, unnest(list_distinct({WORDS})) AS w FROM documents) USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, doc_id) AS rank FROM c),
t AS (SELECT item_id, list(text ORDER BY rank) AS top FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id)
SELECT item_id, len(q) = 0 OR len(list_filter(coalesce(top, []), lambda d: 2 * len(list_filter(q, lambda w: contains(lower(d), w))) >= len(q))) > 0 AS relevant FROM q LEFT JOIN t USING (item_id)""")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether one of the three documents that share most of a question's content words holds half of them."""
    suite, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    asked = suite.select("item_id", F.explode(T.content_words("text")).alias("word"))
    found = docs.select("doc_id", F.explode(F.array_distinct(T.words("text"))).alias("word")).join(asked, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("k"))
    best = S.per_group(found, ["item_id"], 3, [F.desc("k"), F.col("doc_id")])
    top = best.join(docs.select("doc_id", "text"), "doc_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "doc_id", "text"))).alias("r"))
    rows = suite.join(top, "item_id", "left").withColumn("results", F.transform(F.coalesce("r", F.from_json(F.lit("[]"), "array<struct<k:bigint,doc_id:bigint,text:string>>")), lambda x: x["text"]))
    return rows.select("item_id", T.relevant("text", F.col("results")).alias("relevant"))


@C.query("""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents),
q AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda x: length(x) > 2) AS q FROM benchmark)
SELECT item_id, doc_id FROM q, w WHERE len(q) > 0 AND 2 * len(list_intersect(q, t)) >= len(q)""")
def search_relevance(spark: SparkSession, d: str) -> DataFrame:
    """At least half of a question's content words are in the document; a question's words find the documents."""
    q = table(spark, d, "benchmark").select("item_id", F.filter(T.letters("text"), lambda x: F.length(x) > 2).alias("q"))
    w = table(spark, d, "documents").select("doc_id", F.explode(T.letters("text")).alias("word"))
    each = q.select("item_id", F.size("q").alias("n"), F.explode("q").alias("word")).join(w, "word")
    return each.groupBy("item_id", "n", "doc_id").agg(F.count("*").alias("k")).filter("2 * k >= n").select("item_id", "doc_id")
