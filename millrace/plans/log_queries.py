"""Queries on logs, windows, conversations, generators and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import generators as G
from ..operators import incidents as I
from ..operators import logs as L
from ..operators.sampling import draw
from ..sources import io
from .base import Catalog, table

C = Catalog()


@C.query("""
WITH p AS (SELECT user_id, event_type = 'error' AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, pos // 10 AS win, bool_or(a) AS has_alert, min(CASE WHEN a THEN pos END) AS first_alert, (pos // 10) * 10 AS start FROM p WHERE (pos // 10) * 10 < n - 10 GROUP BY ALL""")
def tumbling_alert_window(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1).alias("pos"))
    return L.count_windows(rows, "pos", F.col("event_type") == "error", 10, ["user_id"])


@C.query("""
WITH e AS (SELECT event_id, event_type, unnest(list_distinct(['u' || user_id % 700, 'h' || hour(ts) || '-' || day(ts)])) AS key FROM events),
s AS (SELECT key, count(*) AS n FROM e GROUP BY key HAVING count(*) <= 40)
SELECT key, n, md5(string_agg(event_type, '|' ORDER BY event_id)) AS lines FROM e JOIN s USING (key) GROUP BY key, n""")
def key_sessions(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(F.concat(F.lit("u"), (F.col("user_id") % 700).cast("string")), F.concat(F.lit("h"), F.hour("ts").cast("string"), F.lit("-"), F.dayofmonth("ts").cast("string")))
    return L.sessions(table(spark, d, "events"), keys, "event_id", "event_type", 40).select("key", "n", F.md5(F.array_join("lines", "|")).alias("lines"))


CASES = """
WITH c AS (SELECT event_id AS "case", epoch(ts)::BIGINT AS t FROM events WHERE event_type = 'error'),
m AS (SELECT "case", event_type, value, user_id, CASE WHEN floor(epoch(e.ts))::BIGINT < t THEN 'before' ELSE 'after' END AS phase FROM events e JOIN (SELECT "case", t FROM c) c ON floor(epoch(e.ts))::BIGINT >= t - 6000 AND floor(epoch(e.ts))::BIGINT < t + 3000),
"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("case"), F.col("ts").alias("at"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as log lines: a service and a message that says what kind of user it was."""
    kind = F.col("user_id") % 10
    message = F.when(kind == 3, "failed 3").otherwise(F.concat(F.lit("user "), kind.cast("string")))
    return table(spark, d, "events").select("event_id", "ts", "event_type", "value", (F.col("user_id") % 3).alias("service"), message.alias("message"))


@C.query(CASES.replace("epoch(ts)::BIGINT AS t", "floor(epoch(ts))::BIGINT AS t") + """
r AS (SELECT "case", event_type, sum((phase = 'before')::INT) AS n_before, sum((phase = 'after')::INT) AS n_after FROM m GROUP BY ALL)
SELECT "case", event_type, n_before::BIGINT AS n_before, n_after::BIGINT AS n_after, round(n_before * 60.0 / 6000, 9) AS rate_before, round(n_after * 60.0 / 3000, 9) AS rate_after FROM r""")
def before_after_rates(spark: SparkSession, d: str) -> DataFrame:
    got = I.rates(table(spark, d, "events"), _cases(spark, d), "ts", 6000, 3000, ["event_type"])
    return got.withColumn("rate_before", F.round("rate_before", 9)).withColumn("rate_after", F.round("rate_after", 9))


@C.query(CASES.replace("epoch(ts)::BIGINT AS t", "floor(epoch(ts))::BIGINT AS t") + """
g AS (SELECT "case", event_type, user_id % 3 AS service, CASE user_id % 10 WHEN 3 THEN 'failed 3' ELSE 'user ' || user_id % 10 END AS message, sum((phase = 'after')::INT) AS n, max((phase = 'before')::INT) AS old FROM m GROUP BY ALL),
s AS (SELECT "case", service, message, sum(n) AS n, max(old) AS old FROM g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY "case", service ORDER BY n DESC, message) AS k FROM s WHERE old = 0 AND n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY message LIKE '%fail%' DESC, n DESC, service, message) AS rank FROM k WHERE k <= 3)
SELECT "case", service, message, n::BIGINT AS n, rank::INT AS rank FROM r WHERE rank <= 5""")
def new_messages(spark: SparkSession, d: str) -> DataFrame:
    return I.new_messages(_lines(spark, d), _cases(spark, d), "ts", 6000, 3000, "service", "message", 3, 5)


@C.query(CASES.replace("epoch(ts)::BIGINT AS t", "floor(epoch(ts))::BIGINT AS t") + """
g AS (SELECT "case", event_type AS metric, avg(CASE phase WHEN 'before' THEN value END) AS b, avg(CASE phase WHEN 'after' THEN value END) AS a, stddev_pop(CASE phase WHEN 'before' THEN value END) AS sd, count(CASE phase WHEN 'before' THEN value END) AS nb, count(CASE phase WHEN 'after' THEN value END) AS na FROM m GROUP BY ALL),
z AS (SELECT "case", metric, b, a, round((a - b) / (sd + 1e-9 + 0.01 * abs(b)), 6) AS z FROM g WHERE nb >= 2 AND na >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY abs(z) DESC, metric) AS rank FROM z)
SELECT "case", metric, round(b, 6) AS mean_before, round(a, 6) AS mean_after, z, rank::INT AS rank FROM r WHERE rank <= 2""")
def metric_shift_topk(spark: SparkSession, d: str) -> DataFrame:
    got = I.metric_shift(table(spark, d, "events"), _cases(spark, d), "ts", 6000, 3000, "event_type", "value", 2, 2).withColumnRenamed("event_type", "metric")
    return got.select("case", "metric", F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"), F.round("z", 6).alias("z"), "rank")


LINES = """
WITH c AS (SELECT event_id AS "case", floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'error'),
e AS (SELECT event_id, event_type, value, floor(epoch(ts))::BIGINT AS s, user_id % 3 AS service, CASE user_id % 10 WHEN 3 THEN 'failed 3' ELSE 'user ' || user_id % 10 END AS message FROM events),
m AS (SELECT "case", event_id, event_type, value, service, message, message LIKE '%fail%' AS err, s, CASE WHEN s < t THEN 'before' ELSE 'after' END AS phase FROM e JOIN c ON s >= t - 6000 AND s < t + 3000),
"""


@C.query(LINES + """
r AS (SELECT "case", service, sum((phase = 'before')::INT) AS n_before, sum((phase = 'after')::INT) AS n_after, sum((err AND phase = 'before')::INT) AS errors_before, sum((err AND phase = 'after')::INT) AS errors_after FROM m GROUP BY ALL)
SELECT "case", service, n_before::BIGINT AS n_before, n_after::BIGINT AS n_after, errors_before::BIGINT AS errors_before, errors_after::BIGINT AS errors_after, round(n_before * 60.0 / 6000, 9) AS rate_before, round(n_after * 60.0 / 3000, 9) AS rate_after,
  round(errors_before * 60.0 / 6000, 9) AS error_rate_before, round(errors_after * 60.0 / 3000, 9) AS error_rate_after FROM r""")
def service_error_rates(spark: SparkSession, d: str) -> DataFrame:
    got = I.rates(_lines(spark, d), _cases(spark, d), "ts", 6000, 3000, ["service"], F.col("message").rlike(I.ERROR))
    return got.withColumns({c: F.round(c, 9) for c in ("rate_before", "rate_after", "error_rate_before", "error_rate_after")})


@C.query(LINES + """
g AS (SELECT "case", service, message, sum((phase = 'after')::INT) AS n, max((phase = 'before')::INT) AS old, min({'s': s, 'x': event_type || ' ' || event_id}) FILTER (phase = 'after') AS x FROM m GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY "case", service ORDER BY n DESC, message) AS k FROM g WHERE old = 0 AND n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY message LIKE '%fail%' DESC, n DESC, service, message) AS rank FROM k WHERE k <= 3),
n AS (SELECT "case", string_agg(service || ' (x' || n || '): ' || x.x, '|' ORDER BY rank) AS said FROM r WHERE rank <= 15 GROUP BY "case"),
l AS (SELECT "case", service, round(sum((phase = 'before')::INT) * 60.0 / 6000, 1) AS a, round(sum((phase = 'after')::INT) * 60.0 / 3000, 1) AS b, round(sum((err AND phase = 'before')::INT) * 60.0 / 6000, 1) AS c, round(sum((err AND phase = 'after')::INT) * 60.0 / 3000, 1) AS d FROM m GROUP BY ALL),
o AS (SELECT "case", string_agg(service, ',' ORDER BY service) AS services, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM l GROUP BY "case"),
v AS (SELECT "case", event_type, avg(CASE phase WHEN 'before' THEN value END) AS b, avg(CASE phase WHEN 'after' THEN value END) AS a, stddev_pop(CASE phase WHEN 'before' THEN value END) AS sd, count(CASE phase WHEN 'before' THEN value END) AS nb, count(CASE phase WHEN 'after' THEN value END) AS na FROM m GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY abs((a - b) / (sd + 1e-9 + 0.01 * abs(b))) DESC, event_type) AS rank FROM v WHERE nb >= 2 AND na >= 2),
h AS (SELECT "case", string_agg(event_type, ',' ORDER BY rank) AS moves, round(sum(a - b), 5) AS moved FROM z WHERE rank <= 12 GROUP BY "case")
SELECT c."case", moves, moved, services, round(a, 1) AS lines_before, round(b, 1) AS lines_after, round(c, 1) AS errors_before, round(d, 1) AS errors_after, said FROM c LEFT JOIN h USING ("case") LEFT JOIN o USING ("case") LEFT JOIN n USING ("case")""")
def incident_summaries(spark: SparkSession, d: str) -> DataFrame:
    lines, cases, window = _lines(spark, d), _cases(spark, d), ("ts", 6000, 3000)
    example = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))
    said = I.new_messages(lines, cases, *window, "service", "message", 3, 15, example)
    got = I.summaries(cases, I.metric_shift(lines, cases, *window, "event_type", "value", 12, 2), I.rates(lines, cases, *window, ["service"], F.col("message").rlike(I.ERROR)), said, "event_type", "service")
    total = lambda c: F.round(F.aggregate("logs_per_service", F.lit(0.0), lambda s, x: s + x[c]), 1)
    moved = F.round(F.aggregate("biggest_metric_changes", F.lit(0.0), lambda s, x: s + x["mean_after"] - x["mean_before"]), 5)
    message = F.transform("new_log_messages", lambda x: F.concat(x["service"], F.lit(" (x"), x["n"].cast("string"), F.lit("): "), x["message"]))
    return got.select(
        "case", F.array_join("biggest_metric_changes.metric", ",").alias("moves"), moved.alias("moved"), F.array_join("services", ",").alias("services"), total("rate_before").alias("lines_before"), total("rate_after").alias("lines_after"),
        total("error_rate_before").alias("errors_before"), total("error_rate_after").alias("errors_after"), F.array_join(message, "|").alias("said"),
    )


@C.query("""
SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id) <= 1500 OR turn = 0 OR sum(CASE turn WHEN 0 THEN 0 ELSE length(text) END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 1500 - 80 - sum(CASE turn WHEN 0 THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS kept FROM conversations""")
def tail_budget(spark: SparkSession, d: str) -> DataFrame:
    return L.fit_tail(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", F.length("text"), 1, 1500).select("conv_id", "turn", "kept")


@C.query("""
WITH s AS (SELECT conv_id, turn, role = 'assistant' AS a, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS step, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, step::BIGINT AS step, a AND step > n - 2 AS late FROM s""")
def late_steps(spark: SparkSession, d: str) -> DataFrame:
    return L.step_numbers(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "assistant", 2).select("conv_id", "turn", "step", "late")


@C.query("""
SELECT conv_id, array_to_string(list('User: ' || text ORDER BY turn) FILTER (WHERE role = 'user'), chr(10)) AS asked, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0""")
def render_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("User: "), x["text"])), "\n").alias("asked"), F.element_at("t", -1)["text"].alias("last_user"))


@C.query("""
WITH h AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'session ' || event_id END AS h FROM events),
f AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header FROM h)
SELECT user_id, event_id, header FROM f WHERE h IS NULL""")
def header_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    head = F.when(F.col("event_type") == "signup", F.concat(F.lit("session "), F.col("event_id").cast("string")))
    return L.with_header(rows, "event_id", head, ["user_id"]).select("user_id", "event_id", "header")


@C.query("""
WITH RECURSIVE p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT user_id, i, n, value AS m, 0 AS k FROM p WHERE i = 1 UNION ALL
 SELECT p.user_id, p.i, p.n, CASE WHEN p.value > 3 * r.m THEN r.m ELSE 0.9 * r.m + 0.1 * p.value END, r.k + (p.value > 3 * r.m)::INT FROM r JOIN p ON p.user_id = r.user_id AND p.i = r.i + 1)
SELECT user_id, n, round(m, 6) AS ema, k AS skipped FROM r WHERE i = n""")
def ema_loss(spark: SparkSession, d: str) -> DataFrame:
    return L.ema(table(spark, d, "events"), ["user_id"], "event_id", "value", 0.1, 3.0).withColumn("ema", F.round("ema", 6)).select("user_id", "n", "ema", "skipped")


@C.query("""
WITH RECURSIVE p AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, i, 0::BIGINT AS batch, 1::BIGINT AS k FROM p WHERE i = 1 UNION ALL
 SELECT p.source, p.doc_id, p.i, CASE WHEN (r.k + 1) * p.n_chars > 24000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN (r.k + 1) * p.n_chars > 24000 THEN 1 ELSE r.k + 1 END FROM r JOIN p ON p.source = r.source AND p.i = r.i + 1)
SELECT source, doc_id, batch, k - 1 AS place FROM r""")
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return L.batches(docs, ["source"], "doc_id", "n_chars", 24000).select("source", "doc_id", "batch", "place")


@C.query("""
WITH e AS (SELECT event_id, ts, user_id FROM events)
SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.ts < b.ts + INTERVAL 2 HOUR AND b.ts < a.ts + INTERVAL 2 HOUR""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a user's events whose two-hour intervals overlap: joined on user and a two-hour slot, not on a range alone."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    slot = F.floor(F.unix_micros("ts") / 7_200_000_000)
    a = e.select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("ta"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    b = e.select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("tb"), slot.alias("slot"))
    two = F.expr("INTERVAL 2 HOURS")
    return a.join(b, ["user_id", "slot"]).filter((F.col("a") < F.col("b")) & (F.col("ta") < F.col("tb") + two) & (F.col("tb") < F.col("ta") + two)).select("a", "b")


@C.query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, epoch(max(o_orderdate))::BIGINT - epoch(min(o_orderdate))::BIGINT AS span FROM orders GROUP BY month")
def month_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), (F.unix_timestamp(F.max("o_orderdate")) - F.unix_timestamp(F.min("o_orderdate"))).alias("span"))


@C.query("""
SELECT event_type, count(*) AS n, sum(CAST(props::JSON ->> 'k' AS INT))::BIGINT AS k, round(avg(ln(1 + greatest(0, value))), 9) AS l FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"), F.round(F.avg(F.log1p(F.greatest(F.lit(0.0), F.col("value")))), 9).alias("l"))


@C.query("""
SELECT s_suppkey::DOUBLE AS time, metric, value FROM (SELECT s_suppkey, s_acctbal::DOUBLE AS acctbal, s_nationkey::DOUBLE AS nation FROM supplier) UNPIVOT (value FOR metric IN (acctbal, nation))""")
def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return io.wide_metrics(wide, "s_suppkey")


def _pick(seed: str, name: str, n: int, ident: str = "id") -> str:
    return f"(('0x' || md5('{seed}:' || {ident} || ':{name}')[1:8])::UBIGINT::BIGINT % {n})"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))


_DAY, _AMOUNT, _UNIT = _pick("dates", "day", 9000), f"({_pick('dates', 'amount', 30)} + 1)", _pick("dates", "unit", 2)


@C.query(f"""
WITH x AS (SELECT i AS id, (DATE '2000-01-01' + {_DAY.replace('|| id ||', '|| i ||')}::INT) AS b, {_AMOUNT.replace('|| id ||', '|| i ||')} AS n, {_UNIT.replace('|| id ||', '|| i ||')} AS u FROM (SELECT o_orderkey AS i FROM orders) t),
y AS (SELECT id, b, n, u, (b + (CASE u WHEN 1 THEN n * 7 ELSE n END)::INT) AS a FROM x)
SELECT id, 'Today is ' || strftime(b, '%m/%d/%Y') || '; what is the date in ' || n || CASE u WHEN 1 THEN ' weeks?' ELSE ' days?' END AS state, strftime(a, '%m/%d/%Y') AS answer,
  array_to_string(list_sort(list_transform([-7, -2, -1, 0, 1, 2, 7], lambda k: strftime(a + k::INT, '%m/%d/%Y'))), ' ') AS options FROM y""")
def gen_dates(spark: SparkSession, d: str) -> DataFrame:
    return G.dates(_ids(spark, d)).withColumn("options", F.array_join("options", " "))


@C.query(f"""
WITH x AS (SELECT i AS id, [{', '.join(f"{_pick('ordinals', f'x{j}', 90, 'i')} + {100 * j}" for j in range(7))}] AS up, {_pick('ordinals', 'k', 7, 'i')} + 1 AS k FROM (SELECT o_orderkey AS i FROM orders) t)
SELECT id, k::INT AS k, up[k] AS smallest, up[8 - k] AS largest FROM x""")
def gen_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return G.ordinals(_ids(spark, d)).select("id", "k", "smallest", "largest")


@C.query(f"""
WITH x AS (SELECT i AS id, [{', '.join(f"{{'d': {_pick('navigate', f'd{j}', 4, 'i')}, 'l': {_pick('navigate', f'l{j}', 5, 'i')} + 1}}" for j in range(6))}] AS w FROM (SELECT o_orderkey AS i FROM orders) t)
SELECT id, list_sum(list_transform(w, lambda s: CASE s.d WHEN 1 THEN s.l WHEN 3 THEN -s.l ELSE 0 END))::BIGINT AS x, list_sum(list_transform(w, lambda s: CASE s.d WHEN 0 THEN s.l WHEN 2 THEN -s.l ELSE 0 END))::BIGINT AS y FROM x""")
def gen_navigation(spark: SparkSession, d: str) -> DataFrame:
    return G.navigation(_ids(spark, d)).select("id", "x", "y")


@C.query(f"""
WITH x AS (SELECT i AS id, {_pick('sums', 'a', 90, 'i')} + 10 AS a, {_pick('sums', 'b', 90, 'i')} + 10 AS b, {_pick('sums', 'c', 90, 'i')} + 10 AS c FROM (SELECT o_orderkey AS i FROM orders) t)
SELECT id, a || ' * ' || b || ' - ' || c AS state, a * b - c AS answer FROM x""")
def gen_sums(spark: SparkSession, d: str) -> DataFrame:
    return G.sums(_ids(spark, d)).select("id", "state", "answer")


@C.query(f"""
WITH x AS (SELECT i AS id, [{', '.join(f"{_pick('lies', f's{j}', 2, 'i')} = 1" for j in range(5))}] AS s FROM (SELECT o_orderkey AS i FROM orders) t)
SELECT id, len(list_filter(s, lambda v: NOT v)) % 2 = 0 AS truthful FROM x""")
def gen_truth_chains(spark: SparkSession, d: str) -> DataFrame:
    return G.truth_chains(_ids(spark, d)).select("id", "truthful")


@C.query(f"""
WITH x AS (SELECT i AS id, [{', '.join(f"{_pick('tracking', f'a{j}', 4, 'i')} * 10 + ({_pick('tracking', f'a{j}', 4, 'i')} + 1 + {_pick('tracking', f'b{j}', 3, 'i')}) % 4" for j in range(5))}] AS s FROM (SELECT o_orderkey AS i FROM orders) t),
n AS (SELECT id, s, ['Ann', 'Bea', 'Cal', 'Dee'] AS who FROM x)
SELECT id, array_to_string(list_transform(s, lambda v: who[v // 10 + 1] || '-' || who[v % 10 + 1]), ' ') AS swaps, who[list_reduce(list_prepend(0, s), lambda p, v: CASE WHEN p = v // 10 THEN v % 10 WHEN p = v % 10 THEN v // 10 ELSE p END) + 1] AS holder FROM n""")
def gen_tracking(spark: SparkSession, d: str) -> DataFrame:
    return G.tracking(_ids(spark, d))


@C.query()
def table_manifest(spark: SparkSession, d: str) -> DataFrame:
    return io.manifest({n: table(spark, d, n) for n in ("region", "nation", "orders")})


@C.query("""
WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
k AS (SELECT o_custkey, o_totalprice AS kth FROM o WHERE i = 2), p AS (SELECT o_custkey, o_totalprice AS prev FROM o WHERE i = 1), x AS (SELECT o_custkey, o_totalprice AS next FROM o WHERE i = 3), z AS (SELECT o_custkey, o_totalprice AS from_end FROM o WHERE i = n - 1)
SELECT o_custkey, kth, prev, next, from_end FROM k JOIN p USING (o_custkey) LEFT JOIN x USING (o_custkey) LEFT JOIN z USING (o_custkey)""")
def ordinal_kth(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("s")).filter(F.size("s") >= 2)
    at = lambda i: F.get("s", i)["o_totalprice"]
    return lists.select("o_custkey", at(F.lit(1)).alias("kth"), at(F.lit(0)).alias("prev"), at(F.lit(2)).alias("next"), at(F.size("s") - 2).alias("from_end"))


@C.query("""
SELECT c_custkey % 5 AS shard, c_nationkey, count(*) AS n, md5(string_agg(c_name, '|' ORDER BY md5('shard:' || c_custkey), c_custkey)) AS names FROM customer GROUP BY ALL""")
def shard_lists(spark: SparkSession, d: str) -> DataFrame:
    """Customers of all five shards, each nation's in a drawn order."""
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 5).alias("shard"), "c_nationkey", F.struct(draw("shard", "c_custkey").alias("h"), "c_custkey", "c_name").alias("x"))
    lists = rows.groupBy("shard", "c_nationkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("x")).alias("s"))
    return lists.select("shard", "c_nationkey", "n", F.md5(F.array_join(F.transform("s", lambda x: x["c_name"]), "|")).alias("names"))


@C.query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def host_of_nation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", T.capital("n_name").alias("n_name"))
