"""Queries that must use the whole of their tables, against plain forms of the whole job."""

import json
import math
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators import ranks
from millrace.operators.ranks import running
from millrace.plans import catalog

from test_queries import rows


@pytest.fixture
def made(spark, tmp_path):
    """Writes tables as the queries read them: made(name=(rows, schema), ...) gives the folder."""

    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


TABLES = "events lineitem".split()


def whole(folder, name):
    """Rows of a query's SQL, which has no cuts by number."""
    sql, con = catalog.SQL[name], duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(sql).df()


def got(spark, name, folder):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).collect())


def test_ema_loss_of_all_users(spark, small):
    want = []
    lists = duckdb.sql(f"SELECT user_id, list(value ORDER BY event_id) FROM '{small}/events.parquet' GROUP BY user_id").fetchall()
    for user, values in lists:
        m, skipped = values[0], 0
        for v in values[1:]:
            m, skipped = (m, skipped + 1) if v > 3 * m else (0.9 * m + 0.1 * v, skipped)
        want.append((user, len(values), pytest.approx(m, abs=2e-6), skipped))
    assert got(spark, "ema_loss", small) == sorted(want, key=lambda r: r[0])


def test_ema_loss_beyond_the_first_users(spark, made):
    d = made(events=([(1, 19, 1.0), (2, 20, 1.0), (3, 20, 2.0), (4, 900, 5.0), (5, 900, 16.0)], "event_id bigint, user_id bigint, value double"))
    assert got(spark, "ema_loss", d) == [(19, 1, 1.0, 0), (20, 2, 1.1, 0), (900, 2, 5.0, 1)]


def test_interval_overlap_of_all_users(spark, made):
    import datetime as dt

    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    rows = [(i, u, at(m)) for i, (u, m) in enumerate((u, m) for u in (3, 40, 777) for m in (0, 119, 120, 250, 369, 371))]
    want = sorted((a, b) for a, ua, ta in rows for b, ub, tb in rows if ua == ub and a < b and abs(tb - ta) < dt.timedelta(hours=2))
    assert {rows[a][1] for a, _ in want} == {3, 40, 777}
    d = made(events=(rows, "event_id bigint, user_id bigint, ts timestamp"))
    assert got(spark, "interval_overlap", d) == want


@pytest.mark.parametrize("name", ["before_after_rates", "new_messages", "metric_shift_topk"])
def test_every_error_is_a_case(spark, small, name):
    want = whole(small, name)
    assert (want["case"] % 25 != 0).any()
    assert rows(catalog.QUERIES[name](spark, small).toPandas()) == rows(want)


@pytest.mark.parametrize("name", ["mcnemar_gate", "regression_gate"])
def test_gates_of_all_orders(spark, small, name):
    assert rows(catalog.QUERIES[name](spark, small).toPandas()) == rows(whole(small, name))


def test_mcnemar_of_large_counts(spark):
    counts = [(5, 0), (1000, 1100), (1001, 1100), (3000, 3100), (40, 9000), (4999, 5000), (20_100, 19_900)]
    got = spark.createDataFrame(counts, "loss bigint, win bigint").select("loss", "win", M.mcnemar(F.col("loss"), F.col("win")).alias("p")).collect()
    for r in got:
        n, k = r.loss + r.win, min(r.loss, r.win)
        tail = term = 1
        for i in range(1, k + 1):
            term = term * (n - i + 1) // i
            tail += term
        assert r.p == pytest.approx(min(1.0, float(Fraction(2 * tail, 2**n))), rel=1e-9, abs=0)
    huge = spark.createDataFrame([(3_000_000_000, 3_000_100_000)], "loss bigint, win bigint").select(M.mcnemar(F.col("loss"), F.col("win")).alias("p")).first().p
    assert huge == pytest.approx(math.erfc((100_000 - 1) / math.sqrt(2 * 6_000_100_000)), rel=1e-4)


def test_search_relevance_of_all_questions_and_words(spark, made):
    questions = [(3, "aa bb cc apple"), (10, "alpha beta gamma delta epsilon zeta theta omega kappa sigma"), (250, "Zebra zebra yak, ox"), (300, "a b")]
    texts = [(1, "alpha beta delta epsilon gamma"), (2, "alpha beta delta epsilon"), (3, "theta omega kappa sigma zeta"), (4, "yak apple"), (5, "nothing"), (6, None)]
    d = made(benchmark=(questions, "item_id bigint, text string"), documents=(texts, "doc_id bigint, text string"))
    of = lambda t: set(re.findall("[a-z]+", (t or "").lower()))
    want = [(i, k) for i, q in questions for k, t in texts if (w := {x for x in of(q) if len(x) > 2}) and 2 * len(w & of(t)) >= len(w)]
    assert (10, 3) in want and (10, 2) not in want and (250, 4) in want
    assert got(spark, "search_relevance", d) == want


def test_training_mix_compares_and_keeps_whole_texts(spark, made):
    filler = "\n".join(f"line {i} of many that nobody else has written, number {i * 7}." for i in range(8))
    passages = ["the red fox swam over nine quiet rivers", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"]
    texts = [filler, f"{filler}\n{passages[0]}\n{filler}", f"{filler} {passages[0]}", f"{filler}\n{passages[0]}", f"say\t\"{passages[0]}\"", passages[1].replace(" six", "; six") + " a b c", f"{filler}\nthe red fox swam over nine"]
    langs = ["en", "de", "fr", "es", "en", "de", "fr"]
    d = made(documents=([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))], "doc_id bigint, text string, lang string"), benchmark=(list(enumerate(passages)), "item_id bigint, text string"))
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    segments = lambda t: {tuple(w) for x in re.split(r"[.?!:;\n]+", t) if len(w := words(x)) >= 5}
    grams = lambda t: [tuple(w[i : i + 13]) for w in [words(t)] for i in range(len(w) - 12)]
    asked = "Which language?"
    seg, gram = {x for p in passages for x in segments(p)}, {x for p in passages for x in grams(p)}
    dirty = {i for i, t in enumerate(texts) if segments(t) & seg or ((g := grams(f"{t}\n{asked}")) and sum(x in gram for x in g) / len(g) >= 0.2)}
    assert dirty == {1, 2, 3, 5}
    prompts = {}
    for r in catalog.QUERIES["training_mix"](spark, d).collect():
        prompts.setdefault(int(r.id.split("#")[0].split(":")[1]), set()).add(r.prompt)
    assert set(prompts) == set(range(len(texts))) - dirty
    assert all(json.loads(p)["state"] == texts[i] for i, ps in prompts.items() for p in ps)


@pytest.mark.parametrize("whole", [0, 1_000_000])
def test_running_sums(spark, monkeypatch, whole):
    """In pieces of a group, and in one window."""
    monkeypatch.setattr(ranks, "WHOLE", whole)
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 0.5, -1.0, 2.0, rng.random()]), i, rng.choice([None, 1, 2, 5])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, id int, n int")
    place = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    for by in (["g"], []):
        same = lambda r, o: not by or r[0] == o[0]  # noqa: B023, E731
        got = {r["id"]: (r["n_before"], r["n_all"]) for r in running(df, by, ["x", "id"], n=F.col("n")).collect()}
        assert got == {r[2]: (sum(o[3] or 0 for o in rows if same(r, o) and place(o) < place(r)), sum(o[3] or 0 for o in rows if same(r, o))) for r in rows}
    assert running(df.filter("id < 0"), [], ["id"], n=F.lit(1)).count() == 0
