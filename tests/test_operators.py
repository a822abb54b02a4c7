"""Hand-made cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.functions import records as R
from millrace.functions import text as T
from millrace.operators import decontam as X
from millrace.operators import logs as L
from millrace.operators import metrics as M
from millrace.operators import records as O
from millrace.operators import reviews as V
from millrace.operators import sampling as S
from millrace.sources import io
from millrace.streaming import resume


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_grams_need_thirteen_words(spark):
    df = spark.createDataFrame([(words(12),), (words(13),), (words(14),), (None,), ("",)], "text string")
    got = df.select(T.words("text").alias("w")).select(F.size(T.grams("w")).alias("n")).collect()
    assert [r.n for r in got] == [0, 1, 2, 0, 0]


def test_segments_need_five_words(spark):
    got = one(spark, s=T.segments(F.lit("a b c d. A b c d E! x")))
    assert got.s == ["a b c d e"]


def test_grams_cross_segments(spark):
    got = spark.createDataFrame([(words(7) + ". " + words(7, 7),)], "text string").select(T.words("text").alias("w")).select(F.size(T.grams("w")).alias("n"))
    assert got.first().n == 2


def test_segment_goes_before_ngram(spark):
    suite = spark.createDataFrame([(1, words(20))], "item_id int, text string")
    docs = spark.createDataFrame([(1, words(20)), (2, "x " + words(20)), (3, "nothing at all like it here"), (4, None)], "doc_id int, text string")
    assert {r.doc_id: r.why for r in X.verdicts(docs, suite).collect()} == {1: "segment", 2: "ngram"}


def test_pieces_of_many_suite_rows_are_ignored(spark):
    suite = spark.createDataFrame([(i, "one two three four five") for i in range(21)] + [(30, "six seven eight nine ten")], "item_id int, text string")
    assert [r.piece for r in X.index(suite, T.segments("text")).collect()] == ["six seven eight nine ten"]


def test_repeated_grams_count(spark):
    suite = spark.createDataFrame([(1, words(13))], "item_id int, text string")
    # 13 shared words, then 60 others: 1 of 61 windows; three times the shared ones: more.
    docs = spark.createDataFrame([(1, "a " + words(13) + " " + words(60, 100)), (2, " b ".join([words(13)] * 4))], "doc_id int, text string")
    assert [r.doc_id for r in X.verdicts(docs, suite, share=0.05).collect()] == [2]


def test_empty_suite(spark):
    suite = spark.createDataFrame([], "item_id int, text string")
    docs = spark.createDataFrame([(1, words(30))], "doc_id int, text string")
    assert X.verdicts(docs, suite).count() == 0


def test_round_robin(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate("aaaaabbc")], "id int, g string")
    got = S.round_robin(df, ["g"], 6, "s", "id").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 3, "b": 2, "c": 1}


def test_option_value(spark):
    cases = [("option_3", "d", '"d"'), ("A", "d", '"d"'), ("a", "d", '{"key":"a","description":"d"}'), ("k_0f", "d", '"d"'), ("x y", "x y", '"x y"'), ("cat", "a cat here", '"a cat here"'), ("billing", None, '"billing"'), ("billing", "Money", '{"key":"billing","description":"Money"}')]
    df = spark.createDataFrame([(k, d) for k, d, _ in cases], "k string, d string")
    assert [r.v for r in df.select(R.option_value(F.col("k"), F.col("d")).alias("v")).collect()] == [v for *_, v in cases]


def test_labels():
    assert [R.label(i) for i in (0, 25, 26, 255)] == ["A", "Z", "AA", "IV"]


def _questions(spark, rows):
    return spark.createDataFrame(rows, "record_id string, qkey string, kind string, criteria array<struct<key:string,desc:string>>, gold string")


def test_expand_guards_and_copies(spark):
    options = lambda n: [(f"o{i}", None) for i in range(n)]
    rows = [("r1", "q", "choice", options(1), "o0"), ("r2", "q", "choice", options(256), "o0"), ("r3", "q", "choice", options(3), None), ("r4", "q", "choice", options(3), "zz"), ("r5", "q", "choice", options(10), "o1"), ("r6", "q", "choice", options(11), "o1"), ("r7", "q", "noul", None, "yes")]
    got = O.expand(_questions(spark, rows)).collect()
    assert sorted(r.id for r in got) == ["r5#q#0", "r5#q#1", "r6#q#0", "r7#q#0", "r7#q#1"]
    assert all(r.order[r.labels.index(r.gold)] == r.gold_key for r in got)


def test_blend(spark):
    m = lambda **k: F.create_map(*(x for a, b in k.items() for x in (F.lit(a), F.lit(b))))
    got = one(spark, x=D.blend(m(a=0.8), m(b=0.6), 0.8), y=D.blend(m(a=0.8), F.lit(None).cast("map<string,double>"), 0.8))
    assert got.x == pytest.approx({"a": 0.64 / 0.76, "b": 0.12 / 0.76}) and got.y == {"a": 0.8}


def test_top_token_mass(spark):
    top = lambda p: F.array(F.struct(F.lit("A").alias("token"), F.lit(p).alias("p")))
    got = one(spark, x=D.to_probs(top(0.49), F.array(F.lit("A"), F.lit("B"))), y=D.to_probs(top(0.5), F.array(F.lit("A"), F.lit("B"))))
    assert got.x is None and got.y == pytest.approx({"A": 0.5, "B": 0.5})


def test_distillation_loss(spark):
    got = one(spark, x=D.cross_entropy(F.array(*map(F.lit, (0.02, 0.06, 0.92))), F.array(*map(F.lit, (0.186, 0.307, 0.506)))))
    assert got.x == pytest.approx(0.7312, abs=0.002)


def test_argmax_takes_the_first(spark):
    got = one(spark, x=D.argmax(F.array(F.lit("yes"), F.lit("no")), F.create_map(F.lit("no"), F.lit(0.5), F.lit("yes"), F.lit(0.5))))
    assert got.x == "yes"


def test_auc_ties_and_empty_class(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 1, False), ("a", 0, False), ("b", 1, True)], "g string, s int, y boolean")
    assert {r.g: r.auc for r in M.auc(df, "s", "y", ["g"]).collect()} == {"a": 0.875, "b": None}


def test_mcnemar(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (3, 4)], "l int, w int")
    assert [round(r.p, 9) for r in df.select(M.mcnemar(F.col("l"), F.col("w")).alias("p")).collect()] == [0.0625, 1.0, 1.0]


def test_order_statistics(spark):
    got = M.order_statistics(spark.range(1, 11).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v")), "v", ["g"]).first()
    assert (got.p90, got.median, got.p95) == (9, 5.5, 10)


def test_window_rule(spark):
    df = spark.range(20).select(F.lit("a").alias("g"), F.col("id").alias("pos"))
    assert [r.start for r in L.count_windows(df, "pos", F.col("pos") == 3, 10, ["g"]).collect()] == [0]


def plain_batches(rows, budget):
    """(group, key): (batch, place) row by row."""
    out, state = {}, {}
    for g, k, n in sorted(rows, key=lambda r: (str(r[0]), r[2] or 0, r[1])):
        batch, held = state.get(g, (0, 0))
        if held and (held + 1) * (n or 0) > budget:
            batch, held = batch + 1, 0
        out[g, k] = (batch, held)
        state[g] = (batch, held + 1)
    return out


def test_batches(spark):
    rng = random.Random(7)
    rows = [("g", 1, 10), ("g", 2, 10), ("g", 3, 30)] + [(rng.choice(["a", "b", None]), i, rng.choice([None, 0, 1, 2, 3, 5, 8, 13, 40, 90])) for i in range(10, 400)]
    rows += [("hot", i, 7) for i in range(400, 1400)] + [("zeros", i, 0) for i in range(1400, 1430)] + [("zeros", 1430, 1)]
    df = spark.createDataFrame(rows, "g string, k int, n int")
    for budget in (1, 40, 57):
        assert {(r.g, r.k): (r.batch, r.place) for r in L.batches(df, ["g"], "k", "n", budget).collect()} == plain_batches(rows, budget)
    alone = L.batches(df.filter("g = 'g'").drop("g"), [], "k", "n", 40).collect()
    assert {r.k: (r.batch, r.place) for r in alone} == {1: (0, 0), 2: (0, 1), 3: (1, 0)}
    assert L.batches(df.filter("false"), ["g"], "k", "n", 40).count() == 0


def test_ema(spark):
    rows = [("a", 2, 2.0), ("a", 1, 1.0), ("a", 3, 9.0), ("a", 4, None), (None, 1, 5.0), ("b", 1, None), ("b", 2, 4.0)] + [("long", i, float(1 + i % 2)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, at int, x double")
    got = {r.g: (r.n, r.ema, r.skipped) for r in L.ema(df, ["g"], "at", "x", 0.5, 3.0).collect()}
    mean = 1.0
    for i in range(1, 5000):
        mean = 0.5 * mean + 0.5 * (1 + i % 2)
    assert got == {"a": (4, 1.5, 1), None: (1, 5.0, 0), "b": (2, 4.0, 0), "long": (5000, pytest.approx(mean), 0)}
    assert [tuple(r) for r in L.ema(df.filter("g = 'a'"), [], "at", "x", 0.5, 3.0).collect()] == [(4, 1.5, 1)]
    assert L.ema(df.filter("false"), ["g"], "at", "x", 0.5, 3.0).count() == 0


def test_fit_tail(spark):
    df = spark.range(10).select(F.lit(1).alias("c"), F.col("id").alias("p"), F.lit(100).alias("n"))
    kept = lambda budget: sorted(r.p for r in L.fit_tail(df, "c", "p", F.col("n"), 6, budget).filter("kept").collect())
    assert kept(900) == [0, 1, 2, 3, 4, 5, 8, 9] and kept(1000) == list(range(10))


def test_labels_leave_one_out(spark):
    got = one(spark, x=R.labels()).x
    assert len(got) == 255 and got[-1] == "IV" and "GZ" not in got


def test_relevance(spark):
    got = one(spark, x=T.relevant(F.lit("who won the Wimbledon final"), F.array(F.lit("Korean won"), F.lit("a"), F.lit("b"), F.lit("wimbledon final won"))), y=T.relevant(F.lit("Wimbledon final"), F.array(F.lit("The finals"))), z=T.relevant(F.lit("who is it"), F.array().cast("array<string>")))
    assert (got.x, got.y, got.z) == (False, True, True)


def test_outcomes(spark):
    review = "array<struct<login:string,state:string,at:int>>"
    cases = [
        ("me", [("you", "CHANGES_REQUESTED", 5)], [1], 0, False, "yes"),
        ("me", [("you", "COMMENTED", 5)], [6], 2, False, "yes"),
        ("me", [("you", "COMMENTED", 5)], [1], 4, False, "yes"),
        ("me", [("you", "APPROVED", 5)], [1], 0, True, "yes"),
        ("me", [("you", "APPROVED", 5)], [1], 0, False, "no"),
        ("me", [("you", "APPROVED", 5)], [1], 2, False, "ambiguous"),
        ("me", [("you", "APPROVED", 5)], [1], 1, False, "no"),
        ("renovate[bot]", [("you", "APPROVED", 5)], [1], 0, False, "bot_author"),
        ("me", [("me", "APPROVED", 5), ("codecov", "COMMENTED", 2)], [1], 0, False, "no_human_review"),
    ]
    df = spark.createDataFrame(cases, f"a string, r {review}, c array<int>, t int, rev boolean, want string")
    got = df.select("want", V.outcome(F.col("a"), F.col("r"), F.col("c"), F.col("t"), F.col("rev")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_md5_mod10(spark):
    import hashlib

    got = spark.range(300).select("id", S.md5_mod10(F.col("id")).alias("m")).collect()
    assert all(r.m == int(hashlib.md5(str(r.id).encode()).hexdigest(), 16) % 10 for r in got)


def test_records_keep_option_order(spark, tmp_path):
    record = {"id": "r", "source": "s", "state": {"z": 1.0, "a": "é"}, "questions": {"q": {"type": "choice", "instructions": "?", "criteria": {"z": "last", "a": None}}}, "expected": {"q": "z"}}
    (tmp_path / "x.jsonl").write_text(json.dumps(record, ensure_ascii=False) + "\n{broken\n")
    (got,) = io.records(spark, str(tmp_path / "x.jsonl")).collect()
    assert [(c.key, c.desc) for c in got.criteria] == [("z", "last"), ("a", None)] and json.loads(got.state) == record["state"] and got.gold == "z"


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "out")
    assert io.append_new(spark.range(5), path, "id") == 5
    assert io.append_new(spark.range(8), path, "id") == 3
    assert spark.read.parquet(path).count() == 8


def test_manifest_ignores_partitions(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    a, b = io.manifest({"t": df.repartition(5)}).first(), io.manifest({"t": df.repartition(2, "x")}).first()
    assert a == b and a.rows == 1000


def test_readers(spark, tmp_path):
    (tmp_path / "bug").mkdir()
    (tmp_path / "bug" / "a.sol").write_text("one\ntwo\n")
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "p.txt").write_text("# no\nab+\n\ncd\n")
    assert [(r.position, r.line) for r in io.lines(spark, str(tmp_path / "bug" / "a.sol")).collect()] == [(0, "one"), (1, "two")]
    assert io.files(spark, str(tmp_path / "bug")).first().folder == "bug"
    assert io.csv(spark, str(tmp_path / "c.csv")).first().b == "x\ny"
    assert io.patterns(spark, str(tmp_path / "p.txt")) == "(?:ab+)|(?:cd)"


def test_stream_enriches_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in (spark.range(3), spark.range(5)):
        k.write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long").parquet(src)
        resume.enrich_once(stream, lambda df: df.withColumn("y", F.col("id") * 2), out, str(tmp_path / "cp"), "id").awaitTermination()
    assert sorted(r.y for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8]


def test_puzzles(spark):
    from millrace.operators import puzzles as Z

    got = Z.puzzles(spark.range(40)).collect()
    assert {r.family for r in got} == set(Z.FAMILIES) and all(r.answer in r.options and len(set(r.options)) == len(r.options) for r in got)
    for r in got:
        if r.family == "boolean":
            assert str(eval(r.state)) == r.answer  # noqa: S307  made of True, False, and, or, not
        if r.family == "program_output":
            text, call = r.state.split("\n\n")
            space = {}
            exec(text, space)  # noqa: S102  one of four fixed texts
            assert repr(eval(call, space)) == r.answer  # noqa: S307
        if r.family == "free_slot":
            assert [h for h in r.options if f" {h}" not in r.state.replace(",", "").replace(".", "")] == [r.answer]
    assert [tuple(r) for r in Z.puzzles(spark.range(40)).orderBy("family", "id").collect()] == [tuple(r) for r in Z.puzzles(spark.range(40).repartition(3)).orderBy("family", "id").collect()]


def test_expand_with_copies_asked_for(spark):
    many = [(str(i), None) for i in range(12)]
    q = spark.createDataFrame([("a", "q", "choice", many, "3"), ("b", "q", "choice", many[:3], "1")], "record_id string, qkey string, kind string, criteria array<struct<key:string,desc:string>>, gold string")
    count = lambda **more: {r.record_id: r["count"] for r in O.expand(q, **more).groupBy("record_id").count().collect()}
    assert count() == {"a": 1, "b": 2} and count(copies=3) == {"a": 3, "b": 3}


def test_agreed_on_yes_no_is_at_one_half(spark):
    rows = spark.createDataFrame([(1, True, {"true": 0.5, "false": 0.5}, {"true": 0.6, "false": 0.4}), (2, True, {"true": 0.4}, {"true": 0.45, "false": 0.3}), (3, True, {"true": 0.4, "false": 0.6}, {"true": 0.7, "false": 0.3})], "k int, noul boolean, a map<string,double>, b map<string,double>")
    options = F.array(F.lit("false"), F.lit("true"))
    assert {r.k: r.choice for r in O.agreed(rows, options, F.col("a"), F.col("b"), yes_no=F.col("noul")).collect()} == {1: "true", 2: "false"}


def test_record_texts_hold_every_string_apart(spark):
    """Segments end with the string that they stand in; options of choices count, keys and yes/no options don't."""
    schema = "record_id string, state string, qkey string, kind string, instructions string, criteria array<struct<key:string,desc:string>>"
    state = '{"title": "one two three", "body": ["four five", {"x": "six seven. eight", "n": 3}]}'
    rows = [("r", state, "b", "noul", "Is it so?", [("true", "Yes, the statement is true.")]), ("r", state, "a", "choice", "Which one?", [("k", "first kind of it"), ("l", None), ("m", "second")]), ("s", '"plain text"', "q", "choice", None, [])]
    got = {r.record_id: r.text for r in O.record_texts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"r": "one two three\nfour five\nsix seven. eight\nWhich one?\nfirst kind of it\nsecond\nIs it so?", "s": "plain text\n"}
