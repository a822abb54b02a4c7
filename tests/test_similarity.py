"""Similar rows and templates of lines against all pairs."""

import hashlib
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from millrace.operators import similarity as Y
from millrace.plans import catalog


def plain_similar(left, right, k):
    out = []
    for a, ta in left:
        scored = [(-len({*ta} & {*tb}) / len({*ta} | {*tb}), b) for b, tb in right if a != b and {*ta} & {*tb}]
        out += [(a, b, pytest.approx(-s), i + 1) for i, (s, b) in enumerate(sorted(scored)[:k])]
    return out


def sets(rng, n, first, words=40):
    # Frequent and rare tokens, equal rows, ties and empty rows.
    rows = [(first + i, [f"w{min(rng.randrange(words), rng.randrange(words))}" for _ in range(rng.randrange(0, 9))]) for i in range(n)]
    return rows + [(first + n, rows[0][1]), (first + n + 1, [])]


@pytest.mark.parametrize(("k", "seed"), [(1, 0), (3, 1), (5, 2), (60, 3)])
def test_similar_is_the_best_of_all_pairs(spark, k, seed):
    rng = random.Random(seed)
    left, right = sets(rng, 40, 0), sets(rng, 70, 20)  # some ids on both sides
    frames = [spark.createDataFrame(rows, "id int, tokens array<string>") for rows in (left, right)]
    got = sorted((r.a, r.b, r.sim, r["rank"]) for r in Y.similar(*frames, k).collect())
    assert got == sorted(plain_similar(left, right, k), key=lambda r: (r[0], r[1]))


def test_similar_of_one_table_and_of_none(spark):
    rows = [(i, ["common", f"w{i // 2}"]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    got = sorted((r.a, r.b, r.sim, r["rank"]) for r in Y.similar(df, df, 2).collect())
    assert got == sorted(plain_similar(rows, rows, 2), key=lambda r: (r[0], r[1]))
    assert Y.similar(df.filter("false"), df, 2).count() == 0 == Y.similar(df, df.filter("false"), 2).count()


CASES = [
    ("a<*>b", "xaYb"), ("a<*>b", "ba"), ("a<*>a", "a"), ("a<*>a", "aa"), ("<*>", ""), ("<*>", "x"), ("", "x"), ("a.b", "axb"), ("a\\E<*>(", "a\\E ("), ("ab<*>bc", "abc"),
    ("ab<*>bc", "abbc"), ("<*>x<*>", "x"), ("a<*>b<*>c", "a c b c"), ("a\nb<*>c", "a\nb\nc"), ("ü<*>ö", "üö"), ("aa<*>ab", "aaab"),
]


def test_fits_is_the_pattern_found_anywhere(spark):
    df = spark.createDataFrame([*CASES, (None, "x"), ("x", None)], "template string, line string")
    got = [r.f for r in df.select(Y.fits(F.col("line"), F.col("template")).alias("f")).collect()]
    assert got == [re.search(".*?".join(re.escape(p) for p in t.split("<*>")), x, re.S) is not None for t, x in CASES] + [False, False]


def made(spark, seed):
    """Lines of two systems from templates, some of which are wider forms of others."""
    rng = random.Random(seed)
    words = ["open", "close", "read", "write", "sync", "drop"]
    forms = [f"{rng.choice(words)} {rng.choice(words)} block <*> of {rng.choice(words)}" for _ in range(25)]
    forms += [re.sub(r"^\w+", "<*>", f) for f in forms[:5]] + ["<*>", "9<*>", "block <*> of"]
    templates = [(s, t, t) for s in ("x", "y") for t in dict.fromkeys(forms)] + [("z", "lone", "lone"), (None, "n", "n")]
    lines = [(s, i, t.replace("<*>", str(rng.randrange(99))), t) for i, (s, t, _) in enumerate(templates * 2)] + [("x", 900, None, forms[0]), ("x", 901, "", forms[0])]
    return spark.createDataFrame(lines, "system string, line_id int, line string, event string"), spark.createDataFrame(templates, "system string, event string, template string"), lines, templates


def plain_fits(line, template):
    return line is not None and re.search(".*?".join(re.escape(p) for p in template.split("<*>")), line, re.S) is not None


def test_fitting_is_all_lines_by_all_templates(spark):
    lines, templates, some, forms = made(spark, 1)
    got = sorted((r.system, r.line_id, r.event) for r in Y.fitting(lines, templates).collect())
    assert got == sorted((s, i, e) for s, i, x, _ in some for t, e, form in forms if s == t and s is not None and plain_fits(x, form))


def test_lines_meet_only_templates_whose_word_they_have(spark):
    lines, templates, *_ = made(spark, 2)
    plan = Y.fitting(lines, templates)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and all("=" in x for x in plan.splitlines() if "Join" in x)
    rare = {r.template: r.token for r in Y.anchors(templates.filter("system = 'x'"), lines).collect()}
    assert rare["<*>"] is None and rare["9<*>"] is None and rare["block <*> of"] is None  # no word stands whole
    assert all(t is None or t in form for form, t in rare.items())


@pytest.mark.parametrize("sent", [0, Y.SENT])
def test_templates_are_held_and_never_lines(spark, small, tmp_path, monkeypatch, sent):
    # Files of lines are far smaller than the lines; Spark's guess from them made it send all lines through the driver.
    monkeypatch.setattr(Y, "SENT", sent)
    lines, templates, some, forms = made(spark, 4)
    lines.write.parquet(f"{tmp_path}/lines")
    templates.write.parquet(f"{tmp_path}/templates")
    for df in (Y.fitting(spark.read.parquet(f"{tmp_path}/lines"), spark.read.parquet(f"{tmp_path}/templates")), catalog.QUERIES["template_fits"](spark, small)):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        kind = "BroadcastHashJoin" if sent else "ShuffledHashJoin"
        assert joins and all(kind in x and "BuildRight" in x for x in joins)
        # No filter on templates alone is made of whether a line fits; in the first query of a session it failed.
        assert not any("Filter" in x and "aggregate(" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    got = sorted((r.system, r.line_id, r.event) for r in Y.fitting(lines, templates).collect())
    assert got == sorted((s, i, e) for s, i, x, _ in some for t, e, form in forms if s == t and s is not None and plain_fits(x, form))


def test_fits_in_a_new_session():
    """The same as the first query of a process."""
    code = """
from pyspark.sql import SparkSession
from millrace.plans import catalog
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", catalog.QUERIES["template_fits"](spark, "/root/testdata/sf0.001").count())
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))})
    assert "rows 400" in got.stdout, got.stderr[-2000:]


def test_distractors(spark):
    lines, templates, some, forms = made(spark, 3)
    asked = lines.filter("line_id < 60")
    got = Y.distractors(asked, templates, "s").collect()
    by_id = {i: (s, x, e) for s, i, x, e in some}
    tokens = {t: {*re.findall("[a-z]+", t)} for _, t, _ in forms}
    assert len(got) > 20 and {r.system for r in got} == {"x", "y"}
    for r in got:
        system, line, event = by_id[r.line_id]
        others = [e for s, e, form in forms if s == system and e != event and not plain_fits(line, form)]
        assert event in r.options and len({*r.options}) == len(r.options) and {*r.options} <= {event, *others}
        n = min(6 + int(int(hashlib.md5(f"s:n:{r.line_id}".encode()).hexdigest()[:8], 16) / 2**32 * 3), sum(s == system for s, *_ in forms))
        assert len(r.options) == min(n, 1 + len(others))
        sim = lambda e: len(tokens[e] & tokens[event]) / len(tokens[e] | tokens[event])  # noqa: B023, E731
        hard = sorted((e for e in others if tokens[e] & tokens[event]), key=lambda e: (-sim(e), e))[: max(1, (n - 1) * 2 // 3)]
        assert {*hard} <= {*r.options}
    assert Y.distractors(asked.filter("false"), templates, "s").count() == 0
