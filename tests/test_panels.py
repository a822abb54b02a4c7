"""Views, panels, pairs and teachers' labels against plain versions."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import panels as P
from millrace.operators import teachers as T
from millrace.operators.records import averaged


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_views_are_samples_in_order(spark):
    rng = random.Random(1)
    rows = [("hot", i, f"line {i}", f"k{i}") for i in range(500)] + [(rng.choice(["a", None]), 1000 + i, f"line {i}", f"m{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "g string, position int, line string, id string")
    got = P.views(df, ["g"], "position", "line", "id", 3, 6, "s").collect()
    by = defaultdict(list)
    for g, at, line, key in rows:
        by[g].append((at, line, key))
    assert len(got) == 9
    for r in got:
        own = sorted(by[r.g], key=lambda x: (md5("s", r["view"], x[2]), x[2]))[:6]
        assert r.lines == [line for _, line, _ in sorted(own)] and r.total == len(by[r.g])
    assert len({tuple(r.lines) for r in got if r.g == "hot"}) == 3
    assert [r.total for r in P.views(df.drop("g"), [], "position", "line", "id", 1, 2, "s").collect()] == [509]
    assert P.views(df.filter("false"), ["g"], "position", "line", "id", 3, 6, "s").count() == 0


def plain_panels(ballots, panels, most=255):
    ranks, people = {}, defaultdict(set)
    for r, m, c, k in ballots:
        ranks[r, m, c] = min(k, ranks.get((r, m, c), k))
    for r, m in panels:
        people[r].add(m)
    sets = defaultdict(set)
    for r, m, c in ranks:
        sets[r, m].add(c)
    groups = defaultdict(set)
    for (r, m), cs in sets.items():
        groups[r, frozenset(cs)].add(m)
    out = []
    for (r, cs), who in groups.items():
        total = {c: sum(ranks[r, m, c] for m in who) for c in cs}
        best = [c for c in cs if total[c] == min(total.values())]
        if who == people[r] and 2 <= len(cs) <= most and len(best) == 1:
            order = sorted(cs, key=lambda c: hashlib.sha256(f"{r}{c}".encode()).hexdigest())
            out.append((r, len(who), order, f"option_{order.index(best[0])}"))
    return sorted(out)


def test_panels_must_be_whole(spark):
    rng = random.Random(2)
    ballots, panels = [], []
    for r in range(60):
        cands = [f"c{i}" for i in range(rng.randrange(1, 6))]
        for m in range(rng.randrange(1, 4)):
            panels.append((r, f"m{m}"))
            own = cands if rng.random() < 0.85 else cands[:-1]
            if rng.random() < 0.95:
                ballots += [(r, f"m{m}", c, rng.randrange(1, 4)) for c in own]
        if r % 20 == 0:
            ballots += [(r, "stranger", c, 1) for c in cands]
    ballots += ballots[:5]
    frames = spark.createDataFrame(ballots, "round int, member string, candidate string, rank int"), spark.createDataFrame(panels, "round int, member string")
    got = sorted((r["round"], r.members, r.options, r.winner) for r in P.panel_winners(*frames).collect())
    assert got == plain_panels(ballots, panels) and 10 < len(got) < 60
    few = sorted((r["round"], r.members, r.options, r.winner) for r in P.panel_winners(*frames, most=3).collect())
    assert few == plain_panels(ballots, panels, 3)


def test_pairs_of_lines(spark):
    forms = ["open file <*> now", "open disk <*> now", "open <*> now", "stop node <*>", "stop host <*>", "lone line"]
    lines = [(f, f.replace("<*>", str(i))) for f in forms for i in range(9)] + [("lone line", "lone line")] * 3 + [(forms[0], None)]
    df, templates = spark.createDataFrame(lines, "event string, line string"), spark.createDataFrame([(f, f) for f in forms], "event string, template string")
    got = P.same_event_pairs(df, templates, 40, "s").collect()
    assert 20 <= len(got) <= 40 and len({r.k for r in got}) == len(got)
    event_of = defaultdict(set)
    for e, x in lines:
        event_of[x].add(e)
    for r in got:
        assert r.line_a != r.line_b and r.event in event_of[r.line_a] and r.other in event_of[r.line_b]
        assert r.same == (r.event == r.other) and r.same == (r.k % 2 == 0)
        if not r.same:  # neither could have made the other's line
            assert not (r.event == "open <*> now" and r.line_b.startswith("open ")) and not (r.other == "open <*> now" and r.line_a.startswith("open "))
    assert not {r.event for r in got} & {"lone line"} and sum(r.same for r in got) == 20
    assert Counter(r.event for r in got if r.same).most_common()[0][1] <= 8  # events take turns
    assert P.same_event_pairs(df.filter("false"), templates, 40, "s").count() == 0


MAP = "map<string,double>"


def test_prefix_rules(spark):
    sources = spark.createDataFrame([("hf/anli",), ("hf/anli/r1",), ("hf",), ("",), (None,), ("x",)], "source string")
    rules = spark.createDataFrame([("hf/", "a"), ("hf/anli", "b"), ("hf/anli", "c"), ("", "d")], "prefix string, teacher string")
    all_of = sorted((r.source, r.teacher) for r in T.by_prefix(sources, rules).collect())
    assert all_of == sorted((s, t) for s in ("hf/anli", "hf/anli/r1", "hf", "", "x") for p, t in [("hf/", "a"), ("hf/anli", "b"), ("hf/anli", "c"), ("", "d")] if s.startswith(p))
    longest = sorted((r.source, r.teacher) for r in T.by_prefix(sources, rules, longest=True).collect())
    assert longest == [("", "d"), ("hf", "d"), ("hf/anli", "b"), ("hf/anli", "c"), ("hf/anli/r1", "b"), ("hf/anli/r1", "c"), ("x", "d")]
    assert T.by_prefix(sources, rules.filter("false")).count() == 0


def test_attached_teachers(spark):
    questions = spark.createDataFrame([(1, "hf/a"), (2, "hf/a"), (3, "x"), (4, "x"), (5, None), (6, "x")], "qid int, source string")
    labels = [("t", 1, {"A": 0.8, "B": 0.2}), ("o", 1, {"A": 0.5, "C": 0.5}), ("o", 2, {"A": 1.0}), ("t", 3, {"A": 0.0}), ("o", 4, {"A": 1.0}), ("f", 4, {"B": 2.0}), ("g", 4, {"C": 1.0}), ("g", 5, {"C": 1.0})]
    labels = spark.createDataFrame(labels, f"teacher string, qid int, probs {MAP}")
    rules = spark.createDataFrame([("", "t"), ("hf/", "o"), ("hf/a", "o")], "prefix string, teacher string")
    fallbacks = spark.createDataFrame([("g", 1), ("f", 0)], "teacher string, priority int")
    got = {r.qid: (r.status, r.probs and {k: round(v, 6) for k, v in r.probs.items()}) for r in T.attached(questions, labels, rules, fallbacks).collect()}
    assert got == {
        1: ("3_teachers", {"A": 0.6, "B": 0.066667, "C": 0.333333}), 2: ("2_teachers", {"A": 1.0}), 3: ("1_teachers", {"A": 0.0}),
        4: ("fallback", {"B": 1.0}), 5: ("fallback", {"C": 1.0}), 6: ("none", None),
    }


def test_the_order_of_labels_does_not_show_in_averages(spark):
    # R's mean is 0.90625 / 4, halfway between two millionths: it must not depend on the order in which labels are added up.
    given = {"t1": {"A": 0.09375, "R": 0.90625}, "t2": {"A": 0.7608695652173914, "N": 0.2391304347826087}, "t0": {"N": 1.0}}
    rows, n = [], 0
    for teachers in itertools.permutations(given):
        for flip in itertools.product([1, -1], repeat=2):
            turned = {"t1": flip[0], "t2": flip[1], "t0": 1}
            rows += [(t, n, dict([*given[t].items()][:: turned[t]])) for t in teachers]
            n += 1
    labels = spark.createDataFrame(rows, f"teacher string, qid int, probs {MAP}").coalesce(1)
    rules = spark.createDataFrame([("", "t1"), ("h", "t2"), ("hf", "t0"), ("hf/", "t2")], "prefix string, teacher string")
    questions = spark.createDataFrame([(q, "hf/x") for q in range(n)], "qid int, source string")
    got = {(r.status, tuple(sorted(r.probs.items()))) for r in T.attached(questions, labels, rules, rules.selectExpr("teacher", "0 priority").limit(0)).collect()}
    assert len(got) == 1 and dict(got.pop()[1])["R"] == 0.2265625
    each = spark.createDataFrame([(k, q, o, p) for q, order in enumerate(itertools.permutations([(k, o, p) for k, t in enumerate(("t1", "t2", "t0")) for o, p in given[t].items()])) for k, o, p in order], "teacher int, qid int, option string, p double")
    assert len({(r.option, r.p) for r in averaged(each.coalesce(1), ["qid"]).collect()}) == 3


def test_a_fallback_that_adds_up_to_one_stays(spark):
    probs = {"A": 3 / 384, "N": 100 / 384, "R": 281 / 384}
    bad = {"A": 0.1, "N": 0.2, "R": 0.7}  # adds up to 0.9999999999999999 in one order
    labels = spark.createDataFrame([("f", 1, probs), ("f", 2, bad), ("f", 3, {"A": 3.0, "B": 1.0})], f"teacher string, qid int, probs {MAP}")
    one = F.map_from_arrays(F.array(*map(F.lit, "ARN")), F.array(*(F.lit(bad[k]) for k in "ARN")))
    labels = labels.withColumn("probs", F.when(F.col("qid") == 2, one).otherwise(F.col("probs")))
    questions = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "qid int, source string")
    rules = spark.createDataFrame([("x", "none")], "prefix string, teacher string")
    fallbacks = spark.createDataFrame([("f", 0)], "teacher string, priority int")
    assert {r.qid: r.probs for r in T.attached(questions, labels, rules, fallbacks).collect()} == {1: probs, 2: bad, 3: {"A": 0.75, "B": 0.25}}


def test_student_targets(spark):
    rows = [("a", False, {"x": 1.0}), ("a~2", None, {"x": 1.0}), ("b", True, {"x": 1.0}), ("b~2", True, None), ("c", False, None), ("d", False, {"x": 1.0})]
    examples = spark.createDataFrame(rows, f"id string, replay boolean, probs {MAP}")
    own = spark.createDataFrame([("a", {"y": 1.0}), ("b", {"y": 0.4, "x": 0.6}), ("c", {"y": 1.0})], f"id string, probs {MAP}")
    targets = T.student_targets(examples, own)
    got = {r.id: (r.how, r.probs) for r in targets.collect()}
    half = {"x": 0.5, "y": 0.5}
    assert got == {"a": ("blend", half), "a~2": ("blend", half), "b": ("own", {"y": 0.4, "x": 0.6}), "b~2": ("own", {"y": 0.4, "x": 0.6}), "c": ("own", {"y": 1.0}), "d": ("missing", None)}
    gold = targets.select("id", F.lit("x").alias("gold"))
    assert {r.how: (r.agree, r.disagree) for r in T.agreement(targets, gold, "how").collect()} == {"blend": (2, 0), "own": (2, 1)}


@pytest.mark.parametrize("k", [1, 3])
def test_smallest_is_the_first_of_each_group(spark, k):
    rows = [(i % 3 or None, (i * 7919) % 101, i) for i in range(300)]
    got = sorted((r.id, r.rn) for r in P.smallest(spark.createDataFrame(rows, "g int, x int, id int"), ["g"], k, ["x", "id"]).collect())
    want = [(i, n + 1) for g in (None, 1, 2) for n, (_, i) in enumerate(sorted((x, i) for h, x, i in rows if h == g)[:k])]
    assert got == sorted(want)
