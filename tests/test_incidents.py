"""Windows around an event against every event of every case."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import incidents as I

START = 1_700_000_000


def frames(spark, rows, cases):
    events = spark.createDataFrame(rows, "s bigint, g string, v double, x string, edge string, slot string, rows string").withColumn("ts", F.timestamp_seconds("s"))
    at = spark.createDataFrame(cases, "case bigint, s bigint").withColumn("at", F.timestamp_seconds("s"))
    return events, at


def made(seed, n=300, span=3000):
    rng = random.Random(seed)
    rows = [(START + rng.randrange(span), rng.choice(["a", "b", None]), rng.choice([None, round(rng.uniform(0, 9), 2)]), f"x{rng.randrange(9)}", "e", "s", "r") for _ in range(n)]
    return rows + rows[:30], [(i, START + rng.randrange(-200, span + 200)) for i in range(25)] + [(100, START + 5), (101, START + 5)]


@pytest.mark.parametrize(("before", "after"), [(600, 300), (50, 200), (7, 7), (1, 5000)])
def test_around_is_all_events_of_all_cases(spark, before, after):
    rows, cases = made(before)
    rows.append((None, "a", 1.0, "x", "e", "s", "r"))
    events, at = frames(spark, rows, [*cases, (200, None)])
    want = defaultdict(lambda: [0, 0, 0.0, 0.0, None])
    for case, t in cases:
        for s, g, v, x, *_ in rows:
            if s is not None and t - before <= s < t + after:
                own, side = want[case, g], s >= t
                own[side] += 1
                own[2 + side] += v or 0
                if side and (own[4] is None or (s, x) < own[4]):
                    own[4] = (s, x)
    got = I.around(events, at, "ts", before, after, ["g"], F.col("x"), n=F.lit(1), v=F.col("v")).collect()
    assert len(got) == len(want)
    for r in got:
        nb, na, vb, va, x = want[r["case"], r.g]
        assert (r.n_before, r.n_after, r.example) == (nb, na, x and x[1])
        assert (r.v_before, r.v_after) == (pytest.approx(vb), pytest.approx(va))


def test_around_without_groups_and_without_rows(spark):
    events, at = frames(spark, [(START, "a", 1.0, "x", "e", "s", "r"), (START + 1, "b", 1.0, "x", "e", "s", "r")], [(1, START + 1)])
    assert [tuple(r) for r in I.around(events, at, "ts", 5, 5, [], n=F.lit(1)).collect()] == [(1, 1, 1)]
    assert I.around(events.filter("false"), at, "ts", 5, 5, ["g"], n=F.lit(1)).count() == 0
    assert I.around(events, at.filter("false"), "ts", 5, 5, ["g"], n=F.lit(1)).count() == 0


def test_a_hundred_times_the_events(spark):
    """More events in the same seconds: counts grow, rows that cases meet do not."""
    rows, cases = made(4)
    once, at = frames(spark, rows, cases)
    many = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("copy")
    plain, dense = ({(r["case"], r.g): (r.n_before, r.n_after) for r in I.around(df, at, "ts", 600, 300, ["g"], n=F.lit(1)).collect()} for df in (once, many))
    assert dense == {k: (100 * a, 100 * b) for k, (a, b) in plain.items()}
    plan = I.around(many, at, "ts", 600, 300, ["g"], n=F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and all("=" in line and "<" not in line for line in joins)  # equalities on slot and time only


def test_new_messages_and_rates(spark):
    rows = [(START + s, "web", 0.0, x, "e", "s", "r") for s, x in [(-5, "old"), (3, "old"), (4, "new"), (5, "new"), (6, "error 1"), (9, "late")]]
    events, at = frames(spark, rows, [(1, START)])
    got = I.new_messages(events, at, "ts", 60, 9, "g", "x", 3, 5, F.concat(F.lit("raw "), F.col("x"))).orderBy("rank").collect()
    assert [(r.x, r.n, r["rank"], r.example) for r in got] == [("error 1", 1, 1, "raw error 1"), ("new", 2, 2, "raw new")]
    r = I.rates(events, at, "ts", 60, 30, ["g"], F.col("x").rlike(I.ERROR)).first()
    assert (r.rate_before, r.rate_after, r.error_rate_before, r.error_rate_after) == (1.0, 10.0, 0.0, 2.0)


def test_metric_shift(spark):
    rows = [(START + s, "cpu", float(v), "x", "e", "s", "r") for s, v in [(-4, 1), (-3, 3), (-2, 1), (-1, 3), (0, 6), (1, 8)]] + [(START, "mem", None, "x", "e", "s", "r")]
    events, at = frames(spark, rows, [(1, START)])
    (r,) = I.metric_shift(events, at, "ts", 10, 10, "g", "v", 3, 2).collect()
    assert (r.g, r.mean_before, r.mean_after, r["rank"]) == ("cpu", 2.0, 7.0, 1) and r.z == pytest.approx(5 / 1.02)
