"""The suite's index: made once, found again, made anew for another suite."""

import shutil

from pyspark.sql import functions as F

from millrace.operators import decontam as X


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def suite_of(spark, rows):
    return spark.createDataFrame(rows, "item_id int, text string")


def test_fingerprint_hangs_on_rows_alone(spark):
    rows = [(1, words(20)), (2, "a b c d e"), (3, None), (3, None)]
    one = X.fingerprint(suite_of(spark, rows))
    assert one == X.fingerprint(suite_of(spark, rows[::-1]).repartition(5))
    others = [rows[:3], [*rows, (4, "x")], [(1, words(20)), (2, "a b c d f"), (3, None), (3, None)], [(9, words(20)), *rows[1:]], []]
    assert len({one, *(X.fingerprint(suite_of(spark, r)) for r in others)}) == 6


def test_index_is_made_once_and_found_again(spark, tmp_path):
    suite = suite_of(spark, [(1, words(20)), (2, "one two three four five")])
    docs = spark.createDataFrame([(1, words(20)), (2, "x " + words(20)), (3, "one two three four five. six"), (4, None), (5, "nothing like it")], "doc_id int, text string")
    first, made = X.kept_index(suite, str(tmp_path), buckets=4)
    want = sorted(map(tuple, X.verdicts(docs, suite).collect()))
    assert made and sorted(map(tuple, X.verdicts_by(docs, first).collect())) == want
    for name in spark.catalog.listTables():  # as in a session of its own
        if name.name.startswith("suite_index_"):
            spark.sql(f"DROP TABLE {name.name}")
    again, made = X.kept_index(suite.repartition(3), str(tmp_path), buckets=4)
    assert not made and sorted(map(tuple, X.verdicts_by(docs, again).collect())) == want
    # Only the index and the documents are read.
    assert set(X.verdicts_by(docs, again).inputFiles()) == set(again.inputFiles()) and all(str(tmp_path) in f for f in again.inputFiles())


def test_index_is_not_exchanged(spark, tmp_path):
    suite = suite_of(spark, [(i, words(30, 7 * i)) for i in range(50)])
    docs = spark.createDataFrame([(i, words(40, 11 * i)) for i in range(50)], "doc_id int, text string")
    idx, _ = X.kept_index(suite, str(tmp_path), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = X.verdicts_by(docs, idx)
        plan = found._jdf.queryExecution().executedPlan().toString()
        want = sorted(map(tuple, X.verdicts(docs, suite).collect()))
        assert sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # One exchange of the documents' pieces into the index's buckets, one for the sums of a document.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("hashpartitioning(h") == 1


def test_another_suite_is_another_index_and_broken_builds_are_none(spark, tmp_path):
    suite = suite_of(spark, [(1, words(20))])
    idx, _ = X.kept_index(suite, str(tmp_path), buckets=2)
    more, made = X.kept_index(suite.union(suite_of(spark, [(2, words(20, 100))])), str(tmp_path), buckets=2)
    assert made and more.count() > idx.count()
    for folder in tmp_path.iterdir():
        (folder / "_SUCCESS").unlink()
    assert X.kept_index(suite, str(tmp_path), buckets=2)[1]
    shutil.rmtree(tmp_path)


def test_empty_suite(spark, tmp_path):
    docs = spark.createDataFrame([(1, words(30))], "doc_id int, text string").withColumn("h", F.lit(1))
    idx, made = X.kept_index(suite_of(spark, []), str(tmp_path), buckets=2)
    assert made and X.verdicts_by(docs, idx).count() == 0
