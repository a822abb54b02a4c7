"""Samples that stop reading early, and counts that come with the run."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.sources import io
from millrace.sources.progress import Progress


@pytest.fixture
def parts(spark, tmp_path):
    """40 files of 50 rows each."""
    spark.range(0, 2000, 1, 40).select("id", (F.col("id") % 3).alias("kind")).write.parquet(f"{tmp_path}/t.parquet")
    return f"{tmp_path}/t.parquet"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_early_sample_reads_the_files_it_needs(spark, parts):
    got = io.early_sample(spark, parts, 30, "s", "id", buffer=120)
    assert len(ids(got)) == 30 and len(got.inputFiles()) == 3
    assert ids(io.early_sample(spark, parts, 30, "s", "id", buffer=120)) == ids(got)
    pool = {r.id for r in spark.read.parquet(*got.inputFiles()).collect()}
    assert set(ids(got)) < pool and len({i // 50 for i in ids(got)}) == 3
    few = io.early_sample(spark, parts, 30, "s", "id", buffer=120, where="kind = 0")
    assert all(i % 3 == 0 for i in ids(few)) and 7 <= len(few.inputFiles()) <= 9


def test_early_sample_of_more_than_there_is(spark, parts):
    assert ids(io.early_sample(spark, parts, 5000, "s", "id")) == [*range(2000)]
    assert ids(io.early_sample(spark, parts, 5, "s", "id", where="id < 0")) == []


def test_early_sample_is_even(spark, parts):
    """Over seeds, files and places within them are drawn about equally often."""
    seen = Counter(i for seed in range(25) for i in ids(io.early_sample(spark, parts, 40, seed, "id", buffer=200)))
    by_file, by_place = Counter(), Counter()
    for i, n in seen.items():
        by_file[i // 50] += n
        by_place[i % 50 // 10] += n
    assert len(by_file) > 30 and all(140 <= by_place[k] <= 260 for k in range(5))


def test_progress_counts_with_the_run(spark, tmp_path):
    with Progress(odd=F.col("id") % 2 == 1) as p:
        p.counted(spark.range(101)).write.parquet(f"{tmp_path}/out")
    assert p.rows == 101 and p.counts["odd"] == 50 and p.rate > 0
    assert p.remaining(202) == pytest.approx(101 / p.rate)


def test_append_new_counts_what_it_writes(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert io.append_new(spark.range(10), path, "id") == 10
    assert io.append_new(spark.range(5, 15), path, "id") == 5
    assert io.append_new(spark.range(3), path, "id") == 0
    assert spark.read.parquet(path).count() == 15
