"""Decontamination against a held-out suite: segment and n-gram overlap.

Pieces meet by a 64-bit hash, so a shuffle moves 8 bytes for each and not some hundred characters; hashes never show in
results. The suite's index is small by nature but not by proof, so its joins are left to the planner, which broadcasts it where
its size allows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import children

MOST_SUITE_ROWS, GRAM_SHARE = 20, 0.2


def grams_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, grams: hashes of 13-word windows. Words are a projection of their own: inside the windows' expression they would be
    found again for each."""
    return docs.select(key, T.words(text).alias("w")).select(key, T.gram_hashes("w").alias("grams"))


def hashed(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.xxhash64(p))


def by_hash(idx: DataFrame) -> DataFrame:
    """h of an index's pieces."""
    return idx.select(F.xxhash64("piece").alias("h"))


def index(suite: DataFrame, pieces, key: str = "item_id", most: int = MOST_SUITE_ROWS) -> DataFrame:
    """Pieces of the suite that stand in at most `most` of its rows: piece, df. pieces: expression of an array."""
    each = suite.select(key, F.explode(F.array_distinct(pieces)).alias("piece"))
    return each.groupBy("piece").agg(F.count("*").alias("df")).filter(F.col("df") <= most)


def without(idx: DataFrame, allowed: DataFrame) -> DataFrame:
    """An index without allowed pieces (piece)."""
    return idx.join(allowed, "piece", "left_anti")


def corpus_common(docs: DataFrame, idx: DataFrame, pieces, least: int, key: str = "doc_id") -> DataFrame:
    """Suite pieces that `least` documents or more have: boilerplate, to be taken out of the index."""
    each = docs.select(key, F.explode(F.array_distinct(pieces)).alias("piece")).withColumn("h", F.xxhash64("piece")).join(by_hash(idx), "h", "left_semi")
    return each.groupBy("piece").agg(F.count("*").alias("df")).filter(F.col("df") >= least)


def hashes(suite: DataFrame, suite_key: str = "item_id", segment_index: DataFrame | None = None) -> DataFrame:
    """h, segment: the suite's index as hashes, true for segments and false for 13-grams."""
    seg = index(suite, T.segments("text"), suite_key) if segment_index is None else segment_index
    gram = index(grams_of(suite, suite_key, "text"), F.col("grams"), suite_key)
    return by_hash(seg).select("h", F.lit(True).alias("segment")).unionByName(gram.select(F.col("piece").alias("h"), F.lit(False).alias("segment"))).distinct()


def verdicts(docs: DataFrame, suite: DataFrame, key: str = "doc_id", text: str = "text", suite_key: str = "item_id", share: float = GRAM_SHARE, segment_index: DataFrame | None = None) -> DataFrame:
    """key, why of contaminated documents: "segment" on any shared segment, else "ngram" if the share of 13-grams (repeats
    counted) that the suite has is `share` or more."""
    return verdicts_by(docs, hashes(suite, suite_key, segment_index), key, text, share)


def verdicts_by(docs: DataFrame, suite_hashes: DataFrame, key: str = "doc_id", text: str = "text", share: float = GRAM_SHARE) -> DataFrame:
    """`verdicts` by an index (h, segment)."""
    known = suite_hashes.withColumn("hit", F.lit(1))
    # One pass: both kinds of pieces of a text meet the index together and shrink to two numbers before the exchange.
    kinds = docs.select(key, T.words(text).alias("w"), hashed(T.segments(text)).alias("s"))
    tagged = lambda xs, kind: F.transform(xs, lambda h: F.struct(h.alias("h"), F.lit(kind).alias("segment")))
    pieces = kinds.select(key, F.concat(tagged(F.array_distinct("s"), True), tagged(T.gram_hashes("w"), False)).alias("pieces"))
    # An outer explode: for a plain one the optimizer infers a filter on the array and evaluates it from the text once more.
    each = pieces.select(key, F.explode_outer("pieces").alias("p")).filter("p is not null").select(key, "p.*")
    hit = F.coalesce("hit", F.lit(0))
    by = each.join(known, ["h", "segment"], "left").groupBy(key).agg(F.max(F.when(F.col("segment"), hit)).alias("segment"), F.avg(F.when(~F.col("segment"), hit)).alias("mean"))
    why = F.when(F.col("segment") == 1, "segment").when(F.col("mean") >= share, "ngram")
    return by.select(key, why.alias("why")).filter("why is not null")


#: Rules that an index is made by; another number is another index.
RULES = 1


def fingerprint(suite: DataFrame, suite_key: str = "item_id") -> str:
    """A digest of the suite's rows, whatever their order and partitions, and of the rules that its index is made by."""
    row = F.xxhash64(F.struct(suite_key, "text"))
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("string")
    found = suite.agg(F.count("*").alias("n"), total(row).alias("a"), total(F.xxhash64(row, F.lit(7))).alias("b")).first()
    rules = f"{RULES}:{T.GRAM_WORDS}:{T.SEGMENT_WORDS}:{MOST_SUITE_ROWS}"
    return hashlib.sha256(f"{found.n}:{found.a}:{found.b}:{rules}".encode()).hexdigest()[:32]


def kept_index(suite: DataFrame, root: str, suite_key: str = "item_id", buckets: int = 64) -> tuple[DataFrame, bool]:
    """The suite's index (h, segment) as a bucketed table in `root`, and whether it was made by this call. It is made once for a suite
    and its rules; a later session that has the folder finds it there. Documents are then exchanged to its buckets, the table itself
    isn't, or is broadcast where it is small. A build that was broken off is not taken for one, and of two builders at once both make
    a whole one."""
    spark, mark = suite.sparkSession, fingerprint(suite, suite_key)
    pattern = f"{mark}-{buckets}-*"
    found = children(spark, root, pattern, "_SUCCESS")
    if not found:
        path = f"{root}/{pattern[:-1]}{uuid.uuid4().hex[:8]}"
        _table(spark, path, buckets)
        hashes(suite, suite_key).repartition(buckets, "h", "segment").write.insertInto(_name(path))
        return spark.table(_name(path)), True
    _table(spark, found[0], buckets)
    return spark.table(_name(found[0])), False


def _name(path: str) -> str:
    return "suite_index_" + path.rpartition("/")[2].replace("-", "_")


def _table(spark: SparkSession, path: str, buckets: int) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} (h BIGINT, segment BOOLEAN) USING parquet CLUSTERED BY (h, segment) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{path}'")


def report(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """source, why (kept or the reason), n."""
    return docs.select(key, "source").join(found, key, "left").groupBy("source", F.coalesce("why", F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


def sharing_any_gram(docs: DataFrame, suite: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of documents with at least one 13-gram of the suite."""
    grams = grams_of(suite.withColumn("__k", F.lit(0)), "__k", "text").select(F.explode_outer("grams").alias("h")).filter("h is not null").distinct()
    return grams_of(docs, key, text).select(key, F.explode(F.array_distinct("grams")).alias("h")).join(grams, "h", "left_semi").select(key).distinct()
