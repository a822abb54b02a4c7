"""Readers and writers. Each takes paths of any store that Spark reads."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .progress import Progress

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("state", T.StringType()),
        T.StructField("questions", T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("instructions", T.StringType()), T.StructField("criteria", T.MapType(T.StringType(), T.StringType()))]))),
        T.StructField("expected", T.MapType(T.StringType(), T.StringType())),
    ]
)


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, also gzipped, of one or several paths. Broken lines are skipped. Nested values in string fields keep their
    text, so key order survives."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each question of decision records: record_id, source, state (JSON text), qkey, kind, instructions, criteria in
    order, gold."""
    rows = jsonl(spark, path, RECORD)
    each = rows.select("id", "source", "state", "expected", F.explode(F.map_entries("questions")).alias("q"))
    criteria = F.transform(F.map_entries("q.value.criteria"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("desc")))
    return each.select(F.col("id").alias("record_id"), "source", "state", F.col("q.key").alias("qkey"), F.col("q.value.type").alias("kind"), F.col("q.value.instructions").alias("instructions"), criteria.alias("criteria"), F.col("expected")[F.col("q.key")].alias("gold"))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line feeds and fields of any length."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1)
    return (reader.schema(schema) if schema else reader).csv(path)


def wide_metrics(table: DataFrame, time: str) -> DataFrame:
    """time, metric, value of a table with a column for each metric; what is no number goes."""
    others = [c for c in table.columns if c != time]
    long = table.select(F.col(time).cast("double").alias("time"), *(F.col(c).cast("string").alias(c) for c in others)).unpivot("time", others, "metric", "value")
    return long.withColumn("value", F.col("value").try_cast("double")).filter("value is not null")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def early_sample(spark: SparkSession, path: str, n: int, seed: str | int, key: str, buffer: int = 10_000, where: str = "true") -> DataFrame:
    """n rows of a table's files that meet a condition, drawn from a pool that is filled from files in a drawn order until it has
    `buffer` rows or more (and n); files beyond are not read. Like a shuffle buffer over a stream of files: what is drawn is random
    within the pool, and the pool follows the order of the files. Files are counted some at a time, four times as many with each go."""
    files = sorted(spark.read.parquet(path).inputFiles(), key=lambda f: (hashlib.md5(f"{seed}:{f.rpartition('/')[2]}".encode()).hexdigest(), f))
    schema = spark.read.parquet(path).schema
    some = lambda lo, hi: spark.read.schema(schema).parquet(*files[lo:hi]).filter(where)
    held, lo, step = 0, 0, 1
    while lo < len(files) and held < max(n, buffer):
        counts = {r.f: r["count"] for r in some(lo, lo + step).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()}  # a row a file
        for f in files[lo : lo + step]:
            lo, held = lo + 1, held + counts.get(unquote(f.rpartition("/")[2]), 0)
            if held >= max(n, buffer):
                break
        step *= 4
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return some(0, lo).orderBy(draw, key).limit(n) if files else spark.read.parquet(path).limit(0)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, position, line: position counts the lines of each file from 0 (text files are numbered within their splits, which
    a whole file is as long as wholetext reads it)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("position", "line"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, folder, text of whole files; the folder's name serves as label."""
    found = spark.read.text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("file"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"), F.col("value").alias("text"))


def document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document over several lines."""
    return spark.read.option("multiLine", True).json(path)


def patterns(spark: SparkSession, path: str) -> str:
    """An alternation of a file's patterns, one a line, comments and empty lines left out."""
    found = [r.value.strip() for r in spark.read.text(path).collect()]
    return "|".join(f"(?:{p})" for p in found if p and not p.startswith("#"))


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the output doesn't have yet; returns their number, which is counted as they are written. A rerun
    goes on where the last one ended. One writer at a time: two could both add a key."""
    spark = df.sparkSession
    try:
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    with Progress() as progress:
        progress.counted(df).write.mode("append").parquet(path)
    return progress.rows


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, sha256 of each table: the digest of its rows' digests in order of their own, so it doesn't hang on partitions.
    Row digests are folded by 256 prefixes, so no task holds all of them."""
    spark, out = next(iter(tables.values())).sparkSession, None
    for name, df in tables.items():
        row = df.select(F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("h"))
        part = row.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
        one = part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))
        one = one.select(F.lit(name).alias("name"), "rows", "sha256")
        out = one if out is None else out.unionByName(one)
    return out


def report(df: DataFrame, path: str) -> str:
    """A small table as one JSON text on the driver, with its sha256; for reports of known size."""
    text = json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=False, sort_keys=True, default=str)
    with open(path, "w") as f:
        f.write(text)
    return hashlib.sha256(text.encode()).hexdigest()
