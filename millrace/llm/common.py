"""Reading tables, scratch tables in the shared folder, and word arrays over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python holds one slice of about so many bytes of text at a time (a longer text is a slice of its own).
SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null id within an operator: after all other ids.
NO_ID = (1 << 63) - 1


def with_id(name: str = "doc_id") -> Column:
    """A long id, NO_ID for null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def id_back(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, a new temporary one under a local master, where it
    is shared by nature. On a cluster such a folder would be one machine's own, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Rows are whole documents here, so Arrow batches of the default 10,000 rows are large: 2,000, unless the session says
    something else."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


class Scratch:
    """Written tables that cut lineage. They survive lost executors, being in the shared folder."""

    #: Folders of this process, until `clear`.
    roots: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        Scratch.roots.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        _delete(self.spark, [df.scratch_path for df in dfs])

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        """Delete all tables of this process: for callers who have written the results that read them."""
        _delete(spark, cls.roots)
        cls.roots.clear()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for found in paths:
        path = jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(conf).delete(path, True)


def collected(df: DataFrame) -> pd.DataFrame:
    """A bounded table on the driver, by way of Arrow."""
    return df.toArrow().to_pandas()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    """Freed memory goes back to the system: the worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over Arrow batches that gives freed memory back at the end."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def tidy_group(run):
    """A function of a group that gives freed memory back after each."""

    @functools.wraps(run)
    def tidied(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(pdf)
        finally:
            _give_back()

    return tidied


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of slices of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ([^\\x20\\x09-\\x0D]+) and, for each text, the index of its first word (one more at the end)."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = cut[cut > 0] - 1
    last[cut] = solid[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes, A-Z lower-cased; the same on every machine."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    codes = (_LOWER[data] if lower else data).astype(np.uint64)
    codes += np.uint64(1)
    codes *= up[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_STEPS = [np.uint64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word windows; of the whole sequence if it is shorter; none without words. At most 5 words a window."""
    if not len(words):
        return words
    width = min(k, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total += words[i : len(words) - width + 1 + i] * _STEPS[i]
    return mix(total)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


#: Packed numbers in a range, about; what one task holds when it gathers them.
RANGE = 4_000_000


def packed(x: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers as little-endian bytes of the smallest common width."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def ranges_of(spark, n_hashes: int) -> int:
    """Ranges that so many hashes are cut into."""
    return max(2 * partitions(spark), -(-n_hashes // RANGE))


def by_range(sent: DataFrame, n_ranges: int):
    """Grouped by range, in as many partitions as the ranges need."""
    few = partitions(sent.sparkSession)
    return (sent.repartition(n_ranges // 2, "range") if n_ranges > 2 * few else sent).groupBy("range")
