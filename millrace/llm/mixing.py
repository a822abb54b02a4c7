"""Mixing sources to target weights by the cube method.

Every document of a source has the same inclusion rate target / size of source: a whole part, taken for sure, and a
fraction. The cube method moves the fractions within the null space of two constraints, number of documents and words, so
that both totals of a source stay as they are while fractions go to 0 or 1. It runs in blocks of a bounded size, dealt by a
hash; each block leaves two fractions at most, which meet in blocks again until a source has one block. There the flight
leaves out some ten documents of spread sizes; they and the last two fractions are the landing problem, rounded in the way,
of all, that misses the words least.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0 take part and add
no words; repeated rows and ties are documents each, told apart by a hash where they differ; a null doc_id stays null; an
empty table gives no rows; other columns are ignored by `mix_sources` and kept by `mixed`. The same input gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import running
from .common import Scratch, id_back, numbers, text_slices, tidy, with_id, word_bounds

WEIGHTS, MOST_REPEATS, BLOCK = (5, 2, 1), 3, 192
#: Equal rows (doc_id, source, size) that one task numbers.
RUN = 10_000
#: Documents whose repeats are sent to all tasks (some 40 bytes each) rather than joined.
FEW_IDS = 500_000
_TINY = 1e-9


def _measured(batch: pa.RecordBatch, name: str = "size") -> pa.RecordBatch:
    """The batch with the number of words of its texts."""
    sizes = [np.diff(word_bounds(data, offsets)[2]) for _, _, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text")))]
    size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(size)], [*batch.schema.names, name])


@tidy
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _measured(batch).drop_columns(["text"])


@tidy
def _with_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _measured(batch, "__size")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""
    return docs.select(with_id(), F.col("source").cast("string"), "text").mapInArrow(_sizes, "doc_id bigint, source string, size bigint")


def told_apart(sized: DataFrame) -> DataFrame:
    """Rows with a number, copy, among those that are equal, so a hot id is dealt over all blocks. Equal rows may stand for each
    other, so counting and unfolding them gives the same rows, and any numbering the same result."""
    by = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("__k"))
    if not by.filter(F.col("__k") > RUN).isEmpty():
        by = by.withColumn("__from", F.explode(F.sequence(F.lit(0), F.col("__k") - 1, F.lit(RUN)))).repartition("doc_id", "source", "size", "__from")
    else:
        by = by.withColumn("__from", F.lit(0).cast("long"))
    until = F.least(F.col("__k"), F.col("__from") + RUN) - 1
    return by.select("doc_id", "source", "size", F.explode(F.sequence("__from", until)).alias("copy"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, n, source_size, target. Weights repeat over the sources by code point, null last. A target stops at `most` times
    the size; what is over goes to the others by weight, until none is above. That level is found from running sums over the
    sources by the level at which each stops."""
    by = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    stops = (most * F.col("source_size") / F.col("weight")).alias("stops")
    order = Window.orderBy("stops", F.col("source").asc_nulls_last())
    every, upto = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("stops", stops).withColumn("k", F.row_number().over(order)).withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_weight", F.sum("weight").over(every))
    by = by.withColumn("level", (F.col("total") - F.sum(most * F.col("source_size")).over(upto) + most * F.col("source_size")) / (F.col("all_weight") - F.sum("weight").over(upto) + F.col("weight")))
    # The first source that doesn't stop below its level sets the level for itself and all after it.
    level = F.min(F.when(F.col("stops") >= F.col("level"), F.struct("k", "level"))).over(every)["level"]
    by = by.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.coalesce(level, F.col("stops")) * F.col("weight")))
    return by.select("source", "n", "source_size", "target")


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Move the fractions p until at most two are left, keeping sum(p) and sum(p * size)."""
    p = p.copy()
    hold: list[int] = []
    for i in np.flatnonzero((p > _TINY) & (p < 1 - _TINY)).tolist():
        hold.append(i)
        if len(hold) < 3:
            continue
        a, b, c = hold
        # Null vector of [[1, 1, 1], sizes].
        u = [float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b])]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        scale = max(map(abs, u))
        u = [x / scale for x in u]
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(hold, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(hold, u, strict=True) if x)
        # A martingale step: up or down, each as likely as the other step is long.
        draw = ((a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ c * 0x165667B19E3779F9) >> 11) % 1_000_003 / 1_000_003
        step = up if draw < down / (up + down) else -down
        for i, x in zip(hold, u, strict=True):
            p[i] += step * x
            if p[i] < _TINY:
                p[i] = 0.0
            elif p[i] > 1 - _TINY:
                p[i] = 1.0
        hold = [i for i in hold if 0 < p[i] < 1]
    p[p <= _TINY] = 0
    p[p >= 1 - _TINY] = 1
    return p


def landing(p: np.ndarray, size: np.ndarray, spread: int = 10) -> np.ndarray:
    """Flight without `spread` of the fractions, then the rounding of all that are left that misses the words least."""
    p, open_ = p.copy(), np.flatnonzero((p > _TINY) & (p < 1 - _TINY))
    by_size = open_[np.argsort(size[open_], kind="stable")]
    held = by_size[np.unique(np.linspace(0, len(by_size) - 1, spread).astype(int))] if len(by_size) > spread else by_size
    rest = np.setdiff1d(open_, held)
    p[rest] = flight(p[rest], size[rest])
    open_ = np.flatnonzero((p > _TINY) & (p < 1 - _TINY))
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    miss = np.abs((ways - p[open_]) @ size[open_].astype(float))
    p[open_] = ways[np.lexsort((np.abs((ways - p[open_]).sum(1)), miss))[0]]
    return np.round(p)


_STATE = "doc_id bigint, source string, size bigint, source_size bigint, target double, whole int, p double, salt bigint, blocks bigint"


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["salt", "doc_id", "size"], kind="stable", ignore_index=True)
    size = pdf["size"].to_numpy()
    p = (landing if pdf["blocks"].iloc[0] <= 1 else flight)(pdf["p"].to_numpy(), size)
    return pdf.assign(p=p)[[c.split()[0] for c in _STATE.split(", ")]]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken of documents (doc_id, source, text): how often the mix takes each."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(told_apart(sizes(docs)))
    goal = scratch.keep(targets(sized, weights, most))
    largest = goal.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    joined = sized.join(F.broadcast(goal), sized["source"].eqNullSafe(goal["source"])) if goal.count() <= 10_000 else sized.join(goal, sized["source"].eqNullSafe(goal["source"]))
    state = joined.select("doc_id", sized["source"], "size", "source_size", "target", F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("p"), F.xxhash64(F.lit("mix"), "doc_id", "size", "copy").alias("salt"), F.ceil(F.col("n") / block).alias("blocks"))
    done, n = [], largest
    while True:
        blocks = max(1, -(-n // block))
        moved = scratch.keep(state.groupBy("source", F.pmod(F.xxhash64("salt", F.lit(len(done))), F.col("blocks"))).applyInPandas(_round, _STATE))
        if blocks == 1:
            done.append(moved)
            break
        done.append(moved.filter("p <= 0 or p >= 1"))
        # Two fractions a block at most are left: so many blocks come next.
        n = 2 * blocks
        state = moved.filter("p > 0 and p < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    repeats = F.col("whole") + F.col("p").cast("int")
    return out.select(id_back(), "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK) -> DataFrame:
    """The documents, with all their columns, each as often as the mix takes it. Rows of one id, source and size share their repeats,
    those of smaller hash one more where it doesn't divide; so rows of one id, or without one, don't meet in one task."""
    scratch, same = Scratch(docs.sparkSession, "mixed"), ["__id", "__source", "__size"]
    times = mix_sources(docs, weights, most, block).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    times = scratch.keep(times.agg(F.sum("repeats").alias("__n"), F.count("*").alias("__rows")))
    few = times.count() <= FEW_IDS

    def joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        on = F.lit(True)
        for k in keys:
            on &= rows[k].eqNullSafe(other[k])
        return rows.join(F.broadcast(other) if few else other, on).select(rows["*"], *(other[c] for c in other.columns if c not in keys))

    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__h": F.xxhash64(*docs.columns), "__h2": F.xxhash64(F.lit(1), *docs.columns)})
    rows = rows.mapInArrow(_with_size, T.StructType([*rows.schema.fields, T.StructField("__size", T.LongType())]))
    whole, over = F.floor(F.col("__n") / F.col("__rows")), F.pmod("__n", "__rows")
    out = joined(rows, times, same).withColumn("__times", whole)
    parted = times.filter(over > 0)
    if not parted.isEmpty():
        # Equal rows are counted before they are ranked, and ranked without their texts.
        counts = joined(rows.select(*same, "__h", "__h2"), parted, same).groupBy(*same, "__h", "__h2", "__n", "__rows").agg(F.count("*").alias("__equal"))
        ranked = running(scratch.keep(counts), same, ["__h", "__h2"], __k=F.col("__equal"))
        more = F.greatest(F.lit(0), F.least(over - F.col("__k_before"), F.col("__equal")))
        ranked = scratch.keep(ranked.select(*same, "__h", "__h2", "__equal", more.alias("__more")))
        few = ranked.count() <= FEW_IDS
        plain = joined(rows, times.filter(over == 0), same).withColumn("__times", whole)
        shared = joined(joined(rows, parted, same).withColumn("__times", whole), ranked, [*same, "__h", "__h2"])
        all_or_none = (F.col("__more") == 0) | (F.col("__more") == F.col("__equal"))
        each = shared.filter(all_or_none).withColumn("__times", F.col("__times") + F.when(F.col("__more") > 0, 1).otherwise(0))
        # Of equal rows of which some are taken once more, one stands for all.
        one = shared.filter(~all_or_none).groupBy(*same, "__h", "__h2").agg(F.first(F.struct(*docs.columns)).alias("__row"), F.first(F.col("__times") * F.col("__equal") + F.col("__more")).alias("__times"))
        columns = [*docs.columns, "__times"]
        out = plain.select(*columns).unionByName(each.select(*columns)).unionByName(one.select("__row.*", "__times"))
    return out.filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)
