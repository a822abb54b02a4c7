"""N-gram Jaccard join: near duplicates on word shingles by a grouped prefix join.

A document's set is its distinct 5-word shingles. Shingles are put in one order for all documents, rare before frequent; two
sets of similarity 0.8 or more share one of their first n - ceil(0.8 n) + 1 shingles. Documents with the same prefix and size
are one group; groups that share a prefix shingle are candidates, filtered by size and position; candidates are then expanded
to their member sets and verified on whole sets.

How it stays in bounds:
* Equal sets are one node, whatever their ids; copies never meet in pairs. A node's number is its own; ids only name the
  components at the end.
* Arrays of hashes are cut into ranges by the volume of the text, so a task's share is the same at every size.
* The most frequent shingles, at most HOT of them by an exact count over all documents, come last in the order. Any order
  gives the same links; this one keeps shared passages out of prefixes.
* Prefix shingles are sent as packed arrays by hash range, and only those that two groups share come back as rows.
* In each list of a shared shingle all members are verified against the most central one (the one with the fewest rarer
  shingles). What that links is one component, and only pairs across components are then made from the list, of sizes that
  can match, the smaller set by its index prefix (n - ceil(2 * 0.8 n / 1.8) + 1 shingles). No link between different texts is
  lost for components; links inside a component needn't all be found.

Defined cases: a null text, or one without words, has n_shingles 0 and is its own component; a text of fewer than 5 words has
one shingle, the whole; rows are documents each, so rows without an id, or with one id and different texts, are linked by their
texts alone; a null doc_id comes after all others, and a component without any other is null in the result; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_range, collected, id_back, mix, numbers, packed, ranges_of, shingle_hashes, text_slices, tidy, tidy_group, unpacked, with_id, word_bounds, word_hashes
from .components import components

WORDS, PERCENT, HOT = 5, 80, 1 << 20
#: Hashes that a task holds before it sends them; candidate pairs that are sent to all tasks (64 bytes each) rather than joined.
FLUSH, FEW_PAIRS = 1_500_000, 1_000_000
#: Dropped rows' keys that are sent to all tasks (some 30 bytes each) rather than joined.
FEW_IDS = 1_000_000
_SHIFT = np.uint64(24)  # tokens are 40 bits of a shingle's hash; sets are verified on 48


def document_sets(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a batch's texts, of the rows wanted."""
    column = batch.column(batch.schema.get_field_index("text"))
    rows = np.arange(len(column)) if wanted is None else wanted
    if wanted is not None:
        column = column.take(pa.array(wanted))
    for lo, _, data, offsets in text_slices(column):
        starts, ends, first = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            yield int(rows[lo + i]), np.unique(shingle_hashes(words[a:b], WORDS))


def _ranges(tokens: np.ndarray, n: int) -> np.ndarray:
    """Bounds of n equal ranges of 40-bit tokens within sorted tokens."""
    edges = [((i << 40) + n - 1) // n for i in range(n + 1)]
    return np.searchsorted(tokens, np.array(edges, np.uint64))


def _count_map(n_ranges: int):
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held) >> _SHIFT, return_counts=True)
        at, out = _ranges(tokens, n_ranges), []
        for r in range(n_ranges):
            own, n = tokens[at[r] : at[r + 1]], counts[at[r] : at[r + 1]]
            if len(own):
                gaps, width = packed(np.diff(own))
                many = np.flatnonzero(n > 1)
                out.append((r, int(own[0]), gaps, width, many.astype("<u4").tobytes(), n[many].astype("<u4").tobytes()))
        cols = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "first", "gaps", "width", "many", "n"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, own in document_sets(batch):
                if len(own):
                    held.append(own)
                    n += len(own)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _count_reduce(least: int):
    @tidy_group
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in pdf.itertuples():
            tokens = np.cumsum(np.concatenate([np.array([r.first], np.uint64), unpacked(r.gaps, r.width)]), dtype=np.uint64)
            times = np.ones(len(tokens), np.int64)
            times[np.frombuffer(r.many, "<u4")] = np.frombuffer(r.n, "<u4")
            parts.append((tokens, times))
        tokens = np.concatenate([t for t, _ in parts])
        order = np.argsort(tokens)
        tokens, times = tokens[order], np.concatenate([n for _, n in parts])[order]
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.add.reduceat(times, at)
        keep = df >= least
        return pd.DataFrame({"token": tokens[at][keep].astype(np.int64), "df": df[keep]})

    return run


def frequent(docs: DataFrame, scratch: Scratch, most: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingle tokens over all documents, `most` at most: tokens in order, and their ranks by rising count."""
    spark = docs.sparkSession
    # A shingle for about 6 bytes of text.
    n = ranges_of(spark, (docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // 6)
    sent = docs.select("text").mapInArrow(_count_map(n), "range int, first bigint, gaps binary, width int, many binary, n binary")
    counts = scratch.keep(by_range(sent, n).applyInPandas(_count_reduce(least), "token bigint, df bigint"))
    # Counts from 2^16 on are told apart by their power of two only; the list of counts stays small.
    level = F.when(F.col("df") < 65536, F.col("df")).otherwise(F.floor(F.log2("df")).cast("long") * 65536)
    by = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, floor = 0, None
    for x, k in by:
        if total + k > most:
            break
        total, floor = total + k, x
    found = collected(counts.filter(level >= floor)) if floor is not None else pd.DataFrame({"token": [], "df": []}, dtype=np.int64)
    scratch.drop(counts)
    tokens, df = found["token"].to_numpy().astype(np.uint64), found["df"].to_numpy()
    rank = np.empty(len(tokens), np.uint64)
    rank[np.lexsort((tokens, df))] = np.arange(len(tokens), dtype=np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(hot, percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = hot.value
        for batch in batches:
            ids, keys = numbers(batch, "doc_id"), numbers(batch, "h")
            out = {k: [] for k in ("doc_id", "h", "n", "f1", "f2", "g", "prefix", "cold")}
            for row, own in document_sets(batch):
                out["doc_id"].append(ids[row])
                out["h"].append(keys[row])
                out["n"].append(len(own))
                if not len(own):
                    for k, x in (("f1", 0), ("f2", 0), ("g", 0), ("prefix", b""), ("cold", 0)):
                        out[k].append(x)
                    continue
                token = own >> _SHIFT
                key, cold = own >> np.uint64(1), len(own)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
                    is_hot = tokens[at] == token
                    key[is_hot] = np.uint64(1 << 63) | (ranks[at[is_hot]] << _SHIFT) | (own[is_hot] & np.uint64(0xFFFFFF))
                    cold -= int(is_hot.sum())
                prefix = token[np.argsort(key)][: prefix_size(len(own), percent)]
                scrambled = mix(own ^ np.uint64(0x51_7C_C1_B7_27_22_0A_95))
                out["f1"].append(int(scrambled.sum(dtype=np.uint64).view(np.int64)))
                out["f2"].append(int(np.bitwise_xor.reduce(mix(scrambled + np.uint64(1))).view(np.int64)))
                out["g"].append(int(mix(prefix + (np.arange(len(prefix), dtype=np.uint64) << np.uint64(40))).sum(dtype=np.uint64).view(np.int64)))
                out["prefix"].append(prefix.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                out["cold"].append(min(cold, len(prefix)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


_ROWS = "doc_id bigint, h bigint, n int, f1 bigint, f2 bigint, g bigint, prefix binary, cold int"
_LISTS = "token bigint, node bigint, n int, pos int"
_SETS = "key bigint, id bigint, own binary"


@tidy
def _hot_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """List entries of the frequent tokens, which stand at the end of a prefix."""
    for batch in batches:
        gid, n, cold = (numbers(batch, k) for k in ("gid", "n", "cold"))
        sizes, tokens, pos = [], [], []
        for i, raw in enumerate(batch.column(batch.schema.get_field_index("prefix"))):
            own = unpacked(raw.as_py(), 5)[cold[i] :]
            sizes.append(len(own))
            tokens.append(own)
            pos.append(np.arange(cold[i], cold[i] + len(own), dtype=np.int32))
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.repeat(gid, sizes)), pa.array(np.repeat(n, sizes)), pa.array(np.concatenate(pos))], ["token", "node", "n", "pos"])


def _cold_map(n_ranges: int):
    def flush(held: list[tuple]) -> pa.RecordBatch:
        token = np.concatenate([h[0] for h in held])
        sizes = [len(h[0]) for h in held]
        gid, n = np.repeat([h[1] for h in held], sizes), np.repeat([h[2] for h in held], sizes)
        pos = np.concatenate([np.arange(k) for k in sizes])
        order = np.argsort(token)
        token, gid, n, pos = token[order], gid[order], n[order], pos[order]
        at, out = _ranges(token, n_ranges), []
        for r in range(n_ranges):
            cut = slice(at[r], at[r + 1])
            if at[r] < at[r + 1]:
                base = int(gid[cut].min())
                out.append((r, int(token[at[r]]), base, *packed(np.diff(token[cut])), *packed((gid[cut] - base).astype(np.uint64)), *packed(n[cut].astype(np.uint64)), *packed(pos[cut].astype(np.uint64))))
        kinds = (pa.int32(), pa.int64(), pa.int64(), *(pa.binary(), pa.int32()) * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], _BLOBS.replace(" int", "").replace(" bigint", "").replace(" binary", "").split(", "))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            gid, n, cold = (numbers(batch, k) for k in ("gid", "n", "cold"))
            for i, raw in enumerate(batch.column(batch.schema.get_field_index("prefix"))):
                own = unpacked(raw.as_py(), 5)[: cold[i]]
                if len(own):
                    held.append((own, gid[i], n[i]))
                    total += len(own)
                if total >= FLUSH:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    return run


_BLOBS = "range int, first bigint, base bigint, gaps binary, gw int, ids binary, iw int, ns binary, nw int, at binary, aw int"


@tidy_group
def _cold_reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    """List entries of the tokens that two groups or more have."""
    token = np.concatenate([np.cumsum(np.concatenate([np.array([r.first], np.uint64), unpacked(r.gaps, r.gw)]), dtype=np.uint64) for r in pdf.itertuples()])
    order = np.argsort(token)
    token = token[order]
    same = token[1:] == token[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    pick = order[shared]
    gid = np.concatenate([unpacked(r.ids, r.iw).astype(np.int64) + r.base for r in pdf.itertuples()])[pick]
    n = np.concatenate([unpacked(r.ns, r.nw) for r in pdf.itertuples()])[pick]
    pos = np.concatenate([unpacked(r.at, r.aw) for r in pdf.itertuples()])[pick]
    return pd.DataFrame({"token": token[shared].astype(np.int64), "node": gid, "n": n.astype(np.int32), "pos": pos.astype(np.int32)})


def _possible(a: str, b: str, percent: int):
    """Size and position filter of a pair that shares a token at pos, with n the sizes."""
    need = F.ceil(F.lit(percent) * (F.col(f"{a}n") + F.col(f"{b}n")) / F.lit(100.0 + percent) - F.lit(1e-9))
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    sizes = 100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")
    return sizes & (rest >= need)


def _set_bytes(own: np.ndarray) -> bytes:
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _sets_for(wanted):
    """wanted.value: of rows (h sorted, doc_id) the node and the keys to send its set by."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, nodes, keys = wanted.value
        for batch in batches:
            docs, h = numbers(batch, "doc_id"), numbers(batch, "h")
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            out = []
            # Copies of a text share its hash; the set is sent for the one whose id is wanted.
            hits = {r: k for r in np.flatnonzero(hi > lo).tolist() if len(k := lo[r] + np.flatnonzero(ids[lo[r] : hi[r]] == docs[r]))}
            for row, own in document_sets(batch, np.array(list(hits), np.int64)):
                raw = _set_bytes(own)
                out += [(int(keys[k]), int(nodes[k]), raw) for k in hits[row].tolist()]
                if len(out) > 2000:
                    yield _set_rows(out)
                    out = []
            if out:
                yield _set_rows(out)

    return run


def _set_rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "id", "own"])


@tidy
def _sets_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, keys = numbers(batch, "id"), numbers(batch, "key")
        out = [(int(keys[row]), int(nodes[row]), _set_bytes(own)) for row, own in document_sets(batch)]
        if out:
            yield _set_rows(out)


def _overlap(percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep, last, x = [], None, None
            for i in range(len(a)):
                raw = left[i].as_buffer()
                if last is None or a[i] != last:
                    last, x = a[i], unpacked(raw, 6)
                y = unpacked(right[i].as_buffer(), 6)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (a, b)], ["a", "b"])

    return run


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n_pairs: int, repeated: bool, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough. docs: doc_id, h, text; nodes: node and the doc_id and h of
    a row that has its set; repeated: whether rows of one doc_id and text occur."""
    spark = docs.sparkSession

    def sets(wanted: DataFrame) -> DataFrame:
        """key, id, own for each (id, key) wanted, once."""
        wanted = wanted.join(nodes.select(F.col("node").alias("id"), "doc_id", "h"), "id")
        if n_pairs <= FEW_PAIRS:
            rows = collected(wanted).sort_values("h")
            value = spark.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("h", "doc_id", "id", "key")))
            out = docs.mapInArrow(_sets_for(value), _SETS)
        else:
            out = docs.join(wanted, ["doc_id", "h"]).select("id", "key", "text").mapInArrow(_sets_joined, _SETS)
        return out.groupBy("key", "id").agg(F.first("own").alias("own")) if repeated else out

    left = sets(pairs.select(F.col("a").alias("id"), F.col("a").alias("key")).distinct()).select(F.col("key").alias("a"), F.col("own").alias("left"))
    right = sets(pairs.select(F.col("b").alias("id"), F.col("a").alias("key"))).select(F.col("key").alias("a"), F.col("id").alias("b"), F.col("own").alias("right"))
    return left.hint("merge").join(right, "a").select("a", "b", "left", "right").mapInArrow(_overlap(percent), "a bigint, b bigint")


def _across(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of list entries (token, node, n, pos, comp) of different components that size and position allow. The smaller
    set of a pair stands in its index prefix, and sizes meet by their logarithm, so lists don't meet in full."""
    both = 100 + percent
    place = F.log("n") / float(np.log(100 / percent)) if percent < 100 else F.log("n") * 1e9
    entry = lambda s: [F.col(c).alias(f"{s}{c}") for c in ("node", "n", "pos", "comp")]
    small = open_.filter(F.expr(f"pos <= n - ({2 * percent} * n + {both - 1}) div {both}"))
    x = small.select("token", *entry("x"), F.explode(F.sequence(F.floor(place - 1e-6), F.floor(place + 1 + 1e-6))).alias("size"))
    y = open_.select("token", *entry("y"), F.floor(place).alias("size"))
    first = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xnode") < F.col("ynode")))
    met = x.join(y, ["token", "size"]).filter(first & (F.col("xcomp") != F.col("ycomp")) & _possible("x", "y", percent))
    return met.groupBy(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).agg(F.count("*").alias("k")).select("a", "b")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h, text; rows of equal doc_id and h are one document repeated."""
    return docs.select(with_id(), F.xxhash64("text").alias("h"), "text")


def labelled(docs: DataFrame, percent: int = PERCENT, hot: int = HOT) -> tuple[DataFrame, bool]:
    """doc_id, h, n_shingles, comp (a number for each component, null without words), component_id, and whether some rows are
    repeated, of documents (doc_id, text)."""
    spark = docs.sparkSession
    docs = _keyed(docs)
    scratch = Scratch(spark, "jaccard")
    listed = spark.sparkContext.broadcast(frequent(docs, scratch, hot))
    rows = scratch.keep(docs.mapInArrow(_prefixes(listed, percent), _ROWS))
    some = rows.filter("n > 0")
    repeated = not some.groupBy("doc_id", "h").agg(F.count("*").alias("k")).filter("k > 1").isEmpty()
    nodes = some.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.min("g").alias("g"))
    nodes = scratch.keep(nodes.select("n", "f1", "f2", "g", "rep.doc_id", "rep.h", F.monotonically_increasing_id().alias("node")))
    # Groups by prefix and size; one of several different sets is expanded to these, and is a list of its own too.
    numbered = nodes.groupBy("n", "g").agg(F.min("node").alias("gid"), F.count("*").alias("k"))
    groups = some.groupBy("n", "g").agg(F.first("prefix").alias("prefix"), F.first("cold").alias("cold")).hint("merge").join(numbered, ["n", "g"])
    n_cold = rows.agg(F.sum(F.col("cold").cast("long")).alias("n")).first().n or 0
    n_ranges = ranges_of(spark, n_cold)
    cold = by_range(groups.mapInArrow(_cold_map(n_ranges), _BLOBS), n_ranges).applyInPandas(_cold_reduce, _LISTS)
    lists = scratch.keep(groups.mapInArrow(_hot_lists, _LISTS).unionByName(cold))
    members = scratch.keep(nodes.join(numbered.filter("k > 1"), ["n", "g"]).select("gid", "node", "n"))
    if not members.isEmpty():
        each = members.select("gid", F.col("node").alias("member"))
        wide = lists.join(each, lists["node"] == each["gid"], "left").select("token", F.coalesce("member", "node").alias("node"), "n", "pos")
        old, lists = lists, scratch.keep(wide.unionByName(members.select((-1 - F.col("gid")).alias("token"), "node", "n", F.lit(0).alias("pos"))))
        scratch.drop(old)
    # First, every entry with the most central one of its list.
    center = lists.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("c"), F.count("*").alias("k")).filter("k > 1")
    star = lists.join(center.select("token", F.col("c.pos").alias("cpos"), F.col("c.node").alias("cnode"), F.col("c.n").alias("cn")), "token").filter((F.col("node") != F.col("cnode")) & _possible("", "c", percent))
    pairs = scratch.keep(star.groupBy(F.least("node", "cnode").alias("a"), F.greatest("node", "cnode").alias("b")).agg(F.count("*").alias("k")).select("a", "b"))
    links = scratch.keep(verified(docs, nodes, pairs, pairs.count(), repeated, percent))
    found = components(links, scratch)
    # Then, pairs across components only.
    at = lists.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    open_ = scratch.keep(at.join(mixed, "token", "left_semi"))
    more = scratch.keep(_across(open_, percent).join(pairs, ["a", "b"], "left_anti"))
    n_more = more.count()
    if n_more:
        links = scratch.keep(links.unionByName(verified(docs, nodes, more, n_more, repeated, percent)))
        found = components(links, scratch)
    scratch.drop(lists, open_, more, pairs, members)
    names = found.join(nodes.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("name"))
    of_set = nodes.join(found.join(names, "comp"), "node", "left").select("n", "f1", "f2", F.coalesce("comp", "node").alias("comp"), F.coalesce("name", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "h", "n", "f1", "f2").join(of_set, ["n", "f1", "f2"], "left")
    return out.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), "comp", F.coalesce("component_id", "doc_id").alias("component_id")), repeated


def near_duplicates(docs: DataFrame, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of documents (doc_id, text)."""
    out, _ = labelled(docs, percent, hot)
    return out.select(id_back(), "n_shingles", id_back("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """The documents, with all their columns, one row of each component: the smallest doc_id's, no id coming last; of equal ids
    the one whose text has the smaller hash; of repeated rows the first by its JSON. Rows without words stay."""
    found, repeated = labelled(docs, percent, hot)
    scratch = Scratch(docs.sparkSession, "jaccard-keep")
    found = scratch.keep(found.filter("comp is not null").select("doc_id", "h", "comp"))
    best = scratch.keep(found.groupBy("comp").agg(F.min(F.struct("doc_id", "h")).alias("best"), F.count("*").alias("k")).filter("k > 1"))
    # A component may hold a third of the rows: they meet its best row where they are, while components are few.
    away = found.join(F.broadcast(best) if best.count() <= FEW_IDS else best, "comp").filter(F.struct("doc_id", "h") != F.col("best")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    away = scratch.keep(away)
    few = away.count() <= FEW_IDS
    out = docs.select(*docs.columns, with_id().alias("__id"), F.xxhash64("text").alias("__h"))
    out = out.join(F.broadcast(away) if few else away, ["__id", "__h"], "left_anti")
    if repeated:
        again = found.groupBy("doc_id", "h").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
        again = scratch.keep(again)
        few = again.count() <= FEW_IDS
        again = F.broadcast(again) if few else again
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        once = out.join(again, ["__id", "__h"], "left_semi").groupBy("__id", "__h").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        return out.join(again, ["__id", "__h"], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
    return out.select(*docs.columns)
