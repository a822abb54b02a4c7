"""Best-fit packing: token pieces into sequences of a fixed capacity by best-two-fit.

The plan depends on piece lengths only, so it is made from the histogram of lengths (at most `capacity` rows, whatever the
corpus) and names, for each length, which ranks go to which sequences. Pieces then find their place on their own: rank
within their length class, then a look-up. No piece is collected and no group is gathered into one task.

Defined cases: a null or empty text is the closing id alone; equal documents and repeated rows are packed each; a null
doc_id is null in the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_back, numbers, text_slices, tidy, with_id, word_bounds, word_hashes

CAPACITY, END_ID = 4096, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordCache:
    """Ids of whole texts from the ids of their parts, which this tokenizer treats each on its own: it drops white space and no
    merge crosses it, and marks between an ASCII letter and white space are a token of their own. Parts are encoded once and
    kept in one flat array; the memory is bounded: beyond so many parts, or bytes of them, the cache starts anew."""

    MOST, MOST_BYTES = 1_000_000, 32_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[k for w, k in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.at = array("H"), array("q", [0])

    def learn(self, new: list[bytes], many: int = 1000) -> None:
        """Words of letters alone are encoded in one go: each ends with the only id that closes a word."""
        plain = []
        for w in new:
            x = w.decode()
            if x.isalpha() and (x.isascii() or x.lower().isalpha()):
                plain.append((w, x))
            else:
                self._add([w], np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.int64), None)
        for k in range(0, len(plain), many):
            some = plain[k : k + many]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(x for _, x in some)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                self._add([w for w, _ in some], ids, ends)
            else:
                for w, x in some:
                    self._add([w], np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.int64), None)

    def _add(self, parts: list[bytes], ids: np.ndarray, ends: np.ndarray | None) -> None:
        base, n = len(self.flat), len(self.at) - 1
        self.flat.frombytes(ids.astype(np.uint16).tobytes())
        self.at.extend([base + len(ids)] if ends is None else (base + ends).tolist())
        self.index.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.held += sum(map(len, parts))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the bounds of each text's within them."""
        lower, plain = _LOWER[data], np.ones(len(data), bool)
        raw = data.tobytes()
        if b"<|" in raw:  # a special token's name may be in it, in just these letters: such texts stay as they are
            for a, b in itertools.pairwise(offsets.tolist()):
                if b"<|" in raw[a:b]:
                    lower[a:b], plain[a:b] = data[a:b], False
        starts, ends, first = word_bounds(data, offsets)
        # The last byte of each word that isn't a mark: if it is a letter, and not the word's last, the word is cut after it.
        tail, odd = ends.copy(), np.flatnonzero(_MARK[data[ends - 1]])
        for _ in range(16):
            tail[odd] -= 1
            odd = odd[tail[odd] > starts[odd]]
            odd = odd[_MARK[data[tail[odd] - 1]]]
        if len(odd):  # many marks in a row
            tail[odd] = np.maximum.accumulate(np.where(_MARK[data], 0, np.arange(1, len(data) + 1)))[tail[odd] - 1]
        cut = (tail > starts) & (tail < ends)
        cut[cut] = _LETTER[data[tail[cut] - 1]] & plain[starts[cut]]
        more = np.concatenate([[0], np.cumsum(cut)])
        at = np.arange(len(starts)) + more[:-1]
        lo, hi = np.empty(len(starts) + more[-1], np.int64), np.empty(len(starts) + more[-1], np.int64)
        lo[at], hi[at] = starts, np.where(cut, tail, ends)
        lo[at[cut] + 1], hi[at[cut] + 1] = tail[cut], ends[cut]
        first = first + more[first]
        _, one, which = np.unique(word_hashes(lower, lo, hi, lower=False), return_index=True, return_inverse=True)
        raw = lower.tobytes()
        parts = [raw[a:b] for a, b in zip(lo[one].tolist(), hi[one].tolist(), strict=True)]
        at = np.fromiter(map(self.index.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(at < 0)
        if len(self.index) + len(unknown) > self.MOST or self.held > self.MOST_BYTES:
            self.clear()
            unknown = np.arange(len(parts))
        new = [parts[k] for k in unknown.tolist()]
        self.learn(new)
        at[unknown] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        which = at[which]
        bound, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, np.uint16)
        start, sizes = bound[which], bound[which + 1] - bound[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return flat[np.arange(total[-1]) + np.repeat(start - total[:-1], sizes)], total[first]


_caches: dict[str, WordCache] = {}


def _cut(path: str, capacity: int, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _caches.setdefault(path, None) or WordCache(path)
        _caches[path] = cache
        for batch in batches:
            docs, out = numbers(batch, "doc_id"), []
            for lo, hi, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text"))):
                flat, bounds = cache.ids(data, offsets)
                ends = bounds.tolist()
                for doc, a, b in zip(docs[lo:hi], ends, ends[1:], strict=False):
                    ids = np.append(flat[a:b], np.uint16(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        out.append((int(doc), k, start, len(piece), zlib.crc32(piece.tobytes())))
            cols = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Best-two-fit over a histogram of lengths. Rows (length, first rank, end rank, first sequence, copies a sequence, offset
    of the first copy, 0), and the number of sequences.

    A bin takes the longest piece that fits, again and again. If a gap stays, its smallest piece is replaced by the two
    unpacked pieces that fill the gap and its place most tightly, if they fill more. The same bin is repeated as long as the
    lengths last, so there are about as many steps as lengths, not as pieces.
    """
    left = {length: n for length, n in counts.items() if n}
    avail = sorted(left)
    used: Counter = Counter()
    rows, sequences = [], 0
    while avail:
        own: Counter = Counter()
        gap = capacity
        while (i := bisect.bisect_right(avail, gap)) > 0:
            length = next((avail[j] for j in range(i - 1, -1, -1) if left[avail[j]] > own[avail[j]]), 0)
            if not length:
                break
            take = min(gap // length, left[length] - own[length])
            own[length] += take
            gap -= take * length
        if gap:
            least = min(own)
            room = gap + least
            free = np.array([x for x in avail[: bisect.bisect_right(avail, room - 1)] if left[x] > own[x]])
            if len(free):
                at = np.searchsorted(free, room - free, "right") - 1
                twice = np.array([left[x] - own[x] for x in free.tolist()]) >= 2
                at = np.where((at >= 0) & (free[at] == free) & ~twice, at - 1, at)
                total = np.where(at >= 0, free + free[at], 0)
                best = int(np.argmax(total))
                if total[best] > least:
                    own[least] -= 1
                    own[int(free[best])] += 1
                    own[int(free[at[best]])] += 1
        own = +own
        times = min(left[x] // n for x, n in own.items())
        offset = 0
        for length in sorted(own, reverse=True):
            n = own[length]
            rows.append((length, used[length], used[length] + n * times, sequences, n, offset, 0))
            used[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                avail.remove(length)
        sequences += times
    return rows, sequences


def _place(rows: np.ndarray):
    """rows: sorted by length and first rank."""
    key = (rows[:, 0] << np.int64(48)) | rows[:, 1] if len(rows) else np.zeros(0, np.int64)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = numbers(batch, "length"), numbers(batch, "rank")
            row = rows[np.searchsorted(key, (length << np.int64(48)) | rank, "right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 3] + k // row[:, 4], row[:, 5] + (k % row[:, 4]) * length
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of at most `capacity` ids of each document, `end_id` closing it."""
    return docs.select(with_id(), "text").mapInArrow(_cut(tokenizer, capacity, end_id), _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, salts: int = 256) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of documents (doc_id, text). Ranks are found
    within salts of a length, which follow the row, so equal ids and lengths are dealt over all; there are `salts`, and more where
    pieces are so many that a salt of a length would hold over a million."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    cut = Scratch(spark, "packing").keep(cut)
    salts = max(salts, -(-(cut.groupBy("length").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0) // 1_000_000))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    part = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(counts, capacity)
    before = part.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")).cast("long") - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    ordered = np.array(sorted(rows), np.int64).reshape(-1, 7)
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(ordered), _PIECES + ", sequence_id bigint, offset bigint")
    return placed.withColumn("doc_id", id_back())
