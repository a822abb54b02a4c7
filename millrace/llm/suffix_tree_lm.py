"""LM scoring by a probabilistic suffix tree over the tokens of a text.

Symbols are the end, the most frequent words (TOP at most) and classes of all other words by their last two bytes (TAILS at
most, and one for the rest). A context is a state if it is frequent enough and its next-symbol distribution diverges from its
suffix's: by MIN_BITS bits or more in expectation, and beyond chance. Next-symbol counts are smoothed into the next shorter
state's distribution, down to the root, which gives every symbol a probability. A symbol is scored in the longest state that
is a suffix of what stands before it; a word in a class also with its share of the class, (c + 1) / (C + V + 1): c its count,
C and V tokens and kinds of the class, and one kind more for all unknown words.

Contexts of 1 to DEPTH symbols that occur LEAST times, an absolute number, are all judged, so the tree grows with the corpus.
Where they are judged hangs on how frequent they are, what comes out doesn't. The trunk has all contexts of one symbol, bounded by
the alphabet, and longer ones that make up P_MIN of all training tokens, as do all their suffixes: 1 / P_MIN a length at most, and
about MOST_ENTRIES (context, symbol) counts of states a length; the tests run in Spark, and only what passes comes to the driver and
goes to all tasks. All other contexts are in the branches, which are never gathered: a token goes, packed, to the task of its
shortest context that isn't in the trunk, where that one and longer ones are counted, tested and smoothed, and what the branches
change in each text's score comes back. A context that many tokens share is in the trunk, so no task meets more than P_MIN of the
tokens in one; states that MOST_ENTRIES has no room for, those of the fewest tokens, are in the branches too.

Counts come from all training documents. Frequent words' counts, at most WORDS of them, go to every task; all other words meet
their counts in a join. Texts are taken apart twice, for the words' counts and then for symbols, which are written, two bytes a token;
what comes after reads these.

Defined cases: a null text is empty, its end alone is scored; repeated rows are scored each; without training tokens the model
is uniform; rows of one doc_id are told apart; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, Scratch, by_range, collected, id_back, mix, numbers, packed, ranges_of, text_slices, tidy, unpacked, with_id, word_bounds, word_hashes

DEPTH, P_MIN, MIN_BITS, LEAST, MOST_ENTRIES = 4, 1e-5, 0.02, 2, 2_000_000
TOP, TAILS, WORDS = 400, 600, 300_000
BITS, END = 10, 0
ONE = (1 << BITS) - 1
_FLUSH = 3_000_000
#: Tokens that are worked on at a time, about (a longer text is worked on whole).
_TOKENS = 200_000
#: Texts of a range, about, and ranges at least, for what the branches change in texts' scores.
TEXTS, LEAST_TEXT_RANGES = 25_000, 8


def tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of each word as a number, a zero before a word of one."""
    last = _LOWER[data[ends - 1]].astype(np.int64)
    return last + (np.where(ends - starts > 1, _LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.int64) << 8)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Parts (key, n, more...) added up by key."""
    keys, n, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at), *(x[order][at] for x in more)


@tidy
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, tail, n; the end has word 0 and tail -1."""
    held, total, ends = [], 0, 0

    def rows(parts) -> pa.RecordBatch:
        word, n, tail = _added(parts)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n)], ["word", "tail", "n"])

    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            starts, stops, first = word_bounds(data, offsets)
            ends += len(first) - 1
            if len(starts):
                own, one, n = np.unique(word_hashes(data, starts, stops), return_index=True, return_counts=True)
                held.append((own, n, tails(data, starts[one], stops[one])))
                total += len(own)
            if total >= _FLUSH:
                yield rows(held)
                held, total = [], 0
    if held:
        yield rows(held)
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], ["word", "tail", "n"])


class Places:
    """Where numbers stand in a sorted list of numbers that are spread evenly: first by their highest bits, then one by one."""

    def __init__(self, listed: np.ndarray, bits: int):
        """listed: distinct, of so many bits."""
        self.listed, width = listed.view(np.uint64), min(bits, max(10, len(listed).bit_length() + 2))
        self.shift = np.uint64(bits - width)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((self.listed >> self.shift).astype(np.int64), minlength=1 << width))]).astype(np.int32)

    def __len__(self) -> int:
        return len(self.listed)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        """-1 for those not listed."""
        own = numbers.view(np.uint64)
        part = (own >> self.shift).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        out, left = np.full(len(own), -1, np.int64), np.flatnonzero(at < end)
        at, end, own = at[left], end[left], own[left]
        while len(left):
            hit = self.listed[at] == own
            out[left[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            left, at, end, own = left[more], at[more] + 1, end[more], own[more]
        return out


class Alphabet:
    """Symbols: 0 the end, then the top words, then classes by tail; the last is for all other tails."""

    def __init__(self, top: np.ndarray, classes: np.ndarray):
        """top: hashes of the top words, most frequent first. classes: tails."""
        order = np.argsort(top)
        self.top, self.top_symbol = Places(top[order], 64), order + 1
        self.by_tail = np.full(1 << 16, len(top) + len(classes) + 1, np.int64)
        self.by_tail[classes] = len(top) + 1 + np.arange(len(classes))
        self.n_top, self.size = len(top), len(top) + len(classes) + 2

    def symbols(self, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        out, at = self.by_tail[tail], self.top(hashes)
        hit = np.flatnonzero(at >= 0)
        out[hit] = self.top_symbol[at[hit]]
        return out


def with_ends(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all tokens of a slice, ends included, and the bounds of each text's."""
    n_docs = len(first) - 1
    bounds = first + np.arange(n_docs + 1)
    out = np.full(bounds[-1], END, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(n_docs), np.diff(first))] = symbols
    return out, bounds


def token_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, symbols, bounds of each text's from 0) of slices of a column of symbols, ends included."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bounds, lo = (offsets - offsets[0]) // 2, 0
    while lo < len(column):
        hi = min(len(column), max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + _TOKENS, "right")) - 1))
        yield lo, hi, np.frombuffer(data, "<u2", int(bounds[hi] - bounds[lo]), int(offsets[lo])).astype(np.int64), bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def grams(symbols: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """Keys of all tokens of a slice: the token (lowest bits) and depth symbols before it, ends before a text."""
    key = symbols.copy()
    before = symbols
    for k in range(1, depth + 1):
        # The symbol of k tokens before; a text begins with ends, and so does what lies before its first k.
        before = np.concatenate([[END], before[:-1]])
        before[bounds[:-1]] = END
        key |= before << (BITS * k)
    return key


def _spread(depth: int) -> tuple[int, int, int]:
    """A one-to-one scramble of contexts of `depth` symbols: factor, its inverse, mask."""
    mask = (1 << BITS * depth) - 1
    factor = 0x9E3779B97F4A7C15 & mask | 1
    return factor, pow(factor, -1, mask + 1), mask


class Contexts:
    """A list of contexts of a length."""

    def __init__(self, contexts: np.ndarray, length: int):
        self.factor, _, self.mask = _spread(length)
        self.places = Places(np.sort(contexts * self.factor & self.mask), BITS * length)

    def scrambled(self, keys: np.ndarray) -> np.ndarray:
        """The contexts in keys, scrambled."""
        return (keys >> BITS) * self.factor & self.mask


def _count_grams(depth: int, answered: dict[int, np.ndarray]):
    """key, n of contexts of depth symbols and the next; of those listed whose suffixes are, if depth is 2 or more."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if depth == 1:
            total = np.zeros(1 << 2 * BITS, np.int64)
            for batch in batches:
                for _, _, symbols, bounds in token_slices(batch.column(0)):
                    total += np.bincount(grams(symbols, bounds, 1), minlength=len(total))
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["key", "n"])
            return
        lists = [Contexts(answered[k], k) for k in range(2, depth + 1)]
        held, total = [], 0
        for batch in batches:
            for _, _, symbols, bounds in token_slices(batch.column(0)):
                key = grams(symbols, bounds, depth)
                for listed in lists:
                    key = key[listed.places(listed.scrambled(key)) >= 0]
                own, n = np.unique(key, return_counts=True)
                held.append((own, n))
                total += len(own)
                if total >= _FLUSH:
                    own, n = _added(held)
                    held, total = [(own, n)], len(own)
                    if total > _FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["key", "n"])
                        held, total = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _added(held))], ["key", "n"])

    return run


def diverges(bits, total, kinds, min_bits: float):
    """Whether a context's distribution is apart from its suffix's: bits, the divergence; total, kinds of its next symbols. Twice
    the log-likelihood ratio exceeds what chance gives so many symbols, with room. Works on arrays and on Columns."""
    return (bits >= min_bits) & (2 * float(np.log(2)) * total * bits >= 2 * kinds + 10)


class Tree:
    """States by length of context: contexts, totals, numbers of next symbols, which these are and how often each comes."""

    def __init__(self, size: int, first: tuple[np.ndarray, np.ndarray] | None = None):
        """first: keys, as in `grams`, and counts of all contexts of one symbol; the root is made of them."""
        self.root = np.ones(size)
        if first is not None:
            keys, n = first
            self.root += np.bincount(keys & ONE, n, size)
        self.root /= self.root.sum()
        self.levels: list[tuple[np.ndarray, ...]] = []

    def grow(self, keys: np.ndarray, n: np.ndarray) -> None:
        """One more level, of these states' entries."""
        contexts = Contexts(np.unique(keys >> BITS), len(self.levels) + 1)
        state, symbol = contexts.places(contexts.scrambled(keys)), keys & ONE
        order = np.argsort(state << BITS | symbol)
        state, symbol, n = state[order], symbol[order], n[order].astype(float)
        # A bit for each next symbol of a state, 64 to a word, and where a word's first entry stands.
        word = state << BITS - 6 | symbol >> 6
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        has, start = np.zeros(len(contexts.places) << BITS - 6, np.uint64), np.zeros(len(contexts.places) << BITS - 6, np.int32)
        if len(at):
            has[word[at]], start[word[at]] = np.bitwise_or.reduceat(np.uint64(1) << (symbol & 63).astype(np.uint64), at), at
        self.levels.append((contexts, np.bincount(state, n, len(contexts.places)), np.bincount(state, minlength=len(contexts.places)).astype(float), has, start, np.append(n, 0.0)))

    @property
    def n_states(self) -> int:
        return 1 + sum(len(x[0].places) for x in self.levels)

    def probability(self, keys: np.ndarray, longest: int | None = None) -> np.ndarray:
        """P(symbol | what stands before it): from the root to the longest state that is a suffix, of `longest` symbols at most."""
        p, symbols = self.root[keys & ONE], keys & ONE
        for contexts, total, kinds, has, start, n in self.levels[:longest]:
            if not len(contexts.places):
                continue
            s = contexts.places(contexts.scrambled(keys))
            hit = np.flatnonzero(s >= 0)
            s, symbol = s[hit], symbols[hit]
            word = s << BITS - 6 | symbol >> 6
            bit = np.uint64(1) << (symbol & 63).astype(np.uint64)
            of = has[word]
            at = start[word] + np.bitwise_count(of & (bit - np.uint64(1)))
            count = n[np.where(of & bit != 0, at, len(n) - 1)]
            p[hit] = (count + kinds[s] * p[hit]) / (total[s] + kinds[s])
        return p


def _listed(contexts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of own are among these sorted contexts."""
    return contexts[np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)] == own if len(contexts) else np.zeros(len(own), bool)


def _send(frequent, depth: int, n_ranges: int):
    """Tokens that have a context of up to `depth` symbols outside the trunk, by the length of the shortest such and a range of it,
    scrambled: codes (that context, the symbols before it up to `depth`, the token) as sorted gaps, and for each the row and whether
    it is held out."""

    def flush(length: int, codes: list, rows: list, held: list) -> list[tuple]:
        edges = np.array([-(-(i << BITS * length) // n_ranges) for i in range(n_ranges + 1)], np.int64)
        code, row, out_ = np.concatenate(codes), np.concatenate(rows), np.concatenate(held)
        order = np.argsort(code)
        code, row, out_ = code[order], row[order], out_[order]
        at, out = np.searchsorted(code >> BITS * (depth - length + 1), edges), []
        for r in range(n_ranges):
            cut = slice(at[r], at[r + 1])
            if at[r] < at[r + 1]:
                base = int(row[cut].min())
                out.append((length * n_ranges + r, int(code[at[r]]), *packed(np.diff(code[cut]).astype(np.uint64)), base, *packed(row[cut].astype(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)), np.packbits(out_[cut]).tobytes()))
        return out

    def sent(held: dict[int, tuple[list, list, list]]) -> pa.RecordBatch:
        out = [x for length, parts in held.items() for x in flush(length, *parts)]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _SENT.split(", ")])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, total = {}, 0
        lists = {k: Contexts(x, k) for k, x in frequent.value.items()}
        for batch in batches:
            row, out_ = numbers(batch, "row"), numbers(batch, "held").astype(bool)
            for lo, hi, symbols, bounds in token_slices(batch.column(batch.schema.get_field_index("symbols"))):
                key, sizes = grams(symbols, bounds, depth), np.diff(bounds)
                of, held = np.repeat(row[lo:hi], sizes), np.repeat(out_[lo:hi], sizes)
                left = np.arange(len(key))
                for length in range(2, depth + 1):
                    code = lists[length].scrambled(key[left])
                    here = lists[length].places(code) >= 0
                    rare, code = left[~here], code[~here]
                    left, rest = left[here], key[rare]
                    for j in [*range(length + 1, depth + 1), 0]:
                        code = code << BITS | rest >> BITS * j & ONE
                    if len(rare):
                        for kept, x in zip(waiting.setdefault(length, ([], [], [])), (code, of[rare], held[rare]), strict=True):
                            kept.append(x)
                        total += len(rare)
                if total >= _FLUSH // 2:
                    yield sent(waiting)
                    waiting, total = {}, 0
        if total:
            yield sent(waiting)

    return run


_SENT = "range int, first bigint, gaps binary, gw int, base bigint, rows binary, rw int, held binary"


def _level(group: np.ndarray, entry: np.ndarray, train: np.ndarray, q: np.ndarray, least: int, min_bits: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of tokens by group (context) and entry (context and symbol), both numbered from 0: the probability in the context where it
    is a state, else q, which is a function of the entry; whether it is one; and how many are."""
    n_groups, n_entries = int(group.max()) + 1, int(entry.max()) + 1
    count = np.bincount(entry[train], minlength=n_entries).astype(float)
    of, q_of = np.empty(n_entries, np.int64), np.empty(n_entries)
    of[entry], q_of[entry] = group, q
    total = np.bincount(of, count, n_groups)
    kinds = np.bincount(of[count > 0], minlength=n_groups).astype(float)
    share = count / np.maximum(total[of], 1)
    bits = np.bincount(of, share * np.log2(np.where(count > 0, share / q_of, 1.0)), n_groups)
    state = (total >= least) & diverges(bits, total, kinds, min_bits)
    p = np.where(state[of], (count + kinds[of] * q_of) / np.maximum(total + kinds, 1)[of], q_of)
    return p[entry], state[group], int(state.sum())


_CHANGED = "range int, first bigint, gaps binary, gw int, delta binary"


def _by_rows(rows: np.ndarray, delta: np.ndarray, n_ranges: int) -> list[tuple]:
    """Sorted rows and their numbers, packed by a hash of the row."""
    where = (mix(rows.astype(np.uint64)) % np.uint64(n_ranges)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    rows, delta, at = rows[order], delta[order], np.searchsorted(where[order], np.arange(n_ranges + 1))
    return [(r, int(rows[a]), *packed(np.diff(rows[a:b].astype(np.uint64))), delta[a:b].astype("<f8").tobytes()) for r, (a, b) in enumerate(itertools.pairwise(at.tolist())) if a < b]


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """row, delta: sums by row; of range -1, with row null, the number of states."""
    delta = np.concatenate([np.frombuffer(r.delta, "<f8") for r in pdf.itertuples()])
    if pdf["range"].iloc[0] < 0:
        return pd.DataFrame({"row": pd.array([None], "Int64"), "delta": [delta.sum()]})
    rows = np.concatenate([np.cumsum(np.concatenate([np.array([r.first], np.int64).view(np.uint64), unpacked(r.gaps, r.gw)]), dtype=np.uint64) for r in pdf.itertuples()]).astype(np.int64)
    rows, which = np.unique(rows, return_inverse=True)
    return pd.DataFrame({"row": pd.array(rows, "Int64"), "delta": np.bincount(which, delta, len(rows))})


def _branch(tree, depth: int, least: int, min_bits: float, n_ranges: int, text_ranges: int):
    """What the branches of a range of contexts add to the log10 probability of each text, as far as it isn't 0, packed by row;
    and as range -1 the number of states."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        length = int(pdf["range"].iloc[0]) // n_ranges
        _, inverse, mask = _spread(length)
        one, below = (1 << BITS) - 1, BITS * (depth - length + 1)
        code = np.concatenate([np.cumsum(np.concatenate([np.array([r.first], np.uint64), unpacked(r.gaps, r.gw)]), dtype=np.uint64) for r in pdf.itertuples()]).astype(np.int64)
        row = np.concatenate([(unpacked(r.rows, r.rw) + np.uint64(r.base & 0xFFFFFFFFFFFFFFFF)).astype(np.int64) for r in pdf.itertuples()])
        train = np.concatenate([np.unpackbits(np.frombuffer(r.held, np.uint8), count=len(r.rows) // r.rw) == 0 for r in pdf.itertuples()])
        _, group = np.unique(code >> below, return_inverse=True)
        some = (np.bincount(group[train], minlength=group.max() + 1) >= least)[group]
        code, row, train = code[some], row[some], train[some]
        n_states = 0
        if len(code):
            kinds, entry = np.unique(code >> below << BITS | code & one, return_inverse=True)
            # What the trunk says: its states are suffixes of this context.
            q = tree.value.probability(((kinds >> BITS) * inverse & mask) << BITS | kinds & one, length - 1)[entry]
            p = q
            for j in range(length, depth + 1):
                context = code >> BITS * (depth - j + 1)
                _, group = np.unique(context, return_inverse=True)
                _, entry = np.unique(context << BITS | code & one, return_inverse=True)
                p, _, more = _level(group, entry, train, p, least, min_bits)
                n_states += more
            moved = np.flatnonzero(p != q)
            rows, which = np.unique(row[moved], return_inverse=True)
            delta = np.bincount(which, np.log10(p[moved] / q[moved]), len(rows))
        else:
            rows, delta = np.zeros(0, np.int64), np.zeros(0)
        out = [*_by_rows(rows, delta, text_ranges), (-1, 0, b"", 1, np.array([n_states], "<f8").tobytes())]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGED.split(", ")])

    return run


def _read(model):
    """For each text what its words give, and its symbols; the words whose counts are still to come, and how often each occurs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, class_log, listed, log_counts, top_logs = model.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text"))):
                starts, stops, first = word_bounds(data, offsets)
                hashes, n = word_hashes(data, starts, stops), hi - lo
                symbols = alphabet.symbols(hashes, tails(data, starts, stops))
                doc = np.repeat(np.arange(n), np.diff(first))
                logs, shares, found = np.zeros(len(hashes)), np.zeros(len(hashes)), symbols <= alphabet.n_top
                logs[found] = top_logs[symbols[found]]
                other = np.flatnonzero(~found)
                at = listed(hashes[other])
                logs[other] = log_counts[at]
                found[other] = at >= 0
                # A word's share of its class, but for its own count where that is still to come.
                shares[other] = logs[other] - class_log[symbols[other]]
                rare = other[at < 0]
                kinds, which = np.unique(hashes[rare], return_inverse=True)
                pair, times = np.unique((doc[rare] << 32) | which, return_counts=True)
                of = pa.array(np.searchsorted(pair >> 32, np.arange(n + 1)).astype(np.int32))
                tokens, bounds = with_ends(symbols, first)
                raw = pa.py_buffer(tokens.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(batch.schema.get_field_index(c)).slice(lo, n) for c in ("row", "doc_id", "held")),
                        pa.array(np.diff(bounds)),
                        pa.array(np.bincount(doc[found], minlength=n)),
                        pa.array(np.bincount(doc, logs, n)),
                        pa.array(np.bincount(doc, shares, n)),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((2 * bounds).astype(np.int64).tobytes()), raw]).cast(pa.binary()),
                        pa.ListArray.from_arrays(of, pa.array(kinds[pair & 0xFFFFFFFF].view(np.int64))),
                        pa.ListArray.from_arrays(of, pa.array(times.astype(np.int64))),
                    ],
                    [c.split()[0] for c in _READ.split(", ")],
                )

    return run


_READ = "row bigint, doc_id bigint, held boolean, n_tokens bigint, known bigint, logs double, shares double, symbols binary, words array<bigint>, times array<bigint>"


def _score(tree, depth: int):
    """Adds the trunk's log10 probabilities to the shares."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *plain, shares, symbols = batch.columns
            scores = [np.add.reduceat(np.log10(tree.value.probability(grams(x, bounds, depth))), bounds[:-1]) for _, _, x, bounds in token_slices(symbols)]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(np.concatenate([*scores, np.zeros(0)]) + shares.to_numpy())], [c.split()[0] for c in _SCORED.split(", ")])

    return run


_SCORED = "row bigint, doc_id bigint, n_tokens bigint, known bigint, logs double, score double"


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of the highest n, `most` at most: by a threshold on n, from the numbers of rows by n (by power of two from 2^16 on)."""
    level = F.when(F.col("n") < 65536, F.col("n")).otherwise(F.floor(F.log2("n")).cast("long") * 65536)
    by = sorted(((r.level, r.k) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    taken, floor = 0, None
    for x, k in by:
        if taken + k > most:
            break
        taken, floor = taken + k, x
    return counts.filter(level >= floor) if floor is not None else counts.limit(0)


def _with_probability(tree):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.probability(batch.column(0).to_numpy()))], ["key", "n", "q"])

    return run


def trunk(counts_of, size: int, n_tokens: int, depth: int, p_min: float, least: int, min_bits: float, most_entries: int, spark: SparkSession) -> tuple[Tree, dict[int, np.ndarray]]:
    """The trunk, and by length from 2 on the contexts that it answers for, sorted. counts_of: key, n of contexts of a length, of
    those listed from 2 on. The divergence of a context is sum(n log2(n / q)) / total - log2(total)."""
    # Contexts of one symbol are bounded by the alphabet.
    counts = counts_of(1, {})
    every = collected(counts)
    tree, answered = Tree(size, (every["key"].to_numpy(), every["n"].to_numpy())), {}
    often = max(least, p_min * n_tokens)
    for k in range(1, depth + 1):
        if k > 1:
            # Beginnings of the last length's counts; 0 is the beginning of a text. At most 1 / p_min contexts.
            found = np.union1d(collected(counts.filter(F.col("n") >= often).select("key"))["key"].to_numpy(np.int64), [0])
            own = found & ((1 << BITS * (k - 1)) - 1)
            answered[k] = found[_listed(answered[k - 1], own)] if k > 2 else found
            counts = counts_of(k, answered)
        judged = counts.mapInArrow(_with_probability(spark.sparkContext.broadcast(tree)), "key bigint, n bigint, q double")
        by = judged.groupBy(F.shiftright("key", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log2(F.col("n") / F.col("q"))).alias("s"))
        by = by.withColumn("bits", F.col("s") / F.col("total") - F.log2("total")).filter(F.col("total") >= least)
        kept = collected(by.filter(diverges(F.col("bits"), F.col("total"), F.col("kinds"), min_bits)).select("context", "kinds", "total")).sort_values("total", ascending=False)
        # Where there is no room for all, those of the fewest tokens are the branches'.
        over = kept[kept["kinds"].cumsum() > most_entries] if k > 1 else kept[:0]
        left = kept[kept["total"] <= over["total"].max()] if len(over) else over
        kept = kept.drop(left.index)
        if k > 1:
            answered[k] = np.setdiff1d(answered[k], left["context"].to_numpy(np.int64))
        chosen = spark.sparkContext.broadcast(np.sort(kept["context"].to_numpy(np.int64)))
        entries = collected(counts.mapInArrow(_of_contexts(chosen), "key bigint, n bigint"))
        tree.grow(entries["key"].to_numpy(np.int64), entries["n"].to_numpy(np.int64))
    return tree, answered


def _of_contexts(chosen):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_listed(chosen.value, batch.column(0).to_numpy() >> BITS)))

    return run


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, p_min: float = P_MIN, min_bits: float = MIN_BITS, top: int = TOP, most_tails: int = TAILS, most_words: int = WORDS, least: int = LEAST, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states of documents (doc_id, text). held_out: a
    condition on doc_id; those documents are only scored. top + most_tails + 2 are at most 2 ** BITS, depth at most 5. p_min and
    most_entries deal work out and change no score."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "suffix-tree")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    # Where ids don't tell rows apart, numbers do; they are written with the symbols, once.
    docs = docs.withColumn("row", with_id() if unique else F.monotonically_increasing_id())
    training = docs.filter(~F.col("held")).select("text")
    counted = training.mapInArrow(_count_words, "word bigint, tail int, n bigint")
    words = scratch.keep(counted.groupBy("word", "tail").agg(F.sum("n").alias("n")))
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("tail") < 0, F.col("n"))).alias("ends")).first()
    n_tokens, n_kinds, n_ends = totals.n or 0, totals.v, totals.ends or 0
    plain = words.filter("tail >= 0")
    best = plain.orderBy(F.desc("n"), "word").limit(top).collect()
    # At most 65,536 tails.
    by_tail = {r.tail: [r.n, r.v] for r in plain.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    for r in best:
        by_tail[r.tail][0] -= r.n
        by_tail[r.tail][1] -= 1
    chosen = sorted((t for t, (n, _) in by_tail.items() if n), key=lambda t: (-by_tail[t][0], t))[:most_tails]
    alphabet = Alphabet(np.array([r.word for r in best], np.int64).view(np.uint64), np.array(chosen, np.int64))
    weight = np.ones(alphabet.size)
    for t, (n, v) in by_tail.items():
        weight[alphabet.by_tail[t]] += n + v
    listed = collected(_most_frequent(plain.filter("n > 3"), most_words).select("word", "n"))
    hashes = listed["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    top_logs = np.log10(np.array([0, *(r.n for r in best)], float) + 1)
    # The last number is for words that are not listed.
    model = spark.sparkContext.broadcast((alphabet, np.log10(weight), Places(hashes[order], 64), np.log10(np.append(listed["n"].to_numpy()[order], 0) + 1.0), top_logs))
    read = scratch.keep(docs.select(with_id(), "row", "held", "text").mapInArrow(_read(model), _READ))
    symbols = read.filter(~F.col("held")).select("symbols")
    # Level by level, as a context can't be frequent if its beginning isn't.
    held_counts = []

    def counts_of(k: int, answered: dict[int, np.ndarray]) -> DataFrame:
        counted = symbols.mapInArrow(_count_grams(k, {j: answered[j] for j in range(2, k + 1)}), "key bigint, n bigint")
        held_counts.append(scratch.keep(counted.groupBy("key").agg(F.sum("n").alias("n"))))
        return held_counts[-1]

    tree, frequent = trunk(counts_of, alphabet.size, n_tokens, depth, p_min, least, min_bits, most_entries, spark)
    scratch.drop(*held_counts)
    trunk_value, frequent_value = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(frequent)
    n_ranges = ranges_of(spark, n_tokens)
    sent = read.select("row", "held", "symbols").mapInArrow(_send(frequent_value, depth, n_ranges), _SENT)
    # What comes back to the texts has as many ranges as these need, not as many as tokens do.
    text_ranges = max(LEAST_TEXT_RANGES, -(-read.count() // TEXTS))
    changed = by_range(sent, (depth - 1) * n_ranges).applyInPandas(_branch(trunk_value, depth, least, min_bits, n_ranges, text_ranges), _CHANGED)
    branches = scratch.keep(by_range(changed, text_ranges).applyInPandas(_summed, "row bigint, delta double"))
    n_states = tree.n_states + int(branches.filter("row is null").agg(F.sum("delta").alias("n")).first().n or 0)
    scored = scratch.keep(read.select("row", "doc_id", "n_tokens", "known", "logs", "shares", "symbols").mapInArrow(_score(trunk_value, depth), _SCORED))
    rare = read.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times").withColumnRenamed("words", "word")
    met = rare.join(plain, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    each = scored.join(met, "row", "left").join(branches, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("logs") + more + float(np.log10(n_ends + 1)) - F.col("n_tokens") * float(np.log10(n_tokens + n_kinds + 1))
    each = each.withColumn("doc_id", id_back())
    return each.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + (1 if n_ends else 0)).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + more + F.coalesce("delta", F.lit(0.0))).alias("score"), F.lit(n_states).cast("long").alias("n_states"),
    )
