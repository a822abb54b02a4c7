"""Quality rules by line sequence labelling: a linear-chain conditional random field marks each line as content or boilerplate
by Viterbi decoding, and the share of words in content lines decides whether a document stays.

Two rules stand before it (fewer than 50 words; more than half of the words in repeated 3-word windows). The field is fitted
on at most SAMPLE labelled documents (half of either class, the first by a hash); its states start as the document's label,
and lines of bad documents that look like content are relabelled before the transitions are fitted. Without labels of both
classes the prior weights hold.

Defined cases: a null or empty text has 0 words and fails the first rule; lines without a word take no part; an unlabelled or
repeated row is judged like any other, each row by itself; a null label counts as none; an empty table gives no rows; other
columns are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbers, shingle_hashes, small_batches, text_slices, tidy, word_bounds, word_hashes

SAMPLE, SHARE = 4000, 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_SYMBOL, _PIPE, _DIGIT = _table(b"#*$%&|<>"), _table(b"|"), _table(b"0123456789")
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_SHOUT = _table(b"!")
_POINT = np.ones(256, np.int32)
_POINT[128:192] = 0
_POINT[[9, 10, 11, 12, 13, 32]] = 0  # code points that are in words

#: Upper bounds of the classes of each line feature; a value above all is the last class.
_CUTS = (
    ("words", (1, 2, 4, 8, 16, 32, 64)),
    ("symbols per word", (0.0, 0.05, 0.25, 0.6, 1.2)),
    ("bars per word", (0.0, 0.05, 0.25)),
    ("capitals per letter", (0.02, 0.1, 0.3, 0.6)),
    ("exclamation marks per word", (0.0, 0.1, 0.5)),
    ("digits per character", (0.0, 0.05, 0.3)),
    ("characters per word", (2.5, 4.0, 6.0, 8.0, 11.0)),
    ("seen before in the text", (0.5,)),
    ("repeated words", (0.1, 0.5)),
)
_SIZES = [len(c) + 1 for _, c in _CUTS]
_STARTS = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
N_FEATURES = int(sum(_SIZES))


@dataclass
class Field:
    """Scores of state 1 (content) over state 0: of features, and of first states and transitions [from][to]."""

    weights: np.ndarray
    first: np.ndarray
    steps: np.ndarray


def prior() -> Field:
    w = np.zeros(N_FEATURES)
    at = dict(zip((n for n, _ in _CUTS), _STARTS.tolist(), strict=True))
    w[at["words"] : at["words"] + 8] = 0.5
    w[at["symbols per word"] + 3 : at["symbols per word"] + 6] = -2.5
    w[at["bars per word"] + 3] = -2.0
    w[at["capitals per letter"] + 4] = -2.0
    w[at["exclamation marks per word"] + 3] = -2.0
    w[at["seen before in the text"] + 1] = -1.0
    return Field(w, np.zeros(2), np.array([[0.5, -0.5], [-0.5, 0.5]]))


class Measured:
    """What `judge` needs of one slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_bounds(data, offsets)
        n_docs = len(offsets) - 1
        self.n_words = np.diff(first)
        total = lambda t: np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])
        points, symbols = total(_POINT), total(_SYMBOL)
        self.word_chars = np.diff(points[offsets])
        self.n_symbols = np.diff(symbols[offsets])
        hashes = word_hashes(data, starts, ends, lower=False)
        repeated = np.zeros(len(hashes), bool)
        for a, b in itertools.pairwise(first.tolist()):
            if b - a >= 4:
                _, inverse, counts = np.unique(shingle_hashes(hashes[a:b], 3), return_inverse=True, return_counts=True)
                twice = np.flatnonzero(counts[inverse] > 1) + a
                for k in range(3):
                    repeated[twice + k] = True
        in_window = np.concatenate([[0], np.cumsum(repeated)])
        self.n_repeat_words = np.diff(in_window[first])
        # Lines: cut at line feeds and at texts' bounds.
        feeds = np.flatnonzero(data == 10)
        lo = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
        hi = np.sort(np.concatenate([offsets[1:], feeds]))
        w_lo, w_hi = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        some = w_hi > w_lo
        lo, hi, w_lo, w_hi = lo[some], hi[some], w_lo[some], w_hi[some]
        doc = np.searchsorted(offsets, lo, "right") - 1
        raw, seen, before, last = data.tobytes(), set(), np.zeros(len(lo), bool), -1
        for i, (d, a, b) in enumerate(zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True)):
            if d != last:
                seen, last = set(), d
            line = raw[a:b]
            before[i] = line in seen
            seen.add(line)
        self.n_dup_lines = np.bincount(doc[before], minlength=n_docs)
        self.line_words = w_hi - w_lo
        self.line_first = np.searchsorted(doc, np.arange(n_docs + 1))
        n = np.maximum(self.line_words, 1)
        span = lambda t: (s := total(t))[hi] - s[lo]
        chars = np.maximum(points[hi] - points[lo], 1)
        values = (
            self.line_words, (symbols[hi] - symbols[lo]) / n, span(_PIPE) / n, span(_UPPER) / np.maximum(span(_LETTER), 1),
            span(_SHOUT) / n, span(_DIGIT) / chars, chars / n, before,
            (in_window[w_hi] - in_window[w_lo]) / n,
        )
        self.features = np.stack([np.searchsorted(np.array(cuts, float), np.asarray(v, float)) + s for (_, cuts), v, s in zip(_CUTS, values, _STARTS, strict=True)], 1).astype(np.int16) if len(lo) else np.zeros((0, len(_CUTS)), np.int16)
        # searchsorted "left": a value equal to a bound belongs to the class that the bound closes.


def viterbi(scores: list[float], field: Field) -> list[int]:
    """Best states of one sequence; scores: of state 1 over state 0. Ties go to content."""
    if not scores:
        return []
    (s00, s01), (s10, s11) = field.steps.tolist()
    a, b = float(field.first[0]), float(field.first[1]) + scores[0]
    back = []
    for x in scores[1:]:
        from1_to0, from1_to1 = b + s10 >= a + s00, b + s11 >= a + s01
        back.append((from1_to0, from1_to1))
        a, b = (b + s10 if from1_to0 else a + s00), (b + s11 if from1_to1 else a + s01) + x
    state = int(b >= a)
    out = [state]
    for step in reversed(back):
        state = int(step[state])
        out.append(state)
    return out[::-1]


def fit(docs: list[np.ndarray], good: np.ndarray, rounds: int = 60, l2: float = 1.0) -> Field:
    """docs: line features of each document."""
    if not len(docs) or good.all() or not good.any():
        return prior()
    lengths = np.array([len(d) for d in docs])
    x = np.concatenate(docs).astype(np.int64)
    line_doc = np.repeat(np.arange(len(docs)), lengths)
    # First, lines alone: logistic regression on the label of the document, both classes weighing the same.
    y = good[line_doc].astype(float)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = prior().weights * 0
    m, v = np.zeros_like(w), np.zeros_like(w)

    def adam(value, grad, m, v, t, rate=0.15):
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        return value + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    for t in range(1, 2 * rounds + 1):
        p = 1 / (1 + np.exp(-w[x].sum(1)))
        grad = np.bincount(x.ravel(), np.repeat(weight * (y - p), x.shape[1]), N_FEATURES) - l2 * w
        w = adam(w, grad / len(y), m, v, t)
    # Lines of bad documents that look like content are content; so is every line of a good one.
    z = np.where(good[line_doc], 1, (w[x].sum(1) > 0).astype(int))
    # Then the chain, by its likelihood: forward and backward over all documents at once, longest first.
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    size = lengths[order]
    top = int(size.max())
    alive = [int((size > t).sum()) for t in range(top)]
    state = Field(w.copy(), np.zeros(2), np.zeros((2, 2)))
    mom = [np.zeros_like(a) for a in (state.weights, state.first, state.steps) for _ in range(2)]
    seen_steps, seen_first = np.zeros((2, 2)), np.bincount(z[first[size > 0]], minlength=2).astype(float)
    inner = np.flatnonzero(line_doc[1:] == line_doc[:-1])
    np.add.at(seen_steps, (z[inner], z[inner + 1]), 1)
    for t in range(1, rounds + 1):
        score = state.weights[x].sum(1)
        emit = np.stack([np.zeros_like(score), score], 1)
        alpha = np.zeros((len(x), 2))
        beta = np.zeros((len(x), 2))
        for k in range(top):
            at = first[: alive[k]] + k
            alpha[at] = emit[at] + (state.first if k == 0 else np.logaddexp(alpha[at - 1][:, [0]] + state.steps[0], alpha[at - 1][:, [1]] + state.steps[1]))
        for k in range(top - 2, -1, -1):
            at = first[: alive[k + 1]] + k
            nxt = emit[at + 1] + beta[at + 1]
            beta[at] = np.stack([np.logaddexp(state.steps[s, 0] + nxt[:, 0], state.steps[s, 1] + nxt[:, 1]) for s in (0, 1)], 1)
        log = alpha + beta
        norm = np.logaddexp(log[:, 0], log[:, 1])
        p = np.exp(log[:, 1] - norm)
        pair = alpha[inner][:, :, None] + state.steps[None] + (emit + beta)[inner + 1][:, None, :] - norm[inner][:, None, None]
        start = p[first[size > 0]]
        grads = (
            np.bincount(x.ravel(), np.repeat(z - p, x.shape[1]), N_FEATURES) - l2 * state.weights,
            seen_first - np.array([(1 - start).sum(), start.sum()]) - l2 * state.first,
            seen_steps - np.exp(pair).sum(0) - l2 * state.steps,
        )
        state = Field(*(adam(a, g / len(x), mom[2 * i], mom[2 * i + 1], t) for i, (a, g) in enumerate(zip((state.weights, state.first, state.steps), grads, strict=True))))
    return state


@tidy
def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = numbers(batch, "doc_id"), []
        for lo, hi, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text"))):
            got = Measured(data, offsets)
            out += [(int(d), got.features[a:b].tobytes()) for d, (a, b) in zip(ids[lo:hi], itertools.pairwise(got.line_first.tolist()), strict=True)]
        cols = zip(*out, strict=True) if out else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary()), strict=True)], ["doc_id", "lines"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field, fitted on at most `sample` labelled documents, half of either class, the first by a hash of doc_id."""
    picked = {}
    for good in (1, 0):
        some = labels.filter(F.col("quality") == good).filter("doc_id is not null")
        for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(sample // 2).collect():
            picked.setdefault(r.doc_id, bool(good))
    if not picked:
        return prior()
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("doc_id").isin(list(picked))).mapInArrow(_lines, "doc_id bigint, lines binary")
    # Of rows with one doc_id, one.
    rows = rows.groupBy("doc_id").agg(F.max("lines").alias("lines")).collect()
    found = {r.doc_id: np.frombuffer(r.lines, np.int16).reshape(-1, len(_CUTS)) for r in sorted(rows, key=lambda r: r.doc_id)}
    found = {d: x for d, x in found.items() if len(x)}
    return fit(list(found.values()), np.array([picked[d] for d in found], bool))


def _verdicts(data: np.ndarray, offsets: np.ndarray, field: Field, share: float) -> dict[str, np.ndarray]:
    got = Measured(data, offsets)
    failed = (got.n_words < LEAST_WORDS) | (100 * got.n_repeat_words > MOST_REPEATED * got.n_words)
    scores = field.weights[got.features.astype(np.int64)].sum(1).tolist()
    words, content = got.line_words, np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(itertools.pairwise(got.line_first.tolist())):
        if a < b and not failed[i]:
            content[i] = words[a:b] @ np.array(viterbi(scores[a:b], field))
    kept = ~failed & (content >= share * got.n_words)
    out = {k: getattr(got, k).astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return out | {"base_failed": failed, "kept": kept, "content_words": content}


def _judge(field: Field, share: float, filters: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_verdicts(data, offsets, field, share) for _, _, data, offsets in text_slices(batch.column(batch.schema.get_field_index("text")))]
            if not parts:
                continue
            out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            if filters:
                yield batch.filter(pa.array(out["kept"]))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *map(pa.array, out.values())], ["doc_id", *out])

    return run


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words."""
    small_batches(docs.sparkSession)
    field = fitted(docs, labels, sample)
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_words bigint"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_judge(field, share, False), schema)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """The documents, with all their columns, that stay."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_judge(fitted(docs, labels, sample), share, True), docs.schema)
