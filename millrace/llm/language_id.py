"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 3 characters of the lower-cased text, runs of anything but letters and marks being one space, hashed
to 2^16 numbers; a value is (1 + ln count) * idf, scaled to length 1. Document frequencies are counted over all texts that may be
learnt from. The weights are fitted with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties), which leaves
most of them at zero, in one pass over a bounded sample: about SAMPLE texts of each language, chosen by a hash of the text. A
fifth of the sample is kept from that fit and sets the temperature by which logits are divided before they are made probabilities.

Counts of n-grams are of whole texts, CHUNK characters at a time. Frequencies leave a task as one row for each number; the model
is at most 2^16 rows of a weight for each language.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text where nothing can be learnt; languages
with no text to learn from can't be predicted; one language gets score 1; of equal probabilities the language that is first by
code point wins; equal texts of one language count once in the sample; repeated rows and null ids are rows each; an empty table
gives no rows; other columns are ignored. Beyond LANGUAGES languages the most frequent are learnt.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, collected, small_batches, tidy

BITS, ORDERS = 16, 3
SIZE = 1 << BITS

#: Bounds of the fit: texts a language, about, and languages.
SAMPLE, LANGUAGES = 1_500, 300

#: Step size, its offset, and the penalties on absolute values and on squares.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.1

#: Characters taken at a time.
CHUNK = 1 << 20

NONE = "und"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """2 for each letter, 1 for each mark, 0 for any other character."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)], np.uint8)


_STEPS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def _numbers(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the n-grams of these characters, an order at a time."""
    total = np.zeros(len(codes), np.uint32)
    for n in range(min(ORDERS, len(codes))):
        ahead = codes[n:]
        total = (total[: len(ahead)] + ahead + np.uint32(1)) * _STEPS[n]
        yield (((total ^ (total >> np.uint32(15))) * _STEPS[0]) >> np.uint32(32 - BITS)).astype(np.uint16)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's n-grams in order, and their counts; none if it has no letter."""
    rest, seen, many = np.array([32], np.uint32), False, np.zeros(SIZE, np.int64) if len(text or "") > CHUNK else None
    for lo in range(0, len(text or ""), CHUNK):
        codes = np.frombuffer(text[lo : lo + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kinds()[codes]
        seen |= bool((kinds == 2).any())
        codes = np.where(kinds > 0, codes, np.uint32(32))
        # A space stays only after something else.
        stays = codes != 32
        stays[1:] |= codes[:-1] != 32
        stays[0] |= rest[-1] != 32
        rest = np.concatenate([rest, codes[stays]])
        if many is not None and lo + CHUNK < len(text):
            # N-grams that begin in the last few characters wait for what follows.
            starts = max(0, len(rest) - ORDERS + 1)
            many += np.bincount(np.concatenate([x[:starts] for x in _numbers(rest)]), minlength=SIZE)
            rest = rest[starts:]
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if rest[-1] != 32:
        rest = np.append(rest, np.uint32(32))
    numbers = np.sort(np.concatenate([*_numbers(rest)]), kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    found, counts = numbers[starts].astype(np.int64), np.diff(starts, append=len(numbers))
    if many is None:
        return found, counts
    many[found] += counts
    found = np.flatnonzero(many)
    return found, many[found]


class Model(NamedTuple):
    """Weights of `rows` (n-gram numbers in order; SIZE is the constant), times idf, a column a language; temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at, x = vector(found, counts, self.idf)
        return x @ self.weights[at] + self.weights[SIZE]

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = counted(text)
        if not len(found) or not self.languages:
            return NONE, 0.0
        p = softmax(self.logits(found, counts) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF values of length 1."""
    x = (1 + np.log(counts)) * idf[found]
    return found, x / np.sqrt(x @ x)


def idf_of(frequencies: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + frequencies)) + 1


class Leader:
    """Follow-the-regularised-leader for all languages: sums of gradients less what steps moved, and sums of their squares."""

    def __init__(self, n_languages: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((SIZE + 1, n_languages)), np.zeros((SIZE + 1, n_languages))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        small = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -small / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, found: np.ndarray, x: np.ndarray, language: int) -> None:
        at, x = np.append(found, SIZE), np.append(x, 1.0)
        w = self.weights(at)
        error = softmax(x @ w)
        error[language] -= 1
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature_of(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden section over its logarithm; 1 without texts."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        x = logits / math.exp(log_t)
        top = x.max(1)
        return float((np.log(np.exp(x - top[:, None]).sum(1)) + top - x[np.arange(len(x)), truth]).mean())

    lo, hi, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


@tidy
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, texts that have it) of a task's texts; number SIZE counts the texts."""
    total = np.zeros(SIZE + 1, np.int64)
    for batch in batches:
        for text in batch.column(0):
            found, _ = counted(text.as_py())
            if len(found):
                total[found] += 1
                total[SIZE] += 1
    some = np.flatnonzero(total)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["number", "n"])


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, language, texts = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            found, counts = counted(texts[i].as_py())
            if len(found):
                arrays = [pa.array([x], t) for x, t in ((key[i].as_py(), pa.int64()), (language[i].as_py(), pa.string()), (found, pa.list_(pa.int32())), (counts, pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "language", "found", "counts"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for batch in batches:
        language, found, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("language", "found", "counts"))
        for i in range(batch.num_rows):
            yield language[i].as_py(), found[i].values.to_numpy().astype(np.int64), counts[i].values.to_numpy()


def _fit(languages: list[str], idf: np.ndarray, settings: tuple[float, float, float, float]):
    number = {c: i for i, c in enumerate(languages)}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader(len(languages), *settings)
        for language, found, counts in _rows(batches):
            leader.learn(*vector(found, counts, idf), number[language])
        w = leader.weights()
        some = np.flatnonzero(w.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(w[some]), pa.list_(pa.float64()))], ["number", "w"])

    return run


def _logits(model: Model):
    number = {c: i for i, c in enumerate(model.languages)}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, found, counts in _rows(batches):
            arrays = [pa.array([number[language]], pa.int32()), pa.array([model.logits(found, counts)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["truth", "logits"])

    return run


def fitted(docs: DataFrame, may_learn: Column, sample: int = SAMPLE, settings: tuple[float, float, float, float] = (ALPHA, BETA, L1, L2)) -> Model:
    """The model, learnt from text and lang of the documents that may be learnt from."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "languages")
    learnt = docs.filter(may_learn).select("text", "lang").filter("text is not null")
    frequencies = collected(learnt.select("text").mapInArrow(_frequencies, "number int, n bigint").groupBy("number").agg(F.sum("n").alias("n")))  # SIZE rows at most
    by_number = np.zeros(SIZE + 1, np.int64)
    by_number[frequencies["number"]] = frequencies["n"]
    idf = idf_of(by_number[:SIZE], int(by_number[SIZE]))
    n_texts = learnt.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    n_texts = {r.lang: r.n for r in n_texts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    empty = Model([], idf, np.zeros((SIZE + 1, 0)), 1.0)
    if not n_texts:
        return empty
    # A hash of the text is below the language's share for about `sample` of its texts.
    key = F.xxhash64("text")
    shares = F.create_map(*(F.lit(x) for c, n in n_texts.items() for x in (c, min(1.0, sample / n))))
    picked = learnt.select(key.alias("key"), "lang", "text").filter(F.col("lang").isin(list(n_texts)))
    picked = picked.filter(F.shiftrightunsigned("key", 1) / F.lit(2.0**63) < shares[F.col("lang")]).dropDuplicates(["lang", "key"])
    picked = scratch.keep(picked.mapInArrow(_features, "key bigint, language string, found array<int>, counts array<bigint>"))
    checks = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    languages = sorted(r.language for r in picked.filter(~checks).select("language").distinct().collect())  # LANGUAGES at most
    if not languages:
        return empty
    # The fit goes through its bounded sample row by row, in one task, in the order of the hash.
    in_order = picked.filter(~checks).repartition(1).sortWithinPartitions("key", "language")
    found = collected(in_order.mapInArrow(_fit(languages, idf, settings), "number int, w array<double>"))
    weights = np.zeros((SIZE + 1, len(languages)))
    if len(found):
        weights[found["number"]] = np.stack([*found["w"]])
    model = Model(languages, idf, weights, 1.0)
    known = picked.filter(checks & F.col("language").isin(languages))
    held = collected(known.mapInArrow(_logits(model), "truth int, logits array<double>"))  # about a fifth of the sample
    if not len(held):
        return model
    return model._replace(temperature=temperature_of(np.stack([*held["logits"]]), held["truth"].to_numpy()))


def _predicted(model):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.value.predict(t.as_py()) for t in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array([c for c, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents (doc_id, text, lang). held_out: a condition on doc_id; a row that isn't known to
    be held out is learnt from."""
    small_batches(docs.sparkSession)
    held = F.coalesce(held_out, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, ~held, sample))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    return rows.mapInArrow(_predicted(model), "doc_id bigint, held_out boolean, lang_pred string, score double")
