"""Each operator against a plain version, and the cases that its docstring defines."""

import hashlib
import itertools
import math
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat_format, html_blocks, jaccard_join, line_crf, mixing, packing, pii, queries, suffix_tree_lm, url_rules, voronoi_join
from millrace.llm.components import components
from millrace.llm.common import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row string, n string, key string, token string"


def docs(spark, rows):
    """(doc_id, text[, source]) rows, with columns whose names the operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "a", "b", "c", "d", "e") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Ünï cödé — “quotes” \U0001f600"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (7, "x " * 30000), (8, "nbsp\u00a0stays\x1cone word")]


def table(df):
    return df.toPandas()


# 1


def test_lm_base_and_cases(spark):
    rows = ODD + [(i, prose(60, i)) for i in range(20, 60)]
    got = table(suffix_tree_lm.score(docs(spark, rows), F.col("doc_id") % 7 == 2))
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if i is None or i % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert set(got.train_tokens) == {n} and (got.score < 0).all()


def test_lm_probabilities_sum_to_one():
    keys, n = np.array([(1 << 10) | 2, (1 << 10) | 3, (2 << 10) | 1, (3 << 10) | 1, 1, (2 << 10)]), np.array([900, 5, 400, 300, 50, 20])
    tree = suffix_tree_lm.Tree(8, (keys, n))
    tree.grow(keys[:4], n[:4])
    assert tree.n_states > 1
    for context in range(8):
        assert tree.probability(np.array([(context << 10) | s for s in range(8)])).sum() == pytest.approx(1)


class PlainTree:
    """The model in dictionaries, text by text: contexts are tuples of symbols, the nearest first."""

    def __init__(self, rows, held, depth, top, n_tails, least, min_bits=suffix_tree_lm.MIN_BITS):
        self.depth, train = depth, [self.words(t) for i, t in rows if not held(i)]
        self.counts = Counter(w for ws in train for w in ws)
        n_all = sum(self.counts.values()) + len(train)
        best = [w for w, _ in self.counts.most_common(top)]
        tail = lambda w: w[-2:]
        by_tail = Counter()
        for w, n in self.counts.items():
            if w not in best:
                by_tail[tail(w)] += n
        number = lambda t: t[-1] + (t[0] << 8 if len(t) > 1 else 0)
        classes = sorted(by_tail, key=lambda t: (-by_tail[t], number(t)))[:n_tails]
        self.symbol = lambda w: 1 + best.index(w) if w in best else 1 + len(best) + (classes.index(tail(w)) if tail(w) in classes else len(classes))
        self.size, self.n_top = len(best) + len(classes) + 2, len(best)
        self.weight = Counter()
        for w, n in self.counts.items():
            if w not in best:
                self.weight[self.symbol(w)] += n + 1
        grams = [Counter() for _ in range(depth + 1)]  # by length of context: (context, symbol)
        for ws in train:
            for k in range(depth + 1):
                grams[k].update(self.tokens(ws, k))
        self.root = [(1 + sum(n for (_, s), n in grams[1].items() if s == x)) for x in range(self.size)]
        self.root = [x / sum(self.root) for x in self.root]
        self.states = {}
        for k in range(1, depth + 1):
            self.keep(grams[k], lambda total: total >= least, min_bits)

    @staticmethod
    def words(t):
        return (t or "").encode().lower().split()

    def tokens(self, ws, k):
        symbols = [*map(self.symbol, ws), 0]
        return [(tuple(symbols[i - j] if i >= j else 0 for j in range(1, k + 1)), s) for i, s in enumerate(symbols)]

    def keep(self, grams, enough, min_bits):
        by = defaultdict(dict)
        for (c, s), n in grams.items():
            by[c][s] = n
        new = {}
        for c, own in by.items():
            total = sum(own.values())
            bits = sum(n / total * math.log2(n / total / self.probability(c[:-1], s)) for s, n in own.items())
            if enough(total) and bits >= min_bits and 2 * math.log(2) * total * bits >= 2 * len(own) + 10:
                new[c] = own
        self.states |= new

    def probability(self, context, s):
        p = self.root[s]
        for k in range(1, len(context) + 1):
            own = self.states.get(context[:k])
            if own:
                p = (own.get(s, 0) + len(own) * p) / (sum(own.values()) + len(own))
        return p

    def score(self, t):
        ws = self.words(t)
        out = sum(math.log10(self.probability(c, s)) for c, s in self.tokens(ws, self.depth))
        return out + sum(math.log10((self.counts[w] + 1) / (1 + self.weight[self.symbol(w)])) for w in ws if self.symbol(w) > self.n_top)


@pytest.mark.parametrize("again", [False, True])
def test_lm_scores_are_those_of_a_plain_tree(spark, again, monkeypatch):
    """Trunk, branches, classes and smoothing against the plain version; also with repeated ids and in many small packets."""
    monkeypatch.setattr(suffix_tree_lm, "_FLUSH", 500)
    rng = np.random.default_rng(5)

    def text(n):
        at, out = 0, []
        for _ in range(n):
            at = (3 * at + int(rng.integers(0, 3))) % 60 if rng.random() < 0.7 else int(rng.integers(0, 60) * rng.random())
            out.append(words[at])
        return " ".join(out)

    words = [f"w{chr(97 + i % 7)}{chr(97 + i % 3)}{chr(97 + i % 5)}" if i > 3 else f"top{i}" for i in range(60)]
    texts = [text(int(rng.integers(1, 60))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[i]) for i in range(20)] + [(700, None), (701, ""), (-9, texts[3])]
    rows += [(3, texts[3]), (3, texts[8]), (None, texts[8])] if again else []
    held = lambda i: (1 if i is None else i) % 7 == 2
    often = sorted(Counter(w for i, t in rows if not held(i) for w in (t or "").split()).values(), reverse=True)
    # A number of top words that no tie makes open.
    more = {"depth": 3 + again, "top": next(k for k in range(25, 60) if often[k - 1] > often[k]), "least": 2 + again}
    got = suffix_tree_lm.score(docs(spark, rows), F.coalesce(F.col("doc_id"), F.lit(1)) % 7 == 2, most_tails=6, p_min=0.01, most_entries=40 if again else 10_000, **more).collect()
    plain = PlainTree(rows, held, n_tails=6, **more)
    assert all(sum(len(c) == k for c in plain.states) > 3 for k in range(1, more["depth"] + 1))
    assert {r.n_states for r in got} == {1 + len(plain.states)}
    key = lambda i, x: (-1 if i is None else i, round(x, 7))
    assert sorted(key(r.doc_id, r.score) for r in got) == sorted(key(i, plain.score(t)) for i, t in rows)


def test_lm_tells_texts_that_occur_twice(spark):
    """What the tree holds grows with the corpus: of texts of words that are all rare, those that occur twice score higher."""
    for n in (60, 600):
        rows = docs(spark, [(7 * i, prose(80, i if i >= n // 10 else i // 2)) for i in range(n)])
        got = table(suffix_tree_lm.score(rows, F.lit(False), top=20))
        twice = got.doc_id < 7 * (n // 10)
        each = got.score / got.n_tokens
        assert each[twice].min() > each[~twice].max() and got.n_states.iloc[0] > 3 * n


def test_lm_learns(spark):
    rows = [(i, " ".join(["the quick brown fox jumps over the lazy dog again"] * 5) if i % 2 else prose(50, i)) for i in range(140)]
    got = table(suffix_tree_lm.score(docs(spark, rows), F.col("doc_id") % 7 == 2))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_lm_keeps_contexts_of_a_fifty_thousandth(spark):
    """A context seen in 0.001% to 0.005% of the training tokens is a state by default, wherever it is judged."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 300, 1000)) for _ in range(250)]
    texts = [t + " v0 v1 v2" if i < 6 else t for i, t in enumerate(texts)]
    n = " ".join(texts).split()
    seen = sum(a == "v0" and b == "v1" for a, b in zip(n, n[1:], strict=False))
    assert 1e-5 * len(n) <= seen < 5e-5 * len(n)
    rows = docs(spark, [(i * 7, t) for i, t in enumerate(texts)] + [(1, "v0 v1 v2")])
    held = F.col("doc_id") % 7 == 1
    got, same, few = (table(suffix_tree_lm.score(rows, held, **more).filter("held_out")).iloc[0] for more in ({}, {"p_min": 1e-3}, {"least": 50}))
    assert got.n_states == same.n_states and got.score == pytest.approx(same.score, abs=1e-9)
    assert got.n_states > few.n_states and got.score > few.score


@pytest.mark.parametrize("p_min", [1e-3, 1e-5])
def test_lm_other_text_takes_no_state_away(spark, p_min):
    """A phrase seen 40 times is worth as much in a large corpus as in a small one, however the work is dealt."""
    rng = np.random.default_rng(5)
    phrase = [f"u{i} alpha beta gamma" for i in range(40)]
    texts = [" ".join(phrase[i : i + 10] + [f"z{x}" for x in rng.integers(0, 400, 40)]) for i in range(0, 40, 10)]
    other = [" ".join(f"z{x}" for x in rng.integers(0, 400, 900)) for _ in range(100)]
    held = F.col("doc_id") == 9_999
    gain = []
    for more in ([], other):
        rows = [(i, t) for i, t in enumerate(texts + more)] + [(9_999, "alpha beta gamma")]
        got = table(suffix_tree_lm.score(docs(spark, rows), held, p_min=p_min).filter("held_out")).iloc[0]
        gain.append(got.score - got.base_score)
    assert gain[1] > gain[0] > 1  # what the words alone are worth falls, what the phrase is worth stays


def test_lm_frequent_contexts_have_longer_states(spark):
    """What follows is clear only from four symbols back, all the shorter contexts being frequent."""
    rng = np.random.default_rng(6)
    texts = []
    for i in range(60):
        out = []
        for _ in range(30):
            x = int(rng.integers(0, 2))
            out.append(f"k{x} of the old m{x}")
        texts.append(" ".join(out))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, "k0 of the old m0"), (901, "k0 of the old m1")]
    got = table(suffix_tree_lm.score(docs(spark, rows), F.col("doc_id") >= 900)).set_index("doc_id")
    assert got.score[900] - got.score[901] > 2


@pytest.mark.parametrize("depth", [2, 4])
def test_lm_takes_texts_apart_twice(spark, tmp_path, depth):
    """Once for the words' counts and once for symbols, however long contexts are; one more pass is over ids."""

    def passed(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    rows = docs(spark, [(i, prose(40, i)) for i in range(30)]).select("doc_id", "text").coalesce(1)
    got = suffix_tree_lm.score(rows.mapInArrow(passed, "doc_id bigint, text string"), F.col("doc_id") % 7 == 2, depth=depth)
    assert got.count() == 30 and len(list(tmp_path.iterdir())) == 3


def test_lm_places():
    """Numbers are found wherever they stand, also where many begin alike."""
    rng = np.random.default_rng(8)
    for bits, listed in ((20, rng.integers(0, 1 << 20, 5000)), (10, np.arange(1024)), (40, np.arange(700) + 5), (64, rng.integers(0, 1 << 63, 3000) * 2 + 1), (64, np.zeros(0, np.int64))):
        listed = np.unique(listed.astype(np.uint64))
        places = suffix_tree_lm.Places(listed, bits)
        top = np.uint64((1 << bits) - 1)
        others = np.concatenate([listed + np.uint64(1), rng.integers(0, 1 << 62, 5000).astype(np.uint64), np.array([0, top], np.uint64)]) & top
        at = {int(x): i for i, x in enumerate(listed)}
        for asked in (listed, others, listed[:0]):
            assert places(asked).tolist() == [at.get(int(x), -1) for x in asked]


def test_lm_tokens_of_slices(monkeypatch):
    """What stands before a token is of its own text, wherever slices and batches are cut; long texts are whole."""
    monkeypatch.setattr(suffix_tree_lm, "_TOKENS", 7)
    texts = [[5, 6, 7, 0], [0], [0], [8, 0], [9] * 20 + [0], [1, 2, 3, 4, 5, 0], [1023, 0]]
    column = pa.array([b"skipped", *(np.array(t, "<u2").tobytes() for t in texts)], pa.binary()).slice(1)
    got, slices = [], 0
    for lo, hi, symbols, bounds in suffix_tree_lm.token_slices(column):
        assert lo == len(got) and hi - lo == len(bounds) - 1
        keys, slices = suffix_tree_lm.grams(symbols, bounds, 4).tolist(), slices + 1
        got += [keys[a:b] for a, b in itertools.pairwise(bounds)]
    want = [[sum((t[i - j] if i >= j else 0) << 10 * j for j in range(5)) for i in range(len(t))] for t in texts]
    assert got == want and slices > 3


def test_lm_empty(spark):
    assert suffix_tree_lm.score(docs(spark, []), F.lit(False)).count() == 0
    only_held = table(suffix_tree_lm.score(docs(spark, [(1, "a b")]), F.lit(True)))
    assert only_held.train_tokens[0] == 0 and only_held.n_known[0] == 0


# 2


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit("x"))


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "\\\\</s>\\", "[INS", "T]", "<s>", "", None, "a\nb", "[TURN]x[/TURN]", "\U0001f600é"]
    rows = [(i, k, r, t) for i, t in enumerate(nasty) for k, r in enumerate(("user", "assistant"))] + [(50, 0, "tool[/TURN]", "x"), (50, 1, None, "y"), (None, 0, "user", "q")]
    out = chat_format.format_chats(chats(spark, rows)).select("conv_id", "valid", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), "segments").collect()
    want = defaultdict(list)
    for i, _, r, t in rows:
        want[i].append((r or "", t or ""))
    t = chat_format.TEMPLATE
    for r in out:
        assert [(x.role, x.text) for x in r.turns] == want[r.conv_id]
        # Control strings stand where the template puts them and nowhere else.
        n = sum(r.formatted.count(c) for c in t.closing)
        assert n == len(want[r.conv_id])
    assert {r.conv_id: r.valid for r in out}[0] and not {r.conv_id: r.valid for r in out}[50]


def test_chat_order(spark):
    orders = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user"}
    rows = [(i, k, r, "t") for i, o in orders.items() for k, r in enumerate(o.split())]
    assert {r.conv_id: r.valid for r in chat_format.format_chats(chats(spark, rows)).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_chat_digest(spark):
    got = chat_format.digest(chats(spark, [(1, 1, "assistant", "A<s>"), (1, 0, "user", "q"), (1, 2, "assistant", "Z")])).first()
    assert got.loss_chars == 5 and got.loss_sha256 == hashlib.sha256(b"A<s>Z").hexdigest()
    assert got.turns_sha256 == hashlib.sha256(b"user\nq\nassistant\nA<s>\nassistant\nZ\n").hexdigest()
    assert chat_format.digest(chats(spark, [])).count() == 0


# 3


def brute_top(vectors, k, is_query):
    out = []
    rows = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for at, (q, v) in enumerate(rows):
        if is_query(q):
            best = sorted((-int(v @ w), i) for b, (i, w) in enumerate(rows) if b != at and i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 8))
    rows = [(i, (centre[i % 5] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(700)] + [(5000, None), (5001, [None] * 8), (5002, [float("nan")] * 8), (5003, [float("inf")] * 8), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("g", F.lit(1)).withColumn("v", F.lit(2))
    got = voronoi_join.top_k(df, F.col("vec_id") % 100 == 0, n_pivots=7)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 10, lambda i: i % 100 == 0)


def test_knn_copies_little_of_clustered_vectors(spark):
    """200 clusters: of some 5,000 rows few are copied to other groups, though there are many bundles; still exact."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(200, 16))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    rows = [(i, (centre[i % 200] + 0.03 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(5003)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got, n, copies = voronoi_join.top_k_with_copies(df, F.col("vec_id") % 10 == 3, bundle=10)
    assert n == 5003 and copies < 5 * n
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 10, lambda i: i % 10 == 3)


def test_knn_copies_once_a_bundle_without_structure(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(2000)]
    got, n, copies = voronoi_join.top_k_with_copies(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert copies <= n
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 10, lambda i: i % 20 == 0)


def test_knn_repeated_ids(spark):
    """Rows of one id are queries and candidates each, and none answers another."""
    rng = np.random.default_rng(3)
    rows = [(i % 40, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(200)] + [(0, [1.0] * 4)] * 30
    got = voronoi_join.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, n_pivots=5, bundle=7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 10, lambda i: i % 20 == 0)


def test_knn_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in voronoi_join.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert voronoi_join.top_k(few.limit(0), F.lit(True)).count() == 0
    assert voronoi_join.top_k(few, F.lit(False)).count() == 0


# 4


def test_url_rules(spark):
    urls = ["http://a.example.com/en/71", "https://COM/en/x", "http://x.example.com/en/8", "http://m.example.net/de/8", "http://example.net/de/7?q", "http://a.org/es/#x", "http://organ/es/", "nothing", None, "", "x://h", "ftp://u@H.com:8/en/?a://b"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(99, urls[0])], "page_id bigint, url string").withColumn("tokens", F.lit(1))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.verdicts(pages, labels).collect()}
    assert got[0] == got[99] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1] == ("com", "/en/x", "com/en/", "block") and got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("org/es/", "block")
    assert got[6] == ("organ", "/es/", None, "allow") and got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10] == ("h", "", None, "allow")
    assert got[11] == ("u@h.com:8", "/en/", None, "allow")


def test_url_mining(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam-farm' if i % 4 == 0 else 'good'}.site{i % 3}.test/{'buy' if i % 8 == 0 else 'read'}/{i}") for i in range(800)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)] + [(1, None, None)], "doc_id bigint, quality int, toxic int")
    got = url_rules.verdicts(pages, labels).collect()
    assert len(got) == 800 and all((r.verdict == "block") == (r.page_id % 4 == 0) for r in got)
    # Each rule against plain counts.
    rows = {r.page_id: set(r.t) for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    for rule in url_rules.mined(pages, labels).collect():
        have = [i for i in range(600) if set(rule["items"]) <= rows[i]]
        bad = [i for i in have if i % 4 == 0]
        assert rule.support == pytest.approx(len(bad) / 600) and rule.confidence == pytest.approx(len(bad) / len(have)) and len(bad) >= url_rules.LEAST


def test_url_mining_of_a_template(spark):
    """Thirty names of one query aren't 2 ** 30 combinations; a rule needs all of a kind only where that makes it right."""
    names = "&".join(f"n{i}=1" for i in range(30))
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.test/p{i}?{names if i % 3 == 0 else 'n1=1'}") for i in range(300)] + [(None, None)] * 5, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    got = url_rules.verdicts(pages, labels).collect()
    assert len(got) == 305 and all((r.verdict == "block") == (r.page_id is not None and r.page_id % 3 == 0) for r in got)
    assert url_rules.mined(pages, labels).count() < 2000
    assert url_rules.verdicts(pages.limit(0), labels).count() == 0 and url_rules.verdicts(pages, labels.limit(0)).count() == 305


def mining(spark, rows):
    """(host, bad) rows as pages and labels."""
    pages = spark.createDataFrame([(i, f"http://{h}/p/{i}") for i, (h, _) in enumerate(rows)], "page_id bigint, url string")
    return pages, spark.createDataFrame([(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(rows)], "doc_id bigint, quality int, toxic int")


def test_url_mining_of_a_small_share(spark):
    """A host of six pages, all bad, is mined among some hundred pages and among many; two bad pages are too few."""
    for n in (200, 6000):
        pages, labels = mining(spark, [("farm.test", True)] * 6 + [("few.test", True)] * 2 + [(f"h{i % 40}.test", i % 5 == 0) for i in range(n)])
        blocked = {r.host for r in url_rules.verdicts(pages, labels).collect() if r.verdict == "block"}
        assert "farm.test" in blocked and "few.test" not in blocked and ("h1.test" not in blocked)


def test_url_mining_where_most_are_bad(spark):
    pages, labels = mining(spark, [("farm.test", True)] * 100 + [(f"h{i % 9}.test", i % 10 < 6) for i in range(900)])
    rules = {tuple(r["items"]): r.confidence for r in url_rules.mined(pages, labels).collect()}
    assert rules[("host=farm",)] == 1 and not any(x.startswith("host=h") for items in rules for x in items)


# 5


def plain_measures(text):
    text = text or ""
    ws = [m for m in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    hit = set()
    for i in range(len(ws) - 2):
        if grams[tuple(ws[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_measures(spark):
    rows = ODD + [(20, "a b c a b c a b c d"), (21, "l 1\n l 1\nl 1\n\n\nl 1"), (22, "\n".join(["x y z"] * 40)), (23, "#|<> a&b\r\nq")]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = sorted(tuple(r) for r in line_crf.judge(docs(spark, rows), labels).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted((-1 if i is None else i, *plain_measures(t)) for i, t in rows)


def lines_of(good, n, seed):
    rng = np.random.default_rng(seed)
    if good:
        return "\n".join(" ".join(f"word{x}" for x in rng.integers(0, 900, 14)) + "." for _ in range(n))
    return "\n".join(" | ".join(f"cell{x}" for x in rng.integers(0, 900, 14)) for _ in range(n))


def test_quality_learns(spark):
    rows = [(i, lines_of(i % 3 > 0, 8, i)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 200, 2)] + [(1, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = line_crf.judge(docs(spark, rows), labels).collect()
    assert all(r.kept == (r.doc_id % 3 > 0) for r in got)
    kept = line_crf.keep_good(docs(spark, rows), labels)
    assert kept.columns == docs(spark, []).columns and kept.count() == sum(r.kept for r in got)
    assert line_crf.judge(docs(spark, []), labels).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        field = line_crf.Field(np.zeros(1), rng.normal(size=2), rng.normal(size=(2, 2)))
        scores = rng.normal(size=6).tolist()

        def worth(path, field=field, scores=scores):
            return field.first[path[0]] + sum(s for s, x in zip(scores, path, strict=True) if x) + sum(field.steps[a, b] for a, b in itertools.pairwise(path))

        assert worth(line_crf.viterbi(scores, field)) == pytest.approx(max(map(worth, itertools.product((0, 1), repeat=6))))


# 6


def brute_components(rows):
    sets = []
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])))
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            comp[find(a)] = find(b)
    big = 1 << 63
    low = defaultdict(lambda: big)
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low[find(k)], big if i is None else i)
    return sorted((-1 if i is None else i, len(s), -1 if (c := low[find(k)]) == big else c) for k, (i, s) in enumerate(sets))


def varied(base, n, edits, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        ws = base.split()
        for p in rng.integers(0, len(ws), rng.integers(0, edits + 1)):
            ws[p] = f"e{rng.integers(1 << 30)}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_near_duplicates(spark, hot):
    passage = prose(60, 77)
    texts = varied(prose(120, 1), 60, 5, 1) + varied(prose(200, 2), 40, 14, 2) + [f"{passage} {prose(40, 100 + i)}" for i in range(40)] + [f"{passage} {prose(9, 300 + i)}" for i in range(40)]
    texts += [prose(30, 900 + i) for i in range(30)] + [passage] * 20 + ["A b C d e", "a B c d e", "a b c", "A B C"]
    rows = ODD + [(100 + (i * 37) % 1000, t) for i, t in enumerate(texts)]
    got = jaccard_join.near_duplicates(docs(spark, rows), hot=hot).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_components(rows)


def test_near_duplicates_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(jaccard_join, "FLUSH", 500)
    rows = [(i, t) for i, t in enumerate(varied(prose(120, 1), 40, 9, 5) + [prose(50, i) for i in range(10, 20)])]
    got = jaccard_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows)


def loose_ids():
    """Null and repeated ids near different documents, and one id of several texts."""
    a, b, c = prose(100, 3), prose(100, 4), prose(80, 5)
    return [(5, a), (9, b), (None, a + " more"), (None, b + " more"), (None, prose(70, 6)), (None, None), (7, a + " too"), (7, b + " too"), (7, c), (8, c), (8, c), (8, prose(60, 8)), (8, prose(60, 9)), (8, prose(60, 9)), (4, ""), (4, "")]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_near_duplicates_are_linked_by_text_not_by_id(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", few)
    monkeypatch.setattr(jaccard_join, "FEW_IDS", few)
    rows = loose_ids()
    got = jaccard_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_components(rows)
    four = jaccard_join.near_duplicates(docs(spark, rows[:4])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in four) == [(0, 5), (0, 9), (5, 5), (9, 9)]
    # One row of each component stays, and all without words.
    kept = [r.text for r in jaccard_join.keep_one(docs(spark, rows)).collect()]
    a, b, c = prose(100, 3), prose(100, 4), prose(80, 5)
    assert sorted(map(str, kept)) == sorted([a, b + " too", c, prose(70, 6), "None", prose(60, 8), prose(60, 9), "", ""])


def test_keep_one(spark):
    a = prose(100, 3)
    rows = [(5, a), (3, a), (3, a), (9, a + " more"), (4, prose(50, 4)), (1, None), (None, a), (2, "")]
    out = jaccard_join.keep_one(docs(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4] and out.columns == docs(spark, []).columns
    assert jaccard_join.keep_one(docs(spark, [])).count() == 0


def test_lists_of_unlinked_documents_make_no_pairs(spark):
    """Documents that share 8 of 10 shingles never link, and don't meet in pairs either."""
    entries = spark.createDataFrame([(1, i, 10, 2, i) for i in range(3000)] + [(2, i, 10 + i, 0, i) for i in range(200)], "token bigint, node bigint, n int, pos int, comp bigint")
    pairs = jaccard_join._across(entries, 80).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(i, j) for i in range(200) for j in range(i + 1, 200) if 100 * (10 + i) >= 80 * (10 + j)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 90)], "a bigint, b bigint")
    got = {r.node: r.comp for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 95: 90, 90: 90}


# 7


def water_level(sizes, weights, most=3):
    target, open_, rest = {}, dict(zip(sizes, weights, strict=True)), float(sum(sizes.values()))
    while open_:
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            rest -= target[s]
            del open_[s]
    return target


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(k * 1000 + i, "w " * int(rng.integers(1, 60)), s) for k, (s, n) in enumerate({"a": 400, "b": 20, "c": 300, "é": 5, None: 90}.items()) for i in range(n)] + [(1, None, "a"), (None, "x y", "z"), (7, "", "zz")]
    got = table(mixing.mix_sources(docs(spark, rows), block=64))
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ["a", "b", "c", "z", "zz", "é", None]}
    want = water_level(sizes, [5, 2, 1, 5, 2, 1, 5])
    for s, g in got.groupby(got["source"].where(got["source"].notna(), None), dropna=False):
        s = None if pd.isna(s) else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        if sizes[s] > 100:
            assert abs(g.taken.sum() - want[s]) <= 5
    again = table(mixing.mix_sources(docs(spark, rows[::-1]).repartition(3), block=64))
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).fillna(-1).values.tolist() == again[key].sort_values(key).fillna(-1).values.tolist()
    out = mixing.mixed(docs(spark, rows), block=64)
    assert out.count() == got.repeats.sum() and out.columns == docs(spark, []).columns
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_mix_of_a_hot_id(spark, monkeypatch):
    """Equal rows are dealt over blocks, in runs, and every one is there once."""
    monkeypatch.setattr(mixing, "RUN", 70)
    rows = [(None, "a b c", "s")] * 500 + [(i, "x y", "t") for i in range(100)]
    got = table(mixing.mix_sources(docs(spark, rows), block=16))
    assert len(got) == 600 and got.doc_id.isna().sum() == 500
    by = got.groupby("source")
    assert all(abs(g.taken.sum() - g.target.iloc[0]) <= 6 for _, g in by) and (got.taken <= 3 * got["size"]).all()


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    p, size = np.full(300, 0.37), rng.integers(0, 50, 300)
    q = mixing.flight(p, size)
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)


# 8


def plain_spans(text):
    def luhn(n):
        return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(n))) % 10 == 0

    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}


PII = [
    "mail a@b.co or \U0001f600 c.d+e@x-y.org.uk.; x@y", "a@b.c%d@e.f g@@h.i j@k..l", "1.2.3.4 001.002.3.4 1.2.3.4.5 256.1.1.1 1.2.3.256 12.34.56", "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 5",
    "+1 (017) 555-7713 and +44 20 7946 0958. +123 +1-2-3 +1234567890123456", "7 " * 9000, "1" * 5000, "a." * 5000 + "@" + "b." * 3000 + "c", "+" + "1 " * 8000, "9" * 12 + " " + "4111111111111111", "no data here",
]


def test_pii_base(spark):
    rows = ODD + [(100 + i, t) for i, t in enumerate(PII)]
    got = pii.spans(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        want = plain_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, xs in want.items() for a, b in xs)
        assert tuple(by[i][f"n_{k}"] for k in want) == tuple(map(len, want.values())), i
        assert by[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), i
        assert set(filter(None, text.split(","))) <= set(by[i].spans.split(","))
    assert pii.spans(docs(spark, [])).count() == 0


def test_pii_redaction(spark):
    rows = [(1, "mail a@b.co now"), (2, "ip 1.2.3.4, card 4111 1111 1111 1111"), (3, None), (4, "clean \U0001f600"), (5, "\U0001f600 +1 (017) 555-7713")]
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs(spark, rows)).collect()}
    assert out[1] == ("mail <email> now", 16) and out[2][0] == "ip <ip>, card <card>" and out[3] == (None, None) and out[4] == ("clean \U0001f600", 7) and out[5][0] == "\U0001f600 <phone>"
    assert pii.redact(docs(spark, rows)).columns == docs(spark, []).columns


def test_pii_em_finds_the_reliable_labeler():
    patterns = [((1, 0, 1, 1, 0, 0), 400), ((0, 0, 1, 1, 0, 0), 50), ((0, 0, -1, 0, -1, 0), 300), ((0, 0, 1, 0, -1, 0), 20)]
    share, tables, post = pii.reliabilities(patterns)
    assert post[0] > 0.9 and post[2] < 0.1 and 0.3 < share < 0.8
    w = pii.span_classifier(patterns)
    score = lambda v: w[0] + sum(w[1 + 2 * i] * (x == 1) + w[2 + 2 * i] * (x == -1) for i, x in enumerate(v))
    assert score((0, 0, 1, 1, 0, 0)) > 0 > score((0, 0, -1, 0, -1, 0))


def test_pii_em_is_that_of_whole_spans():
    """EM over counted patterns is EM over the spans themselves, in a plain version."""
    rng = np.random.default_rng(1)
    votes = [tuple(int(x) for x in rng.choice([-1, 0, 1], 6, p=[0.5, 0.3, 0.2] if rng.random() < 0.4 else [0.1, 0.3, 0.6])) for _ in range(300)]
    counted = sorted(Counter(votes).items())
    share, _, post = pii.reliabilities(counted, rounds=5)
    v = np.array(votes)
    p = 1 / (1 + np.exp(-v.sum(1)))
    for _ in range(5):
        plain_share = (pii.WEIGHT / 2 + p.sum()) / (pii.WEIGHT + len(v))
        odds = np.full(len(v), math.log(plain_share / (1 - plain_share)))
        for k in range(6):
            right = pii.RIGHT[pii.LABELERS[k]]
            yes = [(right if s == 1 else 1 - right) * pii.WEIGHT + p[v[:, k] == s].sum() for s in (1, -1)]
            no = [(1 - right if s == 1 else right) * pii.WEIGHT + (1 - p)[v[:, k] == s].sum() for s in (1, -1)]
            for s, a, b in zip((1, -1), yes, no, strict=True):
                odds[v[:, k] == s] += math.log(a / sum(yes) / (b / sum(no)))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    assert share == pytest.approx(plain_share) and dict(zip([c for c, _ in counted], post, strict=True)) == pytest.approx(dict(zip(votes, p, strict=True)))


def with_check_digit(number):
    return next(number + str(c) for c in range(10) if sum((2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) if k % 2 else int(x) for k, x in enumerate(reversed(number + str(c)))) % 10 == 0)


def planted(seed, n=400):
    """(text, spans to find besides the base ones) of hidden personal data and of look-alikes, with plain personal data around."""
    rng = np.random.default_rng(seed)
    r = lambda a, b: int(rng.integers(a, b))
    word = lambda: "".join(chr(97 + r(0, 26)) for _ in range(r(4, 9)))
    end = lambda: str(rng.choice(["com", "org", "de", "fr", "net", "br"]))
    four = lambda: f"{r(1000, 10000)}"

    def card():
        x = with_check_digit(f"4{r(10**13, 10**14)}")
        return str(rng.choice([".", "/", "_"])).join(x[i : i + 4] for i in range(0, 16, 4))

    true = {
        "email": [lambda: f"{word()} (at) {word()} (dot) {end()}", lambda: f"{word()}.{word()}[at]{word()}.{end()}", lambda: f"{word()} at {word()} dot {end()}"],
        "ip": [lambda: "[.]".join(str(r(1, 224) if i == 0 else r(0, 256)) for i in range(4)).replace("127[", "128["), lambda: ":".join(f"{r(0, 65536):x}" for _ in range(8))],
        "card": [card],
        "phone": [lambda: f"({r(212, 300)}) 555-0{r(100, 200)}", lambda: f"0049 30 {r(10**6, 10**7)}", lambda: f"030/{r(10**6, 10**7)}"],
    }
    false = [
        lambda: f"see you {word()} (at) {word()} (dot) {word()}zq now", lambda: f"we look at {word()} dot {word()}qz and", lambda: f"version {r(256, 999)}[.]{r(0, 9)}[.]{r(0, 9)}[.]{r(0, 9)}", lambda: f"ref {four()}.{four()}.{four()}.1{four()}9",
        lambda: f"order 1{r(11, 99)}-{r(111, 199)}-{four()}", lambda: f"sum 0{r(11, 99)} {r(100, 1000)}", lambda: f"serial {r(111, 199)}.{r(100, 199)}.{four()}",
    ]
    plain = [lambda: f"mail {word()}@{word()}.{end()}", lambda: f"ip {r(1, 120)}.{r(0, 256)}.2.3", lambda: "card " + with_check_digit(f"4{r(10**13, 10**14)}"), lambda: f"tel +49 30 {r(10**6, 10**7)}"]
    out = []
    for _ in range(n):
        text, want = f"{word()} {word()}, ", set()
        for _ in range(r(1, 5)):
            what = r(0, 5)
            if what < 2:
                kind = str(rng.choice(list(true)))
                text += f"{rng.choice(pii.CONTEXT[kind][:3])}: "
                span = true[kind][r(0, len(true[kind]))]()
                want.add(f"{kind}:{len(text)}:{len(text) + len(span)}")
                text += span
            else:
                text += false[r(0, len(false))]() if what < 4 else plain[r(0, len(plain))]()
            text += f"; {word()} {word()}. "
        out.append((text, want))
    return out


@pytest.mark.parametrize("seed", [7, 8])
def test_pii_finds_hidden_data_and_leaves_look_alikes(spark, seed):
    rows = planted(seed)
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.spans(docs(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    hits = found = wanted = 0
    by_kind = Counter()
    for i, (text, want) in enumerate(rows):
        base = {f"{k}:{a}:{b}" for k, xs in plain_spans(text).items() for a, b in xs}
        assert base <= got[i]
        more = got[i] - base
        hits, found, wanted = hits + len(more & want), found + len(more), wanted + len(want - base)
        by_kind.update(s.split(":")[0] for s in more & want)
    assert hits >= 0.95 * found and hits >= 0.95 * wanted and all(by_kind[k] > 20 for k in pii.KINDS), (hits, found, wanted, by_kind)


def test_pii_gazetteer_from_a_table(spark):
    own = pii.gazetteer(spark, spark.createDataFrame([("email", "Zone"), ("ip", None), ("other", "x"), (None, "y")], "kind string, entry string"))
    assert own.email == ["zone"] and own.phone == pii.gazetteer(spark).phone and "de" in pii.gazetteer(spark).email


# 9

PAGES = {
    "article": ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class=ad>Buy the best of it now.</div><article><h1>Head &amp; tail</h1><p>First  <b>bold</b>\n text.</p><p>Second &lt;p&gt;&nbsp;x<br>y</article><footer>The end of the page.</footer>", "Head & tail\nFirst bold text.\nSecond <p> x y"),
    "comments": ("<main><p>Body of the text is here.</p><div class='reader-comments'><p>I like it a lot.</p></div><aside>See also this.</aside><form>Name <input></form></main>", "Body of the text is here."),
    "plain": ("<body><div id=menu><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div><div><h2>A title</h2><p>" + "The cat sat on the mat and it was in the house of the man. " * 6 + "</p><p>And then it was over.</p><p>" + "It is the end of the story that we have to tell to you in this text. " * 5 + "</p></div><div class=footer>Copyright by the owner of this site.</div></body>", "A title\n" + ("The cat sat on the mat and it was in the house of the man. " * 6).strip() + "\nAnd then it was over.\n" + ("It is the end of the story that we have to tell to you in this text. " * 5).strip()),
    "named": (f"<body><div class='site-header'><h1>Site</h1></div><div id='topnav'><a href=1>Home</a></div><div id='content' class='has-sidebar'><h2>Head</h2><p>{'It was the best of the times. ' * 9}</p><p>Short one.</p><p>x | y | z</p><div class='comments'><p>{'I think it is the best of all. ' * 30}</p></div></div><div id='sidebar'><p>Most read of the week.</p></div><div class='cookie-notice'>We use cookies.</div></body>", "Head\n" + ("It was the best of the times. " * 9).strip() + "\nShort one.\nx | y | z"),
    "nested comments": ("<article class='post'><header class='entry-header'><h1>Head</h1></header><p>The text of it.</p><section id='comments'><article class='comment'><p>" + "I like it. " * 99 + "</p></article></section></article>", "Head\nThe text of it."),
    "inline": ("<article><p>One <span class='ad'>buy <span>this</span></span> two</p><p hidden>no</p><p style='display:none'>no</p></article>", "One two"),
    "around the article": ("<main><div class='promo'>Buy now</div><article><h1>T</h1><p>The text is in here and it is short.</p></article><section><h2>More news</h2><ul><li><a href=a>A thing</a></li></ul></section></main>", "T\nThe text is in here and it is short."),
    "broken": ("<article><p>One <b>two<p>three < four <!-- gone", "One two\nthree < four"),
    "formulas and buttons": ("<article><p>We have <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> here.<p><button>Go<p>The rest of it.<p><a href=x>A linked sentence of the text.</a><p>End of it.<select><option>A</select> And <svg><text>z</text></svg>more.</article>", "We have E=m here.\nThe rest of it.\nA linked sentence of the text.\nEnd of it. And more."),
    "links in the article": (f"<article><h1>Head</h1><p>{'It was the best of the times. ' * 9}</p><ul><li>One point</li><li><a href=a>One linked point</a></li><li>Last point</li></ul><h3>More</h3><ul><li><a href=a>First of the links</a></li><li><a href=b>Second of the links</a></li></ul></article>", "Head\n" + ("It was the best of the times. " * 9).strip() + "\nOne point\nOne linked point\nLast point"),
    "unclosed textarea": ("<article><p>Text of it.</p><textarea><p>More of the text.</p></article>", "Text of it.\nMore of the text."),
    "empty": ("", ""),
    "text only": ("just words", "just words"),
}


@pytest.mark.parametrize("name", PAGES)
def test_html(name):
    page, want = PAGES[name]
    assert html_blocks.main_text(page) == want


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGES["article"][0]), (2, None, None), (None, "v", "<"), (1, "u", PAGES["article"][0])], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_blocks.extract(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "v", 1), (1, "u", 43), (1, "u", 43), (2, "", 0)]
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_html_takes_time_in_proportion():
    import time

    for page in ("<table>" + "<tr><td>cell x</td></tr>" * 100_000 + "</table>", "<div>" * 10_000 + "x" + "</div>" * 10_000, "<div class=ad>" * 10_000 + "<p>y" * 10_000, "<div>" * 10_000 + "</ul>x<textarea>" * 10_000):
        began = time.process_time()
        html_blocks.main_text(page)
        # Beyond 2 seconds only where the machine itself is slow; the plain way would take minutes.
        assert time.process_time() - began < 6


def test_html_blocks_are_those_of_a_plain_parser():
    """Random pages of closed elements, against the parser of the standard library."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.text, self.linked, self.raw, self.tags, self.links = [], "", "", 0, [], 0

        def cut(self):
            if words := " ".join(self.text.split()):
                self.out.append((words, len(" ".join(self.linked.split())), any(t in html_blocks.BAD_TAGS for t in self.tags), "article" in self.tags))
            self.text = self.linked = ""

        def handle_starttag(self, tag, attrs):
            if tag in html_blocks.BLOCK_TAGS:
                self.cut()
                self.tags.append(tag)
            self.raw += tag in ("script", "style")
            self.links += tag == "a"

        def handle_endtag(self, tag):
            if tag in html_blocks.BLOCK_TAGS:
                self.cut()
                self.tags.pop()
            self.raw -= tag in ("script", "style")
            self.links -= tag == "a"

        def handle_data(self, data):
            if not self.raw:
                self.text += data
                self.linked += data if self.links else ""

    rng = np.random.default_rng(4)

    def inline():
        kind = rng.integers(0, 6)
        word = f"w{rng.integers(0, 50)} &amp; the of "
        return word if kind < 3 else f"<b>{word}</b>" if kind == 3 else f"<a href='/x'>{word}</a>" if kind == 4 else "<script>a<b>c</script> "

    def tree(deep):
        tag = str(rng.choice(["div", "section", "nav", "article", "aside", "blockquote", "ul"]))
        inner = "".join(tree(deep - 1) if deep and rng.integers(0, 2) else f"<p>{''.join(inline() for _ in range(rng.integers(1, 5)))}</p>" for _ in range(rng.integers(1, 5)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(200):
        page = f"<body>{tree(3)}{tree(2)}</body>"
        plain = Plain()
        plain.feed(page)
        found, _ = html_blocks.blocks(page)
        assert [(b.text, b.linked, b.sure_bad, b.level == 3) for b in found] == plain.out


def plain_labels(found):
    """The passes by looking along the page from every block. found: (text length, stop words' share, link share, bad for sure,
    in the article, heading of this level or 0, prose, words)."""
    n = len(found)
    if sum(f[1] * f[7] for f in found if not f[3]) < 0.05 * sum(f[7] for f in found if not f[3]):
        found = [(f[0], 1.0, *f[2:]) for f in found]
    rest = sum(f[0] for f in found if not f[3]) or 1
    has = sum(f[0] for f in found if not f[3] and f[4]) >= 0.3 * rest
    inside = [has and f[4] and not f[3] for f in found]

    def first(i):
        length, stops, links, bad, _, _, prose, _ = found[i]
        if bad or (has and not inside[i]):
            return "bad"
        if inside[i]:
            if links > 0.5 and length < 200 and not prose:
                return "links"
            return "short" if length < 70 or links > 0.5 else "good" if stops >= 0.2 or length > 200 else "near"
        if links > 0.2 or (length < 70 and links):
            return "bad"
        if length < 70:
            return "short"
        return ("good" if length > 200 else "near") if stops >= 0.3 else "near" if stops >= 0.2 else "bad"

    raw = [first(i) for i in range(n)]
    mine = [i for i in range(n) if inside[i]]

    def menu(i):
        at = mine.index(i)
        lo = next((k for k in range(at, -1, -1) if raw[mine[k]] != "links"), -1)
        hi = next((k for k in range(at, len(mine)) if raw[mine[k]] != "links"), len(mine))
        return hi - lo > 2 and (lo < 0 or (hi == len(mine) and not found[mine[lo]][5]))

    firsts = [x if x != "links" else "bad" if menu(i) else "short" for i, x in enumerate(raw)]

    def look(i, step, kinds, own=False):
        j = i + step
        while 0 <= j < n:
            if firsts[j] in kinds and (not own or inside[j]):
                return firsts[j]
            j += step
        return "edge"

    out = []
    for i in range(n):
        x, heading = firsts[i], found[i][5]
        if x in ("good", "bad"):
            out.append(x == "good")
        elif inside[i]:
            nxt = next((firsts[j] for j in range(i + 1, n) if inside[j]), "edge")
            out.append(heading == 1 or nxt != "bad" if heading else not look(i, -1, ("good", "bad"), True) == look(i, 1, ("good", "bad"), True) == "bad")
        else:
            a, b = look(i, -1, ("good", "bad")), look(i, 1, ("good", "bad"))
            if heading:
                out.append(None)
            elif x == "near":
                out.append("good" in (a, b) or "good" not in firsts)
            elif "good" in (a, b):
                kinds = ("good", "bad", "near")
                out.append(a == b or (look(i, -1, kinds) in ("near", "good") and look(i, 1, kinds) in ("near", "good")))
            else:
                out.append(False)
    for i in range(n):
        if out[i] is None:  # goes with what the next block that is no heading has become
            out[i] = next((out[j] for j in range(i + 1, n) if not found[j][5]), False)
    return out if any(out) else [x in ("short", "near") and not f[3] for x, f in zip(firsts, found, strict=True)]


def test_html_labels_are_those_of_the_plain_passes():
    rng = np.random.default_rng(5)
    seen = Counter()
    for _ in range(3000):
        found = []
        for _ in range(rng.integers(1, 14)):
            n, stops = int(rng.choice([3, 12, 14, 30, 80])), rng.choice([0, 0.25, 0.5])
            text = " ".join("the" if rng.random() < stops else "word" for _ in range(n))
            heading = int(rng.choice([0, 0, 0, 1, 2]))
            found.append(html_blocks.Block(text, int(len(text) * rng.choice([0, 0, 0, 0.3, 0.8])), bool(rng.random() < 0.1), 0, int(rng.choice([0, 0, 3])), heading, heading > 0 or rng.random() < 0.5))
        plain = [(len(b.text), b.text.split().count("the") / len(b.text.split()), b.linked / len(b.text), b.sure_bad, b.level == 3, int(b.title) or 2 * b.heading, b.prose, len(b.text.split())) for b in found]
        html_blocks.first_pass(found, [0])
        html_blocks.second_pass(found)
        assert [b.label == "good" for b in found] == plain_labels(plain)
        seen.update((b.first, b.label, b.article) for b in found)
    assert len(seen) >= 10


def test_html_random_tags_never_fail():
    rng = np.random.default_rng(0)
    bits = ["<", ">", "p", "</p>", "<p>", "<div class='", '"', "'", " x ", "<!--", "-->", "<script>", "</script", "&amp;", "<a href=", "</article>", "<article>", "=", "/", "<br/>", "\n"]
    for _ in range(500):
        html_blocks.main_text("".join(rng.choice(bits, rng.integers(0, 40))))


# 10


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    tricky = ["it's the dog's. They're", "A<|endoftext|>b <|ENDOFTEXT|> c.", "e\u0301 combining", "ΟΔΟΣ ΣΑΣ", "İstanbul ǅ", "x...!! ,a. b,c", "\u3000wide\u2003spaces\x85", "don't 'quoted' 'tis", "#tag $$$ a&&& %%%", "123abc4.5", "ﬁ ligature ½", "日本語 text。"]
    rows = ODD + [(100 + i, x) for i, x in enumerate(tricky)] + [(200 + i, prose(300, i)) for i in range(30)] + [(300, prose(9000, 1)), (300, prose(9000, 1))]
    got = table(packing.pack(docs(spark, rows), path))
    want = []
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, k, s, len(p), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), 4096)) for p in [ids[s : s + 4096]]]
    assert sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    bins = []
    for n in sorted(got.length, reverse=True):
        k = next((k for k, b in enumerate(bins) if b + n <= 4096), None)
        bins.append(n) if k is None else bins.__setitem__(k, bins[k] + n)
    assert got.sequence_id.nunique() <= len(bins)  # first-fit decreasing
    assert packing.pack(docs(spark, []), path).count() == 0


@pytest.mark.parametrize(("most", "most_bytes"), [(1_000_000, 32_000_000), (50, 32_000_000), (1_000_000, 300)])
def test_parts_of_long_runs_of_marks_and_a_cache_that_starts_anew(monkeypatch, most, most_bytes):
    monkeypatch.setattr(packing.WordCache, "MOST", most)
    monkeypatch.setattr(packing.WordCache, "MOST_BYTES", most_bytes)
    cache = packing.WordCache(queries.tokenizer_path())
    texts = [f"{a}{'!' * n}{b}" for n in (0, 1, 2, 15, 16, 17, 18, 40, 300) for a in ("", "x", "x ", "é", "1", "a.b") for b in ("", " y", "y", "\n" + "?" * n)] + [prose(40, k) for k in range(40)]
    seen = set()
    for lo in range(0, len(texts), 8):
        some = [x.encode() for x in texts[lo : lo + 8]]
        flat, bounds = cache.ids(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        for k, x in enumerate(some):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == cache.tokenizer.encode(x.decode(), add_special_tokens=False).ids, x
        assert cache.held == sum(map(len, cache.index))
        seen |= {*cache.index}
    assert (len(cache.index) == len(seen)) == (most > 50 and most_bytes > 300)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    for seed in range(20):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 100, 30), rng.integers(1, 50, 30), strict=True)}
        rows, n = packing.plan(counts, 100)
        fill, used = Counter(), Counter()
        for length, lo, hi, first, copies, _, _ in rows:
            assert (hi - lo) % copies == 0
            used[length] += hi - lo
            for s in range(first, first + (hi - lo) // copies):
                fill[s] += length * copies
        assert used == Counter(counts) and max(fill.values()) <= 100 and len(fill) == n, seed


def test_second_swap_of_best_two_fit():
    # Greedy fills 60 + 30 and leaves 10; its smallest, 30, gives way to 21 + 19, which fill the gap.
    rows, _ = packing.plan({60: 1, 30: 1, 21: 1, 19: 1}, 100)
    assert sorted(r[0] for r in rows if r[3] == 0) == [19, 21, 60]


# Pipeline


def test_pipeline_stages(spark, small, tmp_path):
    current = spark.read.parquet(f"{small}/documents.parquet")
    start = {r.doc_id: r for r in current.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, small)
        if name != "pack_sequences":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if name in ("quality_rules", "near_duplicates"):
            assert {r.doc_id for r in new.collect()} <= {r.doc_id for r in current.collect()}
            assert all(r == start[r.doc_id] for r in new.collect())
        if name == "near_duplicates":
            comp = brute_components([(r.doc_id, r.text) for r in current.collect()])
            assert sorted(r.doc_id for r in new.collect()) == sorted({c for _, _, c in comp})
        if name == "personal_data":
            assert new.count() == current.count()
            assert not any(any(plain_spans(r.text).values()) for r in new.collect())
        if name == "mix_sources":
            old = {r.doc_id: r for r in current.collect()}
            n = Counter(r.doc_id for r in new.collect())
            assert max(n.values()) <= 3 and all(r == old[r.doc_id] for r in new.collect())
        current = new
    assert current.count() > 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_rows(spark, small, k):
    stage = corpus_pipeline.STAGES[k][1]
    for rows in ([], ODD, [(None, None)]):
        df = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
        stage(spark, df, small).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = table(queries.QUERIES[name](spark, small)), con.execute(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(map(tuple, got[cols].astype(object).values.tolist()), key=repr) == sorted(map(tuple, want[cols].astype(object).values.tolist()), key=repr)


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
