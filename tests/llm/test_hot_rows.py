"""Texts with very many spans, and mixes of documents without ids."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, pii

from test_llm import docs, plain_spans, prose


def many_spans(n, seed):
    """Base spans of all kinds close together, over many blocks and chunks, in text of one to four bytes a character."""
    rng = np.random.default_rng(seed)
    kinds = [lambda i: f"user{i}@host.example.com", lambda i: f"10.{i % 256}.3.{i % 200}", lambda i: "4111 1111 1111 1111", lambda i: f"+49 30 {1_000_000 + i}"]
    gaps = [" ", ", ", " \U0001f600 ", " é ", " tel ", "\n", " " + "ü" * 40 + " ", " x" * 700 + " "]
    p = np.array([30, 30, 5, 5, 5, 5, 5, 0.3])
    return "".join(kinds[int(rng.integers(4))](i) + gaps[int(rng.choice(8, p=p / p.sum()))] for i in range(n))


@pytest.mark.parametrize("n", [255, 256, 257, 1500])
def test_pii_of_many_spans(spark, n):
    text = many_spans(n, n)
    row = pii.spans(docs(spark, [(1, text)])).first()
    want = plain_spans(text)
    assert tuple(row[f"n_{k}"] for k in want) == tuple(map(len, want.values()))
    found = [x.split(":") for x in row.spans.split(",")]
    assert {f"{k}:{a}:{b}" for k, xs in want.items() for a, b in xs} <= set(row.spans.split(","))
    # Redacting is cutting these spans out of the text, one by one.
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in found), key=lambda x: (x[1], x[2], pii.KINDS.index(x[0]))):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    assert pii.redact(docs(spark, [(1, text)])).first().text == "".join(out) + text[at:]


def test_pii_left_is_what_stands_before(spark):
    """Also where matches follow each other within LEFT characters, and at the start."""
    text = many_spans(600, 3)
    df = docs(spark, [(1, text)]).select("text")
    got = pii.with_spans(df, {"e": (F.lit(True), pii.EMAIL), "d": (F.lit(True), "[0-9]")}).first()
    assert len(got.d) > 3000
    for x in (*got.e, *got.d):
        assert text[x.start : x.end] == x.match and x.left == text[max(0, x.start - pii.LEFT) : x.start]


def test_pii_proposals_beside_base_spans(spark):
    """Of the proposed spans those go that overlap a base span of any kind: against all pairs."""
    texts = [many_spans(300, 5), "mail a (at) b.example.com, 1.2.3.4 tel (212) 555-7713 1.2.3.4 and +49 30 1234567 or 0049 30 1234567", "a@b.example.com" * 5, ""]
    df = docs(spark, list(enumerate(texts))).select("doc_id", "text")
    known = pii.gazetteer(spark)
    marked = {r.doc_id: r for r in pii.marked(df).collect()}
    for r in pii.candidates(df, known).collect():
        m = marked[r.doc_id]
        base = [(k, x.start, x.end) for k in pii.KINDS for x in m[f"b_{k}"]]
        more = [(k, x.start, x.end) for k in pii.KINDS for x in m[f"p_{k}"] if not any(b < x.end and x.start < c for _, b, c in base)]
        got = [(pii.KINDS[x.kind], x.start, x.end, x.base) for x in r["all"]]
        assert Counter(got) == Counter([(*b, True) for b in base] + [(*p, False) for p in more])


def test_mix_of_rows_without_ids(spark):
    """A third of all rows has no id, among them equal rows: every row stays what it is, and totals are the mix's."""
    rows = [(None, prose(int(n), i), "a") for i, n in enumerate(np.random.default_rng(2).integers(1, 6, 150))] + [(None, "same words here", "a")] * 60 + [(7, "same words here", "b")] * 9
    rows += [(i, prose(3 + i % 5, i), "b") for i in range(100, 300)] + [(400, None, None), (401, "", None), (None, None, None)]
    df = docs(spark, rows)
    took = mixing.mix_sources(df, block=64).toPandas()
    out = mixing.mixed(df, block=64)
    got = out.select("doc_id", "text", "source").collect()
    assert out.columns == df.columns and len(got) == took.repeats.sum()
    size = lambda t: len((t or "").split())
    want = Counter()
    for r in took.itertuples():
        want[None if r.doc_id != r.doc_id else int(r.doc_id), r.source if isinstance(r.source, str) else None, r.size] += r.repeats
    assert Counter((r.doc_id, r.source, size(r.text)) for r in got) == Counter({k: v for k, v in want.items() if v})
    here, copies = Counter((r[0], r[1], r[2]) for r in rows), Counter((r.doc_id, r.text, r.source) for r in got)
    rates = {s: took[(took.source == s) if s else took.source.isna()].repeats for s in ("a", "b", None)}
    for key, n in copies.items():  # as often as its source's rate lets each of these rows be taken
        assert here[key] * rates[key[2]].min() <= n <= here[key] * rates[key[2]].max()
    again = mixing.mixed(docs(spark, rows[::-1]).repartition(5), block=64).select("doc_id", "text", "source").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    windows = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line]
    assert not any("windowspecdefinition(doc_id" in line for line in windows)


def test_knn_outliers_do_not_copy_the_table(spark):
    """Queries in groups of their own, with fewer rows than k: bounds come from other groups, and results stay exact."""
    from millrace.llm import voronoi_join

    from test_llm import brute_top

    rng = np.random.default_rng(2)
    centre = rng.normal(size=(200, 16))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    rows = [(i, (centre[i % 200] + 0.03 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(4003)]
    far = [(10 * (10_000 + i) + 3, (8 * np.sign(rng.normal(size=16))).astype(np.float32).tolist()) for i in range(4)]
    df = spark.createDataFrame(rows + far, "vec_id bigint, embedding array<float>")
    asked = lambda i: i % 100 == 3
    got, n, copies = voronoi_join.top_k_with_copies(df, F.col("vec_id") % 100 == 3, bundle=10)
    assert n == 4007 and copies < 2 * n
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows + far, 10, asked)
