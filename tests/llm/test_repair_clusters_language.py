"""Conversation repair, centroid clustering and language identification against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import conv_repair, language_id, partial_distance, queries
from millrace.llm.conv_repair import Conversation, Turn

# 11


def best_edits(turns):
    """All edits of each row and all insertions of up to two turns between rows; the least (cost, audit) and its turns."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    rows = []
    for x in turns:
        more = 3 if x.fault == "truncated" else 0
        mine = [("D", 4, None)]
        if x.fault not in ("blank", "duplicate"):
            mine += [("K", more, x.role), ("R", 3 + more, "user"), ("R", 3 + more, "assistant")]
        rows.append(mine)
    names = {"u": "user", "a": "assistant"}
    for picks in itertools.product(*rows):
        for fills in itertools.product(gaps, repeat=len(turns) + 1):
            audit, cost, said = "I" * len(fills[0]), 3 * sum(map(len, fills)), [f"{names[c]}:" for c in fills[0]]
            for x, (e, n, role), fill in zip(turns, picks, fills[1:], strict=True):
                audit, cost = audit + e + "I" * len(fill), cost + n
                said += [f"{role}:{x.text}"] * (role is not None) + [f"{names[c]}:" for c in fill]
            if re.fullmatch("(s?(ua)+)?", "".join(s[:1] for s in said)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, said
    return best


def run(turns, rows=True):
    c = Conversation(1, rows)
    out = [e for x in turns for e in c.add(x)] + [*c.end()]
    return c.figures(), out


def random_turns(rng, n):
    faults = rng.choice(["", "", "", "blank", "duplicate", "truncated"], n)
    roles = rng.choice(["system", "user", "assistant", "tool", " "], n, p=[0.2, 0.35, 0.35, 0.05, 0.05])
    return [Turn(int(i), str(r), f"t{i}", str(f)) for i, (r, f) in enumerate(zip(roles, faults, strict=True))]


def test_repair_is_the_best_of_all_edits():
    rng = np.random.default_rng(3)
    for n in [0, 1, 1, 1, 2, 2, 2, 2, *[3] * 12]:
        turns = random_turns(rng, n)
        cost, audit, said = best_edits(turns)
        got, edits = run(turns)
        assert got[6:8] == (cost, audit)
        assert [f"{e.role}:{e.text}" for e in edits if e.edit != "D"] == said
        assert got[8] == hashlib.sha256("\n".join(said).encode()).hexdigest()
        assert "".join(e.edit for e in edits) == audit


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_repair_in_pieces_is_the_same(monkeypatch, piece):
    """Long conversations: pieces of a few rows against one search over all of them."""
    rng = np.random.default_rng(piece)
    for n in (5, 40, 150):
        for _ in range(8):
            turns = random_turns(rng, n)
            monkeypatch.setattr(conv_repair, "PIECE", 10_000)
            whole = run(turns)
            monkeypatch.setattr(conv_repair, "PIECE", piece)
            assert run(turns) == whole
            assert run(turns, rows=False)[0] == whole[0]


def test_repair_holds_little_of_a_long_conversation():
    rng = np.random.default_rng(0)
    c, most = Conversation(1, True), 0
    for _ in range(40):
        for x in random_turns(rng, 500):
            for _ in c.add(x):
                pass
            most = max(most, max(len(w.audit) for w in c.ways.values()), sum(len(w.pieces) for w in c.ways.values()))
    assert most < 4 * conv_repair.PIECE


def test_repair_cases(spark):
    text = "Fine here."
    rows = [
        (1, 0, "user", text), (1, 0, "user", text), (1, 1, "assistant", "Cut"), (1, 4, "assistant", None), (1, None, "system", "First."),
        (2, 0, None, "No role."), (3, 0, "user", "x " * 60_000 + "."), (None, 0, "user", text), (None, 1, "assistant", text), (4, 7, "assistant", "\t\n"),
    ]
    turns = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, fault string, edit string, place int")
    got = {None if pd.isna(r.conv_id) else int(r.conv_id): r for r in conv_repair.figures(turns).toPandas().itertuples()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal) == (2, 1, 1, 1, 2)
    assert (got[1].cost, got[1].audit) == (4 + 3 + 4, "KKDKD")
    assert (got[None].cost, got[None].audit) == (0, "KK") and (got[3].cost, got[3].audit) == (3, "KI") and got[4].audit == "D" and got[2].audit == "D"
    edits = conv_repair.repair(turns).orderBy("conv_id", "place").toPandas()
    said = edits[(edits.conv_id == 1) & (edits.edit != "D")]
    assert list(zip(said.role, said.text, strict=True)) == [("system", "First."), ("user", text), ("assistant", "Cut")]
    assert edits.groupby("conv_id", dropna=False).place.apply(lambda x: sorted(x) == [*range(len(x))]).all()
    empty = turns.filter("false")
    assert conv_repair.figures(empty).count() == 0 and conv_repair.repair(empty).count() == 0


def test_repair_query_damages_by_crc(spark, small, tmp_path):
    """The query's damage row by row, an all-dropped conversation, and repaired rows against the hash."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {c} {t}. Yes!") for c in range(400) for t in range(4)] + [(9000, None, "user", "Alone."), (None, None, None, None)]
    lost = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {None if pd.isna(r.conv_id) else int(r.conv_id): r for r in queries.op11_conv_repair(spark, str(tmp_path)).toPandas().itertuples()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        x = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        by[c] += [(t, "user" if x == 4 else role, "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text)] * (0 if x == 0 else 2 if x == 3 else 1)
    assert set(got) == set(by)
    for c, own in by.items():
        seen, turns = set(), []
        for t, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append(Turn(t, role, text, fault))
        counts, said = Counter(x.fault for x in turns), got[c]
        assert (said.blank, said.duplicate, said.truncated) == (counts["blank"], counts["duplicate"], counts["truncated"])
        assert (said.cost, said.audit, said.repaired_sha256) == run(turns)[0][6:9]
        known = {t for t, _, _ in own} - {None}
        assert said.gaps == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert said.illegal == sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    assert (got[lost].cost, got[lost].audit, got[lost].repaired_sha256) == (0, "", hashlib.sha256().hexdigest())


# 12


@pytest.mark.parametrize(("dims", "k", "spread"), [(64, 16, 3), (64, 16, 40), (5, 3, 2), (64, 1, 9), (9, 16, 1)])
def test_nearest_is_the_first_of_the_least_distances(dims, k, spread):
    rng = np.random.default_rng(dims + k + spread)
    x = rng.integers(-spread, spread + 1, (700, dims))
    c = np.concatenate([x[: k - 1], x[:1]]) if k > 1 else x[:1]  # the last equals the first
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    at, distance, work = partial_distance.nearest(x, c, rng.permutation(dims))
    assert (at == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert work <= 700 * k * dims


def test_centroids_are_given_up_early():
    rng = np.random.default_rng(2)
    centres = rng.integers(-500, 500, (16, 64))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-5, 6, (4000, 64))
    _, _, work = partial_distance.nearest(x, centres, np.arange(64))
    assert work < 0.3 * 4000 * 16 * 64


def plain_clusters(rows, k=16, rounds=3):
    x = [(i, [math.floor(64 * float(a)) for a in v]) for i, v in rows]
    c = [v for _, v in sorted(x, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in x]

    for _ in range(rounds):
        by = defaultdict(list)
        for (_, v), (_, j) in zip(x, assign(), strict=True):
            by[j].append(v)
        c = [[sum(col) // len(by[j]) for col in zip(*by[j], strict=True)] if j in by else m for j, m in enumerate(c)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(x, found, strict=True)]


def test_clusters_are_those_of_a_plain_version(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).round(2).tolist()) for i in range(150)]
    rows += [(5, rows[7][1]), (6, rows[6][1]), (6, rows[6][1]), (None, rows[9][1]), (200, [0.0] * 64), (201, [0.0] * 64)]
    odd = [(300, None), (301, [1.0] * 63), (302, [None] * 64), (303, [float("nan")] * 64), (304, [float("inf")] + [0.0] * 63), (305, [])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows + odd], "vec_id bigint, embedding array<float>, cluster string, v int")
    exact = [(i, np.float32(v).tolist()) for i, v in rows]
    got = partial_distance.clusters(df).toPandas()
    key = lambda r: repr(r)
    want = sorted(plain_clusters(exact), key=key)
    assert sorted(((None if pd.isna(r[0]) else int(r[0]), *r[1:]) for r in got.itertuples(index=False, name=None)), key=key) == want


def test_clusters_of_few_none_and_huge_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert partial_distance.clusters(spark.createDataFrame([], schema)).count() == 0
    few = partial_distance.clusters(spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64)], schema)).toPandas()
    assert sorted(few.cluster) == [0, 1] and set(few.distance) == {0}
    huge = [(i, [3e38 if i % 2 else -3e38] * 64) for i in range(60)]
    got = partial_distance.clusters(spark.createDataFrame(huge, schema)).toPandas()
    assert len(got) == 60 and (got.distance == 0).all()


# 13


def plain_counts(text):
    out, codes = Counter(), []
    text = "".join(c if language_id._kinds()[ord(c)] else " " for c in text.lower())
    codes = [ord(c) for c in f" {' '.join(text.split(' '))} "]
    codes = [c for i, c in enumerate(codes) if c != 32 or i == 0 or codes[i - 1] != 32]
    for i in range(len(codes)):
        total = 0
        for n in range(min(language_id.ORDERS, len(codes) - i)):
            total = (total + codes[i + n] + 1) * int(language_id._STEPS[n]) % 2**32
            out[((total ^ (total >> 15)) * int(language_id._STEPS[0]) % 2**32) >> (32 - language_id.BITS)] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 64, 1 << 20])
def test_counts_are_of_whole_texts(monkeypatch, chunk):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    for text in ("a", "Ab 12 cd", "  x  ", "Ünï—cödé हिन्दी भाषा", "one, two; three...  four\n\n5 6 five", "a1b2c3 " * 40):
        found, counts = language_id.counted(text)
        assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == dict(plain_counts(text))
    for text in (None, "", " ", "123 ... \n", "́"):
        assert not len(language_id.counted(text)[0])


def test_leader_follows_the_plain_rule():
    rng = np.random.default_rng(4)
    leader, z, n = language_id.Leader(3, 0.5, 1.0, 0.2, 0.1), defaultdict(float), defaultdict(float)

    def weight(i, k):
        a = z[i, k]
        return 0.0 if abs(a) <= 0.2 else -(a - math.copysign(0.2, a)) / ((1.0 + math.sqrt(n[i, k])) / 0.5 + 0.1)

    for _ in range(30):
        found, label = np.sort(rng.choice(50, 6, replace=False)), int(rng.integers(3))
        x = rng.random(6)
        leader.learn(found, x, label)
        full = [*zip(found.tolist(), x.tolist(), strict=True), (language_id.SIZE, 1.0)]
        w = {(i, k): weight(i, k) for i, _ in full for k in range(3)}
        e = [math.exp(sum(w[i, k] * v for i, v in full)) for k in range(3)]
        for i, v in full:
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == label))
                z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / 0.5 * w[i, k]
                n[i, k] += g * g
    got = leader.weights()
    assert all(got[i, k] == pytest.approx(weight(i, k)) for i in [*range(50), language_id.SIZE] for k in range(3))
    assert (got[:50] == 0).any() and not got[50 : language_id.SIZE].any()


def test_temperature_is_that_of_the_least_loss():
    rng = np.random.default_rng(6)
    logits = rng.normal(size=(400, 4)) * 3
    truth = np.array([rng.choice(4, p=language_id.softmax(row / 2.5)) for row in logits])
    t = language_id.temperature_of(logits, truth)
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(400), truth]).mean()
    assert loss(t) <= min(loss(x) for x in np.geomspace(0.05, 15, 300)) + 1e-9 and 1.5 < t < 4
    assert language_id.temperature_of(logits[:0], truth[:0]) == 1.0


def test_prediction_is_plain_regression_of_tf_idf():
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], 1 + rng.random(language_id.SIZE), rng.normal(size=(language_id.SIZE + 1, 2)), 0.7)
    text = "Some words, and some more words"
    x = {i: (1 + math.log(c)) * model.idf[i] for i, c in plain_counts(text).items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    z = [sum(v / size * model.weights[i, k] for i, v in x.items()) + model.weights[language_id.SIZE, k] for k in range(2)]
    e = [math.exp(v / 0.7) for v in z]
    name, score = model.predict(text)
    assert name == "ab"[int(e[1] > e[0])] and score == pytest.approx(max(e) / sum(e))


DOCS = "doc_id bigint, text string, lang string, source string, score string, key string, found string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "s", "a", "b", "c") for r in rows], DOCS)


def test_document_frequencies_cover_all_texts(spark):
    texts = [f"word{i} common" if i % 3 else f"mot{i} commun" for i in range(60)] + ["", None, "12"]
    docs = made(spark, [(i, t, None if i == 5 else "en" if i % 3 else "fr") for i, t in enumerate(texts)])
    model = language_id.fitted(docs, F.col("doc_id") != 1)
    counts = Counter(k for i, t in enumerate(texts) if t and i != 1 and i < 60 for k in plain_counts(t))
    want = language_id.idf_of(np.array([counts[i] for i in range(language_id.SIZE)]), 59)
    assert np.allclose(model.idf, want) and model.languages == ["en", "fr"]


def test_held_out_languages(spark, small):
    """On the given documents, with held-out labels, sources and ids changed: same predictions, and right ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = queries.held_out(4)
    got = language_id.languages(docs, held).toPandas().set_index("doc_id")
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    again = language_id.languages(other, held).toPandas().set_index("doc_id")
    assert (got.lang_pred == again.lang_pred[got.index]).all() and (got.score == again.score[got.index]).all()
    truth = docs.toPandas().set_index("doc_id").lang
    out = got[got.held_out]
    assert (out.lang_pred == truth[out.index]).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_language_cases(spark):
    en, fr = "the cat sat on the mat and the dog", "le chat est sur la table et le chien"
    rows = [(i, f"{en} {i}", "en") for i in range(1, 40)] + [(i + 100, f"{fr} {i}", "fr") for i in range(1, 40)]
    rows += [(3, None, "en"), (None, en, "en"), (None, fr, None), (7, "", "fr"), (8, "123 !?", "fr"), (9, en, "en"), (9, en, "en"), (510, f"{fr} " * 40_000, "fr"), (11, "x", None)]
    got = language_id.languages(made(spark, rows), F.col("doc_id") % 5 == 2).toPandas()
    assert len(got) == len(rows)
    assert set(got.lang_pred) == {"en", "fr", "und"} and (got.score[got.lang_pred == "und"] == 0).all()
    assert sorted(got[got.lang_pred == "und"].doc_id) == [3, 7, 8]
    assert not got.held_out[got.doc_id.isna()].any()
    assert set(got[got.doc_id.isin([109, 510])].lang_pred) == {"fr"} and set(got[got.doc_id == 9].lang_pred) == {"en"}
    none = made(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    got = language_id.languages(none, F.col("doc_id") % 5 == 2).toPandas()
    assert set(got.lang_pred) == {"und"} and len(got) == len(rows)
    one = language_id.languages(made(spark, rows).withColumn("lang", F.lit("en")), F.lit(False)).toPandas()
    assert (one.score[one.lang_pred == "en"] == 1).all()
    assert language_id.languages(made(spark, rows).filter("false"), F.lit(False)).count() == 0


def test_a_hot_text_does_not_fill_the_sample(spark):
    """A third of all rows is one text; other texts of its language are still learnt."""
    rows = [(i, "same words again", "en") for i in range(300)] + [(i + 1000, f"quick brown fox {i} jumps", "en") for i in range(300)] + [(i + 2000, f"vif renard brun {i} saute", "fr") for i in range(300)]
    got = language_id.languages(made(spark, rows), F.col("doc_id") % 4 == 2, sample=100).toPandas()
    rest = got[got.doc_id >= 1000]
    assert (rest.lang_pred == np.where(rest.doc_id >= 2000, "fr", "en")).all()
