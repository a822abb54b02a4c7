"""Personal data by weak supervision, in DataFrame functions alone.

Base spans (email, ip, card, phone) come from fixed patterns. Looser patterns propose more spans of every kind: obfuscated
e-mail and internet addresses, cards with other marks between their digits, telephone numbers in national form. Labelers vote on
every span, yes, no or not at all: the strict pattern, marks of obfuscation, gazetteers, context words before the span, words
that speak against it, and what can be computed from the digits. Expectation-maximisation over each kind's table of vote
patterns (a few hundred rows at most, counted over all documents) estimates each labeler's reliability for that kind, and a
logistic span classifier of the kind is trained on its posteriors. It decides on the proposed spans; base spans stay.

Gazetteers are tables (kind, entry): ends of host names, country codes of telephone numbers, first digits of card issuers, and
first parts of internet addresses that belong to nobody. `gazetteer` has a default; a table of one's own may be given.

Defined cases: a null or empty text has no spans; spans of a kind don't overlap, and a proposed span that overlaps any base
span goes; repeated rows are judged each; an empty table gives no rows; other columns are ignored by `spans` and kept by
`redact`. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone")

# Each base pattern matches what the plain one does, with no way back into what it took and, where a start inside a run can't
# match if the run's start can't, with starts at runs only. So long runs take linear time and no deep stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Proposals beyond the base spans. All are bounded or take what they can at once, so none backtracks over long runs.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[(\[{] ?at ?[)\]}] ?[a-z0-9-]{1,64}+(?:(?: ?[(\[{] ?dot ?[)\]}] ?|\.| dot )[a-z0-9-]{1,64}+){1,5}| at [a-z0-9-]{1,64}+(?: dot [a-z0-9-]{1,64}+){1,5})",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?[(\[{] ?(?:\.|dot) ?[)\]}] ?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}[./_](?:[0-9]{4}[./_][0-9]{4}[./_][0-9]{1,7}|[0-9]{6}[./_][0-9]{5})(?![0-9]|[./_][0-9])",
    "phone": r"(?<![0-9+.-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}|00[1-9][0-9]{0,2}[ .-]\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,8}){1,4}|\(?0[1-9][0-9]{1,4}\)?[ /-][0-9]{3,8}(?:[ -][0-9]{2,5})?)(?![0-9-])",
}
#: A cheap condition that a text with a proposal meets.
MAY_HAVE = {
    "email": r"(?i)[(\[{] ?at ?[)\]}]| dot ",
    "ip": r"[0-9] ?[(\[{] ?(?:\.|dot) ?[)\]}]|(?:[0-9A-Fa-f]{1,4}:){7}",
    "card": r"[0-9]{4}[./_][0-9]{4}",
    "phone": r"[0-9]{3}\)? ?[-.]?[0-9]{3}[-.][0-9]{4}|00[1-9][0-9]{0,2}[ .-]|0[1-9][0-9]{1,4}\)?[ /-][0-9]{3}",
}

# Words that stand before personal data, and before numbers that are none.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write", "write to", "reach", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "from", "adresse", "dirección", "client", "login", "user"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "pan"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "handy", "appelez", "llame"),
}
AGAINST = ("isbn", "issn", "doi", "order", "invoice", "version", "release", "build", "page", "section", "figure", "table", "id", "no", "nr", "ref", "sku", "part", "serial", "date", "sum", "total")
# Ends of host names that are no country's; calling codes by their first digits; issuers of cards by theirs, with
# the numbers of digits they give; first parts of internet addresses that no one person has.
HOST_ENDS = "com org net edu gov mil int info biz io eu uk name pro app dev online shop site cloud tech xyz me tv cc ai example test invalid".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CALLING_BLOCKS = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
ISSUERS = r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|62[0-9]{14,17}|(?:50|5[6-9]|6[0-9])[0-9]{10,17}"
NOBODYS = [str(x) for x in (0, 127, *range(224, 256))]

LABELERS = ("strict", "marks", "gazetteer", "context", "against", "digits")
LEFT = 32
#: Characters of a chunk that texts are cut from.
CHUNK = 1_024
MOST_ENTRIES = 100_000


class Gazetteer(NamedTuple):
    """Entries in lower case."""

    email: list[str]
    phone: list[str]
    card: str
    ip: list[str]


def gazetteer(spark: SparkSession, entries: DataFrame | None = None) -> Gazetteer:
    """The default: countries' ends of host names by their ISO codes, and the fixed values. entries (kind, entry), MOST_ENTRIES at
    most, stand in for the default of the kinds that they have; of kind card, an entry is a pattern of whole numbers."""
    countries = [str(x).lower() for x in spark._jvm.java.util.Locale.getISOCountries()]
    found = Gazetteer([*HOST_ENDS, *countries], [*CALLING_CODES, *(f"{x}{i}" for x in CALLING_BLOCKS for i in range(10))], ISSUERS, NOBODYS)
    if entries is None:
        return found
    rows = entries.filter(F.col("kind").isin(*KINDS) & F.col("entry").isNotNull()).select("kind", F.lower("entry").alias("entry")).distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a gazetteer has {MOST_ENTRIES} entries at most")
    by = {k: sorted(r.entry for r in rows if r.kind == k) for k in KINDS}
    return found._replace(**{k: "|".join(x) if k == "card" else x for k, x in by.items() if x})


SPAN = "struct<start:int,end:int,match:string,left:string>"

#: Elements that a fold appends at a time. Appending one by one copies what is there for each element; in blocks it is copied once
#: a block, so 32,000 spans of one text cost some eight times what 4,000 do.
FOLD = 256


def scanned(n: Column, start: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<out> of what step(state, i) gives for i from 1 to n; it returns the next state and the element. start: the first state."""

    def let(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, i: Column) -> Column:
        state, element = step(acc["state"], i)
        return F.struct(state.alias("state"), F.array_append(acc["out"], element).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.sequence(b * FOLD + 1, F.least(n, (b + 1) * FOLD)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(own, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], x["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.ceil(n / FOLD).cast("int") - 1)
    return F.when(n > 0, F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), block, lambda acc: acc["out"])).otherwise(none)


def with_spans(docs: DataFrame, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """docs (with text, not null) and, by name, array<struct<start, end, match, left>> of a pattern's matches, left being the LEFT
    characters before it. Texts that a cheap condition rules out skip the pattern. The pieces between matches say where each match
    stands and what is before it, so no position is looked up in the text. It takes three projections, so that no pattern runs twice
    on a text."""
    own = docs.columns
    docs = docs.select(*own, *(c.alias(f"c_{k}") for k, (c, _) in patterns.items()))
    none = F.array().cast("array<string>")
    found = [F.when(F.col(f"c_{k}"), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, (_, p) in patterns.items()]
    piece = lambda x: F.struct(F.length(x).alias("n"), F.right(x, F.lit(LEFT)).alias("tail"))
    between = [F.when(F.col(f"c_{k}"), F.transform(F.split("text", p, -1), piece)).otherwise(F.array().cast("array<struct<n:int,tail:string>>")).alias(f"g_{k}") for k, (_, p) in patterns.items()]
    docs = docs.select(*own, *found, *between)

    def placed(k: str) -> Column:
        def step(state: Column, i: Column) -> tuple[Column, Column]:
            match, gap = F.element_at(f"m_{k}", i), F.element_at(f"g_{k}", i)
            at, left = state["at"] + gap["n"], F.right(F.concat(state["left"], gap["tail"]), F.lit(LEFT))
            end = at + F.length(match)
            return F.struct(end.alias("at"), F.right(F.concat(left, match), F.lit(LEFT)).alias("left")), F.struct(at.alias("start"), end.alias("end"), match.alias("match"), left.alias("left"))

        return scanned(F.size(f"m_{k}"), F.struct(F.lit(0).alias("at"), F.lit("").alias("left")), SPAN, step)

    return docs.select(*own, *(placed(k).alias(k) for k in patterns))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + (lambda d: F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))(F.substring(number, i, F.lit(1)).cast("int")),
    )
    return F.pmod(total, F.lit(10)) == 0


def _part_ok(match: Column) -> Column:
    """All parts at most 255, leading zeros or not."""
    return match.rlike(r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def marked(docs: DataFrame) -> DataFrame:
    """docs (with text, not null) and b_<kind>, base spans, and p_<kind>, proposed ones."""
    text, own = F.col("text"), docs.columns
    docs = with_spans(
        docs,
        {
            "b_email": (F.contains(text, F.lit("@")), EMAIL),
            "b_ip": (text.rlike(r"[0-9]\.[0-9]"), IP),
            "b_card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD),
            "b_phone": (F.contains(text, F.lit("+")), PHONE),
            **{f"p_{k}": (text.rlike(MAY_HAVE[k]), LOOSE[k]) for k in KINDS},
        },
    )
    n = lambda x: F.length(digits(x["match"]))
    keep = {
        "b_ip": F.filter("b_ip", lambda x: _part_ok(x["match"])),
        "b_card": F.filter(F.filter("b_card", lambda x: n(x).between(13, 19)), lambda x: luhn(digits(x["match"]))),
        "b_phone": F.filter("b_phone", lambda x: n(x).between(9, 15)),
    }
    return docs.select(*own, *(keep.get(c, F.col(c)).alias(c) for c in docs.columns[len(own) :]))


def _near(left: Column, words: tuple[str, ...]) -> Column:
    return left.rlike(r"(?i)(?:^|[^\p{L}])(?:" + "|".join(words) + r")[.:#]*\s*\S{0,12}\s*$")


def _votes(kind: str, base: bool, x: Column, known: Gazetteer) -> Column:
    """A struct of the labelers' votes: 1 yes, -1 no, 0 none."""
    match, left = x["match"], x["left"]
    none = F.lit(0)
    d = digits(match)
    national = d.rlike("^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{6}$")
    v6 = F.contains(match, F.lit(":"))

    def either(yes: Column) -> Column:
        return F.when(yes, 1).otherwise(-1)

    gazetteers = {
        "email": lambda: either(F.lower(F.regexp_extract(match, r"([A-Za-z]+)[^A-Za-z]*$", 1)).isin(*known.email)),
        "ip": lambda: F.when(~v6 & F.regexp_extract(match, "^0*([0-9]+)", 1).isin(*known.ip), -1).otherwise(0),
        "card": lambda: either(d.rlike(f"^(?:{known.card})$")),
        "phone": lambda: F.when(match.rlike(r"^(?:\+|00)"), either(F.regexp_replace(d, "^0+", "").rlike(f"^(?:{'|'.join(known.phone)})"))).otherwise(0),
    }
    marks = {"email": either(F.contains(match, F.lit("@")) | match.rlike(r"[)\]}]")), "ip": F.when(match.rlike(r"[)\]}]"), 1).otherwise(0)}
    computed = {
        "card": lambda: either(luhn(d)),
        "ip": lambda: either(v6 | _part_ok(F.regexp_replace(match, "[^0-9]+", "."))),
        "phone": lambda: F.when(match.rlike(r"^(?:\([2-9]|[1-9])"), either(national)).otherwise(either(F.length(d).between(9, 15))),
    }
    against = F.when(_near(left, AGAINST) | left.rlike(r"[0-9A-Za-z_#=/-]$"), -1).otherwise(0)
    return F.struct(
        F.lit(1 if base else 0).alias("strict"), (none if base else marks.get(kind, none)).alias("marks"), gazetteers[kind]().alias("gazetteer"),
        F.when(_near(left, CONTEXT[kind]), 1).otherwise(0).alias("context"), against.alias("against"), computed.get(kind, lambda: none)().alias("digits"),
    )


def with_candidates(docs: DataFrame, known: Gazetteer) -> DataFrame:
    """docs (with text, not null) and all: array of kind, start, end, base and votes."""
    own = docs.columns
    docs = marked(docs)

    def entry(kind: str, base: bool) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), _votes(kind, base, x, known).alias("votes"))

    base = F.concat(*(F.transform(f"b_{k}", entry(k, True)) for k in KINDS))
    more = F.concat(*(F.transform(f"p_{k}", entry(k, False)) for k in KINDS))
    docs = docs.select(*own, base.alias("base"), more.alias("more"))
    # A proposed span must not overlap a base one: by their starts, none before it ends after its start, and the next one starts
    # after its end. Each is looked at once from either side.
    first = lambda x: F.struct(x["start"].alias("start"), x["base"].alias("base"), x["end"].alias("end"), x["kind"].alias("kind"), x["votes"].alias("votes"))
    docs = docs.select("*", F.array_sort(F.concat(F.transform("base", first), F.transform("more", first))).alias("up"))
    docs = docs.select(*own, "up", F.reverse("up").alias("down"))

    def before(state: Column, i: Column) -> tuple[Column, Column]:
        x = F.element_at("up", i)
        return F.when(x["base"], F.greatest(state, x["end"])).otherwise(state), state

    def after(state: Column, i: Column) -> tuple[Column, Column]:
        x = F.element_at("down", i)
        return F.when(x["base"], x["start"]).otherwise(state), state

    n = F.size("up")
    docs = docs.select(*own, "up", scanned(n, F.lit(0), "int", before).alias("reach"), F.reverse(scanned(n, F.lit((1 << 31) - 1), "int", after)).alias("next"))
    kept = F.filter(F.arrays_zip("up", "reach", "next"), lambda z: z["up"]["base"] | ((z["reach"] <= z["up"]["start"]) & (z["next"] >= z["up"]["end"])))
    whole = lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "base", "votes")))
    return docs.select(*own, F.transform(kept, lambda z: whole(z["up"])).alias("all"))


def candidates(docs: DataFrame, known: Gazetteer | None = None) -> DataFrame:
    """doc_id, all of documents (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return with_candidates(docs, known or gazetteer(docs.sparkSession)).select("doc_id", "all")


Patterns = list[tuple[tuple[int, ...], int]]
#: What is believed of a labeler before any span is seen, as if WEIGHT spans had shown it: the share of its votes that are
#: right. Lists and digits rule things out more surely than words around a span or brackets in it do.
RIGHT, WEIGHT = {"strict": 0.9, "marks": 0.7, "gazetteer": 0.9, "context": 0.8, "against": 0.8, "digits": 0.9}, 8.0


def reliabilities(patterns: Patterns, rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """EM over vote patterns (votes, count) of one kind: the share of true spans, each labeler's P(vote | true), P(vote | false)
    among its votes, and each pattern's posterior. It starts from the majority."""
    post = [1 / (1 + math.exp(-sum(v))) for v, _ in patterns]
    share, tables = 0.5, []
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        share = (WEIGHT / 2 + sum(p * n for p, (_, n) in zip(post, patterns, strict=True))) / (WEIGHT + total)
        tables = []
        for k, name in enumerate(LABELERS):
            right, wrong = RIGHT[name] * WEIGHT, (1 - RIGHT[name]) * WEIGHT
            t = {1: (right, wrong), -1: (wrong, right)}
            for p, (votes, n) in zip(post, patterns, strict=True):
                if votes[k]:
                    a, b = t[votes[k]]
                    t[votes[k]] = (a + p * n, b + (1 - p) * n)
            sums = sum(a for a, _ in t.values()), sum(b for _, b in t.values())
            tables.append({v: (a / sums[0], b / sums[1]) for v, (a, b) in t.items()})
        post = []
        for votes, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes, strict=True) if v)
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return share, tables, post


def span_classifier(patterns: Patterns, rounds: int = 2000, rate: float = 0.5, l2: float = 0.01) -> list[float]:
    """Weights (bias, and two for each labeler: its yes and its no) of a logistic classifier of spans, trained on the posteriors
    from the prior beliefs on. A pattern counts by the logarithm of its number of spans, so those that are everywhere don't
    drown the others."""
    start = [-0.5, *(sign * math.log(RIGHT[k] / (1 - RIGHT[k])) for k in LABELERS for sign in (1, -1))]
    if not patterns:
        return start
    _, _, post = reliabilities(patterns)
    rows = [([1.0, *(float(v == s) for v in votes for s in (1, -1))], p, math.log1p(n)) for (votes, n), p in zip(patterns, post, strict=True)]
    total, w = sum(n for _, _, n in rows), start
    for _ in range(rounds):
        grad = [l2 * (a - x) for a, x in zip(start, w, strict=True)]
        for x, p, n in rows:
            e = (p - 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))) * n / total
            grad = [g + e * a for g, a in zip(grad, x, strict=True)]
        w = [a + rate * g for a, g in zip(w, grad, strict=True)]
    return w


def trained(found: DataFrame) -> list[list[float]]:
    """A classifier for each kind, from all documents' candidates."""
    votes = found.select(F.explode("all").alias("x")).select("x.kind", *(F.col(f"x.votes.{k}").alias(k) for k in LABELERS))
    # At most 3 ** 6 rows a kind.
    counts = votes.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS).collect()
    return [span_classifier([(tuple(r[k] for k in LABELERS), r.n) for r in counts if r.kind == i]) for i in range(len(KINDS))]


def chosen(all_: Column, weights: list[list[float]]) -> Column:
    """Base spans and the proposed ones that the classifier of their kind takes, by kind and start."""

    def score(x: Column, w: list[float]) -> Column:
        total = F.lit(w[0])
        for i, k in enumerate(LABELERS):
            total = total + F.when(x["votes"][k] == 1, w[1 + 2 * i]).when(x["votes"][k] == -1, w[2 + 2 * i]).otherwise(0.0)
        return total

    def taken(x: Column) -> Column:
        out = F.lit(False)
        for i, w in enumerate(weights):
            out = F.when(x["kind"] == i, score(x, w) > 0).otherwise(out)
        return out

    kept = F.filter(all_, lambda x: x["base"] | taken(x))
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))))


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def spans(docs: DataFrame, known: Gazetteer | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of documents (doc_id, text)."""
    found = Scratch(docs.sparkSession, "pii").keep(candidates(docs, known))
    every = found.select("doc_id", chosen(F.col("all"), trained(found)).alias("spans"))
    base = F.filter("spans", lambda x: x["base"])

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == i))).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return every.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, known: Gazetteer | None = None) -> DataFrame:
    """The documents with <kind> in place of each span; of overlapping spans, one mark for all, by the first. n_chars follows
    where the text changed. A null text stays null."""
    known = known or gazetteer(docs.sparkSession)
    w = trained(Scratch(docs.sparkSession, "pii").keep(candidates(docs, known)))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_candidates(own, known).select("row", "text", chosen(F.col("all"), w).alias("found"))
    name = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    order = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    # The text in chunks: a piece between two spans is cut from its first and its last one, whatever stands before them.
    chunks = F.when(F.size("found") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    own = own.select("row", "found", F.length("text").alias("length"), order.alias("order"), chunks.alias("chunks"))

    def cut(a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        one = lambda at, start, n: F.substring(F.coalesce(F.get("chunks", at), F.lit("")), start, n)
        within = one(i, a % CHUNK + 1, b - a)
        across = F.concat(one(i, a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice("chunks", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), one(j, F.lit(1), b % CHUNK))
        return F.when(i == j, within).otherwise(across)

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        x = F.element_at("order", i)
        return F.greatest(at, x["end"]), F.struct(at.alias("from"), x["start"].alias("to"), x["kind"].alias("kind"))

    own = own.select("*", scanned(F.size("order"), F.lit(0), "struct<from:int,to:int,kind:int>", step).alias("gaps"))
    pieces = F.transform(F.filter("gaps", lambda g: g["to"] >= g["from"]), lambda g: F.concat(cut(g["from"], g["to"]), F.get(name, g["kind"])))
    cut = F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform("order", lambda x: x["end"])), F.col("length")))
    own = own.select("row", F.when(F.size("found") > 0, cut).alias("cut"))
    new = {"text": F.coalesce("cut", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut").isNotNull(), F.length("cut").cast("long")).otherwise(F.col("row.n_chars"))
    return own.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
