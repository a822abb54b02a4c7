"""Generators whose answers need a search or an evaluator: a Python function per question, run over Arrow batches of ids. A
question depends on its seed and id only."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Puzzle = tuple[str, list[str], str]  # state, options, answer


def boolean(rng: random.Random, depth: int = 3) -> Puzzle:
    """A random expression of and, or and not, with its value."""

    def grow(d: int) -> tuple[str, bool]:
        if d == 0 or rng.random() < 0.2:
            value = rng.random() < 0.5
            return str(value), value
        kind = rng.choice(("and", "or", "not"))
        left, a = grow(d - 1)
        if kind == "not":
            return f"not ({left})", not a
        right, b = grow(d - 1)
        return f"({left}) {kind} ({right})", (a and b) if kind == "and" else (a or b)

    text, value = grow(depth)
    return text, ["True", "False"], str(value)


NAMES = ("Ada", "Ben", "Cleo", "Dan", "Eve")


def ordering(rng: random.Random, n: int = 4) -> Puzzle:
    """People in a row, with clues that leave one order only: clues are added until the search finds just that one."""
    people = rng.sample(NAMES, n)
    facts = [(f"{a} stands somewhere before {b}.", lambda o, a=a, b=b: o.index(a) < o.index(b)) for a, b in itertools.combinations(people, 2)]
    facts += [(f"{b} stands right after {a}.", lambda o, a=a, b=b: o.index(b) == o.index(a) + 1) for a, b in itertools.pairwise(people)]
    rng.shuffle(facts)
    open_, told = list(itertools.permutations(people)), []
    for text, holds in facts:
        kept = [o for o in open_ if holds(o)]
        if len(kept) < len(open_):
            told.append(text)
            open_ = kept
        if len(open_) == 1:
            break
    place = rng.randrange(n)
    return " ".join([*told, f"Who is number {place + 1}?"]), sorted(people), people[place]


def free_slot(rng: random.Random) -> Puzzle:
    """The only hour of a working day at which nobody is busy."""
    hours = list(range(9, 17))
    free = rng.choice(hours)
    busy: dict[str, list[int]] = {name: [] for name in NAMES[:3]}
    for h in hours:
        if h != free:
            for name in rng.sample(sorted(busy), rng.randint(1, 2)):
                busy[name].append(h)
    text = " ".join(f"{name} is busy at {', '.join(f'{h}:00' for h in hs) or 'no time'}." for name, hs in busy.items())
    return text, [f"{h}:00" for h in hours], f"{free}:00"


#: Program texts, each with what computes the same value.
PROGRAMS: tuple[tuple[str, Callable[[list[int], int], object]], ...] = (
    ("def f(xs, k):\n    return sum(x for x in xs if x % k == 0)", lambda xs, k: sum(x for x in xs if x % k == 0)),
    ("def f(xs, k):\n    return sorted(xs)[k]", lambda xs, k: sorted(xs)[k]),
    ("def f(xs, k):\n    return xs[k:] + xs[:k]", lambda xs, k: xs[k:] + xs[:k]),
    ("def f(xs, k):\n    return ''.join(str(x % k) for x in xs)", lambda xs, k: "".join(str(x % k) for x in xs)),
)


def program_output(rng: random.Random) -> Puzzle:
    """A small function and arguments: what does it return? The wrong options are results for other arguments."""
    text, run = rng.choice(PROGRAMS)
    xs, k = [rng.randint(1, 20) for _ in range(5)], rng.randint(2, 4)
    answer = repr(run(xs, k))
    wrong: set[str] = set()
    for _ in range(20):
        ys, j = list(xs), rng.randint(2, 4)
        ys[rng.randrange(5)] += rng.randint(1, 5)
        wrong |= {repr(run(ys, j))} - {answer}
    options = [answer, *sorted(wrong)[:3]]
    rng.shuffle(options)
    return f"{text}\n\nf({xs}, {k})", options, answer


def diatonic_chord(rng: random.Random) -> Puzzle:
    """Notes of a triad of a major scale: which degree?"""
    names = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
    steps, key, degree = (0, 2, 4, 5, 7, 9, 11), rng.randrange(12), rng.randrange(7)
    notes = [names[(key + steps[(degree + k) % 7]) % 12] for k in (0, 2, 4)]
    rng.shuffle(notes)
    return f"Key of {names[key]} major; notes {' '.join(notes)}.", ["I", "II", "III", "IV", "V", "VI", "VII"], ("I", "II", "III", "IV", "V", "VI", "VII")[degree]


FAMILIES: dict[str, Callable[[random.Random], Puzzle]] = {f.__name__: f for f in (boolean, ordering, free_slot, program_output, diatonic_chord)}


def puzzles(ids: DataFrame, families: tuple[str, ...] = tuple(FAMILIES), seed: str = "0") -> DataFrame:
    """id, family, state, options, answer: a question of each family for each id (id), without repeats of a family's state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, f, *FAMILIES[f](random.Random(f"{seed}:{f}:{i}"))) for i in pdf["id"] for f in families]
            yield pd.DataFrame(rows, columns=["id", "family", "state", "options", "answer"])

    made = ids.select(F.col("id").cast("long")).mapInPandas(run, "id bigint, family string, state string, options array<string>, answer string")
    first = made.groupBy("family", "state").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    return made.join(first, ["family", "state", "id"], "left_semi")
