"""Conversation structure repair: the cheapest edits that give a conversation turns in a legal order.

Nodes of the edit lattice are (turn index, state of a grammar over role initials); it is never built. Dijkstra's search goes
through it with the key (cost, audit), audit being the initials of the edits so far, and stops at the first accepting end node
that it takes up. No edge costs less than nothing and every edge makes the audit longer, so nodes are taken up in order of the
key, and of two ways to a node the one with the smaller key stays the smaller with whatever follows.

A conversation is a stream of rows, sorted by turn. Beyond PIECE rows the search goes piece by piece: it starts from the keys of
all states at the piece's beginning and takes up all states at its end. A state whose cost is above the least one by more than
DETOUR can't be on the cheapest way and is left out. So what a task holds depends on the piece, not on the conversation; a hash of
the repaired text goes along with each state.

Defined cases: rows are ordered by turn, null first, then by role and text; a null role or text is one space; a role counts by its
first character, whatever follows; repeated rows are rows each, and all but the first of the same role and text are duplicates; a
null conv_id is a conversation of its own; a conversation whose rows are all absent has no faults, an empty audit and the hash of
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: White space that texts are trimmed of, and what a whole text ends in.
SPACE, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", (".", "!", "?")

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: The grammar (s?(ua)+)? over initials: start, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FINAL = (START, AFTER_A)
#: What an inserted or changed turn becomes in each state: one role only.
MADE = {START: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}

#: Rows searched at a time.
PIECE = 256
#: From any state: two inserted turns reach AFTER_A, which can go on like every other state but for keeping one system turn.
DETOUR = 2 * INSERT + DELETE


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str


class Found(NamedTuple):
    """The way to a node: its key, and the state where it enters the piece."""

    cost: int
    audit: str
    entry: int


def search(turns: list[Turn], entries: dict[int, tuple[int, str]], last: bool = True) -> dict[int, Found]:
    """Dijkstra's search over the lattice of these turns from states with a key each. If the turns are the last ones: the first
    accepting end node taken up; else all end nodes."""
    heap = [(cost, audit, 0, state, state) for state, (cost, audit) in entries.items()]
    heapify(heap)
    taken, ends = set(), {}
    while heap:
        cost, audit, i, state, entry = heappop(heap)
        if (i, state) in taken:
            continue
        taken.add((i, state))
        if i == len(turns):
            if not last or state in FINAL:
                ends[state] = Found(cost, audit, entry)
            if (last and ends) or len(ends) == len(MADE):
                break
        made = STEPS[state, MADE[state][0]]
        heappush(heap, (cost + INSERT, audit + "I", i, made, entry))
        if i == len(turns):
            continue
        heappush(heap, (cost + DELETE, audit + "D", i + 1, state, entry))
        x = turns[i]
        if x.fault in ("blank", "duplicate"):
            continue
        more = TRUNCATED if x.fault == "truncated" else 0
        heappush(heap, (cost + REROLE + more, audit + "R", i + 1, made, entry))
        kept = STEPS.get((state, x.role[:1]))
        if kept is not None:
            heappush(heap, (cost + KEEP + more, audit + "K", i + 1, kept, entry))
    return ends


class Edit(NamedTuple):
    edit: str
    turn: int | None
    role: str | None
    text: str | None
    fault: str | None


def edits(turns: list[Turn], state: int, audit: str) -> Iterator[Edit]:
    """The edits that an audit stands for; role and text are those after it, null for a deleted turn."""
    i = 0
    for e in audit:
        if e == "I":
            out = Edit(e, None, MADE[state], "", None)
        else:
            x, i = turns[i], i + 1
            out = Edit(e, x.turn, *((None, None) if e == "D" else (x.role if e == "K" else MADE[state], x.text)), x.fault or None)
        if out.role is not None:
            state = STEPS[state, out.role[:1]]
        yield out


@dataclass
class Way:
    """The cheapest way to a state so far: the part of its audit that not all ways share, its hash and its pieces."""

    cost: int = 0
    audit: str = ""
    sha: object = field(default_factory=hashlib.sha256)
    empty: bool = True
    pieces: tuple = ()


class Conversation:
    """One conversation, row by row. rows: whether edits are wanted, else only figures and the hash are kept."""

    def __init__(self, conv_id: int | None, rows: bool):
        self.conv_id, self.rows = conv_id, rows
        self.waiting: list[Turn] = []
        self.ways, self.audit = {START: Way()}, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.latest = self.initial = None
        self.turns = 0

    def add(self, x: Turn) -> Iterator[Edit]:
        if x.turn is not None and x.turn != self.latest:
            self.first = x.turn if self.first is None else self.first
            self.latest, self.turns = x.turn, self.turns + 1
        if x.fault:
            self.counts[x.fault] += 1
        if self.initial is not None and self.initial + x.role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = x.role[:1]
        if len(self.waiting) == PIECE:
            yield from self.step(False)
        self.waiting.append(x)

    def step(self, last: bool) -> Iterator[Edit]:
        turns, self.waiting = self.waiting, []
        found = search(turns, {s: (w.cost, w.audit) for s, w in self.ways.items()}, last)
        least = min(f.cost for f in found.values())
        ways = {}
        for state, f in found.items():
            if f.cost <= least + DETOUR:
                before = self.ways[f.entry]
                piece = (turns, f.entry, f.audit[len(before.audit) :])
                way = Way(f.cost, f.audit, before.sha.copy(), before.empty, (*before.pieces, piece) if self.rows else ())
                for e in edits(*piece):
                    if e.role is not None:
                        way.sha.update(f"{'' if way.empty else chr(10)}{e.role}:{e.text}".encode(errors="surrogatepass"))
                        way.empty = False
                ways[state] = way
        some = [w.audit for w in ways.values()]
        same = next((i for i, c in enumerate(zip(*some)) if len({*c}) > 1), min(map(len, some)))
        self.audit.append(some[0][:same])
        for w in ways.values():
            w.audit = w.audit[same:]
        self.ways = ways
        # Pieces that all ways have alike are settled.
        chains = [w.pieces for w in ways.values()]
        n = next((i for i, c in enumerate(zip(*chains)) if len({id(x) for x in c}) > 1), min(map(len, chains)))
        for piece in chains[0][:n]:
            yield from edits(*piece)
        for w in ways.values():
            w.pieces = w.pieces[n:]

    def end(self) -> Iterator[Edit]:
        yield from self.step(True)

    def figures(self) -> tuple:
        way = next(iter(self.ways.values()))
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), way.cost, "".join([*self.audit, way.audit]), way.sha.hexdigest())


_COLUMNS = ("conv_id", "turn", "role", "text", "fault", "absent")


def _streamed(batches: Iterator[pa.RecordBatch], rows: bool) -> Iterator[tuple[Conversation, list[Edit], bool]]:
    """(conversation, edits that are settled, whether it has ended) in the order of the rows."""
    now = None
    for batch in batches:
        for conv_id, turn, role, text, fault, absent in zip(*(batch.column(c).to_pylist() for c in range(len(_COLUMNS))), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now, [*now.end()], True
                now = Conversation(conv_id, rows)
            if not absent:
                got = [*now.add(Turn(turn, role, text, fault))]
                if got:
                    yield now, got, False
    if now is not None:
        yield now, [*now.end()], True


_EDITS = "conv_id bigint, place bigint, edit string, turn bigint, role string, text string, fault string"
_FIGURES = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_ARROW = {"bigint": pa.int64(), "string": pa.string()}
#: Rows and characters of text sent back at a time.
_BATCH, _CHARS = 2_000, 16_000_000


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


@tidy
def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, chars, place = [], 0, 0
    for now, some, ended in _streamed(batches, True):
        for e in some:
            out.append((now.conv_id, place, *e))
            place, chars = place + 1, chars + len(e.text or "")
            if len(out) >= _BATCH or chars >= _CHARS:
                yield _batch(out, _EDITS)
                out, chars = [], 0
        place = 0 if ended else place
    if out:
        yield _batch(out, _EDITS)


@tidy
def _figure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for now, _, ended in _streamed(batches, False):
        if ended:
            out.append(now.figures())
        if len(out) >= _BATCH:
            yield _batch(out, _FIGURES)
            out = []
    if out:
        yield _batch(out, _FIGURES)


def _sorted(turns: DataFrame) -> DataFrame:
    """Rows with their first fault, each conversation together and in order. Duplicates are found by conversation, role and text,
    so one long conversation is dealt over tasks there."""
    small_batches(turns.sparkSession)
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in turns.columns else F.lit(False)
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role"), spaced("text"), absent.alias("absent"))
    same = Window.partitionBy("conv_id", "absent", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    again, trimmed = F.row_number().over(same) > 1, F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumn("again", again).withColumn("end", F.substring(trimmed, -1, 1))
    fault = F.when(F.col("end") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("end").isin(*ENDS), "truncated").otherwise("")
    rows = rows.withColumn("fault", fault).repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again").select(*_COLUMNS)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R, D or I), turn, role, text, fault: the cheapest edits of conversations (conv_id, turn, role,
    text) in order. role and text are those after the edit, null where it deletes; the repaired conversation is the other rows.
    Turns with a true `absent`, if there is such a column, only say that the conversation exists."""
    return _sorted(turns).mapInArrow(_edit_rows, _EDITS)


def figures(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    return _sorted(turns).mapInArrow(_figure_rows, _FIGURES)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with made faults, by crc32 of `conv_id:turn` modulo 20: 0 makes a turn absent, 1 empties its text, 2 removes `.`, `!` and
    `?`, 3 repeats it, 4 sets its role to user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), by.cast("int").alias("by"))

    def made(n: int, value: Column, otherwise: Column) -> Column:
        return F.when(F.col("by") == n, value).otherwise(otherwise)

    text = F.when(F.col("by") <= 1, "").otherwise(made(2, F.regexp_replace("text", "[.!?]", ""), F.col("text")))
    copies = F.explode(made(3, F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", made(4, F.lit("user"), F.col("role")).alias("role"), text.alias("text"), (F.col("by") == 0).alias("absent"), copies).drop("copy")
