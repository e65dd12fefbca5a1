"""Repair of conversation structure by cheapest edits, worked out once per distinct ending.

``observe`` orders a conversation's turns (by turn, nulls first, then role and a digest of the text), finds each turn's first fault
and spells the conversation as a signature, one letter a turn: ``D`` must go (blank or duplicate), else the role's initial class,
capital where the text is truncated. ``solve`` sorts the distinct signatures by their reversal, so that signatures with one ending
lie together: a task keeps the path of the last one and works only the letters before the shared ending, which makes every node of
the suffix-shared automaton (a distinct ending) cost its work once, however many conversations lead through it. A node holds, per
grammar state, the cost to go and the best edit; nodes are minimised further to the few distinct (cost differences, edits), so a
step is one table lookup. Edits that start with different letters never tie past them, hence the best edit is found without
comparing audits. ``repair`` streams turns through their conversation's audit and gives the repaired messages.

Grammar states: 0 nothing yet, 1 after ``s``, 2 after ``u``, 3 after ``a``; 0 and 3 may end: ``(s?(ua)+)?``. A turn is kept (K, 0),
reroled to the one role the state allows (R, 1) or deleted (D, 2); before it, and at the end, empty turns may be inserted (I, 5 each).

Turns of one conversation are read in order by one task as a stream (sorted outside memory if need be), since an audit is one text
and its digest one chain; a task holds one signature, its path and its edits, about 30 bytes a turn. Equal turns of a conversation are
added up before the shuffle, texts are shuffled once.

Defined cases: a null role or text is one space, a null turn comes first and leaves no gap, a null conversation id is a
conversation of its own; an empty role has no legal initial; turns with one number are ordered by role and digest; a conversation
without turns costs nothing and has the hash of the empty text; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standpoint.llm.common import partitions
from standpoint.operators.scan import skew_join
from standpoint.session import cut_lineage

#: Fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDS = r"[.!?][\x20\x09-\x0D]*\z"
INITIALS = "sua"
#: Where a role's initial leads from each state; absent: not allowed there.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one role an inserted or reroled turn can have, by state.
MADE = ("user", "user", "assistant", "user")
FINAL = (0, 3)

OBSERVED = "conv_null boolean, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature binary"
SOLVED = "signature binary, cost long, audit string"
REPAIRED = "conv_null boolean, conv_id long, edit string, role string, text string"


# ---- cost to go -------------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=None)
def _options(letter: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """Per state: (edits, cost, next state) for one turn, insertions before it included."""
    out = []
    for state in range(4):
        found = []
        for inserted in range(3):
            at = state
            for _ in range(inserted):
                at = STEP[at, MADE[at][0]]
            before, cost = "I" * inserted, INSERT * inserted
            found.append((before + "D", cost + DELETE, at))
            if letter != "D":
                stays = cost + (TRUNCATED if letter.isupper() else 0)
                found.append((before + "R", stays + REROLE, STEP[at, MADE[at][0]]))
                if (at, letter.lower()) in STEP:
                    found.append((before + "K", stays, STEP[at, letter.lower()]))
        out.append(tuple(sorted(found)))
    return tuple(out)


def _end() -> tuple[tuple[int, ...], tuple[str, ...]]:
    cost, edits = [], []
    for state in range(4):
        n, at = 0, state
        while at not in FINAL:
            at, n = STEP[at, MADE[at][0]], n + 1
        cost.append(n * INSERT)
        edits.append("I" * n)
    return tuple(cost), tuple(edits)


END_COST, END_EDITS = _end()


class Minimal:
    """The minimised automaton, read from the end: a node is its cost differences; reading a letter leads to a node, adds to the
    cost and fixes each state's best edits. It has few nodes whatever the signatures are."""

    def __init__(self):
        low = min(END_COST)
        self.nodes = {tuple(c - low for c in END_COST): 0}
        self.costs, self.moves = [tuple(c - low for c in END_COST)], [{}]

    def read(self, node: int, letter: str) -> tuple[int, int, tuple[tuple[str, int], ...]]:
        """(node, cost added, per state the edits and the next state) of a letter before an ending."""
        found = self.moves[node].get(letter)
        if found is None:
            to_go = self.costs[node]
            best = [min((c + to_go[n], e, n) for e, c, n in options) for options in _options(letter)]
            low = min(b[0] for b in best)
            costs = tuple(b[0] - low for b in best)
            if costs not in self.nodes:
                self.nodes[costs] = len(self.costs)
                self.costs.append(costs)
                self.moves.append({})
            found = self.moves[node][letter] = self.nodes[costs], low, tuple((e, n) for _, e, n in best)
        return found


class Endings:
    """The path of the last signature through the suffix-shared automaton; ``solve`` extends it from the shared ending."""

    def __init__(self):
        self.machine, self.path, self.added, self.last = Minimal(), array("i", [0]), array("q", [0]), b""
        self.worked = 0

    def solve(self, signature: bytes) -> tuple[int, str]:
        word = signature[::-1]
        shared = _shared(word, self.last)
        del self.path[shared + 1:], self.added[shared + 1:]
        node, total, read = self.path[-1], self.added[-1], self.machine.read
        for letter in word[shared:].decode():
            node, low, _ = read(node, letter)
            total += low
            self.path.append(node)
            self.added.append(total)
        self.worked += len(word) - shared
        self.last = word
        state, audit = 0, []
        for i, letter in enumerate(signature.decode()):
            edits, state = read(self.path[len(word) - i - 1], letter)[2][state]
            audit.append(edits)
        audit.append(END_EDITS[state])
        return total + self.machine.costs[node][0], "".join(audit)


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)))


def solve(signatures: DataFrame) -> DataFrame:
    """Cost and audit of every distinct signature. Rows are ranged by the reversed signature: a task's neighbours share endings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings()
        rows = ((s, *endings.solve(s)) for b in batches for s in b.column(0).to_pylist())
        yield from _batches(rows, lambda r: 2 * len(r[0]) + 16, _SOLVED_ARROW)

    distinct = signatures.select("signature").distinct()
    ranged = distinct.withColumn("ending", F.reverse(F.decode("signature", "US-ASCII"))).repartitionByRange(partitions(signatures), "ending").sortWithinPartitions("ending")
    return ranged.select("signature").mapInArrow(run, SOLVED)


# ---- turns ------------------------------------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text and ``copies`` (0: dropped)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("harm"))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("copies"))


def as_turns(conversations: DataFrame) -> DataFrame:
    """Conversations as they are, for ``audits`` and ``repair``."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(1).cast("long").alias("copies"))


def _keyed(turns: DataFrame) -> DataFrame:
    """Null-safe keys, a digest of role and text, and the fault a text has by itself."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(F.col("conv_id").isNull().alias("conv_null"), F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("turn").isNotNull().alias("numbered"),
                        F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
                        F.when(~text.rlike(NOT_BLANK), "blank").when(~text.rlike(ENDS), "truncated").otherwise("").alias("fault"), text.alias("text"), "copies")


_CONV, _ORDER = ["conv_null", "conv_id"], ["numbered", "turn", "role", "digest"]


def letter_of(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "D"
    initial = role[0] if role and role[0] in INITIALS else "x"
    return initial.upper() if fault == "truncated" else initial


class Observer:
    """Folds a conversation's turns, in order, to its counts and signature."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.signature, self.illegal, self.last = bytearray(), 0, None
        self.low = self.high = None
        self.numbers = 0

    def add(self, numbered: bool, turn: int, role: str, fault: str, first: bool, copies: int) -> None:
        if numbered:
            if self.high is None or turn != self.high:
                self.numbers += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        for k, n in ((0, 1), (1, copies - 1)):
            if not n:
                continue
            f = fault if fault == "blank" or first and k == 0 else "duplicate"
            if f:
                self.faults[f] += n
            self.signature += letter_of(role, f).encode() * n
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if initial + initial not in ("su", "ua", "au"):
            self.illegal += copies - 1
        self.last = initial

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.numbers if self.numbers else 0
        return gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, bytes(self.signature)


def observe(turns: DataFrame) -> DataFrame:
    """Counts and signature of each conversation. ``turns``: conv_id, turn, role, text, copies (0: only the id counts)."""
    rows = _keyed(turns).groupBy(*_CONV, *_ORDER, "fault").agg(F.sum("copies").alias("copies"))
    present = F.col("copies") > 0
    firsts = rows.where(present).groupBy(*_CONV, "role", "digest").agg(F.min(F.struct("numbered", "turn")).alias("first"))
    rows = skew_join(rows, firsts, [*_CONV, "role", "digest"], "left").select(*_CONV, *_ORDER, "fault", "copies", (F.col("first") == F.struct("numbered", "turn")).alias("is_first"))
    ordered = rows.repartition(partitions(turns), *_CONV).sortWithinPartitions(*_CONV, *_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            key = seen = None
            for b in batches:
                for null, conv, numbered, turn, role, fault, copies, first in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                    if (null, conv) != key:
                        if key is not None:
                            yield (*key, *seen.result())
                        key, seen = (null, conv), Observer()
                    if copies:
                        seen.add(numbered, turn, role, fault, first, copies)
            if key is not None:
                yield (*key, *seen.result())
        yield from _batches(conversations(), lambda r: len(r[-1]) + 60, _OBSERVED_ARROW)

    return ordered.select(*_CONV, "numbered", "turn", "role", "fault", "copies", "is_first").mapInArrow(run, OBSERVED)


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation its counts, least cost and audit; written once."""
    observed = cut_lineage(observe(turns))
    return cut_lineage(skew_join(observed, solve(observed), ["signature"]))


def repair(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The repaired messages in order, a conversation's together: edit (K, R or I), role and text."""
    rows = _keyed(turns).where("copies > 0").select(*_CONV, F.lit(1).alias("part"), *_ORDER, "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = audited.select(*_CONV, F.lit(0).alias("part"), F.lit(False).alias("numbered"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"),
                           F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    ordered = heads.unionByName(rows).repartition(partitions(turns), *_CONV).sortWithinPartitions(*_CONV, "part", *_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages():
            key, audit, at, state = None, "", 0, 0

            def inserted():
                nonlocal at, state
                while at < len(audit) and audit[at] == "I":
                    role = MADE[state]
                    at, state = at + 1, STEP[state, role[0]]
                    yield (*key, "I", role, "")

            for b in batches:
                for null, conv, part, role, text, copies, given in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                    if part == 0:
                        if key is not None:
                            yield from inserted()
                        key, audit, at, state = (null, conv), given, 0, 0
                        continue
                    for _ in range(copies):
                        yield from inserted()
                        edit, at = audit[at], at + 1
                        if edit != "D":
                            new = role if edit == "K" else MADE[state]
                            state = STEP[state, new[0]]
                            yield (*key, edit, new, text)
            if key is not None:
                yield from inserted()
        yield from _batches(messages(), lambda r: len(r[4]) + 40, _REPAIRED_ARROW)

    return ordered.select(*_CONV, "part", "role", "text", "copies", "audit").mapInArrow(run, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines. Reads the stream of ``repair`` as it comes, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            key = h = None
            for b in batches:
                for null, conv, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if (null, conv) != key:
                        if key is not None:
                            yield (*key, h.hexdigest())
                        key, h = (null, conv), hashlib.sha256()
                    else:
                        h.update(b"\n")
                    h.update(f"{role}:{text}".encode())
            if key is not None:
                yield (*key, h.hexdigest())
        yield from _batches(conversations(), lambda r: 100, _DIGESTS_ARROW)

    return repaired.select(*_CONV, "role", "text").mapInArrow(run, "conv_null boolean, conv_id long, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and returns, for each id, its faults, the cheapest audit and the repaired text's hash."""
    turns = damage(conversations)
    audited = audits(turns)
    hashes = digests(repair(turns, audited))
    out = audited.join(hashes, _CONV, "left")
    return out.select(F.when(~F.col("conv_null"), F.col("conv_id")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _batches(rows: Iterable[tuple], size, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= 8 << 20 or len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_CONV_ARROW = [("conv_null", pa.bool_()), ("conv_id", pa.int64())]
_OBSERVED_ARROW = pa.schema([*_CONV_ARROW, *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.binary())])
_SOLVED_ARROW = pa.schema([("signature", pa.binary()), ("cost", pa.int64()), ("audit", pa.string())])
_REPAIRED_ARROW = pa.schema([*_CONV_ARROW, ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_DIGESTS_ARROW = pa.schema([*_CONV_ARROW, ("repaired_sha256", pa.string())])
