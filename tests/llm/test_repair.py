"""Conversation repair against plain Python: every edit sequence for short conversations, whole audits compared for long ones."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from standpoint.llm import conversation_repair as cr

GRAMMAR = re.compile("(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string, cost long, signature string"


def every_sequence(rows):
    """Tries all edits with up to two insertions in a gap."""
    inserts = [()] + [(r,) for r in "ua"] + list(itertools.product("ua", repeat=2))
    best = None
    for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for (_, f), e in zip(rows, edits, strict=True)):
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for i, g in enumerate(gaps):
                roles, audit, cost = roles + "".join(g), audit + "I" * len(g), cost + 5 * len(g)
                if i < len(rows):
                    (role, fault), e = rows[i], edits[i]
                    audit += e[0]
                    cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if fault == "truncated" and e != "D" else 0)
                    roles += "" if e == "D" else (role[:1] or "?") if e == "K" else e[1]
            if (best is None or (cost, audit) < best) and GRAMMAR.fullmatch(roles):
                best = (cost, audit)
    return best


def whole_audits(rows):
    """Cheapest (cost, audit, repaired roles), audits carried whole from the end."""
    @cache
    def best(i, roles):  # roles: what stands so far, shortened to what the grammar needs to know
        out = []
        if i == len(rows):
            if roles in ("", "a"):
                out.append((0, "", ()))
        else:
            role, fault = rows[i]
            step = []
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                step = [(extra, "K", role)] + [(extra + 1, "R", r) for r in ("user", "assistant")]
            for c, e, r in step:
                if roles + r[:1] in ("s", "u", "su", "ua", "au") and r:
                    c2, a, tail = best(i + 1, r[0])
                    out.append((c + c2, e + a, ((e, r),) + tail))
            c2, a, tail = best(i + 1, roles)
            out.append((2 + c2, "D" + a, (("D", ""),) + tail))
        for n in (1, 2, 3):
            made, at = [], roles
            for _ in range(n):
                made.append("assistant" if at == "u" else "user")
                at = made[-1][0]
            if i < len(rows):
                for c, e, r in step:
                    if at + r[:1] in ("ua", "au") and r:
                        c2, a, tail = best(i + 1, r[0])
                        out.append((5 * n + c + c2, "I" * n + e + a, tuple(("I", m) for m in made) + ((e, r),) + tail))
                c2, a, tail = best(i + 1, at)
                out.append((5 * n + 2 + c2, "I" * n + "D" + a, tuple(("I", m) for m in made) + (("D", ""),) + tail))
            elif at == "a":
                out.append((5 * n, "I" * n, tuple(("I", m) for m in made)))
        return min(out)

    return best(0, "")


ROLES, FAULTS = ["system", "user", "assistant", "tool", ""], ["", "", "truncated", "blank", "duplicate"]


def test_against_every_sequence():
    rng = random.Random(1)
    machine = cr.Endings()
    cases = [[(r, f)] for r in ROLES for f in FAULTS] + [[]] + [[(rng.choice(ROLES), rng.choice(FAULTS)) for _ in range(2)] for _ in range(50)]
    cases += [[(rng.choice(ROLES), rng.choice(FAULTS)) for _ in range(3)] for _ in range(5)]
    for rows in cases:
        want = every_sequence(rows)
        assert machine.solve("".join(cr.letter_of(r, f) for r, f in rows).encode()) == want == whole_audits(tuple(rows))[:2], rows


def test_endings_are_worked_once():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("suaxSUAXD") for _ in range(rng.randint(0, 9))).encode() for _ in range(3000)}, key=lambda w: w[::-1])
    machine = cr.Endings()
    for w in words:
        rows = tuple(({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "blank" if c == "D" else "truncated" if c.isupper() else "") for c in w.decode())
        assert machine.solve(w) == whole_audits(rows)[:2], w
    assert machine.worked == len({w[i:] for w in words for i in range(len(w))})
    assert len(machine.machine.costs) < 200
    cost, audit = machine.solve(b"sua" + b"ua" * 60000 + b"D")
    assert cost == 2 and audit == "K" * 120003 + "D"


def plain_report(rows):
    out = []
    for conv in {r[0] for r in rows}:
        made = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if harm == 4:
                role = "user"
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            made += [(turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
        digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        made.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], digest(*m[1:])))
        faults, seen = [], set()
        for _, role, text in made:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [m[0] for m in made if m[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(made))
        cost, audit, edits = whole_audits(tuple((m[1], f) for m, f in zip(made, faults, strict=True)))
        texts = iter(made)
        lines = []
        for e, r in edits:
            text = "" if e == "I" else next(texts)[2]
            if e != "D":
                lines.append(f"{r}:{text}")
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["Fine.", "Yes!", "cut off", "", " \t ", "Tail? \n", None, "é…", "Fine."]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, ""]
    out = [(i, t, rng.choice(roles), rng.choice(texts)) for i in range(150) for t in range(rng.randint(1, 9))]
    out += [(200 + i, 3 * t, "user" if t % 2 == 0 else "assistant", f"Number {t} of {i}.") for i in range(60) for t in range(6)]
    out += [(None, t, "user", "Null id.") for t in (1, 2, None)] + [(300, None, "user", "A."), (300, None, "assistant", "B."), (301, 5, "user", "x" * 100000 + ".")]
    out += [(302, 1, "user", "Same."), (302, 1, "user", "Same."), (302, 1, "assistant", "Other."), (302, 2, "assistant", "Same.")]
    return out + [(303, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(400)]


def test_report(spark, rows):
    got = cr.report(spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_report(rows)
    assert cr.report(spark.createDataFrame([], ROWS)).count() == 0


def test_repaired_messages(spark):
    turns = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "assistant", "cut"), (1, 3, "user", "So?"), (1, 4, "assistant", "Yes."), (2, 0, "assistant", " ")]
    turns = cr.as_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    audited = cr.audits(turns)
    assert {r.conv_id: (r.cost, r.audit) for r in audited.collect()} == {1: (3, "KRDKK"), 2: (2, "D")}
    got = [(r.conv_id, r.edit, r.role, r.text) for r in cr.repair(turns, audited).collect()]
    assert got == [(1, "K", "user", "Hi."), (1, "R", "assistant", "Hello."), (1, "K", "user", "So?"), (1, "K", "assistant", "Yes.")]
