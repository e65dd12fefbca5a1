"""The ledger against a record-by-record replay, and its algebra: order, copies and batches do not matter."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from standpoint.operators import ledger as L

SCHEMA = ("task_id string, seq long, record_id string, revision int, text string, source_id string, authority int, valid_from double, "
          "valid_until double, span string, about array<string>")


def event(seq, rec, rev, text, source="s1", authority=0, vf=None, vu=None, task="t", about=None):
    return (task, seq, rec, rev, text, source, authority, vf, vu, None, about)


def random_events(seed, n=60):
    g = random.Random(seed)
    return [event(i, g.choice("abcd"), g.randint(0, 6), g.choice([None, "one", "two", "three"]), g.choice(["s1", "s2"]), g.randint(0, 2))
            for i in range(n)]


def replay(rows):
    """One delivery at a time: what a single-record ledger would say."""
    top, out = {}, []
    for _, seq, rec, rev, text, src, auth, *_ in sorted(rows, key=lambda r: r[1]):
        key = "w" if text is None else (text, src, auth)
        have = top.get(rec)
        if have is None or rev > have[0]:
            outcome, top[rec] = "applied", (rev, [key])
        elif rev < have[0]:
            outcome = "stale"
        elif key in have[1]:
            outcome = "duplicate"
        else:
            outcome = "conflict"
            have[1].append(key)
        keys = top[rec][1]
        status = "conflicted" if len(keys) > 1 else "withdrawn" if keys[0] == "w" else "active"
        out.append((seq, outcome, outcome in ("applied", "conflict"), status))
    return out, {r: (v[0], len(v[1])) for r, v in top.items()}


@pytest.mark.parametrize("seed,block", [(1, 65536), (2, 7), (3, 3)])
def test_outcomes_match_replay(spark, seed, block):
    rows = random_events(seed)
    want, state = replay(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = L.delivery_outcomes(df, block_rows=block).select("seq", "outcome", "changed", "status").orderBy("seq").collect()
    assert [tuple(r) for r in got] == want
    s = L.ledger_state(df).groupBy("record_id").agg(F.max("revision"), F.max("n_payloads")).collect()
    assert {r[0]: (r[1], r[2]) for r in s} == state
    heads = {r["record_id"]: r["stored_status"] for r in L.record_heads(df).collect()}
    last = {r["record_id"]: r["stored_status"] for r in L.record_summary(L.ledger_state(df)).collect()}
    assert heads == last


def test_order_and_copies_do_not_matter(spark):
    rows = random_events(7)
    g = random.Random(0)
    shuffled = rows * 2
    g.shuffle(shuffled)
    renumbered = [(r[0], i, *r[2:]) for i, r in enumerate(shuffled)]
    snap = lambda rs: sorted(map(tuple, L.snapshot(L.ledger_state(spark.createDataFrame(rs, SCHEMA))).collect()))
    assert snap(rows) == snap(renumbered)


def test_stale_cannot_undo_and_conflict_resolves(spark):
    rows = [event(0, "a", 1, "x"), event(1, "a", 2, None), event(2, "a", 1, "x"), event(3, "b", 3, "October 12"), event(4, "b", 3, "October 19"),
            event(5, "c", 3, "October 19"), event(6, "c", 3, "October 12"), event(7, "c", 4, "October 20")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["seq"]: (r["outcome"], r["status"]) for r in L.delivery_outcomes(df).collect()}
    assert [got[i] for i in range(3)] == [("applied", "active"), ("applied", "withdrawn"), ("stale", "withdrawn")]
    assert got[4] == got[6] == ("conflict", "conflicted") and got[7] == ("applied", "active")
    usable = {r["record_id"] for r in L.active_records(L.ledger_state(df)).collect()}
    assert usable == {"c"}


def test_validity_window(spark):
    df = spark.createDataFrame([event(0, "a", 0, "x", vf=10.0, vu=20.0)], SCHEMA)
    s = L.ledger_state(df)
    from standpoint.functions.scalars import record_status

    for now, want in ((5, "not_yet_valid"), (10, "active"), (19.999, "active"), (20, "expired")):
        assert s.select(record_status(now)).first()[0] == want
    nxt = [[r["next_transition"] for r in L.next_transition(s, t).collect()] for t in (0, 10, 20)]
    assert nxt == [[10.0], [20.0], []]


def test_purge_keeps_keys(spark):
    df = spark.createDataFrame([event(0, "a", 1, "secret"), event(1, "b", 1, "kept")], SCHEMA)
    ids = spark.createDataFrame([("t", "a")], "task_id string, record_id string")
    after = L.purge(df, ids, 100)
    rows = {(r["record_id"], r["revision"]): (r["text"], r["payload_key"]) for r in after.collect()}
    assert rows[("a", 1)][0] == "" and rows[("a", 2)] == (None, "__withdrawn__") and rows[("b", 1)][0] == "kept"
    assert rows[("a", 1)][1] == L.keyed(df).filter("record_id = 'a'").first()["payload_key"]
    again = L.purge(after, ids, 200)
    assert again.count() == after.count()


def test_payload_key_is_length_prefixed(spark):
    df = spark.createDataFrame([event(0, "a", 1, "hé", "s", 2)], SCHEMA)
    parts = ["hé", "s", "2", "", ""]
    raw = b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)
    assert L.keyed(df).first()["payload_key"] == hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 3000])
def test_conflicts_of_any_size_have_one_digest(spark, n):
    rows = [event(i, "a", 1, f"v{i}") for i in range(n)] + [event(9999, "b", 1, "x")]
    a = L.snapshot(L.ledger_state(spark.createDataFrame(rows, SCHEMA)))
    b = L.snapshot(L.ledger_state(spark.createDataFrame([(r[0], 10000 - r[1], *r[2:]) for r in rows], SCHEMA)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.filter("record_id = 'a'").first()["payload_keys"].startswith(f"{n}:")
    c = L.snapshot(L.ledger_state(spark.createDataFrame(rows[1:], SCHEMA))).filter("record_id = 'a'").first()
    assert c is None or c["payload_keys"] != a.filter("record_id = 'a'").first()["payload_keys"]


def test_validation_lists_every_problem(spark):
    df = spark.createDataFrame([event(0, "", -1, "x", authority=12, vf=5.0, vu=1.0), event(1, "ok", 0, "y")], SCHEMA)
    good, bad = L.split_valid(df)
    assert good.count() == 1 and len(bad.first()["problems"]) == 4
