"""Applying batches one after another equals running once over everything, bit for bit."""

import random

import pytest
from pyspark.sql import functions as F

from standpoint.operators import links as K
from standpoint.plans import refresh as X
from standpoint.plans.flow import Flow, gold_scorer
from standpoint.sources import derive as D
from tests.test_ledger import SCHEMA, event
from tests.test_logic import A, GT, P


def flow(spark, events, now=None, **more):
    tasks = ["t0", "t1", "t2"]
    p = spark.createDataFrame([(t, i, c, pr, ac, j) for t in tasks for i, c, pr, ac, j in D.PREDICATES], P)
    g = spark.createDataFrame([(t, i, o, c, k) for t in tasks for i, o, c, k in D.GATES], GT)
    a = spark.createDataFrame([(t, *x) for t in tasks for x in D.ACTIONS], A)
    return Flow(spark.createDataFrame(events, SCHEMA), p, g, a, gold_scorer, now=now, temperature=1.2, bias=(0.1, 0.0, -0.1), **more)


def random_log(seed, n=90):
    g = random.Random(seed)
    return [event(i, f"r{g.randint(0, 6)}", g.randint(0, 5), g.choice([None, "alpha", "beta", "gamma", "delta", ""]), g.choice(["s1", "s2"]),
                  g.randint(0, 2), g.choice([None, 0.0, 10.0]), g.choice([None, 50.0]), f"t{g.randint(0, 2)}",
                  g.choice([None, None, ["p0"], ["p1", "p4", "nope"], []])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_run(spark, seed):
    log = random_log(seed)
    f = flow(spark, log, now=20.0)
    t = X.full_run(flow(spark, log[:40], now=20.0))
    for lo, hi in ((40, 60), (60, 75), (75, 90)):
        t, _ = X.refresh(t, spark.createDataFrame(log[lo:hi], SCHEMA), f)
    full = X.full_run(f)
    for got, want, keys, cols in (
            (t.beliefs, full.beliefs, X.PRED, ["s", "v", "u", "c", "belief", "status", "n_decisive"]),
            (t.assessments, full.assessments, ["task_id", "action_id"], ["s", "v", "u", "belief", "expected_utility", "disposition"]),
            (t.links, full.links, [*X.PRED, "record_id"], ["text", "authority", "payload_key"]),
            (t.edges, full.edges, [*X.PRED, "record_id"], ["text", "p_s", "p_r", "p_n"]),
            (t.state, full.state, ["task_id", "record_id", "payload_key"], ["revision", "n_payloads", "stored_status"])):
        r = X.verify(got, want, keys, cols).first()
        assert r["unequal"] == 0 and r["rows"] > 0


def test_clock_moves_decisions_without_events(spark):
    log = [event(0, "r1", 1, "alpha", vf=30.0, task="t0"), event(1, "r2", 1, "beta", vf=0.0, vu=25.0, task="t0")]
    t = X.full_run(flow(spark, log, now=10.0))
    later, report = X.refresh(t, spark.createDataFrame([], SCHEMA), flow(spark, log, now=40.0), now=40.0)
    full = X.full_run(flow(spark, log, now=40.0))
    assert X.verify(later.beliefs, full.beliefs, X.PRED, ["s", "v", "u", "c", "belief"]).first()["unequal"] == 0
    assert {r["record_id"] for r in report["changed_records"].collect()} == {"r1", "r2"}


def test_duplicates_and_stale_copies_touch_nothing(spark):
    log = [event(0, "r1", 2, "alpha", task="t0"), event(1, "r2", 1, "beta", task="t1")]
    f = flow(spark, log)
    t = X.full_run(f)
    again = [event(5, "r1", 2, "alpha", task="t0"), event(6, "r1", 1, "older", task="t0")]
    t2, report = X.refresh(t, spark.createDataFrame(again, SCHEMA), f)
    assert report["changed_records"].count() == 0 and report["read_pairs"].count() == 0 and report["touched_actions"].count() == 0
    assert X.verify(t2.assessments, t.assessments, ["task_id", "action_id"], ["s", "v", "belief"]).first()["unequal"] == 0


def test_only_new_pairs_are_read(spark):
    log = [event(i, f"r{i}", 1, "alpha", task="t0") for i in range(3)]
    f = flow(spark, log)
    t = X.full_run(f)
    _, report = X.refresh(t, spark.createDataFrame([event(9, "r9", 1, "alpha", task="t0")], SCHEMA), f)
    # the words are known, so only the texts read together as one are new
    assert [r["pair"] for r in report["read_pairs"].collect()] != [] and report["read_pairs"].count() == 1


def test_early_cutoff_and_verify(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, "b")], "k string, v double, w string")
    b = spark.createDataFrame([("x", 1.0, None), ("y", 2.5, "b"), ("z", 0.0, "c")], "k string, v double, w string")
    assert sorted(r["k"] for r in X.early_cutoff(a, b, ["k"], ["v", "w"]).collect()) == ["y", "z"]
    r = X.verify(a, b, ["k"], ["v", "w"]).first()
    assert (r["rows"], r["unequal"], r["max_difference"], r["worst"]) == (3, 2, 0.5, "y")
    nan = spark.createDataFrame([("x", float("nan"))], "k string, v double")
    assert X.verify(nan, nan, ["k"], ["v"]).select(F.col("unequal")).first()[0] == 0


@pytest.mark.parametrize("more", [{"linker": lambda r, p: K.link_all(r, p).filter("text < 'c'")}, {"honour_declared": False}], ids=["linker", "undeclared"])
def test_refresh_links_as_a_full_run_does(spark, more):
    log = random_log(5)
    f = flow(spark, log, now=20.0, **more)
    t, _ = X.refresh(X.full_run(flow(spark, log[:60], now=20.0, **more)), spark.createDataFrame(log[60:], SCHEMA), f)
    full = X.full_run(f)
    assert X.verify(t.links, full.links, [*X.PRED, "record_id"], ["text", "authority", "payload_key"]).first()["unequal"] == 0
    r = X.verify(t.beliefs, full.beliefs, X.PRED, ["s", "v", "u", "c", "belief"]).first()
    assert r["unequal"] == 0 and r["rows"] > 0


def counting(spark):
    """A reading model that counts the pairs it is asked for."""
    asked = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    def scorer(pairs):
        out = gold_scorer(pairs)
        return out.mapInArrow(count, out.schema)

    return asked, scorer


def test_a_full_run_reads_each_pair_once(spark):
    f = flow(spark, random_log(5), now=20.0)
    asked, f.scorer = counting(spark)
    t = X.full_run(f)
    pairs = t.readings.count()
    assert pairs == t.edges.select("pair").distinct().count() > 0 and asked.value == pairs
