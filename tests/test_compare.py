"""Comparing two systems: what is shuffled for it, hot keys, and parts in all forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from standpoint.operators import metrics as M
from standpoint.operators.scan import deal_blocks, running_before
from standpoint.plans import metric_queries as Q


def shuffled_rows(df) -> int:
    """Rows that the exchanges of a plan wrote once it ran, those used again counted once."""
    df.collect()
    rows = {}

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "ReusedExchangeExec":
            return
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        if kind == "ShuffleExchangeExec":
            rows[p.id()] = p.metrics().apply("shuffleRecordsWritten").value()
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(rows.values())


def write_events(spark, folder, n: int, users: int, hot: bool = False) -> str:
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=i), 3 if hot and i % 3 else i * 7 % users, ("view", "click", "error")[i % 3], 1.0, '{"k": %d}' % (i * 11 % 97))
            for i in range(n)]
    rows += [(None, day, 1, "view", 1.0, '{"k": 1}'), (n, day, None, "view", 1.0, '{"k": 1}'), rows[5]]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{folder}/events.parquet")
    return str(folder)


def test_events_are_dealt_once_for_two_systems(spark, tmp_path):
    sf = write_events(spark, tmp_path, 4000, 40)
    log = Q.D.event_log(spark, sf).count()
    c = M.compare(Q.parts(spark, sf, "m1"), Q.parts(spark, sf, "m2"), n_boot=5)
    got = shuffled_rows(c)
    assert log <= got < 1.5 * log


@pytest.mark.parametrize("hot", [False, True])
def test_steps_know_the_step_before(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(Q, "deal_blocks", lambda df, keys, block, name: deal_blocks(df, keys, F.floor(F.col("t") / 50), name, 300))
    sf = write_events(spark, tmp_path, 1200, 11, hot)
    rows = Q.steps(spark, sf, "m1").collect()
    log = Q.D.event_log(spark, sf).filter("task_id is not null and seq is not null")
    assert len(rows) == 3 * log.count()
    last = {}
    for r in sorted(rows, key=lambda r: (r.ep, r.action, r.t)):
        true, pred = last.get((r.ep, r.action), ("NEEDS_INFO", "NEEDS_INFO"))
        assert (r.true_changed, r.pred_changed) == (r.true != true, r.pred != pred)
        last[r.ep, r.action] = r.true, r.pred
    assert {a for _, a in last} == {"a0", "a1", "a2"}


def test_only_keys_that_may_be_hot_are_cut(spark):
    rows = [("big", i) for i in range(4000)] + [(f"k{i % 500}", i) for i in range(1000)] + [(None, 1), ("k1", None)]
    df = deal_blocks(spark.createDataFrame(rows, "k string, i int"), ["k"], F.floor(F.col("i") / 64), "b", 2000).cache()
    cut = {r.k for r in df.filter("b is not null").select("k").distinct().collect()}
    assert "big" in cut and len(cut) < 20 and df.count() == 5002
    plain = {}
    for k, i in sorted((r for r in rows if None not in r), key=lambda r: r[1]):
        plain[k, i] = plain.get((k, "last")), plain.get((k, "sum"))
        plain[k, "last"], plain[k, "sum"] = i, (plain.get((k, "sum")) or 0) + i
    for fold, at in ((F.max, 0), (F.sum, 1)):
        got = running_before(df.filter("i is not null"), ["k"], [F.col("b")], [F.col("i")], {"v": F.col("i")}, fold, F.col("b").isNull()).collect()
        assert len(got) == 5000 and all(r.v == plain[r.k, r.i][at] for r in got)


def test_parts_of_one_frame_are_those_of_three(spark):
    rows = [(e, t, f"a{t % 3}", ("READY", "BLOCKED")[(e + t) % 2], ("READY", "NEEDS_INFO")[t % 2], t % 3 == 0, t % 2 == 0, t / 10, e % 2 == 0, t + 1)
            for e in range(4) for t in range(7) if e or t % 3]  # episode 0 has no a0
    a = spark.createDataFrame(rows, "ep int, t int, action string, true string, pred string, true_changed boolean, pred_changed boolean, "
                                    "p_success double, success boolean, words int")
    p, e = {"p_true": F.col("p_success")}, {"ledger_changed": F.col("pred_changed"), "tokens": F.col("words"), "encodes": F.lit(1)}
    one = M.metric_parts(a, p, e, event_rows=F.col("action") == "a0")
    three = M.metric_parts(a, a.withColumns(p), a.filter("action = 'a0'").withColumns(e))
    want = {(r.ep, r.metric): (r.num, r.den) for r in three.collect()}
    got = {(r.ep, r.metric): (r.num, r.den) for r in one.collect()}
    assert one.columns == three.columns and got.keys() == want.keys() and len(got) == 4 * 9 + 3 * 3
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_compare_joins_by_episode_and_metric(spark):
    s = "ep string, metric string, num double, den double"
    x = [(f"e{i}", m, float(i % 3 + (m == "tokens_x")), 2.0) for i in range(9) for m in ("tokens_x", "u", "only_a")] + [(None, "u", 9.0, 1.0), ("e1", "u", 4.0, 2.0)]
    y = [(f"e{i}", m, float(i % 2 + 1), 1.0) for i in range(1, 12) for m in ("tokens_x", "u", "only_b")] + [("e2", None, 9.0, 1.0)]
    got = {r.metric: r for r in M.compare(spark.createDataFrame(x, s), spark.createDataFrame(y, s), n_boot=50).collect()}
    assert got.keys() == {"tokens_x", "u"}
    names = sorted({r[0] for r in x if r[0]})
    draws = dict(zip(names, M.weights_of([f"|{n}" for n in names], 50, 0)))
    for m, r in got.items():
        j = [(a, b) for a in x for b in y if a[0] is not None and a[:2] == b[:2] and a[1] == m]
        ratio = lambda at, w: sum(w(p) * p[at][2] for p in j) / sum(w(p) * p[at][3] for p in j)
        assert (r.a, r.b) == pytest.approx((ratio(0, lambda p: 1), ratio(1, lambda p: 1)))
        d = sorted(ratio(0, lambda p: draws[p[0][0]][b]) - ratio(1, lambda p: draws[p[0][0]][b]) for b in range(50))
        assert d[0] <= r.lo <= d[2] and d[-3] <= r.hi <= d[-1]
        assert (r.ratio is not None) == (m == "tokens_x")
