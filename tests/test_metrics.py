"""Statistics against numpy and hand-worked tables."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from standpoint.operators import metrics as M
from standpoint.operators.scan import dense_index, running_before, salted_join


def test_running_values_cross_blocks(spark):
    rows = [("k", i, (i * 7) % 11) for i in range(40)] + [("j", 3, 5)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running_before(df, ["k"], [F.floor(F.col("i") / 6)], [F.col("i")], {"s": F.col("v")}).filter("k = 'k'").orderBy("i").collect()
    run = 0
    for r in got:
        assert (r["s"] or 0) == run
        run += r["v"]
    down = running_before(df, ["k"], [(F.floor(F.col("i") / 6), "desc")], [F.col("i").desc()], {"m": F.col("v")}, fold=F.min)
    vals = {r["i"]: r["m"] for r in down.filter("k = 'k'").collect()}
    assert vals[39] is None and vals[0] == min(r[2] for r in rows[1:40])


def test_dense_index_and_salted_join(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    idx = sorted(r["idx"] for r in dense_index(df, ["id"]).collect())
    assert idx == list(range(1000))
    per = dense_index(df, ["id"], within=["g"]).groupBy("g").agg(F.max("idx"), F.countDistinct("idx"), F.count("*")).collect()
    assert all(r[1] + 1 == r[2] == r[3] for r in per)
    right = spark.createDataFrame([(0, "a"), (1, "b")], "g long, x string")
    assert salted_join(df, right, ["g"], ["id"]).count() == 667
    assert salted_join(df, right, ["g"], ["id"], how="left").count() == 1000


def test_quantiles_and_auroc(spark):
    g = np.random.default_rng(0)
    x = np.round(g.random(3001), 3)
    y = g.random(3001) < x
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = {r["q"]: r["value"] for r in M.quantiles(df, [], "x", [0.0, 0.3, 0.95, 1.0]).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(x, q))
    pos, neg = x[y], x[~y]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert M.auroc(df, "x", "y").first()["auroc"] == pytest.approx(want)


def test_mcnemar_tail(spark):
    for k, n in ((0, 0), (3, 10), (50, 130)):
        assert 0 < M.binomial_two_sided(k, n) <= 1
    mk = lambda right: [("i%d" % i, 0.8 if ok else 0.1, 0.1, 0.1 if ok else 0.8, 0) for i, ok in enumerate(right)]
    a = [i < 30 for i in range(60)]
    b = [10 <= i < 52 for i in range(60)]
    s = "item string, p0 double, p1 double, p2 double, label int"
    r = M.mcnemar(spark.createDataFrame(mk(a), s), spark.createDataFrame(mk(b), s), "item").first()
    assert (r["only_a"], r["only_b"]) == (10, 22)
    assert r["p_value"] == pytest.approx(M.binomial_two_sided(22, 32), abs=1e-10)
    want = min(1.0, 2 * sum(math.comb(32, i) for i in range(22, 33)) / 2 ** 32)
    assert r["p_value"] == pytest.approx(want, abs=1e-9)


def test_ece_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0, 0), (0.2, 1), (0.21, 0), (1.0, 1)], "p double, y int")
    got = M.binary_ece(df, "p", "y", bins=5).first()["ece"]
    want = (2 * abs(0.5 - 0.1) + abs(0 - 0.21) + 0) / 4
    assert got == pytest.approx(want)


def test_metrics_by_inspection(spark):
    a = spark.createDataFrame([
        (0, 0, "READY", "READY", True, True, 1.0, True), (0, 1, "READY", "BLOCKED", False, True, 0.5, True),
        (1, 0, "BLOCKED", "READY", True, True, 1.0, False), (1, 1, "BLOCKED", "BLOCKED", False, False, 0.0, False)],
        "ep int, t int, true string, pred string, true_changed boolean, pred_changed boolean, p_success double, success boolean")
    got = {r["metric"]: (r["value"], r["n"]) for r in M.decision_metrics(M.metric_parts(a)).collect()}
    assert got["disposition_accuracy"] == (0.5, 4) and got["stale_decision_rate"] == (0.5, 2)
    assert got["spurious_change_rate"] == (0.5, 2) and got["false_ready_rate"] == (0.5, 2) and got["missed_ready_rate"] == (0.5, 2)
    assert got["success_brier"][0] == pytest.approx((0 + 0.25 + 1 + 0) / 4)
    worst = M.worst_episodes(M.metric_parts(a), 1).first()
    assert (worst["ep"], worst["disposition_accuracy"]) == (0, 0.5)


def test_bootstrap_interval_covers_and_repeats(spark):
    df = spark.range(300).select((F.col("id") % 60).alias("c"), (F.col("id") % 2).cast("double").alias("v"))
    one = M.bootstrap_ci(df, ["c"], F.col("v"), n_boot=100).first()
    two = M.bootstrap_ci(df.repartition(5), ["c"], F.col("v"), n_boot=100).first()
    assert tuple(one) == tuple(two) and one["lo"] <= one["value"] == 0.5 <= one["hi"]


def test_fit_temperature_recovers_scale(spark):
    g = np.random.default_rng(1)
    z = g.normal(size=(4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([g.choice(3, p=q) for q in p])
    df = spark.createDataFrame(pd.DataFrame({"l0": z[:, 0] * 3, "l1": z[:, 1] * 3, "l2": z[:, 2] * 3, "label": y}))
    assert M.fit_temperature(df) == pytest.approx(3.0, rel=0.1)


def test_confusion_and_contrast(spark):
    s = "g int, p0 double, p1 double, p2 double, label int"
    df = spark.createDataFrame([(1, .8, .1, .1, 0), (1, .1, .8, .1, 1), (2, .8, .1, .1, 0), (2, .8, .1, .1, 1), (3, .1, .1, .8, 2)], s)
    r = M.contrast_set_accuracy(df, "g").first()
    assert (r["n_sets"], r["set_accuracy"]) == (2, 0.5)
    rep = M.classification_report(df).first()
    assert rep["accuracy"] == pytest.approx(0.8) and rep["macro_f1"] == pytest.approx((4 / 5 + 2 / 3 + 1) / 3)


def test_replicates_add_up_in_the_tasks_that_draw_them(spark):
    """Weights are those of md5, for texts of any length; clusters are dealt over many tasks, however few bytes they are."""
    names = ["|1", "|22", "|" + "é" * 40, "", "|a|b"]
    w = M.weights_of(names, 1200, 7)
    for i, n in enumerate(names):
        for b in (0, 9, 10, 99, 100, 1000, 1199):
            h = hashlib.md5(f"7|{b}{n}".encode()).hexdigest()
            assert w[i, b] == sum(h >= t for t in M.POISSON)
    rows = [(i, m, float(i % 5) if i % 7 else None, 2.0) for i in range(300) for m in ("x", "y")] + [(None, "y", float("inf"), 1.0)]
    parts = spark.createDataFrame(rows, "k int, m string, num double, den double")
    d = M.replicate_sums(parts.groupBy("k", "m").agg(F.sum("num").alias("num"), F.sum("den").alias("den")), ["k"], ["m"], ["num", "den"], 40)
    got = {(r.m, r.b): (r.num, r.den) for r in d.collect()}
    w = M.weights_of([f"|{i}" if i is not None else "" for i in [*range(300), None]], 40, 0)
    for b in range(40):
        assert got["x", b][0] == sum(w[i, b] * (i % 5) for i in range(300) if i % 7)
        assert got["y", b] == (float("inf") if w[300, b] else got["x", b][0], got["x", b][1] + w[300, b])
    assert "xxhash64" in d._jdf.queryExecution().optimizedPlan().toString()
