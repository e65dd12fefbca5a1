"""Corrections, similar readings, the bar and the gate."""

import random

import numpy as np
import pandas as pd
import pytest

from standpoint.operators import feedback as K
from standpoint.operators import neighbours as N


def test_retracting_restores_the_verdict_before(spark):
    c = spark.createDataFrame([(1, "x", 0), (2, "x", 1), (3, "y", 2)], "item_id int, pair string, label int")
    none = spark.createDataFrame([], "item_id int")
    got = lambda r: {x["pair"]: x["label"] for x in K.correction_log(c, r).collect()}
    assert got(none) == {"x": 1, "y": 2}
    assert got(spark.createDataFrame([(2,), (3,)], "item_id int")) == {"x": 0}


def knn_by_hand(q, p, mem, lab, k, tau, lam_max):
    out = []
    for v, pr in zip(q, p):
        s = mem @ v
        top = np.argsort(-s, kind="stable")[:k]
        w = np.clip((s[top] - tau) / (1 - tau), 0, 1)
        if w.sum() == 0:
            out.append(pr)
            continue
        y = np.array([(w * (lab[top] == c)).sum() for c in range(3)]) / w.sum()
        lam = lam_max * (1 - np.prod(1 - w))
        b = (1 - lam) * pr + lam * y
        out.append(b / b.sum())
    return np.array(out)


@pytest.mark.parametrize("blocks", [(1000, 1000), (20, 15)])
def test_knn_blend_by_hand(spark, blocks):
    g = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q, mem = unit(g.normal(size=(60, 5))), unit(g.normal(size=(50, 5)))
    mem[0] = q[0]  # an exact twin: weight one
    lab = g.integers(0, 3, 50)
    p = g.dirichlet([1, 1, 1], 60)
    qs = spark.createDataFrame(pd.DataFrame({"qid": range(60), "vec": list(map(list, q)), "p_s": p[:, 0], "p_r": p[:, 1], "p_n": p[:, 2]}))
    ms = spark.createDataFrame(pd.DataFrame({"item_id": range(50), "label": lab.astype("int32"), "vec": list(map(list, mem))}))
    near = K.top_neighbours(qs, ms, 8, query_block=blocks[0], memory_block=blocks[1])
    got = K.knn_blend(qs, ms, tau=0.6, lam_max=0.7, neighbours=near).orderBy("qid").toPandas()[["p_s", "p_r", "p_n"]].to_numpy()
    assert got == pytest.approx(knn_by_hand(q, p, mem, lab, 8, 0.6, 0.7), abs=1e-9)
    assert K.knn_blend(qs, ms, lam_max=0.0).filter("touched").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_threshold_trace_follows_the_log(spark, seed):
    g = random.Random(seed)
    log = [("w", i, g.choice(["endorsement", "verdict", "verdict"]), g.random() < 0.4) for i in range(80)]
    got = K.threshold_trace(spark.createDataFrame(log, "workspace string, seq long, kind string, wrong boolean"), block_rows=9).orderBy("seq").collect()
    v = e = out = 0
    peak = 1
    for row, (_, _, kind, wrong) in zip(got, log):
        ok = True
        if kind == "endorsement":
            out += 1
            peak = max(peak, out)
        elif out > 0:
            out, v, e = out - 1, v + 1, e + int(wrong)
        else:
            ok = False
        tau = 0.9 + 0.05 * (e - 0.05 * v)
        assert (row["accepted"], row["outstanding"], row["verdicts"], row["errors"], row["max_outstanding"]) == (ok, out, v, e, peak)
        assert row["tau"] == pytest.approx(tau) and (v == 0 or e / v <= row["bound"] + 1e-9 or row["bound"] == 1.0 or tau > 1)


def test_apply_corrections_overrides_the_model(spark):
    e = spark.createDataFrame([("t", "r", "p", "k1", .1, .2, .7), ("t", "r2", "p", "k2", .1, .2, .7)],
                              "task_id string, record_id string, predicate_id string, pair string, p_s double, p_r double, p_n double")
    v = spark.createDataFrame([("k1", 0)], "pair string, label int")
    r = {x["pair"]: x for x in K.apply_corrections(e, v).collect()}
    assert r["k1"]["p_s"] == 0.995 and r["k1"]["p_n"] == pytest.approx(0.0025) and r["k2"]["p_n"] == 0.7 and not r["k2"]["corrected"]


def test_infeasible_link_threshold(spark):
    m = spark.createDataFrame([(t, x, 0.0) for t in range(5) for x in (0.1, 0.2)], "task_id int, threshold double, miss double")
    r = K.crc_threshold(m, 0.05).first()
    assert r["threshold"] == float("-inf") and not r["feasible"]
    assert K.crc_threshold(m, 0.2).first()["threshold"] == 0.2


def test_gate_reasons(spark):
    gate = spark.createDataFrame([("a", "s1", True), ("a", "s2", False), ("b", "s1", True)], "candidate string, suite string, passes boolean")
    gain = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.01, -0.02)], "candidate string, gain double, lo double")
    hold = spark.createDataFrame([("a", 0.5), ("b", 0.6)], "candidate string, nll double")
    r = K.choose_candidate(gate, gain, hold, 500, 300, 200).first()
    assert not r["adopted"] and r["chosen"] == "champion"
    assert r["reason"] == "a: fails regression on s2; b: no reliable held-out gain (lower bound -0.0200)"
    ok = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.3, 0.02)], "candidate string, gain double, lo double")
    assert K.choose_candidate(gate.filter("suite = 's1'"), ok, hold, 500, 300, 200).first()["chosen"] == "a"
    assert K.choose_candidate(gate, gain, hold, 50, 30, 20).first()["reason"].startswith("only 50")


def clustered(rng, n, dim, spread):
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("least", [-1.0, 0.8])
def test_pivots_are_exact_and_skip(spark, least):
    rng = np.random.default_rng(4)
    mem, q = clustered(rng, 1500, 8, 0.08), clustered(rng, 300, 8, 0.08)
    mem[200:700] = mem[0]  # copies of one vector: a third of the memory
    q[:5] = mem[:5]
    m = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(mem)], "item_id long, label int, vec array<double>")
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vec array<double>")
    near, work = N.search(a, m, 8, least=least, query_block=40, memory_block=100)
    got = {}
    for r in near.collect():
        got.setdefault(r["qid"], []).append((-round(r["sim"], 9), r["item_id"]))
    sims = np.round(q @ mem.T, 9)
    for i in range(300):
        want = sorted((-s, j) for j, s in enumerate(sims[i].tolist()) if s >= least)[:8]
        assert [x for x in sorted(got.get(i, [])) if -x[0] >= least] == want
    assert sum(r["compared"] for r in work.collect()) < 300 * 1500 / 2


def test_queries_travel_once_to_a_block_and_gaps_take_no_part(spark, monkeypatch):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    mem, q = unit(rng.normal(size=(900, 16))), unit(rng.normal(size=(100, 16)))  # no clusters: bounds skip next to nothing
    m = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(mem)] + [(900, 0, None)], "item_id long, label int, vec array<double>")
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(100, None)], "qid long, vec array<double>")
    written = []
    cut = N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df: (out := cut(df), written.append(out.count() if "qid" in out.columns else 0))[0])
    near, _ = N.search(a, m, 8, memory_block=300)
    got = {(r["qid"], r["item_id"]) for r in near.collect()}
    assert got == {(i, j) for i, s in enumerate(q @ mem.T) for j in np.argsort(-s)[:8].tolist()}
    assert sum(written) <= 100 * (2 + 6)  # homes, nearest blocks, and a row for each other block of at least 150 items


def test_growth_stays_below_the_square(spark):
    rng = np.random.default_rng(5)
    compared = []
    for n in (500, 2000):
        x = clustered(rng, n, 4, 0.3)
        m = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "item_id long, label int, vec array<double>")
        _, work = N.search(m.withColumnRenamed("item_id", "qid"), m, 4, exclude_self=True)
        compared.append(sum(r["compared"] for r in work.collect()))
    assert compared[1] < 16 * compared[0] * 0.7


def test_memory_over_time_by_hand(spark):
    rng = np.random.default_rng(6)
    x = clustered(rng, 160, 6, 0.2)
    lab, p = rng.integers(0, 3, 160), rng.dirichlet([1, 1, 1], 160)
    rows = [(i, i, x[i].tolist(), int(lab[i]), *p[i].tolist()) for i in range(160)]
    df = spark.createDataFrame(rows, "qid long, seq long, vec array<double>, label int, p_s double, p_r double, p_n double")
    got = {r["block"]: r for r in K.prequential_eval(df, 4, tau=0.6, lam_max=0.7).collect()}
    for b in range(4):
        part = slice(40 * b, 40 * b + 40)
        helped = knn_by_hand(x[part], p[part], x[:40 * b], lab[:40 * b], 8, 0.6, 0.7) if b else p[part]
        assert got[b]["n"] == 40 and got[b]["frozen"] == pytest.approx((p[part].argmax(1) == lab[part]).mean())
        assert got[b]["with_memory"] == pytest.approx((np.array(helped).argmax(1) == lab[part]).mean())
    assert got[0]["touched"] == 0.0 and K.prequential_eval(df.limit(0), 4, tau=0.6, lam_max=0.7).count() == 0
