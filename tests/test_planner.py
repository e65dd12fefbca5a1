"""Questions and certificates on cases small enough to work out."""

import random

import itertools

import numpy as np
from pyspark.sql import functions as F

from standpoint.operators import logic as G
from standpoint.operators import planner as P
from tests.test_logic import A, BEL, GT, settle
from tests.test_logic import P as PRED


def build(spark, gates, leaves, actions, prior=0.5, cost=0.1):
    p = spark.createDataFrame([("t", x, x, prior, cost, False) for x in leaves], PRED)
    g = spark.createDataFrame([("t", *x) for x in gates], GT)
    a = spark.createDataFrame([("t", n, "", req, 10.0, 5.0, 1.0, 0.0, False) for n, req in actions], A)
    b = spark.createDataFrame([("t", x, prior, *v) for x, v in leaves.items()], BEL)
    comp = G.compile_actions(p, g, a)
    return comp, b, P.task_rows(comp, b, p)


OPEN, YES = (0.0, 0.0, 1.0, 0.0, 0.5), (1.0, 0.0, 0.0, 0.0, 1.0)


def test_or_already_satisfied_makes_the_question_unnecessary(spark):
    comp, b, rows = build(spark, [("g", "OR", ["a", "b"], 0)], {"a": YES, "b": OPEN}, [("act", "g")])
    got = [(r["action_id"], r["predicate_id"]) for r in P.unnecessary_questions(comp, b).collect()]
    assert got == [("act", "b")]
    cert = P.certify_stable(comp, b, P.open_predicates(b)).first()
    assert cert["stable"] and cert["checked"] == 3 and cert["current"] == "READY"


def test_pair_is_worth_asking_when_singles_are_not(spark):
    comp, b, rows = build(spark, [("g", "AND", ["a", "b"], 0)], {"a": OPEN, "b": OPEN}, [("act", "g")])
    v = {tuple(r["asked"]): r for r in P.value_of_asking(rows, P.question_sets(P.askable(b))).collect()}
    assert v[("a",)]["value"] < 0 and v[("b",)]["value"] < 0 and v[("a", "b")]["value"] > 0
    best = P.best_question(rows, P.askable(b)).first()
    assert best["asked"] == ["a", "b"] and best["could_change"] == ["act"]
    assert P.unnecessary_questions(comp, b).count() == 0
    cert = P.certify_stable(comp, b, P.open_predicates(b)).first()
    assert not cert["stable"] and cert["counterexample"] == "a=satisfied,b=satisfied" and cert["checked"] == 1


def test_certificates_agree_with_trying_everything(spark):
    gates = [("g", "ATLEAST", ["a", "b", "c"], 2), ("h", "AND", ["g", "d"], 0)]
    leaves = {"a": YES, "b": OPEN, "c": OPEN, "d": OPEN}
    comp, b, _ = build(spark, gates, leaves, [("x", "g"), ("y", "h")])
    names = {0: "READY", 1: "BLOCKED", 2: "NEEDS_INFO"}
    for r in P.certify_stable(comp, b, P.open_predicates(b)).collect():
        root = {"x": "g", "y": "h"}[r["action_id"]]
        free = [x for x in r["free"].split(",") if x]
        seen = []
        for combo in itertools.product(range(3), repeat=len(free)):
            leaf = {"a": 0, "b": 2, "c": 2, "d": 2} | dict(zip(free, combo))
            seen.append(names[settle(gates, leaf, root)])
        assert r["current"] == "NEEDS_INFO"
        assert r["stable"] == all(s == r["current"] for s in seen)
        if not r["stable"]:
            i = next(i for i, s in enumerate(seen) if s != r["current"])
            assert r["checked"] == i + 1 and r["becomes"] == seen[i]


def test_certificates_of_twelve_open_leaves(spark):
    """More open leaves than could once be tried: against plain reasoning about thresholds."""
    names = [f"q{i:02d}" for i in range(12)]
    gates = [("g", "ATLEAST", names, 7), ("h", "OR", ["yes", *names[:11]], 0), ("m", "AND", ["g", "h"], 0), ("n", "AND", ["no", "m"], 0)]
    comp, b, _ = build(spark, gates, {"yes": YES, "no": (0.0, 1.0, 0.0, 0.0, 0.0)} | dict.fromkeys(names, OPEN), [("x", "m"), ("y", "h"), ("z", "n")])
    got = {r["action_id"]: r for r in P.certify_stable(comp, b, P.open_predicates(b)).collect()}
    assert got["y"]["stable"] and got["y"]["current"] == "READY" and got["y"]["checked"] == 3**11
    assert got["z"]["stable"] and got["z"]["current"] == "BLOCKED" and got["z"]["checked"] == 3**12
    assert not got["x"]["stable"] and got["x"]["becomes"] == "READY" and got["x"]["checked"] == 1
    assert got["x"]["counterexample"] == ",".join(f"{n}=satisfied" for n in names)
    useless = {(r["action_id"], r["predicate_id"]) for r in P.unnecessary_questions(comp, b).collect()}
    assert useless == {("y", n) for n in names[:11]} | {("z", n) for n in names}


def test_unnecessary_questions_agree_with_trying_everything(spark):
    gates = [("g", "OR", ["a", "b"], 0), ("h", "AND", ["g", "c"], 0), ("k", "ATLEAST", ["h", "a", "d"], 2)]
    comp, b, _ = build(spark, gates, {"a": OPEN, "b": OPEN, "c": YES, "d": OPEN}, [("x", "h"), ("y", "k")])
    got = {(r["action_id"], r["predicate_id"]) for r in P.unnecessary_questions(comp, b).collect()}
    want = set()
    for act, root, names in (("x", "h", "ab"), ("y", "k", "abd")):
        for n in names:
            rest = [m for m in names if m != n]
            if all(len({settle(gates, {"c": 0, n: v} | dict(zip(rest, combo)), root) for v in range(3)}) == 1 for combo in itertools.product(range(3), repeat=len(rest))):
                want.add((act, n))
    assert got == want


def test_answers_side_by_side_are_the_fold_s(spark):
    """Question values over arrays are those of the expression, with repeated leaves and every operator; pieces of sets are dealt over many tasks."""
    rng = random.Random(5)
    names = [f"p{i}" for i in range(5)]
    ops = [("AND", 0), ("OR", 0), ("ATLEAST", 2), ("NOT", 0)]
    preds = [(f"t{t}", n, n, 0.5, 0.1, False) for t in range(40) for n in names]
    gates = []
    for t in range(40):
        for i in range(3):
            op, k = ops[(t + i) % 4]
            kids = rng.sample(names, 1 if op == "NOT" else 3)
            gates.append((f"t{t}", f"g{i}", op, kids, k))
        gates.append((f"t{t}", "top", "OR" if t % 2 else "AND", ["g0", "g1", "g2"], 0))
    p = spark.createDataFrame(preds, "task_id string, predicate_id string, text string, prior double, ask_cost double, join boolean")
    g = spark.createDataFrame(gates, "task_id string, gate_id string, op string, children array<string>, k int")
    a = spark.createDataFrame([(f"t{t}", x, x, r, 3.0, 2.0, 0.9, 0.1, False) for t in range(40) for x, r in (("a", "top"), ("b", "g0"))],
                              "task_id string, action_id string, description string, requires string, value_success double, cost_failure double, "
                              "reliability double, leak double, needs_approval boolean")
    rows = []
    for t, n, *_ in preds:
        s, v = rng.choice([(0.7, 0.2), (1.0, 0.0), (0.3, 0.3), (0.0, 0.9)])
        rows.append((t, n, 0.5, s, v, 1 - s - v, 0.0, s + (1 - s - v) * 0.5))
    b = spark.createDataFrame(rows, "task_id string, predicate_id string, prior double, s double, v double, u double, c double, belief double")
    tasks = P.task_rows(G.compile_actions(p, g, a), b, p)
    acts = tasks.select("task_id", "ls", "lb", F.explode("acts").alias("act"))
    one = acts.select("task_id", "act", "ls", "lb", P.outcome_of(F.col("act"), F.col("ls"), F.col("lb"), 0.5, 0.5).alias("o"))
    for r in one.collect():
        act = r.act.asDict(recursive=True)
        d, u = P.outcomes_of(act, np.array([[[x.s, x.v, x.u] for x in r.ls]]), np.array([r.lb]), 0.5, 0.5)
        assert ["READY", "BLOCKED", "NEEDS_INFO"][d[0]] == r.o.d and u[0] == r.o.u
    v = P.value_of_asking(tasks, P.question_sets(P.askable(b)))
    assert "xxhash64" in v._jdf.queryExecution().optimizedPlan().toString() and "aggregate(sequence" not in v._jdf.queryExecution().optimizedPlan().toString()
    assert len({r.p for r in v.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1
