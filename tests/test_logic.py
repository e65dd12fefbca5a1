"""Requirement logic and the precedence policy against enumeration of every world."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from standpoint.operators import beliefs as B
from standpoint.operators import logic as G

P = "task_id string, predicate_id string, text string, prior double, ask_cost double, join boolean"
GT = "task_id string, gate_id string, op string, children array<string>, k int"
A = ("task_id string, action_id string, description string, requires string, value_success double, cost_failure double, reliability double, "
     "leak double, needs_approval boolean")
BEL = "task_id string, predicate_id string, prior double, s double, v double, u double, c double, belief double"


def random_task(seed):
    g = random.Random(seed)
    preds = [f"p{i}" for i in range(g.randint(1, 4))]
    nodes, gates = list(preds), []
    for i in range(g.randint(1, 5)):
        op = g.choice(["AND", "OR", "NOT", "ATLEAST"])
        kids = g.sample(nodes, 1 if op == "NOT" else g.randint(1, min(3, len(nodes))))
        gates.append((f"g{i}", op, kids, g.randint(1, len(kids))))
        nodes.append(f"g{i}")
    return preds, gates, g


def settle(gates, leaf, node):
    by = {x[0]: x for x in gates}
    if node not in by:
        return leaf[node]
    _, op, kids, k = by[node]
    v = [settle(gates, leaf, c) for c in kids]
    if op == "NOT":
        return {0: 1, 1: 0, 2: 2}[v[0]]
    k = len(v) if op == "AND" else 1 if op == "OR" else k
    return 0 if v.count(0) >= k else 1 if v.count(1) > len(v) - k else 2


def frames(spark, tasks):
    p, g, a, b = [], [], [], []
    for t, (preds, gates, values) in tasks.items():
        for x in preds:
            s, v, u, be = values[x]
            p.append((t, x, x, 0.5, 1.0, False))
            b.append((t, x, 0.5, s, v, u, 0.0, be))
        g += [(t, *x) for x in gates]
        a.append((t, "act", "", gates[-1][0] if gates else preds[0], 10.0, 25.0, 1.0, 0.0, False))
    return (spark.createDataFrame(p, P), spark.createDataFrame(g, GT), spark.createDataFrame(a, A), spark.createDataFrame(b, BEL))


def test_evaluate_equals_all_worlds(spark):
    tasks = {}
    for seed in range(40):
        preds, gates, g = random_task(seed)
        vals = {}
        for x in preds:
            w = [g.random() for _ in range(3)]
            if g.random() < 0.3:
                w[g.randrange(3)] = 0.0
            t = sum(w)
            vals[x] = (w[0] / t, w[1] / t, w[2] / t, g.random())
        tasks[f"t{seed}"] = (preds, gates, vals)
    p, g, a, b = frames(spark, tasks)
    got = {r["task_id"]: r for r in G.assess(G.compile_actions(p, g, a), b).collect()}
    for t, (preds, gates, vals) in tasks.items():
        root = gates[-1][0]
        want, belief = [0.0, 0.0, 0.0], 0.0
        for combo in itertools.product(range(3), repeat=len(preds)):
            w = math.prod(vals[x][v] for x, v in zip(preds, combo))
            want[settle(gates, dict(zip(preds, combo)), root)] += w
        for combo in itertools.product((0, 1), repeat=len(preds)):
            w = math.prod(vals[x][3] if v == 0 else 1 - vals[x][3] for x, v in zip(preds, combo))
            belief += w * (settle(gates, dict(zip(preds, combo)), root) == 0)
        r = got[t]
        assert [r["s"], r["v"], r["u"]] == pytest.approx(want, abs=1e-9) and r["belief"] == pytest.approx(belief, abs=1e-9) and r["exact"]


def test_reused_leaf_and_excluded_middle(spark):
    tasks = {
        "reuse": (["x"], [("a", "OR", ["x"], 0), ("b", "OR", ["x"], 0), ("top", "AND", ["a", "b"], 0)], {"x": (0.5, 0.3, 0.2, 0.6)}),
        "middle": (["x"], [("n", "NOT", ["x"], 0), ("top", "OR", ["x", "n"], 0)], {"x": (0.2, 0.3, 0.5, 0.37)}),
    }
    p, g, a, b = frames(spark, tasks)
    r = {x["task_id"]: x for x in G.assess(G.compile_actions(p, g, a), b).collect()}
    assert [r["reuse"][c] for c in ("s", "v", "u", "belief")] == pytest.approx([0.5, 0.3, 0.2, 0.6])
    assert [r["middle"][c] for c in ("s", "v", "u", "belief")] == pytest.approx([0.5, 0.0, 0.5, 1.0])


def test_nine_reused_leaves_are_exact(spark):
    preds = [f"p{i}" for i in range(9)]
    gates = [("a", "AND", preds, 0), ("b", "OR", preds, 0), ("top", "AND", ["a", "b"], 0)]
    p, g, a, b = frames(spark, {"t": (preds, gates, {x: (0.9, 0.1, 0.0, 0.9) for x in preds})})
    r = G.assess(G.compile_actions(p, g, a), b).first()
    assert r["exact"] and [r[c] for c in ("s", "v", "u", "belief")] == pytest.approx([0.9 ** 9, 1 - 0.9 ** 9, 0.0, 0.9 ** 9])


@pytest.mark.parametrize("op,k,vals,want", [
    ("AND", 0, [0, 0], 0), ("AND", 0, [0, 1], 1), ("AND", 0, [0, 2], 2), ("OR", 0, [1, 0], 0), ("OR", 0, [1, 1], 1), ("OR", 0, [1, 2], 2),
    ("NOT", 0, [0], 1), ("NOT", 0, [2], 2), ("ATLEAST", 2, [0, 0, 1], 0), ("ATLEAST", 2, [1, 1, 0], 1), ("ATLEAST", 2, [0, 1, 2], 2)])
def test_kleene(spark, op, k, vals, want):
    df = spark.range(1).select(G.kleene(F.lit(op), F.lit(k), F.array(*[F.lit(v) for v in vals])).alias("x"))
    assert df.first()["x"] == want


def test_belief_interval_is_tight(spark):
    tasks = {}
    for seed in range(10):
        preds, gates, g = random_task(100 + seed)
        tasks[f"t{seed}"] = (preds, gates, {x: (0.0, 0.0, 1.0, g.random()) for x in preds})
    p, g, a, b = frames(spark, tasks)
    free = p.filter("predicate_id <> 'p0'").select("task_id", "predicate_id")
    comp = G.compile_actions(p, g, a)
    got = {r["task_id"]: r for r in G.belief_interval(comp, b, free).collect()}
    rnd = random.Random(5)
    for t, (preds, gates, vals) in tasks.items():
        for _ in range(10):
            be = {x: (vals[x][3] if x == "p0" else rnd.random()) for x in preds}
            val = sum(math.prod(be[x] if v == 0 else 1 - be[x] for x, v in zip(preds, c)) * (settle(gates, dict(zip(preds, c)), gates[-1][0]) == 0)
                      for c in itertools.product((0, 1), repeat=len(preds)))
            assert got[t]["low"] - 1e-9 <= val <= got[t]["high"] + 1e-9


def brute_precedence(edges):
    """Every combination of labels, decided by the first rank group that is not silent."""
    out = [0.0] * 4
    order = sorted({(a, v) for _, a, v in edges}, reverse=True)
    for combo in itertools.product(range(3), repeat=len(edges)):
        w = math.prod(e[0][c] for e, c in zip(edges, combo))
        status = 2
        for rank in order:
            said = {c for e, c in zip(edges, combo) if (e[1], e[2]) == rank and c < 2}
            if said:
                status = 3 if len(said) == 2 else said.pop()
                break
        out[status] += w
    return out


E = "task_id string, predicate_id string, record_id string, authority int, valid_from double, p_s double, p_r double, p_n double"


def test_precedence_equals_enumeration(spark):
    g = random.Random(3)
    rows, want = [], {}
    for t in range(25):
        edges = []
        for i in range(g.randint(1, 6)):
            w = [g.random() for _ in range(3)]
            vf = g.choice([None, 0.0, 10.0, 4000.0, 90000.0])
            edges.append(([x / sum(w) for x in w], g.randint(0, 2), vf))
            rows.append((f"t{t}", "p", f"r{i}", edges[-1][1], vf, *edges[-1][0]))
        want[f"t{t}"] = brute_precedence([(e[0], e[1], float("-inf") if e[2] is None else e[2]) for e in edges])
    got = B.precedence(spark.createDataFrame(rows, E)).collect()
    assert len(got) == 25
    for r in got:
        assert [r["s"], r["v"], r["u"], r["c"]] == pytest.approx(want[r["task_id"]], abs=1e-9)


def test_precedence_rules_and_empty(spark):
    sup, ref, nei = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)
    cases = {"high": [(2, 0.0, sup), (1, 5.0, ref)], "silent": [(2, 0.0, nei), (1, 0.0, ref)], "later": [(1, 0.0, sup), (1, 5.0, ref)],
             "clash": [(1, 0.0, sup), (1, 0.0, ref)]}
    rows = [(t, "p", f"r{i}", a, v, *p) for t, es in cases.items() for i, (a, v, p) in enumerate(es)]
    preds = spark.createDataFrame([(t, "p", "", 0.3 if t == "clash" else 0.8, 1.0, False) for t in [*cases, "none"]], P)
    got = {r["task_id"]: r for r in B.beliefs(spark.createDataFrame(rows, E), preds).collect()}
    assert [got[t]["status"] for t in ("high", "silent", "later", "clash", "none")] == ["SATISFIED", "VIOLATED", "VIOLATED", "CONFLICT", "UNRESOLVED"]
    assert got["clash"]["belief"] == pytest.approx(0.3) and got["none"]["belief"] == 0.8 and got["none"]["n_decisive"] == 0


def test_sums_do_not_depend_on_partitioning(spark):
    g = random.Random(9)
    rows = [("t", "p", f"r{i}", 1, float(i % 50), *(lambda w: [x / sum(w) for x in w])([g.random() for _ in range(2)] + [200.0])) for i in range(3000)]
    a = B.precedence(spark.createDataFrame(rows, E).repartition(3)).first()
    b = B.precedence(spark.createDataFrame(rows[::-1], E).repartition(7, "record_id")).first()
    assert tuple(a) == tuple(b)


def deep_task(seed, n=20):
    """Gates over ``n`` leaves, every one of which is reached on several paths."""
    g = random.Random(seed)
    preds = [f"p{i:02d}" for i in range(n)]
    gates = [(f"a{i}", g.choice(["AND", "OR", "ATLEAST"]), g.sample(preds, 4), g.randint(1, 4)) for i in range(n // 2)]
    gates.append(("n", "NOT", ["a0"], 0))
    gates += [(f"b{i}", g.choice(["AND", "OR", "ATLEAST"]), g.sample([x[0] for x in gates], 4), g.randint(1, 4)) for i in range(4)]
    gates.append(("top", "ATLEAST", ["b0", "b1", "b2", "b3", "n"], 3))
    values = {x: [(lambda s, v: (s, v, 1 - s - v, s + (1 - s - v) * 0.5))(*(y / 2 for y in (g.random(), g.random()))) for _ in "x"][0] for x in preds}
    return preds, gates, values


def test_many_repeated_leaves_are_exact(spark):
    """Enumerates the leaves that have any chance of two outcomes: the others are certain, so all worlds can be tried."""
    tasks, want = {}, {}
    for seed in range(4):
        preds, gates, values = deep_task(seed)
        g = random.Random(seed)
        loose = set(g.sample(preds, 7))
        values = {x: v if x in loose else ((1.0, 0.0, 0.0, 1.0) if g.random() < 0.5 else (0.0, 1.0, 0.0, 0.0)) for x, v in values.items()}
        tasks[f"t{seed}"] = (preds, gates, values)
        total, belief = [0.0, 0.0, 0.0], 0.0
        for world in itertools.product(range(3), repeat=len(loose)):
            leaf = {x: 0 if v[0] == 1.0 else 1 for x, v in values.items()} | dict(zip(sorted(loose), world))
            total[settle(gates, leaf, "top")] += math.prod(values[x][w] for x, w in zip(sorted(loose), world))
            if 2 not in world and settle(gates, leaf, "top") == 0:
                belief += math.prod(values[x][3] if w == 0 else 1 - values[x][3] for x, w in zip(sorted(loose), world))
        want[f"t{seed}"] = (*total, belief)
    p, gt, a, b = frames(spark, tasks)
    compiled = G.compile_actions(p, gt, a)
    assert min(r["n"] for r in compiled.select(F.size("reps").alias("n")).collect()) > G.MAX_CONDITIONED
    for r in G.assess(compiled, b).collect():
        assert r["exact"] and all(abs(x - y) < 1e-9 for x, y in zip((r["s"], r["v"], r["u"], r["belief"]), want[r["task_id"]]))
    free, ranges = [], {}
    for t, (preds, gates, values) in tasks.items():
        loose = [x for x in preds if 0 < values[x][0] < 1]
        free += [(t, x) for x in loose[:4]]
        corners = []
        for corner in itertools.product(range(2), repeat=4):
            total = 0.0
            for rest in itertools.product(range(2), repeat=len(loose) - 4):
                leaf = {x: 0 if v[0] == 1.0 else 1 for x, v in values.items()} | dict(zip(loose, corner + rest))
                if settle(gates, leaf, "top") == 0:
                    total += math.prod(values[x][3] if w == 0 else 1 - values[x][3] for x, w in zip(loose[4:], rest))
            corners.append(total)
        ranges[t] = (min(corners), max(corners))
    for r in G.belief_interval(compiled, b, spark.createDataFrame(free, "task_id string, predicate_id string")).collect():
        assert r["exact"] and (r["low"], r["high"]) == pytest.approx(ranges[r["task_id"]], abs=1e-9)


def test_diagram_equals_every_world():
    from standpoint.operators import diagrams as D
    for seed in range(150):
        preds, gates, g = random_task(seed)
        nodes = preds + [x[0] for x in gates]
        prog = [{"op": op, "k": k, "kids": [nodes.index(c) for c in kids]} for _, op, kids, k in gates]
        order = list(range(len(preds)))
        g.shuffle(order)
        d = D.Diagram(prog, len(nodes) - 1, order)
        for world in itertools.product(range(3), repeat=len(preds)):
            x = d.root
            while x > 2:
                x = d.branches[x][world[order[d.asks[x]]]]
            assert x == settle(gates, dict(zip(preds, world)), nodes[-1])


def test_compiling_is_done_once_and_actions_are_dealt_evenly(spark):
    """A condition on a compiled column must not bring the compiling along, nor may all actions land in one task for their size."""
    p = spark.createDataFrame([(f"t{i}", x, x, 0.5, 1.0, False) for i in range(200) for x in "abc"],
                              "task_id string, predicate_id string, text string, prior double, ask_cost double, join boolean")
    g = p.select("task_id").distinct().selectExpr("task_id", "'g' as gate_id", "'AND' as op", "array('a', 'b') as children", "0 as k")
    a = p.select("task_id").distinct().selectExpr("task_id", "'x' as action_id", "'do' as description", "'g' as requires", "1.0D as value_success", "1.0D as cost_failure",
                                                  "1.0D as reliability", "0.0D as leak", "false as needs_approval")
    b = p.selectExpr("task_id", "predicate_id", "0.9D as s", "0.05D as v", "0.05D as u", "0.0D as c", "0.925D as belief")
    out = G.assess(G.compile_actions(p, g, a), b)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan
    assert len({r.p for r in out.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1
    got = out.collect()
    assert len(got) == 200 and all(abs(r.s - 0.81) < 1e-12 and r.disposition == "READY" for r in got)
