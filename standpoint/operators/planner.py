"""What is worth asking: requirements evaluated under assumed answers.

All actions of a task sit in one row (a bounded document), so a scenario is a changed copy of the leaf
values inside that row. Question sets of a task go together in pieces of bounded size; their answers are worked out side by
side. Nothing is joined or shuffled per scenario.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from standpoint.functions import scalars as S
from standpoint.operators import diagrams
from standpoint.operators.logic import MAX_CONDITIONED, evaluate, let, with_leaves
from standpoint.operators.scan import deal
from standpoint.schemas import READY

SETTLED, MIN_OPEN = 0.999, 0.2
MAX_SET = 3
SETS_TOGETHER = 512  # question sets of a task worked on together


def open_predicates(beliefs: DataFrame, min_open: float = MIN_OPEN) -> DataFrame:
    return beliefs.filter(F.col("u") + F.col("c") >= min_open).select("task_id", "predicate_id", (F.col("u") + F.col("c")).alias("open"))


def askable(beliefs: DataFrame, settled: float = SETTLED) -> DataFrame:
    """All predicates an answer could still inform, with how settled they are."""
    return beliefs.withColumn("sure", F.greatest("s", "v")).filter(F.col("sure") < settled).select("task_id", "predicate_id", "sure")


def task_rows(compiled: DataFrame, beliefs: DataFrame, predicates: DataFrame) -> DataFrame:
    """One row per task: its predicates in order (``pids``), their leaf values (``ls``, ``lb``), priors and costs, and
    ``acts``, the compiled actions with leaf positions into those arrays."""
    leaf = beliefs.join(predicates.select("task_id", "predicate_id", "ask_cost"), ["task_id", "predicate_id"])
    item = F.struct("predicate_id", "s", "v", (F.col("u") + F.col("c")).alias("u"), "belief", "prior", "ask_cost")
    per = leaf.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    per = per.select("task_id", F.transform("x", lambda i: i["predicate_id"]).alias("pids"),
                     F.transform("x", lambda i: F.struct(i["s"].alias("s"), i["v"].alias("v"), i["u"].alias("u"))).alias("ls"),
                     F.transform("x", lambda i: i["belief"]).alias("lb"), F.transform("x", lambda i: i["prior"]).alias("pr"),
                     F.transform("x", lambda i: i["ask_cost"]).alias("costs"))
    acts = compiled.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        "action_id", "prog", "root", "reps", "leaves", "value_success", "cost_failure", "reliability", "leak"))).alias("acts"))
    j = per.join(acts, "task_id")
    placed = F.transform("acts", lambda a: F.struct(
        *[a[n].alias(n) for n in ("action_id", "prog", "root", "reps", "value_success", "cost_failure", "reliability", "leak")],
        F.transform(a["leaves"], lambda x: F.array_position("pids", x).cast("int")).alias("at")))
    return j.withColumn("acts", placed)


def outcome_of(act: Column, ls: Column, lb: Column, ready: float, block: float) -> Column:
    """(disposition, utility if READY else 0) of one compiled action under given leaf values."""
    ev = evaluate(act["prog"], act["root"], act["reps"], F.transform(act["at"], lambda i: F.element_at(ls, i)),
                  F.transform(act["at"], lambda i: F.element_at(lb, i)))

    def read(e):
        d = S.disposition(e["s"], e["v"], ready, block)
        p = S.p_success(e["belief"], act["reliability"], act["leak"])
        gain = F.when(d == READY, S.expected_utility(p, act["value_success"], act["cost_failure"])).otherwise(F.lit(0.0))
        return F.struct(act["action_id"].alias("a"), d.alias("d"), gain.alias("u"))

    return let(ev, read)


def _total(outcomes: Column) -> Column:
    return F.aggregate(outcomes, F.lit(0.0), lambda a, x: a + x["u"])


def policy_utility(tasks: DataFrame, ready: float = 0.5, block: float = 0.5) -> DataFrame:
    """Total expected utility of the actions proposed now, per task, with every disposition."""
    d = tasks.withColumn("o", F.transform("acts", lambda a: outcome_of(a, F.col("ls"), F.col("lb"), ready, block)))
    return d.select("task_id", _total(F.col("o")).alias("utility"),
                    F.transform("o", lambda x: F.concat(x["a"], F.lit("="), x["d"])).alias("dispositions"))


def _number(x) -> float:
    return math.nan if x is None else float(x)


def _position(i: int | None) -> int:
    if i is None or i < 0:
        raise ValueError("a node that is not there")
    return i


def _at_least(ps: list[np.ndarray], k: int | None, one: np.ndarray) -> np.ndarray:
    if k is None:
        return one * math.nan
    t = [one, *[one * 0.0] * len(ps)]
    for p in ps:
        t = [x * (1.0 - p) + (t[i - 1] if i else 0.0) * p for i, x in enumerate(t)]
    return reduce(lambda a, x: a + x, t[max(k, 0):], one * 0.0)


def _folded(prog: list[dict], leaves: list[tuple], root: int, one: np.ndarray) -> tuple:
    """Values of the root, over many settings of the leaves: (satisfied, violated), or (true,) where leaves are truths."""
    nodes = list(leaves)
    for g in prog:
        kids = [nodes[_position(i)] for i in g["kids"]]
        n, k, s = len(kids), g["k"], [x[0] for x in kids]
        v = [x[-1] for x in kids]
        whole, none = reduce(lambda a, x: a * x, s, one), 1.0 - reduce(lambda a, x: a * (1.0 - x), s, one)
        if len(leaves[0]) == 1:
            nodes.append((whole if g["op"] == "AND" else none if g["op"] == "OR" else 1.0 - s[0] if g["op"] == "NOT" else _at_least(s, k, one),))
        elif g["op"] == "AND":
            nodes.append((whole, 1.0 - reduce(lambda a, x: a * (1.0 - x), v, one)))
        elif g["op"] == "OR":
            nodes.append((none, reduce(lambda a, x: a * x, v, one)))
        elif g["op"] == "NOT":
            nodes.append((v[0], s[0]))
        else:
            nodes.append((_at_least(s, k, one), _at_least(v, None if k is None else n - k + 1, one)))
    return nodes[_position(root)]


def _over_worlds(act: dict, leaves: list[tuple], weights: list[tuple], hot: list[tuple], one: np.ndarray) -> list[np.ndarray]:
    """``_folded`` summed over the worlds of the leaves reached on several paths (``weights`` and ``hot``: of each value such a leaf may take)."""
    cond = act["reps"] if len(act["reps"]) <= MAX_CONDITIONED else []
    out = [one * 0.0 for _ in leaves[0]] if leaves else [one * 0.0, one * 0.0]
    for world in product(range(len(hot)), repeat=len(cond)):
        digits = dict(zip(cond, reversed(world), strict=True))  # the first leaf's value changes fastest
        weight = reduce(lambda a, c: a * weights[c][digits[c]], cond, one)
        some = weight > 0
        if some.any():
            fixed = [tuple(one * h for h in hot[digits[i]]) if i in digits else x for i, x in enumerate(leaves)]
            out = [np.where(some, a + weight * y, a) for a, y in zip(out, _folded(act["prog"], fixed, act["root"], one), strict=True)]
    return out


def outcomes_of(act: dict, ls: np.ndarray, lb: np.ndarray, ready: float, block: float) -> tuple[np.ndarray, np.ndarray]:
    """``outcome_of`` over many settings of a task's leaf values (rows): dispositions as 0 ready, 1 blocked, 2 open, and utilities."""
    at = [_position(i - 1) for i in act["at"]]
    one = np.ones(len(lb))
    s, v = _over_worlds(act, [(ls[:, i, 0], ls[:, i, 1]) for i in at], [tuple(ls[:, i].T) for i in at], [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)], one)
    belief, = _over_worlds(act, [(lb[:, i],) for i in at], [(1.0 - lb[:, i], lb[:, i]) for i in at], [(0.0,), (1.0,)], one)
    d = np.where((s >= ready) & (s >= v), 0, np.where(v >= block, 1, 2))
    p = belief * _number(act["reliability"]) + (1.0 - belief) * _number(act["leak"])
    return d, np.where(d == 0, p * _number(act["value_success"]) - (1.0 - p) * _number(act["cost_failure"]), 0.0)


def asked_values(acts: list[dict], ls: list[dict], lb: list, qs: list[list[int]], ready: float, block: float) -> list[dict]:
    """Per question set (positions from one) of a task: the present utility, the expected one over all answers, and the actions whose
    disposition some answer changes. All answers of all sets are worked out side by side."""
    ls, lb = np.array([[_number(x[n]) for n in "svu"] for x in ls]), np.array([_number(x) for x in lb])
    which = [(k, [(_position(i - 1), w >> j & 1) for j, i in enumerate(q)]) for k, q in enumerate(qs) for w in range(2 ** len(q))]
    weight = np.array([reduce(lambda a, x: a * (lb[x[0]] if x[1] == 0 else 1.0 - lb[x[0]]), asked, 1.0) for _, asked in which])
    which = [x for x, y in zip(which, weight > 0, strict=True) if y]  # impossible answers are left out
    weight = weight[weight > 0]
    many_s, many_b = np.repeat(ls[None], len(which) + 1, axis=0), np.repeat(lb[None], len(which) + 1, axis=0)  # the first row: nothing asked
    for row, (_, asked) in enumerate(which, 1):
        for i, no in asked:
            many_s[row, i], many_b[row, i] = ((0.0, 1.0, 0.0), 0.0) if no else ((1.0, 0.0, 0.0), 1.0)
    total, changed = np.zeros(len(many_b)), [set() for _ in qs]
    for act in acts:
        leaves = {i - 1 for i in act["at"]}
        meets = [0, *[row for row, (_, asked) in enumerate(which, 1) if any(i in leaves for i, _ in asked)]]  # others stay as they are
        d, u = outcomes_of(act, many_s[meets], many_b[meets], ready, block)
        every = np.full(len(many_b), u[0])
        every[meets] = u
        total = total + every
        for row in np.flatnonzero(d != d[0]):
            changed[which[meets[row] - 1][0]].add(act["action_id"])
    e = [0.0] * len(qs)
    for (k, _), x, t in zip(which, weight, total[1:], strict=True):
        e[k] += float(x * t)
    none = lambda x: None if math.isnan(x) else float(x)
    return [{"base": none(total[0]), "e": none(e[k]), "c": list(changed[k])} for k in range(len(qs))]


def value_of_asking(tasks: DataFrame, sets: DataFrame, ready: float = 0.5, block: float = 0.5) -> DataFrame:
    """Value of each question set (task_id, asked: sorted predicate ids): expected utility over all answers, each
    weighed by belief, less the present utility and the costs of asking; which question to put first; and
    the actions whose proposal some answer changes."""
    pieces = (1 + F.floor(F.pow(F.size("pids").cast("double"), F.lit(3.0)) / F.lit(6.0 * SETS_TOGETHER))).cast("long")  # all sets of up to three, cut
    piece = sets.join(tasks.select("task_id", pieces.alias("_n")), "task_id").withColumn("_piece", F.pmod(F.xxhash64("asked"), F.col("_n")))
    rows = tasks.join(piece.groupBy("task_id", "_piece").agg(F.collect_list("asked").alias("sets")), "task_id")
    placed = F.transform("sets", lambda s: F.transform(s, lambda p: F.array_position("pids", p).cast("int")))
    d = deal(rows.withColumn("qs", placed), "task_id", "_piece")
    result = "array<struct<base:double,e:double,c:array<string>>>"
    schema = d.select("task_id", "sets", "qs", "pids", "lb", "costs", F.lit(None).cast(result).alias("r")).schema
    arrow = to_arrow_type(schema["r"].dataType)

    def run(batches):
        for b in batches:
            out = [asked_values(r["acts"], r["ls"], r["lb"], r["qs"], ready, block) for r in b.select(["acts", "ls", "lb", "qs"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), pa.array(out, arrow)], names=schema.names)

    d = d.mapInArrow(run, schema).withColumn("x", F.explode(F.arrays_zip("sets", "qs", "r"))).select(
        "task_id", "pids", "lb", "costs", F.col("x.sets").alias("asked"), F.col("x.qs").alias("q"), F.col("x.r").alias("r"))
    cost = F.aggregate(F.transform("q", lambda i: F.element_at("costs", i)), F.lit(0.0), lambda a, x: a + x)
    gain = F.col("r.e") - F.col("r.base")
    first = F.array_min(F.transform("q", lambda i: F.struct(
        (F.element_at("costs", i) / F.greatest(F.lit(1e-9), 1.0 - F.element_at("lb", i))).alias("k"), F.element_at("pids", i).alias("p"))))
    return d.select("task_id", "asked", (gain - cost).alias("value"), gain.alias("gross_gain"), cost.alias("cost"),
                    first["p"].alias("ask_first"), F.array_sort("r.c").alias("could_change"))


def question_sets(candidates: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """All sets of one to ``max_set`` candidates of a task (at most 200, as many as a task has predicates). Sets grow as rows,
    each from those with one member less, so no row holds more than a task's names."""
    c = candidates.groupBy("task_id").agg(F.array_sort(F.collect_set("predicate_id")).alias("c"))
    grown = c.select("task_id", "c", F.explode(F.transform("c", lambda x: F.array(x))).alias("asked"))
    sets = grown
    for _ in range(max_set - 1):
        later = F.filter("c", lambda x: x > F.element_at("asked", -1))
        grown = grown.select("task_id", "c", F.explode(F.transform(later, lambda x: F.concat("asked", F.array(x)))).alias("asked"))
        sets = sets.unionByName(grown)
    return sets.select("task_id", "asked")


def best_question(tasks: DataFrame, candidates: DataFrame, max_set: int = MAX_SET, ready: float = 0.5,
                  block: float = 0.5) -> DataFrame:
    """Per task the set worth most, if any is worth its cost; of equal values the smaller, then the first by name."""
    v = value_of_asking(tasks, question_sets(candidates, max_set), ready, block)
    key = F.struct((-F.round("value", 10)).alias("k"), F.size("asked").alias("n"), F.col("asked").alias("s"))
    best = v.groupBy("task_id").agg(F.min_by(F.struct(*[c for c in v.columns if c != "task_id"]), key).alias("b"))
    return best.select("task_id", "b.*").filter(F.col("value") > 1e-12)


def _action_rows(compiled: DataFrame, beliefs: DataFrame, free: DataFrame) -> DataFrame:
    f = free.groupBy("task_id").agg(F.array_sort(F.collect_set("predicate_id")).alias("fnames"))
    d = with_leaves(compiled, beliefs).join(f, "task_id", "left")
    inside = F.filter(F.coalesce("fnames", F.array().cast("array<string>")), lambda x: F.array_contains("leaves", x))
    return d.withColumn("fnames", inside).withColumn("fpos", F.transform("fnames", lambda x: F.array_position("leaves", x).cast("int")))


def certify_stable(compiled: DataFrame, beliefs: DataFrame, free: DataFrame, ready: float = 0.5, block: float = 0.5) -> DataFrame:
    """Does each action keep its disposition however the free predicates are settled (satisfied, violated, open)? ``checked``
    settlements are covered: all 3^k, or those up to the first that differs, which is the counterexample."""
    schema = "struct<current:string,stable:boolean,checked:int,counterexample:string,becomes:string>"
    out = diagrams.per_action(_action_rows(compiled, beliefs, free), ["task_id", "action_id", "fnames"], lambda row: diagrams.certificate(row, ready, block), schema)
    return out.select("task_id", "action_id", F.array_join("fnames", ",").alias("free"), "out.*")


def unnecessary_questions(compiled: DataFrame, beliefs: DataFrame, min_open: float = MIN_OPEN, ready: float = 0.5, block: float = 0.5) -> DataFrame:
    """Open predicates under an action whose answer never changes its disposition, whatever the other open ones turn
    out to be."""
    d = _action_rows(compiled, beliefs, open_predicates(beliefs, min_open)).filter(F.size("fpos") > 0)
    out = diagrams.per_action(d, ["task_id", "action_id"], lambda row: diagrams.irrelevant(row, ready, block), "array<string>")
    return out.select("task_id", "action_id", F.explode("out").alias("predicate_id"))
