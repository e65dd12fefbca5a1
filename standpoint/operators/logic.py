"""Requirement logic over gate tables.

A task's definition is one document (at most 200 predicates and the gates over them), so it is compiled
into one row: nodes in an order where children come first, each gate holding the positions of its
children. Evaluation is then a fold over that short list inside the row, in the JVM; no join or shuffle
per gate level, and any number of tasks, scenarios or worlds runs side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators import diagrams
from standpoint.operators.scan import deal
from standpoint.session import cut_lineage

#: Up to so many repeated leaves are conditioned on inside the row; beyond, a decision diagram gives the same result.
MAX_CONDITIONED = 8
MAX_PREDICATES = 200  # fixed value: the most predicates a task may declare, which bounds its document


# ---------------------------------------------------------------- compiling definitions


def task_documents(predicates: DataFrame, gates: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per task: sorted predicates, gates ordered children first (``topo``, with levels), actions. Tasks are dealt evenly:
    a document is a few bytes but much work."""
    p = predicates.groupBy("task_id").agg(F.array_sort(F.collect_list(
        F.struct("predicate_id", F.col("text").alias("claim"), "prior", "ask_cost"))).alias("preds"))
    g = gates.groupBy("task_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("gate_id").alias("id"), "op", "k", "children"))).alias("gs"))
    a = actions.groupBy("task_id").agg(F.array_sort(F.collect_list(
        F.struct("action_id", "description", "requires", "value_success", "cost_failure", "reliability", "leak",
                 "needs_approval"))).alias("acts"))
    doc = deal(p.join(a, "task_id", "left").join(g, "task_id", "left"), "task_id")
    none = F.array().cast("array<struct<id:string,op:string,k:int,children:array<string>>>")
    return doc.withColumn("gs", F.coalesce("gs", none)).withColumn("topo", _topological("gs"))


def _topological(gs: str) -> Column:
    """Rounds over a task's gates: each appends those whose gate children are all placed already. A gate on a
    cycle is never placed."""
    ids = F.transform(gs, lambda g: g["id"])
    start = F.array().cast("array<struct<id:string,op:string,k:int,children:array<string>,level:int>>")

    def one_round(acc, level):
        placed = F.transform(acc, lambda g: g["id"])
        ready = F.filter(gs, lambda g: ~F.array_contains(placed, g["id"]) & F.forall(
            g["children"], lambda c: ~F.array_contains(ids, c) | F.array_contains(placed, c)))
        return F.concat(acc, F.transform(ready, lambda g: F.struct(
            g["id"].alias("id"), g["op"].alias("op"), g["k"].alias("k"), g["children"].alias("children"),
            level.cast("int").alias("level"))))

    rounds = F.when(F.size(gs) > 0, F.sequence(F.lit(1), F.size(gs))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, lambda acc, i: F.when(F.size(acc) == F.size(gs), acc).otherwise(one_round(acc, i)))


def gate_levels(gates: DataFrame) -> DataFrame:
    g = gates.groupBy("task_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("gate_id").alias("id"), "op", "k", "children"))).alias("gs"))
    return (g.select("task_id", F.explode(_topological("gs")).alias("g"))
            .select("task_id", F.col("g.id").alias("gate_id"), F.col("g.level").alias("level")))


def compile_actions(predicates: DataFrame, gates: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per action: its leaves, how often each is reached, the gates under it as positions. A table of its own: a
    condition on a compiled column would otherwise bring the compiling along, once more for each time the column occurs."""
    doc = task_documents(predicates, gates, actions)
    one = doc.select("task_id", "preds", "topo", F.explode("acts").alias("a")).select("task_id", "preds", "topo", "a.*")
    reach = F.aggregate(F.reverse("topo"), F.array("requires"), lambda acc, g: F.when(
        F.array_contains(acc, g["id"]), F.array_union(acc, g["children"])).otherwise(acc))
    one = one.withColumn("_reach", reach)
    one = one.withColumn("leaves", F.filter(F.transform("preds", lambda p: p["predicate_id"]),
                                            lambda x: F.array_contains("_reach", x)))
    one = one.withColumn("_under", F.filter("topo", lambda g: F.array_contains("_reach", g["id"])))
    one = one.withColumn("_nodes", F.concat("leaves", F.transform("_under", lambda g: g["id"])))

    def pos(x):
        return F.array_position("_nodes", x).cast("int") - 1

    one = one.withColumn("prog", F.transform("_under", lambda g: F.struct(
        g["op"].alias("op"), g["k"].alias("k"), F.transform(g["children"], lambda c: pos(c)).alias("kids"))))
    one = one.withColumn("root", pos(F.col("requires")))
    seed = F.transform("_nodes", lambda n: (n == F.col("requires")).cast("bigint"))

    def pass_down(acc, g):
        mine = F.element_at(acc, F.array_position("_nodes", g["id"]).cast("int"))
        return F.transform(acc, lambda x, i: x + F.when(
            F.array_contains(g["children"], F.element_at("_nodes", i + 1)), mine).otherwise(F.lit(0).cast("bigint")))

    one = one.withColumn("_counts", F.aggregate(F.reverse("_under"), seed, pass_down))
    one = one.withColumn("n_paths", F.slice("_counts", F.lit(1), F.size("leaves")))
    one = one.withColumn("reps", F.filter(F.transform("n_paths", lambda n, i: F.when(n > 1, i).otherwise(F.lit(-1))),
                                          lambda i: i >= 0))
    order = F.transform("leaves", lambda x: F.filter("preds", lambda p: p["predicate_id"] == x)[0])
    return cut_lineage(one.withColumn("priors", F.transform(order, lambda p: p["prior"]))
                       .drop("preds", "topo", "_reach", "_under", "_nodes", "_counts"))


def leaves_of(compiled: DataFrame) -> DataFrame:
    """Predicates under each action with the number of paths that reach them."""
    return (compiled.select("task_id", "action_id", F.explode(F.arrays_zip("leaves", "n_paths")).alias("x"))
            .select("task_id", "action_id", F.col("x.leaves").alias("predicate_id"), F.col("x.n_paths").alias("n_paths")))


# ---------------------------------------------------------------- one gate


def at_least(ps: Column, k: Column) -> Column:
    """P(at least k of independent events), by building up the distribution of their number."""
    n = F.size(ps)
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), n))
    counts = F.aggregate(ps, start, lambda t, p: F.transform(
        t, lambda x, i: x * (1.0 - p) + F.coalesce(F.get(t, i - 1), F.lit(0.0)) * p))
    return F.aggregate(F.slice(counts, k + 1, n - k + 1), F.lit(0.0), lambda a, x: a + x)


def _product(ps: Column, f=lambda x: x) -> Column:
    return F.aggregate(ps, F.lit(1.0), lambda a, x: a * f(x))


def gate_status(op: Column, k: Column, dists: Column) -> Column:
    """(s, v, u) of a gate over independent children. At least k successes, or so many failures that k can no
    longer be reached; both cannot happen, so each is a one-dimensional count."""
    s, v = F.transform(dists, lambda d: d["s"]), F.transform(dists, lambda d: d["v"])
    n = F.size(dists)

    def out(ps, pv):
        return F.struct(ps.alias("s"), pv.alias("v"), F.greatest(F.lit(0.0), 1.0 - ps - pv).alias("u"))

    return (F.when(op == "AND", out(_product(s), 1.0 - _product(v, lambda x: 1.0 - x)))
            .when(op == "OR", out(1.0 - _product(s, lambda x: 1.0 - x), _product(v)))
            .when(op == "NOT", F.struct(dists[0]["v"].alias("s"), dists[0]["s"].alias("v"), dists[0]["u"].alias("u")))
            .otherwise(out(at_least(s, k), at_least(v, n - k + 1))))


def gate_truth(op: Column, k: Column, ps: Column) -> Column:
    return (F.when(op == "AND", _product(ps)).when(op == "OR", 1.0 - _product(ps, lambda x: 1.0 - x))
            .when(op == "NOT", 1.0 - ps[0]).otherwise(at_least(ps, k)))


def kleene(op: Column, k: Column, vals: Column) -> Column:
    """Three-valued result of a gate over child values 0 satisfied, 1 violated, 2 unresolved."""
    n = F.size(vals)
    need = F.when(op == "AND", n).when(op == "OR", F.lit(1)).otherwise(k)
    n_s, n_v = F.size(F.filter(vals, lambda x: x == 0)), F.size(F.filter(vals, lambda x: x == 1))
    return (F.when(op == "NOT", F.when(vals[0] == 2, F.lit(2)).otherwise(1 - vals[0]))
            .when(n_s >= need, F.lit(0)).when(n_v >= n - need + 1, F.lit(1)).otherwise(F.lit(2)))


# ---------------------------------------------------------------- whole requirements


def _fold(prog: Column, leaves: Column, gate) -> Column:
    """Values of all nodes: the leaves, then each gate from the values before it."""
    return F.aggregate(prog, leaves, lambda acc, g: F.concat(acc, F.array(
        gate(g["op"], g["k"], F.transform(g["kids"], lambda i: F.element_at(acc, i + 1))))))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it by name in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _worlds(cond: Column, base: int) -> Column:
    return F.sequence(F.lit(0), F.pow(F.lit(float(base)), F.size(cond).cast("double")).cast("int") - 1)


def _digit(world: Column, place: Column, base: int) -> Column:
    return F.floor(world / F.pow(F.lit(float(base)), place.cast("double"))).cast("int") % base


def evaluate(prog: Column, root: Column, reps: Column, status: Column, belief: Column,
             max_conditioned: int = MAX_CONDITIONED) -> Column:
    """Status distribution and belief of a requirement, as struct (s, v, u, belief, exact). A leaf reached on
    several paths is conditioned on: every value it may take is a world with its own weight, and
    worlds of weight zero are skipped. Beyond ``max_conditioned`` such leaves the result is not exact."""
    exact = F.size(reps) <= max_conditioned
    cond = F.when(exact, reps).otherwise(F.array().cast("array<int>"))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in "svu"])

    def hot(d):
        return F.struct(*[(d == i).cast("double").alias(n) for i, n in enumerate("svu")])

    def place_of(i):
        return F.array_position(cond, i).cast("int") - 1

    def pick(d, which):
        return F.when(which == 0, d["s"]).when(which == 1, d["v"]).otherwise(d["u"])

    def status_part(ls):
        def world(acc, w):
            weight = _product(F.transform(cond, lambda c, j: pick(F.element_at(ls, c + 1), _digit(w, j, 3))))
            fixed = F.transform(ls, lambda d, i: F.when(place_of(i) >= 0, hot(_digit(w, place_of(i), 3))).otherwise(d))

            def add(x):
                res = F.element_at(_fold(prog, fixed, gate_status), root + 1)
                return let(res, lambda y: F.struct(*[(acc[n] + x * y[n]).alias(n) for n in "svu"]))

            return let(weight, lambda x: F.when(x > 0, add(x)).otherwise(acc))

        return F.aggregate(_worlds(cond, 3), zero, world)

    def truth_part(lb):
        def world(acc, w):
            weight = _product(F.transform(cond, lambda c, j: F.when(_digit(w, j, 2) == 1, F.element_at(lb, c + 1))
                                          .otherwise(1.0 - F.element_at(lb, c + 1))))
            fixed = F.transform(lb, lambda b, i: F.when(place_of(i) >= 0, _digit(w, place_of(i), 2).cast("double"))
                                .otherwise(b))
            return let(weight, lambda x: F.when(
                x > 0, acc + x * F.element_at(_fold(prog, fixed, gate_truth), root + 1)).otherwise(acc))

        return F.aggregate(_worlds(cond, 2), F.lit(0.0), world)

    be = let(belief, truth_part)
    return let(let(status, status_part), lambda x: F.struct(
        x["s"].alias("s"), x["v"].alias("v"), x["u"].alias("u"), be.alias("belief"), exact.alias("exact")))


def leaf_tables(beliefs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Per task (and ``extra`` columns, such as a condition), a map from predicate to its leaf value; conflict counts
    as unresolved inside gates."""
    value = F.struct(F.col("s"), F.col("v"), (F.col("u") + F.col("c")).alias("u"), F.col("belief").alias("b"))
    return beliefs.groupBy("task_id", *(extra or [])).agg(
        F.map_from_entries(F.collect_list(F.struct("predicate_id", value))).alias("leaf"))


def with_leaves(compiled: DataFrame, beliefs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Compiled actions with aligned arrays ``ls`` (status) and ``lb`` (belief) of their leaves."""
    j = compiled.join(leaf_tables(beliefs, extra), "task_id")
    val = F.transform("leaves", lambda x: F.element_at("leaf", x))
    return (j.withColumn("ls", F.transform(val, lambda x: F.struct(x["s"].alias("s"), x["v"].alias("v"), x["u"].alias("u"))))
            .withColumn("lb", F.transform(val, lambda x: x["b"])))


def assess(compiled: DataFrame, beliefs: DataFrame, ready: float | Column = 0.5, block: float = 0.5,
           extra: list[str] | None = None) -> DataFrame:
    """Every action's status distribution, belief, chance of success, expected utility and disposition, exact at any number of
    leaves that are reached on several paths. Actions are dealt evenly: a row is a few bytes but much work."""
    keep = ["task_id", *(extra or []), "action_id", "reliability", "leak", "value_success", "cost_failure", "needs_approval"]
    rows = with_leaves(compiled, beliefs, extra)
    few = deal(rows.filter(F.size("reps") <= MAX_CONDITIONED).drop("leaf"), "task_id", "action_id").select(
        *keep, evaluate(F.col("prog"), F.col("root"), F.col("reps"), F.col("ls"), F.col("lb")).alias("ev"))
    many = diagrams.per_action(rows.filter(F.size("reps") > MAX_CONDITIONED), keep, diagrams.evaluated, "struct<s:double,v:double,u:double,belief:double>")
    ev = few.unionByName(many.select(*keep, F.struct("out.*", F.lit(True).alias("exact")).alias("ev")))
    p = S.p_success("ev.belief", "reliability", "leak")
    return ev.select("task_id", *(extra or []), "action_id", "ev.s", "ev.v", "ev.u", "ev.belief", "ev.exact", p.alias("p_success"),
                     S.expected_utility(p, "value_success", "cost_failure").alias("expected_utility"),
                     S.disposition("ev.s", "ev.v", ready, block).alias("disposition"), "needs_approval")


def node_values(documents: DataFrame, leaf_value: Column, gate, type_name: str, name: str) -> DataFrame:
    """Value of every gate of every task by one fold; ``leaf_value`` maps a predicate row to its value."""
    nodes = F.concat(F.transform("preds", lambda p: p["predicate_id"]), F.transform("topo", lambda g: g["id"]))
    d = documents.withColumn("_nodes", nodes).withColumn("_leaf", leaf_value)
    prog = F.transform("topo", lambda g: F.struct(g["op"].alias("op"), g["k"].alias("k"), F.transform(
        g["children"], lambda c: F.array_position("_nodes", c).cast("int") - 1).alias("kids")))
    d = d.withColumn("_prog", prog).withColumn("_vals", _fold(F.col("_prog"), F.col("_leaf"), gate))
    out = F.transform("topo", lambda g, i: F.struct(g["id"].alias("gate_id"),
                                                    F.element_at("_vals", i + 1 + F.size("_leaf")).alias(name)))
    return d.select("task_id", F.explode(out).alias("x")).select("task_id", "x.*")


def belief_interval(compiled: DataFrame, beliefs: DataFrame, free: DataFrame) -> DataFrame:
    """Range of each action's belief while the predicates in ``free`` (task_id, predicate_id) may take any value, exact at any
    number of them."""
    f = free.groupBy("task_id").agg(F.array_sort(F.collect_set("predicate_id")).alias("free"))
    d = with_leaves(compiled, beliefs).join(f, "task_id", "left")
    inside = F.filter(F.coalesce("free", F.array().cast("array<string>")), lambda x: F.array_contains("leaves", x))
    d = d.withColumn("fpos", F.transform(inside, lambda x: F.array_position("leaves", x).cast("int")))
    out = diagrams.per_action(d, ["task_id", "action_id"], diagrams.interval, "struct<low:double,high:double>")
    return out.select("task_id", "action_id", "out.low", "out.high", F.lit(True).alias("exact"))


# ---------------------------------------------------------------- definitions as data


def validate_tasks(predicates: DataFrame, gates: DataFrame, actions: DataFrame) -> DataFrame:
    """Everything wrong with task definitions, one row per problem (task_id, item, problem)."""
    def problem(df, item, cond, why):
        return df.filter(cond).select("task_id", F.col(item).alias("item"), F.lit(why).alias("problem"))

    nodes = (predicates.select("task_id", F.col("predicate_id").alias("node"))
             .unionByName(gates.select("task_id", F.col("gate_id").alias("node"))))
    repeated = nodes.groupBy("task_id", "node").count().filter("count > 1").select(
        "task_id", F.col("node").alias("item"), F.lit("duplicate id").alias("problem"))
    repeated_action = actions.groupBy("task_id", "action_id").count().filter("count > 1").select(
        "task_id", F.col("action_id").alias("item"), F.lit("duplicate id").alias("problem"))
    known = nodes.distinct()
    child = gates.select("task_id", "gate_id", F.explode("children").alias("node"))
    lost = child.join(known, ["task_id", "node"], "left_anti").select(
        "task_id", F.col("gate_id").alias("item"), F.lit("unknown child").alias("problem"))
    lost_action = actions.withColumnRenamed("requires", "node").join(known, ["task_id", "node"], "left_anti").select(
        "task_id", F.col("action_id").alias("item"), F.lit("unknown required node").alias("problem"))
    n = F.size("children")
    cyclic = gates.select("task_id", "gate_id").distinct().join(gate_levels(gates), ["task_id", "gate_id"], "left_anti").select(
        "task_id", F.col("gate_id").alias("item"), F.lit("part of or above a cycle").alias("problem"))

    def outside(c):
        return (F.col(c) < 0) | (F.col(c) > 1)

    crowded = predicates.groupBy("task_id").count().filter(F.col("count") > MAX_PREDICATES).select(
        "task_id", F.lit("*").alias("item"), F.lit("too many predicates").alias("problem"))
    parts = [
        crowded, repeated, repeated_action, lost, lost_action, cyclic,
        problem(gates, "gate_id", ~F.col("op").isin("AND", "OR", "NOT", "ATLEAST"), "unknown operator"),
        problem(gates, "gate_id", n == 0, "no children"),
        problem(gates, "gate_id", (F.col("op") == "NOT") & (n != 1), "NOT takes one child"),
        problem(gates, "gate_id", (F.col("op") == "ATLEAST") & ((F.col("k") < 1) | (F.col("k") > n)), "k out of range"),
        problem(gates, "gate_id", n != F.size(F.array_distinct("children")), "repeated child"),
        problem(predicates, "predicate_id", outside("prior"), "prior out of range"),
        problem(predicates, "predicate_id", F.col("ask_cost") < 0, "negative cost of asking"),
        problem(actions, "action_id", outside("reliability") | outside("leak"), "probability out of range"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_version(predicates: DataFrame, gates: DataFrame, actions: DataFrame) -> DataFrame:
    """A hash per task that changes with anything a decision could depend on."""
    def num(c):
        return F.coalesce(F.round(F.col(c) * 1e9).cast("bigint").cast("string"), F.lit(""))

    p = predicates.select("task_id", F.concat_ws("|", F.lit("p"), "predicate_id", "text", num("prior"), num("ask_cost"),
                                                 F.col("join").cast("string")).alias("line"))
    g = gates.select("task_id", F.concat_ws("|", F.lit("g"), "gate_id", "op", F.col("k").cast("string"),
                                            F.array_join("children", ",")).alias("line"))
    a = actions.select("task_id", F.concat_ws("|", F.lit("a"), "action_id", "description", "requires", num("value_success"),
                                              num("cost_failure"), num("reliability"), num("leak"),
                                              F.col("needs_approval").cast("string")).alias("line"))
    text = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    return p.unionByName(g).unionByName(a).groupBy("task_id").agg(S.text_hash("task_id", text).alias("version"))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a replaced definition does to each predicate, and whether its readings stay usable: a reading depends on
    the claim's text and on whether texts are read together, not on the prior."""
    a = old.select("task_id", "predicate_id", F.struct("text", "prior", "join").alias("o"))
    b = new.select("task_id", "predicate_id", F.struct("text", "prior", "join").alias("n"))
    j = a.join(b, ["task_id", "predicate_id"], "full_outer")
    change = (F.when(F.col("o").isNull(), F.lit("added")).when(F.col("n").isNull(), F.lit("removed"))
              .when(F.col("o").eqNullSafe(F.col("n")), F.lit("kept")).otherwise(F.lit("changed")))
    keeps = (F.col("o.text").eqNullSafe(F.col("n.text")) & F.col("o.join").eqNullSafe(F.col("n.join"))
             & F.col("o").isNotNull() & F.col("n").isNotNull())
    return j.select("task_id", "predicate_id", change.alias("change"), keeps.alias("readings_survive"))
