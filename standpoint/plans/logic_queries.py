"""Registered queries for requirement logic and task definitions."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators import logic as G
from standpoint.operators import templates as M
from standpoint.plans.flow import derived_flow, disposition_counts
from standpoint.plans.link_queries import r
from standpoint.plans.registry import cte, query
from standpoint.plans.sqltext import G0, G1, NODES, at_least_2, r6, th, values
from standpoint.session import shared_dir
from standpoint.sources import derive as D
from standpoint.sources import tasks as TS


@query("decisions", f"""
  select action_id, disposition, count(*) as n, {r6('avg(belief)')} as mean_belief from assessments group by 1, 2""")
def decisions(spark, sf):
    return disposition_counts(derived_flow(spark, sf)).select("action_id", "disposition", "n", r("mean_belief"))


BROKEN = [("x1", "XOR", ["p0", "p1"], 0), ("x2", "AND", [], 0), ("x3", "NOT", ["p0", "p1"], 0), ("x4", "ATLEAST", ["p0", "p1"], 3),
          ("x5", "OR", ["p0", "p0"], 0), ("x6", "AND", ["zz"], 0), ("x7", "AND", ["x8"], 0), ("x8", "OR", ["x7", "p1"], 0),
          ("x9", "OR", ["x8"], 0)]
WRONG = [("x1", "unknown operator"), ("x2", "no children"), ("x3", "NOT takes one child"), ("x4", "k out of range"),
         ("x5", "repeated child"), ("x6", "unknown child"), ("x7", "part of or above a cycle"),
         ("x8", "part of or above a cycle"), ("x9", "part of or above a cycle")]


@query("validate_tasks", f"""
  select task_id, item, problem from tasks, (values {values(WRONG)}) as w(item, problem)
  where substr(task_id, 2)::bigint % 3 = 0
  union all select task_id, 'p1', 'prior out of range' from tasks where substr(task_id, 2)::bigint % 4 = 0
  union all select task_id, 'a1', 'unknown required node' from tasks where substr(task_id, 2)::bigint % 5 = 0
  union all select task_id, 'a2', 'duplicate id' from tasks where substr(task_id, 2)::bigint % 7 = 0""")
def validate_tasks(spark, sf):
    user = F.substring("task_id", 2, 20).cast("bigint")
    p = D.predicates(spark, sf).withColumn("prior", F.when((user % 4 == 0) & (F.col("predicate_id") == "p1"), F.lit(1.5))
                                           .otherwise(F.col("prior")))
    rows = F.array(*[F.struct(F.lit(i).alias("gate_id"), F.lit(op).alias("op"),
                              (F.array(*[F.lit(c) for c in ch]) if ch else F.array().cast("array<string>")).alias("children"),
                              F.lit(k).alias("k")) for i, op, ch, k in BROKEN])
    bad = D.tasks(spark, sf).filter(user % 3 == 0).select("task_id", F.explode(rows).alias("g")).select("task_id", "g.*")
    a = D.actions(spark, sf).withColumn("requires", F.when((user % 5 == 0) & (F.col("action_id") == "a1"), F.lit("nowhere"))
                                        .otherwise(F.col("requires")))
    a = a.unionByName(a.filter((user % 7 == 0) & (F.col("action_id") == "a2")))
    return G.validate_tasks(p, D.gates(spark, sf).unionByName(bad), a)


@query("gate_levels", """
  with recursive lv(task_id, gate_id, level) as (
    select task_id, gate_id, 1 from (select task_id, gate_id, unnest(children) as c from gates) group by 1, 2
    union all
    select g.task_id, g.gate_id, lv.level + 1 from lv join (select task_id, gate_id, unnest(children) as c from gates) g
      on g.task_id = lv.task_id and g.c = lv.gate_id)
  select task_id, gate_id, max(level) as level from lv group by 1, 2""")
def gate_levels(spark, sf):
    return G.gate_levels(D.gates(spark, sf))


@query("leaves_of", """
  with recursive walk(task_id, action_id, node) as (
    select task_id, action_id, requires from actions
    union all
    select w.task_id, w.action_id, g.c from walk w join (select task_id, gate_id, unnest(children) as c from gates) g
      on g.task_id = w.task_id and g.gate_id = w.node)
  select task_id, action_id, node as predicate_id, count(*) as n_paths from walk where node like 'p%' group by 1, 2, 3""")
def leaves_of(spark, sf):
    return G.leaves_of(G.compile_actions(D.predicates(spark, sf), D.gates(spark, sf), D.actions(spark, sf)))


cte("stat_row", """
  select task_id, """ + ", ".join(
    f"max(case when predicate_id = 'p{i}' then case status when 'SATISFIED' then 0 when 'VIOLATED' then 1 else 2 end end) as k{i}"
    for i in range(5)) + " from beliefs group by 1")


def _kl(op: str, k: str, *kids: str) -> str:
    if op == "NOT":
        return f"(case when {kids[0]} = 2 then 2 else 1 - {kids[0]} end)"
    ns = " + ".join(f"({c} = 0)::int" for c in kids)
    nv = " + ".join(f"({c} = 1)::int" for c in kids)
    return f"(case when {ns} >= {k} then 0 when {nv} >= {len(kids)} - {k} + 1 then 1 else 2 end)"


KG0, KG1, KG2 = _kl("AND", "2", "k0", "k1"), _kl("OR", "1", "k2", "k3"), _kl("NOT", "0", "k4")
KL = {"g0": KG0, "g1": KG1, "g2": KG2, "g3": _kl("ATLEAST", "2", KG0, KG1, KG2), "g4": _kl("AND", "2", KG0, "k0"),
      "g5": _kl("OR", "1", KG1, "k3")}


@query("kleene_status", " union all ".join(f"select task_id, '{g}' as gate_id, {e} as status from stat_row" for g, e in KL.items()))
def kleene_status(spark, sf):
    f = derived_flow(spark, sf)
    docs = G.task_documents(f.predicates, f.gates, f.actions)
    code = F.when(F.col("status") == "SATISFIED", 0).when(F.col("status") == "VIOLATED", 1).otherwise(2)
    leaf = f.beliefs.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("predicate_id", code))).alias("leaf"))
    return G.node_values(docs.join(leaf, "task_id"), F.transform("preds", lambda p: F.element_at("leaf", p["predicate_id"])),
                         G.kleene, "int", "status")


cte("truth_row", "select task_id, " + ", ".join(
    f"max(case when predicate_id = 'p{i}' then belief >= 0.5 end) as h{i}" for i in range(5)) + " from beliefs group by 1")
TR = {"g0": "h0 and h1", "g1": "h2 or h3", "g2": "not h4",
      "g3": "(h0 and h1)::int + (h2 or h3)::int + (not h4)::int >= 2", "g4": "h0 and h1", "g5": "h2 or h3"}


@query("truth", " union all ".join(f"select task_id, '{g}' as gate_id, {e} as holds from truth_row" for g, e in TR.items()))
def truth(spark, sf):
    f = derived_flow(spark, sf)
    docs = G.task_documents(f.predicates, f.gates, f.actions)
    leaf = f.beliefs.groupBy("task_id").agg(F.map_from_entries(
        F.collect_list(F.struct("predicate_id", (F.col("belief") >= 0.5).cast("double")))).alias("leaf"))
    out = G.node_values(docs.join(leaf, "task_id"), F.transform("preds", lambda p: F.element_at("leaf", p["predicate_id"])),
                        G.gate_truth, "double", "holds")
    return out.select("task_id", "gate_id", (F.col("holds") > 0.5).alias("holds"))


G2, G4, G5 = ("v4", "s4"), (f"({G0[0]}*s0)", f"(1-(1-{G0[1]})*(1-v0))"), (f"(1-(1-{G1[0]})*(1-s3))", f"({G1[1]}*v3)")
SD = {"g0": G0, "g1": G1, "g2": G2, "g3": NODES["a0"][:2], "g4": G4, "g5": G5}


@query("gate_status_dist", " union all ".join(
    f"select task_id, '{g}' as gate_id, {r6(s)} as s, {r6(v)} as v, {r6(f'greatest(0, 1 - {s} - {v})')} as u from leafrow"
    for g, (s, v) in SD.items()))
def gate_status_dist(spark, sf):
    f = derived_flow(spark, sf)
    docs = G.task_documents(f.predicates, f.gates, f.actions).join(G.leaf_tables(f.beliefs), "task_id")
    leaf = F.transform("preds", lambda p: F.struct(*[F.element_at("leaf", p["predicate_id"])[n].alias(n) for n in "svu"]))
    out = G.node_values(docs, leaf, G.gate_status, "", "d")
    return out.select("task_id", "gate_id", *[r(F.col(f"d.{n}"), n) for n in "svu"])


BT = {"g0": "b0*b1", "g1": "1-(1-b2)*(1-b3)", "g2": "1-b4",
      "g3": at_least_2("(b0*b1)", "(1-(1-b2)*(1-b3))", "(1-b4)"), "g4": "b0*b1*b0", "g5": "1-(1-b2)*(1-b3)*(1-b3)"}


@query("gate_truth_dist", " union all ".join(f"select task_id, '{g}' as gate_id, {r6(e)} as p_true from leafrow" for g, e in BT.items()))
def gate_truth_dist(spark, sf):
    f = derived_flow(spark, sf)
    docs = G.task_documents(f.predicates, f.gates, f.actions).join(G.leaf_tables(f.beliefs), "task_id")
    out = G.node_values(docs, F.transform("preds", lambda p: F.element_at("leaf", p["predicate_id"])["b"]), G.gate_truth, "", "p")
    return out.select("task_id", "gate_id", r("p", "p_true"))


@query("evaluate", f"select task_id, action_id, {r6('s')} as s, {r6('v')} as v, {r6('u')} as u, {r6('belief')} as belief, "
                   "true as exact from assessments")
def evaluate(spark, sf):
    return derived_flow(spark, sf).assessments.select("task_id", "action_id", r("s"), r("v"), r("u"), r("belief"), "exact")


def interval_sql() -> str:
    parts = []
    for a, (_, _, b) in NODES.items():
        corners = []
        for x in (0, 1):
            for y in (0, 1):
                corners.append(b.replace("b1", str(float(x))).replace("b3", str(float(y))))
        parts.append(f"select task_id, '{a}' as action_id, {r6('least(' + ', '.join(corners) + ')')} as low, "
                     f"{r6('greatest(' + ', '.join(corners) + ')')} as high, true as exact from leafrow")
    return " union all ".join(parts)


@query("belief_interval", interval_sql())
def belief_interval(spark, sf):
    f = derived_flow(spark, sf)
    free = f.predicates.filter(F.col("predicate_id").isin("p1", "p3")).select("task_id", "predicate_id")
    return G.belief_interval(f.compiled, f.beliefs, free).select("task_id", "action_id", r("low"), r("high"), "exact")


@query("assess", f"""select task_id, action_id, {r6('p_success')} as p_success, {r6('expected_utility')} as expected_utility,
                     disposition, needs_approval from assessments""")
def assess(spark, sf):
    return derived_flow(spark, sf).assessments.select("task_id", "action_id", r("p_success"), r("expected_utility"),
                                                      "disposition", "needs_approval")


@query("disposition", """select task_id, action_id, case when s >= 0.8 and s >= v then 'READY' when v >= 0.3 then 'BLOCKED'
                         else 'NEEDS_INFO' end as disposition from assessments""")
def disposition(spark, sf):
    return derived_flow(spark, sf).assessments.select(
        "task_id", "action_id", S.disposition("s", "v", 0.8, 0.3).alias("disposition"))


@query("utility", f"""select action_id, {r6('sum(expected_utility)')} as total_utility, {r6('avg(p_success)')} as mean_p
                      from assessments group by 1""")
def utility(spark, sf):
    a = derived_flow(spark, sf).assessments.join(D.actions(spark, sf), ["task_id", "action_id"])
    p = S.p_success("belief", "reliability", "leak")
    return a.groupBy("action_id").agg(r(F.sum(S.expected_utility(p, "value_success", "cost_failure")), "total_utility"),
                                      r(F.avg(p), "mean_p"))


LINES = """
  select task_id, 'p|' || predicate_id || '|' || claim || '|' || (round(prior * 1e9)::bigint) || '|' || (round(ask_cost * 1e9)::bigint)
         || '|' || (joint::varchar) as line from predicates
  union all select task_id, 'g|' || gate_id || '|' || op || '|' || k || '|' || array_to_string(children, ',') from gates
  union all select task_id, 'a|' || action_id || '|' || description || '|' || requires || '|' || (round(value_success * 1e9)::bigint)
         || '|' || (round(cost_failure * 1e9)::bigint) || '|' || (round(reliability * 1e9)::bigint) || '|' ||
         (round(leak * 1e9)::bigint) || '|' || (needs_approval::varchar) from actions"""


@query("schema_version", f"""
  select task_id, {th('task_id', 't')} as version
  from (select task_id, string_agg(line, chr(10) order by line) as t from ({LINES}) group by 1)""")
def schema_version(spark, sf):
    return G.schema_version(D.predicates(spark, sf), D.gates(spark, sf), D.actions(spark, sf))


@query("schema_diff", """
  select task_id, predicate_id, case predicate_id when 'p1' then 'changed' when 'p2' then 'changed' when 'p3' then 'removed'
    else 'kept' end as change, predicate_id not in ('p2', 'p3') as readings_survive from predicates
  union all select task_id, 'p9', 'added', false from tasks""")
def schema_diff(spark, sf):
    old = D.predicates(spark, sf)
    pid = F.col("predicate_id")
    new = (old.withColumn("prior", F.when(pid == "p1", F.lit(0.9)).otherwise(F.col("prior")))
           .withColumn("text", F.when(pid == "p2", F.lit("click counted")).otherwise(F.col("text")))
           .withColumn("predicate_id", F.when(pid == "p3", F.lit("p9")).otherwise(pid)))
    return G.schema_diff(old, new)


cte("conv_people", """
  select 'c' || conv_id as task_id, list_sort(list_distinct(list(role || ' ' || (turn % 3)))) as people,
         count(*) % 3 as k from conversations group by conv_id""")


@query("tasks_from_templates", M.expected_sql())
def tasks_from_templates(spark, sf):
    c = D.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_set(F.concat("role", F.lit(" "), (F.col("turn") % 3).cast("string")))).alias("people"),
        (F.count("*") % 3).cast("int").alias("k"))
    params = c.select(F.concat(F.lit("c"), "conv_id").alias("task_id"),
                      F.element_at(F.array(*[F.lit(t) for t in M.TEMPLATE_IDS]), (F.col("conv_id") % 7 + 1).cast("int")).alias("template_id"),
                      F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Party "), F.col("conv_id").cast("string"))).otherwise(F.lit("")).alias("name"),
                      "people", "k")
    p, g, a = M.tasks_from_templates(params)
    return (p.select("task_id", F.lit("predicate").alias("kind"), F.col("predicate_id").alias("id"), F.col("text").alias("what"),
                     r("prior", "x"), r("ask_cost", "y"))
            .unionByName(g.select("task_id", F.lit("gate").alias("kind"), F.col("gate_id").alias("id"),
                                  F.concat_ws(" ", "op", F.array_join("children", ",")).alias("what"),
                                  F.col("k").cast("double").alias("x"), F.lit(0.0).alias("y")))
            .unionByName(a.select("task_id", F.lit("action").alias("kind"), F.col("action_id").alias("id"),
                                  F.concat_ws(" | ", "description", "requires").alias("what"), r("value_success", "x"),
                                  r("cost_failure", "y"))))


@query("read_tasks", """
  select task_id, kind, id, x, y from (
    select task_id, 'predicate' as kind, predicate_id as id, case when predicate_id = 'p1' then 0.5::double else prior end as x,
           case when predicate_id = 'p2' then 1.0::double else ask_cost end as y from predicates
    union all select task_id, 'gate', gate_id, k::double, len(children)::double from gates
    union all select task_id, 'action', action_id, case when action_id = 'a0' then 1.0::double else reliability end,
           case when action_id = 'a0' then 0.0::double else leak end from actions)""")
def read_tasks(spark, sf):
    p, g, a = D.predicates(spark, sf), D.gates(spark, sf), D.actions(spark, sf)
    pid, aid = F.col("predicate_id"), F.col("action_id")
    pj = p.groupBy("task_id").agg(F.collect_list(F.struct(
        pid.alias("id"), "text", F.when(pid != "p1", F.col("prior")).alias("prior"),
        F.when(pid != "p2", F.col("ask_cost")).alias("ask_cost"), "join")).alias("predicates"))
    gj = g.groupBy("task_id").agg(F.collect_list(F.struct(F.col("gate_id").alias("id"), "op", "children", "k")).alias("gates"))
    aj = a.groupBy("task_id").agg(F.collect_list(F.struct(
        aid.alias("id"), "description", "requires", "value_success", "cost_failure",
        F.when(aid != "a0", F.col("reliability")).alias("reliability"), F.when(aid != "a0", F.col("leak")).alias("leak"))).alias("actions"))
    docs = pj.join(gj, "task_id").join(aj, "task_id").select("task_id", F.to_json(F.struct("task_id", "predicates", "gates", "actions")).alias("doc"))
    files = max(1, ceil(p.select("task_id").distinct().count() / 100))
    path = f"{shared_dir(spark).rstrip('/')}/tasks-{uuid.uuid4().hex}"
    whole = docs.groupBy(F.pmod(F.xxhash64("task_id"), F.lit(files)).alias("file")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("doc"), ",\n"), F.lit("\n]")).alias("value"))
    whole.write.partitionBy("file").text(path)  # about a hundred tasks a file, each a list over many lines
    p2, g2, a2 = TS.read_tasks(spark, path)
    return (p2.select("task_id", F.lit("predicate").alias("kind"), F.col("predicate_id").alias("id"), F.col("prior").alias("x"), F.col("ask_cost").alias("y"))
            .unionByName(g2.select("task_id", F.lit("gate").alias("kind"), F.col("gate_id").alias("id"), F.col("k").cast("double").alias("x"),
                                   F.size("children").cast("double").alias("y")))
            .unionByName(a2.select("task_id", F.lit("action").alias("kind"), F.col("action_id").alias("id"), F.col("reliability").alias("x"),
                                   F.col("leak").alias("y"))))
