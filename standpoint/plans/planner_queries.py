"""Registered queries for questions and certificates.

The expected rows come from joins over explicit answer tables, worked out independently of the fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from standpoint.operators import planner as P
from standpoint.plans.flow import derived_flow
from standpoint.plans.link_queries import r
from standpoint.plans.registry import cte, query
from standpoint.plans.sqltext import assess_sql, r6, values
from standpoint.sources import derive as D


def task_rows(f):
    return P.task_rows(f.compiled, f.beliefs, f.predicates)


def prepared(spark, sf):
    """The flow with its beliefs written once: planning reads them several times."""
    from standpoint.session import cut_lineage

    f = derived_flow(spark, sf)
    f.__dict__["beliefs"] = cut_lineage(f.beliefs)
    return f


@query("open_predicates", f"select task_id, predicate_id, {r6('u + c')} as open from beliefs where u + c >= 0.2")
def open_predicates(spark, sf):
    return P.open_predicates(derived_flow(spark, sf).beliefs).select("task_id", "predicate_id", r("open"))


@query("askable", f"""
  select task_id, predicate_id, {r6('sure')} as sure from (select *, greatest(s, v) as sure from beliefs) where sure < 0.999""")
def askable(spark, sf):
    return P.askable(derived_flow(spark, sf).beliefs).select("task_id", "predicate_id", r("sure"))


@query("policy_utility", f"""
  select task_id, {r6("sum(case when disposition = 'READY' then expected_utility else 0 end)")} as utility,
         string_agg(action_id || '=' || disposition, ',' order by action_id) as dispositions from assessments group by 1""")
def policy_utility(spark, sf):
    return P.policy_utility(task_rows(prepared(spark, sf))).select(
        "task_id", r("utility"), F.array_join("dispositions", ",").alias("dispositions"))


# One row per task, question set and answers: leaf values with the answered predicates certain.
cte("cands", "select task_id, predicate_id from (select *, greatest(s, v) as sure from beliefs) where sure < 0.999")
cte("qsets", """
  select task_id, predicate_id as a, null as b, null as c from cands
  union all select x.task_id, x.predicate_id, y.predicate_id, null from cands x join cands y
    on x.task_id = y.task_id and x.predicate_id < y.predicate_id
  union all select x.task_id, x.predicate_id, y.predicate_id, z.predicate_id from cands x join cands y
    on x.task_id = y.task_id and x.predicate_id < y.predicate_id
    join cands z on z.task_id = x.task_id and y.predicate_id < z.predicate_id""")
cte("answers", """
  select task_id, concat_ws(',', a, b, c) as asked, qa, qb, qc, a, b, c from qsets, (values (1), (0)) va(qa), (values (1), (0)) vb(qb),
    (values (1), (0)) vc(qc) where (b is not null or qb = 1) and (c is not null or qc = 1)""")
cte("answered", """
  select l.task_id, asked, qa, qb, qc, predicate_id,
    case predicate_id when a then qa when b then qb when c then qc end as ans, s, v, u, c0, belief, ask_cost
  from answers join (select bl.task_id, bl.predicate_id, s, v, u, bl.c as c0, belief, ask_cost
                     from beliefs bl join predicates using (task_id, predicate_id)) l using (task_id)""")
cte("scen_row", "select task_id, asked, qa, qb, qc, " + ", ".join(
    f"max(case when predicate_id = 'p{i}' then {e} end) as {n}{i}" for i in range(5) for n, e in (
        ("s", "case when ans = 1 then 1.0 when ans = 0 then 0.0 else s end"),
        ("v", "case when ans = 1 then 0.0 when ans = 0 then 1.0 else v end"),
        ("u", "case when ans is not null then 0.0 else u + c0 end"),
        ("b", "case when ans is not null then ans else belief end"))) + """,
    product(case when ans = 1 then belief when ans = 0 then 1 - belief else 1 end) as weight,
    sum(case when ans is not null then ask_cost else 0 end) as ask_total,
    arg_min(case when ans is not null then predicate_id end,
            case when ans is not null then [ask_cost / greatest(1e-9, 1 - belief), substr(predicate_id, 2)::double] end) as ask_first
  from answered group by 1, 2, 3, 4, 5""")
cte("scen_assess", assess_sql("scen_row", "task_id, asked, qa, qb, qc, weight, ask_total, ask_first"))
cte("asking", """
  select x.task_id, asked, any_value(x.ask_total) as cost, any_value(ask_first) as ask_first,
    sum(weight * case when x.disposition = 'READY' then x.expected_utility else 0 end) - any_value(base) as gross,
    coalesce(array_to_string(list_sort(list(distinct x.action_id) filter (weight > 0 and x.disposition <> a.disposition)), ','), '')
      as could_change
  from scen_assess x join assessments a using (task_id, action_id)
  join (select task_id, sum(case when disposition = 'READY' then expected_utility else 0 end) as base from assessments group by 1)
    using (task_id) group by 1, 2""")


@query("value_of_asking", f"""
  select task_id, asked, {r6('gross - cost')} as value, {r6('gross')} as gross_gain, {r6('cost')} as cost, ask_first, could_change
  from asking""")
def value_of_asking(spark, sf):
    f = prepared(spark, sf)
    v = P.value_of_asking(task_rows(f), P.question_sets(P.askable(f.beliefs)))
    return v.select("task_id", F.array_join("asked", ",").alias("asked"), r("value"), r("gross_gain"), r("cost"), "ask_first",
                    F.array_join("could_change", ",").alias("could_change"))


@query("best_question", f"""
  select task_id, asked, {r6('gross - cost')} as value, ask_first, could_change from (
    select *, row_number() over (partition by task_id order by round(gross - cost, 10) desc, len(asked), asked) as rn
    from asking where gross - cost > 1e-12) where rn = 1""")
def best_question(spark, sf):
    f = prepared(spark, sf)
    return P.best_question(task_rows(f), P.askable(f.beliefs)).select(
        "task_id", F.array_join("asked", ",").alias("asked"), r("value"), "ask_first",
        F.array_join("could_change", ",").alias("could_change"))


# Settlements: every leaf of an action that is open takes each of three values.
LEAVES = [("a0", f"p{i}") for i in range(5)] + [("a1", "p0"), ("a1", "p1"), ("a2", "p2"), ("a2", "p3")]
cte("act_leaves", f"select * from (values {values(LEAVES)}) as v(action_id, predicate_id)")
cte("free_leaves", """
  select b.task_id, a.action_id, b.predicate_id from beliefs b join act_leaves a using (predicate_id) where b.u + b.c >= 0.2""")
OPEN3 = " ".join(f"cross join (values (0), (1), (2)) w{i}(x{i})" for i in range(5))
cte("free_row", "select task_id, action_id, " + ", ".join(f"bool_or(predicate_id = 'p{i}') as f{i}" for i in range(5))
    + ", string_agg(predicate_id, ',' order by predicate_id) as free, count(*) as n from free_leaves group by 1, 2")
PRIOR = {f"p{i}": p[2] for i, p in enumerate(D.PREDICATES)}
cte("settle_row", "select task_id, action_id as act, free, n, x0, x1, x2, x3, x4, " + ", ".join(
    f"case when f{i} then case x{i} when 0 then {a} when 1 then {b} else {c} end else l.{nm}{i} end as {nm}{i}"
    for i in range(5) for nm, a, b, c in (("s", "1.0", "0.0", "0.0"), ("v", "0.0", "1.0", "0.0"), ("u", "0.0", "0.0", "1.0"),
                                          ("b", "1.0", "0.0", str(PRIOR[f"p{i}"])))) + f"""
  from free_row join leafrow l using (task_id) {OPEN3}
  where """ + " and ".join(f"(f{i} or x{i} = 0)" for i in range(5)))
cte("settled", "select *, " + " + ".join(
    f"case when list_contains(string_split(free, ','), 'p{i}') then x{i} * 3 ** (n - list_position(string_split(free, ','), 'p{i}')) else 0 end"
    for i in range(5)) + " as idx from (" + assess_sql("settle_row", "task_id, act, free, n, x0, x1, x2, x3, x4")
    + ") where act = action_id")
cte("first_bad", """
  select s.task_id, s.action_id, min(idx)::int as idx, arg_min(s.disposition, idx) as becomes,
    arg_min(array_to_string(list_transform(string_split(free, ','), lambda p: p || '=' || ['satisfied', 'violated', 'open'][
      case p when 'p0' then x0 when 'p1' then x1 when 'p2' then x2 when 'p3' then x3 else x4 end + 1]), ','), idx) as counterexample
  from settled s join assessments a using (task_id, action_id) where s.disposition <> a.disposition group by 1, 2""")


@query("certify_stable", """
  select a.task_id, a.action_id, coalesce(f.free, '') as free, a.disposition as current, b.idx is null as stable,
    case when b.idx is not null then b.idx + 1 else (3 ** coalesce(f.n, 0))::int end as checked, counterexample, becomes
  from assessments a left join free_row f using (task_id, action_id) left join first_bad b using (task_id, action_id)""")
def certify_stable(spark, sf):
    f = prepared(spark, sf)
    return P.certify_stable(f.compiled, f.beliefs, P.open_predicates(f.beliefs))


@query("unnecessary_questions", " union all ".join(f"""
  select task_id, action_id, 'p{i}' as predicate_id from (
    select task_id, action_id, count(distinct disposition) as k from settled
    where list_contains(string_split(free, ','), 'p{i}')
    group by task_id, action_id, {', '.join(f'x{j}' for j in range(5) if j != i)}) group by 1, 2 having max(k) = 1""" for i in range(5)))
def unnecessary_questions(spark, sf):
    f = prepared(spark, sf)
    return P.unnecessary_questions(f.compiled, f.beliefs)
