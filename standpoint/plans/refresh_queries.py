"""Registered queries for incremental refresh, views and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from standpoint.operators import beliefs as B
from standpoint.operators import logic as G
from standpoint.plans import refresh as X
from standpoint.plans.flow import derived_flow
from standpoint.plans.link_queries import r
from standpoint.plans.registry import cte, query
from standpoint.plans.state_store import StateStore
from standpoint.plans.sqltext import assess_sql, beliefs_sql, leafrow_sql, precedence_sql, r6, softmax3
from standpoint.plans.sqltext import status_at
from standpoint.session import shared_dir
from standpoint.sources import derive as D

ASSESS = f"task_id, action_id, {r6('s')} as s, {r6('belief')} as belief, disposition"


def refreshed(spark, sf):
    """The first four fifths of the log as a stored run, then the rest applied to it."""
    f = derived_flow(spark, sf)
    n = D.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    old = F.col("seq") < int(n * 0.8)
    store = StateStore(spark, f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}", buckets=8, compact=1.0)
    store.create(derived_flow(spark, sf, events=f.events.filter(old)))
    store.advance(f.events.filter(~old), f)
    return f, store


@query("refresh", f"select {ASSESS} from assessments")
def refresh(spark, sf):
    _, store = refreshed(spark, sf)
    return store.table("assessments").select("task_id", "action_id", r("s"), r("belief"), "disposition")


@query("verify", "select count(*) as rows, 0 as unequal, 0.0::double as max_difference from predicates")
def verify(spark, sf):
    f, store = refreshed(spark, sf)
    return X.verify(store.table("beliefs"), f.beliefs, X.PRED, ["s", "v", "u", "c", "belief", "status"]).select("rows", "unequal", "max_difference")


cte("hard_beliefs", beliefs_sql(precedence_sql("hard_edges")))
cte("hard_row", leafrow_sql("hard_beliefs"))
cte("hard_acts", assess_sql("hard_row"))


@query("early_cutoff", f"""
  select task_id, predicate_id, {r6("round(b.s, 9)")} as s, {r6("round(b.v, 9)")} as v from beliefs b join hard_beliefs h using (task_id, predicate_id)
  where not (round(b.s, 9) = round(h.s, 9) and round(b.v, 9) = round(h.v, 9))""")
def early_cutoff(spark, sf):
    f = derived_flow(spark, sf)
    nine = lambda d: d.select("task_id", "predicate_id", F.round("s", 9).alias("s"), F.round("v", 9).alias("v"))
    hard = B.beliefs(f.edges, f.predicates, hard=True)
    return X.early_cutoff(nine(hard), nine(f.beliefs), X.PRED, ["s", "v"]).select("task_id", "predicate_id", r("s"), r("v"))


@query("change_report", """
  select 'predicate' as kind, task_id, predicate_id as id, h.status as was, b.status as now from beliefs b join hard_beliefs h using (task_id, predicate_id)
  where h.status <> b.status
  union all select 'action', task_id, action_id, h.disposition, a.disposition from assessments a join hard_acts h using (task_id, action_id)
  where h.disposition <> a.disposition""")
def change_report(spark, sf):
    f = derived_flow(spark, sf)
    hard = B.beliefs(f.edges, f.predicates, hard=True)
    p = X.change_report(hard, f.beliefs, X.PRED, "status", "UNRESOLVED")
    a = X.change_report(G.assess(f.compiled, hard), f.assessments, ["task_id", "action_id"], "disposition", "NEEDS_INFO")
    return (p.select(F.lit("predicate").alias("kind"), "task_id", F.col("predicate_id").alias("id"), "was", "now")
            .unionByName(a.select(F.lit("action").alias("kind"), "task_id", F.col("action_id").alias("id"), "was", "now")))


@query("set_config", """select task_id, action_id, case when s >= 0.8 and s >= v then 'READY' when v >= 0.3 then 'BLOCKED' else 'NEEDS_INFO' end
                        as disposition from assessments""")
def set_config(spark, sf):
    f = derived_flow(spark, sf)
    return X.set_bars(X.full_run(f), f, 0.8, 0.3).select("task_id", "action_id", "disposition")


cte("warm_edges", softmax3("logit", "task_id, predicate_id, authority, valid_from", 2.0))
cte("warm_beliefs", beliefs_sql(precedence_sql("warm_edges")))
cte("warm_row", leafrow_sql("warm_beliefs"))
cte("warm_acts", assess_sql("warm_row"))


@query("set_calibration", f"select {ASSESS} from warm_acts")
def set_calibration(spark, sf):
    f = derived_flow(spark, sf)
    _, a = X.recalibrate(X.full_run(f), f, 2.0)
    return a.select("task_id", "action_id", r("s"), r("belief"), "disposition")


@query("task_state", f"""
  select task_id, (select string_agg(action_id || '=' || disposition, ',' order by action_id) from assessments a where a.task_id = t.task_id) as actions,
    (select string_agg(predicate_id || '=' || status, ',' order by predicate_id) from beliefs b where b.task_id = t.task_id) as predicates,
    active, withdrawn, conflicted, expired, not_yet_valid, next_transition
  from tasks t left join (select task_id, {', '.join(f"sum((st = '{n}')::int) as {n}" for n in ('active', 'withdrawn', 'conflicted', 'expired', 'not_yet_valid'))}
    from (select task_id, {status_at(D.NOW)} as st from summary) group by 1) using (task_id)
  left join (select task_id, min(x) as next_transition from (select task_id, unnest([valid_from, valid_until]) as x from state where stored_status = 'active')
    where x > {D.NOW} group by 1) using (task_id)""")
def task_state(spark, sf):
    return X.task_state(derived_flow(spark, sf))


@query("explain", f"""
  select l.task_id, l.action_id, l.predicate_id, b.status, {r6('b.belief')} as belief, n as records_compared, d.record_id, u.revision, u.source_id, u.text,
    d.label, d.read_jointly
  from (select task_id, action_id, predicate_id from tasks, act_leaves) l join beliefs b using (task_id, predicate_id)
  left join (select task_id, predicate_id, count(*) as n from links group by 1, 2) using (task_id, predicate_id)
  left join (select task_id, predicate_id, case when l0 > 0 then 0 when l1 > 0 then 1 else 2 end as label, members like '%,%' as read_jointly,
                    unnest(string_split(members, ',')) as record_id from edges where 1 - p_n >= 0.5) d
    on d.task_id = l.task_id and d.predicate_id = l.predicate_id
  left join usable u on u.task_id = d.task_id and u.record_id = d.record_id""")
def explain(spark, sf):
    from standpoint.functions.scalars import argmax_first

    e = X.explain(derived_flow(spark, sf))
    return e.select("task_id", "action_id", "predicate_id", "status", r("belief"), "records_compared", "record_id", "revision", "source_id", "text",
                    argmax_first("logits").alias("label"), "read_jointly")



