"""Registered queries for corrections, memory, the readiness bar, gates and link calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators import beliefs as B
from standpoint.operators import feedback as K
from standpoint.operators import ledger as L
from standpoint.operators import metrics as M
from standpoint.operators import readings as R
from standpoint.plans.flow import derived_flow
from standpoint.plans.link_queries import r, vector_sides
from standpoint.plans.metric_queries import interval_sql, predictions
from standpoint.plans.registry import cte, query
from standpoint.plans.sqltext import PAIR, STATUS, precedence_sql, r6, softmax3
from standpoint.sources import derive as D


def hash32(*parts):
    return F.conv(F.substring(F.sha2(F.concat(*parts), 256), 1, 8), 16, 10).cast("bigint")


# Corrections: two verdicts on every pair whose key starts with 0-3; the later one is sometimes retracted.
cte("fix_pairs", "select pair, any_value(label) as label, any_value(l0) as l0, any_value(l1) as l1, any_value(l2) as l2 from logit group by 1")
cte("fixes", """
  select pair || '-1' as item_id, pair, (label + 1) % 3 as label from fix_pairs where substr(pair, 1, 1) in ('0', '1', '2', '3')
  union all select pair || '-2', pair, (label + 2) % 3 from fix_pairs where substr(pair, 1, 1) in ('0', '1', '2', '3')""")
cte("retracted", "select item_id from fixes where item_id like '%-2' and substr(pair, 2, 1) in ('0', '1', '2', '3', '4', '5', '6', '7')")
cte("verified", """
  select pair, max(item_id) as item_id, arg_max(label, item_id) as label from fixes
  where item_id not in (select item_id from retracted) group by 1""")


def corrections(pairs):
    p = R.distinct_pairs(pairs).withColumn("label", D.gold_label("text", "predicate_id")).filter(F.substring("pair", 1, 1) < "4")
    items = p.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat("pair", F.lit("-"), F.col("n").cast("string")).alias("item_id"), "pair", ((F.col("label") + F.col("n")) % 3).alias("label"))
    gone = items.filter(F.col("item_id").endswith("-2") & (F.substring("pair", 2, 1) < "8")).select("item_id")
    return items, gone


@query("correction_log", "select pair, item_id, label from verified")
def correction_log(spark, sf):
    return K.correction_log(*corrections(derived_flow(spark, sf).pairs)).select("pair", "item_id", "label")


cte("fixed_edges", """
  select e.* exclude (p_s, p_r, p_n), v.label is not null as corrected,
    case when v.label is null then p_s when v.label = 0 then 0.995 else (1.0 - 0.995) / 2 end as p_s,
    case when v.label is null then p_r when v.label = 1 then 0.995 else (1.0 - 0.995) / 2 end as p_r,
    case when v.label is null then p_n when v.label = 2 then 0.995 else (1.0 - 0.995) / 2 end as p_n
  from edges e left join verified v using (pair)""")


@query("apply_corrections", f"""
  select task_id, record_id, predicate_id, corrected, {r6('p_s')} as p_s, {r6('p_r')} as p_r, {r6('p_n')} as p_n from fixed_edges""")
def apply_corrections(spark, sf):
    f = derived_flow(spark, sf)
    return K.apply_corrections(f.edges, K.correction_log(*corrections(f.pairs))).select(
        "task_id", "record_id", "predicate_id", "corrected", r("p_s"), r("p_r"), r("p_n"))


@query("feedback_readings", "select v.pair, v.item_id, v.label, l0::double as l0, l1::double as l1, l2::double as l2 from verified v join fix_pairs using (pair)")
def feedback_readings(spark, sf):
    f = derived_flow(spark, sf)
    items, gone = corrections(f.pairs)
    audit = items.join(f.readings.select("pair", "logits"), "pair")
    return K.feedback_readings(K.correction_log(items, gone), audit).select(
        "pair", "item_id", "label", *[F.col("logits")[i].alias(f"l{i}") for i in range(3)])


@query("export_feedback", """
  select claim, text as evidence, max(v.label) as label from pairs_keyed join verified v using (pair)
  where record_id not like '%-4' and not joint group by 1, 2""")
def export_feedback(spark, sf):
    f = derived_flow(spark, sf)
    items, gone = corrections(f.pairs)
    verified = K.correction_log(items, gone)
    audit = (f.pairs.filter(~F.col("record_id").startswith("joint")).join(verified.select("pair", "item_id"), "pair")
             .select("item_id", "task_id", "record_id", "predicate_id"))
    live = f.records.filter(~F.col("record_id").endswith("-4"))
    rows, _ = K.export_feedback(verified, audit, live, f.predicates)
    return rows.select("claim", "evidence", "label")


cte("pairs_keyed", f"select *, {PAIR} as pair, record_id like 'joint%' as joint from pairs")

# Vectors: every fifth is a verified item, the rest are queries; a hash gives each its reading.
VH = "('0x' || substr(sha256('vec' || vec_id), 1, 8))::bigint"
cte("vecs", softmax3(f"""(select vec_id, embedding::double[] as e, label % 3 as label, ({VH} % 5)::double as l0, (({VH} // 8) % 5)::double as l1,
                         (({VH} // 64) % 5)::double as l2 from embeddings)""", "vec_id, e, label"))
cte("vec_pairs", """
  select q.vec_id as qid, m.vec_id as item_id, m.label,
    list_inner_product(q.e, m.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(m.e, m.e))) as sim
  from vecs q join vecs m on q.vec_id % 5 <> 0 and m.vec_id % 5 = 0""")
cte("self_pairs", """
  select q.vec_id as qid, m.vec_id as item_id, m.label,
    list_inner_product(q.e, m.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(m.e, m.e))) as sim
  from vecs q join vecs m on q.vec_id <> m.vec_id and q.vec_id % 5 = 0 and m.vec_id % 5 = 0""")


def near_sql(source: str) -> str:
    return f"select * from {source} qualify row_number() over (partition by qid order by sim desc, item_id) <= 8"


def votes_sql(near: str, tau: str, lam: str, keys: str = "qid") -> str:
    return f"""
    select {keys}, sum((w > 0)::int) as votes, sum(w) as wsum, sum(case when label = 0 then w else 0 end) as y0,
      sum(case when label = 1 then w else 0 end) as y1, sum(case when label = 2 then w else 0 end) as y2, max({lam}) * (1 - product(1 - w)) as lam
    from (select *, greatest(0, least(1, (sim - {tau}) / greatest(1e-9, 1 - {tau}))) as w from {near}) group by all"""


def blend(p: str, c: int) -> str:
    return f"case when coalesce(votes, 0) >= 1 and wsum > 0 then (1 - lam) * {p} + lam * y{c} / greatest(wsum, 1e-12) else {p} end"


cte("blended", f"""
  select qid, touched, b0 / (b0 + b1 + b2) as p_s, b1 / (b0 + b1 + b2) as p_r, b2 / (b0 + b1 + b2) as p_n from (
    select q.vec_id as qid, coalesce(votes, 0) >= 1 and coalesce(wsum, 0) > 0 as touched, {blend('p_s', 0)} as b0, {blend('p_r', 1)} as b1,
           {blend('p_n', 2)} as b2
    from vecs q left join ({votes_sql('(' + near_sql('vec_pairs') + ')', '0.2::double', '0.6::double')}) v on v.qid = q.vec_id
    where q.vec_id % 5 <> 0)""")


def vectors(spark, sf):
    h = hash32(F.lit("vec"), F.col("vec_id").cast("string"))
    e = D.table(spark, sf, "embeddings").select(
        "vec_id", S.unit_vector("embedding").alias("vec"), (F.col("label") % 3).cast("int").alias("label"),
        F.array((h % 5).cast("double"), (F.floor(h / 8) % 5).cast("double"), (F.floor(h / 64) % 5).cast("double")).alias("logits"))
    return e.withColumn("p", S.calibrate_probs("logits")).select("vec_id", "vec", "label", "p.*")


def sides(spark, sf):
    v = vectors(spark, sf)
    return (v.filter("vec_id % 5 <> 0").withColumnRenamed("vec_id", "qid"),
            v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("item_id"), "label", "vec"))


@query("top_neighbours", f"select qid, item_id, label, {r6('sim')} as sim from ({near_sql('vec_pairs')})")
def top_neighbours(spark, sf):
    return K.top_neighbours(*sides(spark, sf)).select("qid", "item_id", "label", r("sim"))


@query("knn_blend", f"select qid, touched, {r6('p_s')} as p_s, {r6('p_r')} as p_r, {r6('p_n')} as p_n from blended")
def knn_blend(spark, sf):
    q, m = sides(spark, sf)
    return K.knn_blend(q, m, tau=0.2, lam_max=0.6).select("qid", "touched", r("p_s"), r("p_r"), r("p_n"))


# Evolving beliefs: the vector of a pair is chosen among all by the pair's hash.
cte("pair_vecs", """
  select pair, any_value(p_s) as p_s, any_value(p_r) as p_r, any_value(p_n) as p_n,
         ('0x' || substr(sha256('v' || pair), 1, 8))::bigint % (select count(*) from embeddings) as vec_id from edges group by pair""")
cte("pair_near", """
  select q.pair as qid, m.vec_id as item_id, m.label,
    list_inner_product(v.e, m.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(m.e, m.e))) as sim
  from pair_vecs q join vecs v using (vec_id) join vecs m on m.vec_id % 5 = 0
  qualify row_number() over (partition by q.pair order by
    list_inner_product(v.e, m.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(m.e, m.e))) desc, m.vec_id) <= 8""")
cte("evolved", f"""
  select pair, b0 / (b0 + b1 + b2) as p_s, b1 / (b0 + b1 + b2) as p_r, b2 / (b0 + b1 + b2) as p_n from (
    select q.pair, {blend('p_s', 0)} as b0, {blend('p_r', 1)} as b1, {blend('p_n', 2)} as b2
    from pair_vecs q left join ({votes_sql('pair_near', '0.2::double', '0.6::double')}) v on v.qid = q.pair)""")
cte("evolved_edges", """
  select e.task_id, e.predicate_id, e.authority, e.valid_from,
    case when v.label is null then x.p_s when v.label = 0 then 0.995 else (1.0 - 0.995) / 2 end as p_s,
    case when v.label is null then x.p_r when v.label = 1 then 0.995 else (1.0 - 0.995) / 2 end as p_r,
    case when v.label is null then x.p_n when v.label = 2 then 0.995 else (1.0 - 0.995) / 2 end as p_n
  from edges e join evolved x using (pair) left join verified v using (pair)""")
cte("evolved_dist", precedence_sql("evolved_edges"))


def evolved(spark, sf):
    from standpoint.session import cut_lineage

    f = derived_flow(spark, sf)
    n = D.table(spark, sf, "embeddings").agg(F.count("*")).scalar()
    vid = (hash32(F.lit("v"), F.col("pair")) % n).alias("vec_id")
    vec = vectors(spark, sf).select("vec_id", "vec")
    edges = cut_lineage(f.edges.select("task_id", "record_id", "predicate_id", "pair", "authority", "valid_from", "p_s", "p_r", "p_n", vid))
    # a vector goes with each pair, not with each of its edges
    vectors_of = edges.select("pair", "vec_id").distinct().join(vec, "vec_id").groupBy("pair").agg(F.min("vec").alias("vec"))
    edges = edges.join(vec.select("vec_id"), "vec_id")
    _, memory = sides(spark, sf)
    return f, K.evolving_edges(edges, memory, K.correction_log(*corrections(f.pairs)), vectors_of, tau=0.2, lam_max=0.6)


@query("evolving_beliefs", f"select task_id, predicate_id, {', '.join(f'{r6(x)} as {x}' for x in 'svuc')} from evolved_dist")
def evolving_beliefs(spark, sf):
    _, edges = evolved(spark, sf)
    return B.precedence(edges).select("task_id", "predicate_id", *[r(x) for x in "svuc"])


cte("gold_code", """
  select p.task_id, p.predicate_id, case when n is null then 2 when n > 1 then 3 else lab end as label
  from predicates p left join (
    select task_id, predicate_id, count(distinct label) as n, min(label) as lab from (
      select *, rank() over (partition by task_id, predicate_id order by authority desc, valid_from desc) as rk
      from labelled where label < 2) where rk = 1 group by 1, 2) using (task_id, predicate_id)""")


@query("set_suite_scores", f"""
  select count(*) as n, {r6("avg((st = ['SATISFIED', 'VIOLATED', 'UNRESOLVED', 'CONFLICT'][label + 1])::int)")} as accuracy,
    {r6('avg(-ln(least(greatest([s, v, u, c][label + 1], 1e-12), 1)))')} as nll
  from (select label, s, v, u, c, {STATUS} as st from (
    select label, coalesce(s, 0) as s, coalesce(v, 0) as v, coalesce(u, 1) as u, coalesce(c, 0) as c
    from gold_code left join evolved_dist using (task_id, predicate_id)))""")
def set_suite_scores(spark, sf):
    f, edges = evolved(spark, sf)
    gold = B.gold_status(f.pairs.withColumn("label", D.gold_label("text", "predicate_id")), f.predicates)
    names = F.array(*[F.lit(s) for s in ("SATISFIED", "VIOLATED", "UNRESOLVED", "CONFLICT")])
    labels = gold.select("task_id", "predicate_id", (F.array_position(names, F.col("status")).cast("int") - 1).alias("label"))
    return K.set_suite_scores(B.precedence(edges), labels, ["task_id", "predicate_id"]).select("n", r("accuracy"), r("nll"))


cte("tune_fit", "select * from vecs where vec_id % 5 = 0")
cte("tune_grid", f"""
  select tau, lam, g, row_number() over (order by g) as o from (
    select t.tau, l.lam, (t.i * 10 + l.i) as g from (values (0, 0.1::double), (1, 0.2), (2, 0.3), (3, 0.4), (4, 0.5)) t(i, tau),
      (values (0, 0.2::double), (1, 0.4), (2, 0.6), (3, 0.8), (4, 0.95)) l(i, lam))""")
cte("tune_near", near_sql("self_pairs"))
cte("tuned", f"""
  select tau, lam, g, avg(-ln(least(greatest(py / ps, 1e-12), 1))) as loo, avg(-ln(greatest(p0, 1e-12))) as base,
    avg((coalesce(votes, 0) >= 1 and coalesce(wsum, 0) > 0)::int) as touched from (
    select tau, lam0 as lam, g, votes, wsum, [b0, b1, b2][label + 1] as py, b0 + b1 + b2 as ps, [p_s, p_r, p_n][label + 1] as p0 from (
      select x.tau, x.lam as lam0, x.g, f.label, p_s, p_r, p_n, votes, wsum, {blend('p_s', 0).replace('lam', 'v.lam')} as b0,
        {blend('p_r', 1).replace('lam', 'v.lam')} as b1, {blend('p_n', 2).replace('lam', 'v.lam')} as b2
      from tune_fit f cross join tune_grid x left join (
        {votes_sql('(select n.*, t.tau as tg, t.lam as lg, t.g from tune_near n cross join tune_grid t)', 'tg', 'lg', 'g, qid')}) v
        on v.qid = f.vec_id and v.g = x.g)) group by 1, 2, 3""")


@query("tune_memory", f"""
  select tau, lam as lam_max, {r6('loo')} as loo_nll, {r6('base')} as no_memory_nll, {r6('touched')} as touched,
    g = min(case when round(loo, 9) = best then g end) over () and loo < base - 1e-9 as adopt
  from (select *, min(round(loo, 9)) over () as best from tuned)""")
def tune_memory(spark, sf):
    fit = vectors(spark, sf).filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "qid")
    return K.tune_memory(fit, taus=(0.1, 0.2, 0.3, 0.4, 0.5)).select("tau", "lam_max", r("loo_nll"), r("no_memory_nll"), r("touched"), "adopt")


# The gate: model b against model a, suites by language; "cool" is model a at another temperature.
cte("cool", softmax3("lg_a", "*", 1.5).replace("p_s", "p0").replace("p_r", "p1").replace("p_n", "p2"))
for src in ("pr_a", "pr_b", "cool"):
    cte(f"gate_{src}", f"""select doc_id, lang, label, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end = label as ok,
      -ln(least(greatest(case label when 0 then p0 when 1 then p1 else p2 end, 1e-12), 1)) as nll from {src}""")
cte("gate_cands", "select 'b' as candidate, * from gate_pr_b union all select 'cool', * from gate_cool")
cte("gate_rows", """
  select y.candidate, y.lang as suite, count(*) as n, avg(y.ok::int) as accuracy, avg(y.nll) as nll, avg(x.ok::int) - avg(y.ok::int) as accuracy_drop,
    avg(y.nll) - avg(x.nll) as nll_rise, sum((x.ok and not y.ok)::int) as negative_flips
  from gate_pr_a x join gate_cands y using (doc_id) group by 1, 2""")
GATE_OK = "(accuracy_drop <= 0.005 and nll_rise <= 0.3)"


def gate_inputs(spark, sf):
    base = predictions(spark, sf, "a")
    cool = base.withColumn("p", S.calibrate_probs(F.array("l0", "l1", "l2"), 1.5)).select(
        "doc_id", "lang", "label", F.col("p.p_s").alias("p0"), F.col("p.p_r").alias("p1"), F.col("p.p_n").alias("p2"))
    keep = ["doc_id", "lang", "label", "p0", "p1", "p2"]
    cand = (predictions(spark, sf, "b").select(*keep).withColumn("candidate", F.lit("b"))
            .unionByName(cool.select(*keep).withColumn("candidate", F.lit("cool"))))
    ren = lambda d: d.withColumnRenamed("doc_id", "item").withColumnRenamed("lang", "suite")
    return ren(base.select(*keep)), ren(cand)


@query("regression_gate", f"""
  select candidate, suite, n, {r6('accuracy')} as accuracy, {r6('nll')} as nll, {r6('accuracy_drop')} as accuracy_drop, {r6('nll_rise')} as nll_rise,
    negative_flips, {r6('negative_flips / n')} as negative_flip_rate, {GATE_OK} as passes from gate_rows""")
def regression_gate(spark, sf):
    g = K.regression_gate(*gate_inputs(spark, sf), max_nll_rise=0.3)
    return g.select("candidate", "suite", "n", r("accuracy"), r("nll"), r("accuracy_drop"), r("nll_rise"), "negative_flips",
                    r("negative_flip_rate"), "passes")


HOLD = "('0x' || substr(sha256('holdout:' || doc_id), 1, 8))::bigint / 4294967295.0::double < 0.3"
cte("gain_parts", f"""
  select x.doc_id, candidate, x.nll - y.nll as num, 1.0::double as den from gate_pr_a x join gate_cands y using (doc_id)
  where ('0x' || substr(sha256('holdout:' || x.doc_id), 1, 8))::bigint / 4294967295.0::double < 0.3""")
cte("gain_rows", interval_sql("gain_parts", "doc_id", "candidate", n_boot=1000))


def held(df):
    return df.filter(S.in_holdout(F.col("item").cast("string"), 0.3))


@query("in_holdout", f"select doc_id, {HOLD} as held from documents")
def in_holdout(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", S.in_holdout(F.col("doc_id").cast("string"), 0.3).alias("held"))


@query("paired_gain", "select candidate, value as gain, n, lo, hi from gain_rows")
def paired_gain(spark, sf):
    a, b = gate_inputs(spark, sf)
    return K.paired_gain(held(a), held(b)).select("candidate", r("gain"), "n", r("lo"), r("hi"))


@query("choose_candidate", f"""
  with s as (select count(*) as nf, sum(({HOLD})::int) as nh from documents),
  c as (select candidate, bool_and{GATE_OK} as ok, string_agg(case when not {GATE_OK} then suite end, ', ' order by suite) as bad from gate_rows group by 1),
  h as (select candidate, avg(nll) as nll from gate_cands where {HOLD} group by 1),
  j as (select candidate, ok, bad, lo, nll from c join gain_rows using (candidate) join h using (candidate)),
  z as (select arg_min(candidate, nll) filter (ok and lo > 0) as best, bool_or(ok and lo > 0) as yes,
    string_agg(case when not ok then candidate || ': fails regression on ' || bad when not lo > 0 then candidate ||
      ': no reliable held-out gain (lower bound ' || printf('%.4f', lo) || ')' end, '; ' order by candidate) as why from j)
  select nf >= 200 and nh >= 30 and nf - nh >= 30 and yes as adopted,
    case when nf >= 200 and nh >= 30 and nf - nh >= 30 and yes then best else 'champion' end as chosen,
    case when nf < 200 then 'only ' || nf || ' verified readings; 200 are required' when nh < 30 or nf - nh < 30 then 'too few readings on one side of the split'
      when yes then 'passed the regression gate and improved held-out NLL' else why end as reason from z, s""")
def choose_candidate(spark, sf):
    a, b = gate_inputs(spark, sf)
    gate = K.regression_gate(a, b, max_nll_rise=0.3)
    hold = held(b).groupBy("candidate").agg(F.avg(M.nll_of(M.p_of_label())).alias("nll"))
    n = a.agg(F.count("*")).scalar()
    nh = held(a).agg(F.count("*")).scalar()
    return K.choose_candidate(gate, K.paired_gain(held(a), held(b)), hold, n, n - nh, nh)


# ---- link calibration

ALPHA = 0.4
TS = [-0.2 + 0.02 * i for i in range(40)]
TS_SQL = f"(select unnest({TS}::double[]) as threshold)"
cte("miss_rows", f"""
  select record_id, threshold, avg(case when record_id % 3 = predicate_id % 3 then (sim < threshold)::int end) as miss,
    avg((sim >= threshold)::int) as kept from vec_sims, {TS_SQL} group by 1, 2
  having avg(case when record_id % 3 = predicate_id % 3 then (sim < threshold)::int end) is not null""")
CRC = f"""
  select max(case when cor <= {ALPHA} then threshold end) as t, arg_min(cor, threshold) as first, arg_max(cor, threshold) filter (cor <= {ALPHA}) as cr,
    arg_max(m, threshold) filter (cor <= {ALPHA}) as er, max(n) as n
  from (select threshold, avg(miss) as m, count(*) as n, count(*) / (count(*) + 1.0::double) * avg(miss) + 1 / (count(*) + 1.0::double) as cor
        from miss_rows group by 1)"""


def sims(spark, sf):
    from standpoint.operators import links as LK

    records, targets = vector_sides(spark, sf)
    return LK.count_links(records, targets, TS, lambda r, p: np.fmod(r, 3)[:, None] == np.fmod(p, 3)[None, :], ("record_id",))


@query("crc_threshold", f"""
  select {r6('t')} as threshold, t is not null as feasible, {r6('coalesce(cr, first)')} as corrected_risk, {r6('er')} as empirical_risk, n from ({CRC})""")
def crc_threshold(spark, sf):
    m = K.miss_by_threshold(sims(spark, sf), TS, ("record_id",))
    return K.crc_threshold(m, ALPHA).select(r("threshold"), "feasible", r("corrected_risk"), r("empirical_risk"), "n")


@query("calibrate_links", f"""
  select {r6('t')} as threshold, t is not null as feasible, {r6('coalesce(cr, first)')} as corrected_risk, n,
    (select {r6('avg(kept)')} from miss_rows where threshold = t) as fraction_of_pairs_kept from ({CRC})""")
def calibrate_links(spark, sf):
    return K.calibrate_links(sims(spark, sf), ALPHA, TS, ("record_id",)).select(
        r("threshold"), "feasible", r("corrected_risk"), "n", r("fraction_of_pairs_kept"))


# ---- the bar, confirmations, usage, audit

cte("verdict_log", """
  select 'w' || (user_id % 10) as workspace, event_id as seq, case when event_type in ('view', 'click') then 'endorsement' else 'verdict' end as kind,
    event_type not in ('view', 'click') and k % 4 = 0 as wrong from ev_raw where event_type <> 'error'""")
cte("verdict_walk", """
  select *, sum(case when kind = 'endorsement' then 1 else -1 end) over w as s from verdict_log window w as (partition by workspace order by seq)""")
cte("verdict_low", """
  select *, least(0, min(s) over (partition by workspace order by seq)) as low,
    least(0, coalesce(min(s) over (partition by workspace order by seq rows between unbounded preceding and 1 preceding), 0)) as low0 from verdict_walk""")
cte("verdict_trace", """
  select workspace, seq, kind, wrong, low = low0 as accepted, s - low as outstanding,
    sum((kind = 'verdict' and low = low0)::int) over w as verdicts, sum((kind = 'verdict' and low = low0 and wrong)::int) over w as errors,
    greatest(1, max(s - low) over w) as max_outstanding from verdict_low window w as (partition by workspace order by seq)""")


def verdict_log(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    shown = F.col("event_type").isin("view", "click")
    return D.table(spark, sf, "events").filter("event_type <> 'error'").select(
        F.concat(F.lit("w"), F.col("user_id") % 10).alias("workspace"), F.col("event_id").alias("seq"),
        F.when(shown, F.lit("endorsement")).otherwise(F.lit("verdict")).alias("kind"), (~shown & (k % 4 == 0)).alias("wrong"))


@query("threshold_trace", f"""
  select workspace, seq, kind, accepted, outstanding, verdicts, errors, max_outstanding, {r6('tau')} as tau,
    {r6('case when verdicts > 0 then errors / verdicts else 0 end')} as error_rate,
    round(case when verdicts = 0 then 1 else least(1, 0.05::double + (1 + max_outstanding * 0.0475::double - 0.9::double) / (0.05::double * verdicts)) end + 1.2345e-9, 6) + 0.0 as bound,
    tau > 1 as stalled from (select *, 0.9::double + 0.05 * (errors - 0.05 * verdicts) as tau from verdict_trace)""")
def threshold_trace(spark, sf):
    t = K.threshold_trace(verdict_log(spark, sf))
    return t.select("workspace", "seq", "kind", "accepted", "outstanding", "verdicts", "errors", "max_outstanding", r("tau"), r("error_rate"),
                    r("bound"), "stalled")


def answers(spark, sf):
    """Each conversation turn answers a request about a predicate of some task; one in five predicates has since changed."""
    p = D.predicates(spark, sf).select("task_id", "predicate_id", F.col("text").alias("claim"))
    c = D.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.concat(F.lit("t"), F.col("conv_id") % 100).alias("task_id"), F.concat(F.lit("p"), F.col("turn") % 5).alias("predicate_id"))
    j = c.join(p, ["task_id", "predicate_id"])
    return j.select(
        F.concat(F.lit("tok"), F.col("conv_id").cast("string"), F.lit("x"), F.floor(F.col("turn") / 2).cast("string"), F.lit("y")).alias("token"), "task_id", "predicate_id",
        F.when(F.col("conv_id") % 5 == 0, F.concat("claim", F.lit(" then"))).otherwise(F.col("claim")).alias("predicate_text"),
        F.col("role").alias("to_name"), (F.col("turn") % 4).cast("int").alias("authority"), F.lit(100.0).alias("expires"),
        F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("unsure")), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int")).alias("answer"),
        F.lit("").alias("note"), (F.col("turn") * 20).cast("double").alias("answered"))


cte("answer_rows", """
  select 'tok' || conv_id || 'x' || (turn // 2) || 'y' as token, p.task_id, p.predicate_id, p.claim,
    case when conv_id % 5 = 0 then p.claim || ' then' else p.claim end as asked_text, role, turn % 4 as authority,
    ['yes', 'no', 'unsure'][(conv_id + turn) % 3 + 1] as answer, turn * 20.0::double as answered
  from conversations c join predicates p on p.task_id = 't' || (conv_id % 100) and p.predicate_id = 'p' || (turn % 5)
  qualify row_number() over (partition by token order by answered) = 1""")


@query("confirmations_to_events", """
  select task_id, 'confirmation-' || sha256(token) as record_id, predicate_id, role || case answer when 'yes' then ' confirmed that this holds: '
    else ' said that this does not hold: ' end || claim as text, authority, answered as valid_from, (answer = 'no')::int as label
  from answer_rows where answer <> 'unsure' and answered <= 100 and asked_text = claim""")
def confirmations_to_events(spark, sf):
    ev, fix = K.confirmations_to_events(answers(spark, sf), D.predicates(spark, sf))
    a = ev.withColumn("predicate_id", F.element_at("about", 1))
    key = ["task_id", "record_id", "predicate_id", "pair"]
    claims = D.predicates(spark, sf).select("task_id", "predicate_id", F.col("text").alias("claim"))
    a = a.join(claims, ["task_id", "predicate_id"]).withColumn("pair", S.pair_key("claim", "text"))
    return a.join(fix.select(*key, "label").distinct(), key).select("task_id", "record_id", "predicate_id", "text", "authority", "valid_from", "label")


@query("open_confirmations", """
  select workspace, sum((ans is null and expires > 60)::int) as open, sum((ans is null and expires > 60)::int) > 20 as over_quota
  from (select 'w' || (conv_id % 10) as workspace, case when turn % 3 = 0 then 'yes' end as ans, turn * 30.0 as expires from conversations) group by 1""")
def open_confirmations(spark, sf):
    c = D.table(spark, sf, "conversations").select(
        F.concat(F.lit("w"), F.col("conv_id") % 10).alias("workspace"), F.when(F.col("turn") % 3 == 0, F.lit("yes")).alias("answer"),
        (F.col("turn") * 30.0).alias("expires"))
    return K.open_confirmations(c, 60.0, 20)


@query("usage_by_day", """
  select workspace, seq, events_used, chars_used, events_used > 10 or chars_used > 6000 as refused from (
    select 'w' || (user_id % 20) as workspace, event_id as seq, count(*) over w as events_used, sum(length(event_type) * 100) over w as chars_used
    from events window w as (partition by user_id % 20, cast(ts as date) order by event_id))""")
def usage_by_day(spark, sf):
    e = D.table(spark, sf, "events").select(
        F.concat(F.lit("w"), F.col("user_id") % 20).alias("workspace"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"),
        (F.length("event_type") * 100).alias("chars"))
    return K.usage_by_day(e, 10, 6000).select("workspace", "seq", "events_used", "chars_used", "refused")


cte("timed", """select *, least(3, floor((vec_id - min(vec_id) over ()) / ((max(vec_id) over () - min(vec_id) over () + 1) / 4.0)))::int as block from vecs""")
cte("timed_near", near_sql("""(
  select q.vec_id as qid, m.vec_id as item_id, m.label,
    list_inner_product(q.e, m.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(m.e, m.e))) as sim
  from timed q join timed m on m.block < q.block)"""))
TOP = "case when {0} >= {1} and {0} >= {2} then 0 when {1} >= {2} then 1 else 2 end"


@query("prequential_eval", f"""
  select block, count(*) as n, {r6("avg((frozen = label)::int)")} as frozen, {r6("avg((helped = label)::int)")} as with_memory, {r6("avg(touched::int)")} as touched from (
    select block, label, touched, {TOP.format('p_s', 'p_r', 'p_n')} as frozen, {TOP.format('b0', 'b1', 'b2')} as helped from (
      select q.block, q.label, p_s, p_r, p_n, coalesce(votes, 0) >= 1 and coalesce(wsum, 0) > 0 as touched,
        {blend('p_s', 0)} as b0, {blend('p_r', 1)} as b1, {blend('p_n', 2)} as b2
      from timed q left join ({votes_sql('timed_near', '0.2::double', '0.6::double')}) v on v.qid = q.vec_id)) group by 1""")
def prequential_eval(spark, sf):
    v = vectors(spark, sf).withColumnRenamed("vec_id", "qid").withColumn("seq", F.col("qid"))
    return K.prequential_eval(v, 4, tau=0.2, lam_max=0.6).select("block", "n", r("frozen"), r("with_memory"), r("touched"))


_ = L

from standpoint.plans.sqltext import assess_sql, beliefs_sql, leafrow_sql  # noqa: E402

cte("fixed_beliefs", beliefs_sql(precedence_sql("fixed_edges")))
cte("fixed_row", leafrow_sql("fixed_beliefs"))
cte("fixed_acts", assess_sql("fixed_row"))
