"""Registered queries for links, readings and beliefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators import beliefs as B
from standpoint.operators import ledger as L
from standpoint.operators import links as K
from standpoint.operators import readings as R
from standpoint.plans.flow import derived_flow, gold_scorer
from standpoint.plans.registry import cte, query
from standpoint.plans.sqltext import BIAS, NUDGE, PAIR, STATUS, T, beliefs_sql, precedence_sql, r6, softmax3, th
from standpoint.sources import derive as D

SIM = 0.15


def r(c, name=None):
    name = name or (c if isinstance(c, str) else None)
    return (F.round(S.col(c) + NUDGE, 6) + 0.0).alias(name)


@query("pair_key", f"select task_id, record_id, predicate_id, {PAIR} as pair from pairs")
def pair_key(spark, sf):
    return derived_flow(spark, sf).pairs.select("task_id", "record_id", "predicate_id", "pair")


@query("link_all", "select u.task_id, u.record_id, p.predicate_id, p.claim, u.text from usable u join predicates p using (task_id)")
def link_all(spark, sf):
    f = derived_flow(spark, sf)
    return K.link_all(f.records, f.predicates).select("task_id", "record_id", "predicate_id", "claim", "text")


@query("link_declared", "select task_id, record_id, predicate_id, joint, authority, valid_from from links")
def link_declared(spark, sf):
    return derived_flow(spark, sf).links.select("task_id", "record_id", "predicate_id", "joint", "authority", "valid_from")


cte("vec_sims", """
  select 't' || q.label as task_id, q.vec_id as record_id, m.vec_id as predicate_id,
         list_inner_product(q.e, m.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(m.e, m.e))) as sim
  from (select vec_id, label, embedding::double[] as e from embeddings where vec_id % 5 <> 0) q
  join (select vec_id, label, embedding::double[] as e from embeddings where vec_id % 5 = 0) m using (label)""")


def vector_sides(spark, sf):
    """Vectors: every fifth is a predicate of the task named by its label, the others are records."""
    e = D.table(spark, sf, "embeddings").select(
        F.concat(F.lit("t"), "label").alias("task_id"), "vec_id", "label", S.unit_vector("embedding").alias("vec"))
    return (e.filter("vec_id % 5 <> 0").select("task_id", F.col("vec_id").alias("record_id"), "label", "vec"),
            e.filter("vec_id % 5 = 0").select("task_id", F.col("vec_id").alias("predicate_id"), "label", "vec"))


@query("propose_links", f"""
  select task_id, record_id, predicate_id, {r6('sim')} as sim from (
    select *, sum((sim >= {SIM})::int) over (partition by task_id, record_id) as reached,
           row_number() over (partition by task_id, record_id order by sim desc, predicate_id) as place from vec_sims)
  where case when reached >= 1 then sim >= {SIM} else place <= 1 end""")
def propose_links(spark, sf):
    records, targets = vector_sides(spark, sf)
    return K.propose_links(records, targets, SIM).select("task_id", "record_id", "predicate_id", r("sim"))


@query("link_diff", """
  select task_id, record_id, predicate_id, 'removed' as change
  from (select u.task_id, u.record_id, p.predicate_id from usable u join predicates p using (task_id)
        except select task_id, record_id, predicate_id from links)""")
def link_diff(spark, sf):
    f = derived_flow(spark, sf)
    return K.link_diff(K.link_all(f.records, f.predicates), f.links)


@query("joint_pairs", "select task_id, predicate_id, record_id, text, authority, valid_from, members from joint_pairs")
def joint_pairs(spark, sf):
    return K.joint_pairs(derived_flow(spark, sf).links).select(
        "task_id", "predicate_id", "record_id", "text", "authority", "valid_from", F.array_join("members", ",").alias("members"))


@query("oracle_readings", """
  select task_id, record_id, predicate_id, case when label = 0 then 8.0::double else 0.0 end as l0,
         case when label = 1 then 8.0::double else 0.0 end as l1, case when label = 2 then 8.0::double else 0.0 end as l2 from labelled""")
def oracle_readings(spark, sf):
    pairs = derived_flow(spark, sf).pairs
    gold = (R.distinct_pairs(pairs).withColumn("label", D.gold_label("text", "predicate_id")).filter("label < 2")
            .select("claim", "text", "label"))
    return R.oracle_readings(pairs, gold).select("task_id", "record_id", "predicate_id",
                                                 *[F.col("logits")[i].alias(f"l{i}") for i in range(3)])


HALF = f"substr({PAIR}, 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7')"


def half_table(pairs):
    """The readings of every pair whose key starts with a low digit, as an earlier run would have left them."""
    return gold_scorer(R.distinct_pairs(pairs).filter(F.substring("pair", 1, 1) < "8")).select(
        "pair", "logits", F.lit("v1").alias("version"), R.token_count().alias("tokens"))


@query("table_readings", f"""
  select 'found' as part, task_id, record_id, pair, label from labelled where {HALF}
  union all select distinct 'missing', null, null, pair, null from labelled where not {HALF}""")
def table_readings(spark, sf):
    pairs = derived_flow(spark, sf).pairs
    found, missing = R.table_readings(pairs, half_table(pairs).select("pair", "logits"))
    none = F.lit(None).cast("string")
    return found.select(F.lit("found").alias("part"), "task_id", "record_id", "pair", S.argmax_first("logits").alias("label")).unionByName(
        missing.select(F.lit("missing").alias("part"), none.alias("task_id"), none.alias("record_id"), "pair",
                       F.lit(None).cast("int").alias("label")))


TOKENS = "len(string_split(claim, ' ')) + len(string_split(text, ' '))"


@query("cached_readings", f"""
  select pair, any_value(label) as label, any_value({TOKENS}) as tokens, not any_value({HALF}) as is_new
  from labelled group by 1""")
def cached_readings(spark, sf):
    pairs = derived_flow(spark, sf).pairs
    all_readings, new = R.cached_readings(pairs, half_table(pairs), gold_scorer, "v1")
    return (all_readings.join(new.select("pair", F.lit(True).alias("_new")), "pair", "left")
            .select("pair", S.argmax_first("logits").alias("label"), "tokens", F.coalesce("_new", F.lit(False)).alias("is_new")))


@query("reading_stats", f"""
  select sum(n) as pairs_requested, sum((not hit)::int) as pairs_computed, sum(n) - sum((not hit)::int) as cache_hits,
         sum(case when hit then 0 else tok end) as tokens
  from (select pair, count(*) as n, any_value({HALF}) as hit, any_value({TOKENS}) as tok from labelled group by 1)""")
def reading_stats(spark, sf):
    pairs = derived_flow(spark, sf).pairs
    return R.reading_stats(pairs, half_table(pairs), "v1")


@query("calibrate_probs", f"select task_id, record_id, predicate_id, {r6('p_s')} as p_s, {r6('p_r')} as p_r, {r6('p_n')} as p_n from edges")
def calibrate_probs(spark, sf):
    return derived_flow(spark, sf).edges.select("task_id", "record_id", "predicate_id", r("p_s"), r("p_r"), r("p_n"))


@query("top_label", """select task_id, record_id, predicate_id, case when p_s >= p_r and p_s >= p_n then 0 when p_r >= p_n then 1
                       else 2 end as label from edges""")
def top_label(spark, sf):
    return derived_flow(spark, sf).edges.select("task_id", "record_id", "predicate_id", S.top_label().alias("label"))


@query("dense_rank_edges", """
  select task_id, predicate_id, record_id, dense_rank() over (partition by task_id, predicate_id
         order by authority desc, coalesce(valid_from, '-infinity'::double) desc) - 1 as rank from edges""")
def dense_rank_edges(spark, sf):
    return B.dense_rank_edges(derived_flow(spark, sf).edges).select("task_id", "predicate_id", "record_id", "rank")


DIST = ", ".join(f"{r6(x)} as {x}" for x in "svuc")


@query("precedence", f"select task_id, predicate_id, {DIST} from ({precedence_sql('edges')})")
def precedence(spark, sf):
    return B.precedence(derived_flow(spark, sf).edges).select("task_id", "predicate_id", *[r(x) for x in "svuc"])


cte("hard_edges", """
  select task_id, predicate_id, authority, valid_from, (t = 0)::int::double as p_s, (t = 1)::int::double as p_r,
         (t = 2)::int::double as p_n
  from (select *, case when p_s >= p_r and p_s >= p_n then 0 when p_r >= p_n then 1 else 2 end as t from edges)""")


@query("precedence_hard", f"select task_id, predicate_id, {DIST} from ({precedence_sql('hard_edges')})")
def precedence_hard(spark, sf):
    return B.precedence_hard(derived_flow(spark, sf).edges).select("task_id", "predicate_id", *[r(x) for x in "svuc"])


@query("beliefs", f"""
  select task_id, predicate_id, {DIST}, status, {r6('belief')} as belief, coalesce(n, 0) as n_decisive
  from beliefs left join (select task_id, predicate_id, sum((1 - p_n >= 0.5)::int) as n from edges group by 1, 2)
  using (task_id, predicate_id)""")
def beliefs(spark, sf):
    return derived_flow(spark, sf).beliefs.select("task_id", "predicate_id", *[r(x) for x in "svuc"], "status", r("belief"),
                                                  "n_decisive")


@query("belief_from_status", f"""
  select predicate_id, {r6('avg(s + (u + c) * 0.25)')} as mean_belief from beliefs group by 1""")
def belief_from_status(spark, sf):
    return (derived_flow(spark, sf).beliefs.withColumn("b", S.belief_from_status(F.lit(0.25)))
            .groupBy("predicate_id").agg(r(F.avg("b"), "mean_belief")))


@query("decisive_records", """
  select * from (
    select task_id, predicate_id, record_id, dense_rank() over (partition by task_id, predicate_id
           order by authority desc, valid_from desc) - 1 as rank, 1 - p_n >= 0.5 as d from edges) where d""")
def decisive_records(spark, sf):
    return B.decisive_records(derived_flow(spark, sf).edges).select("task_id", "predicate_id", "record_id", "rank",
                                                                    F.lit(True).alias("d"))


@query("gold_status", """
  select p.task_id, p.predicate_id, case when n is null then 'UNRESOLVED' when n > 1 then 'CONFLICT'
         when lab = 0 then 'SATISFIED' else 'VIOLATED' end as status
  from predicates p left join (
    select task_id, predicate_id, count(distinct label) as n, min(label) as lab from (
      select *, rank() over (partition by task_id, predicate_id order by authority desc, valid_from desc) as rk
      from labelled where label < 2) where rk = 1 group by 1, 2) using (task_id, predicate_id)""")
def gold_status(spark, sf):
    f = derived_flow(spark, sf)
    edges = f.pairs.withColumn("label", D.gold_label("text", "predicate_id"))
    return B.gold_status(edges, f.predicates)


@query("describe", f"""
  select what, value, n, {r6('n / sum(n) over (partition by what)')} as share from (
    select 'event' as what, case when text is null then 'withdrawal' when revision > 0 then 'revision' else 'first' end as value,
           count(*) as n from ev group by 1, 2
    union all select 'outcome', outcome, count(*) from outcomes group by 1, 2
    union all select 'status', status, count(*) from beliefs group by 1, 2
    union all select 'disposition', disposition, count(*) from assessments group by 1, 2)""")
def describe(spark, sf):
    f = derived_flow(spark, sf)
    return B.describe(f.outcomes, f.beliefs, f.assessments, f.events).select("what", "value", "n", r("share"))


cte("cost_step", """
  select s.task_id, s.seq_from as seq, s.seq_to, case when coalesce(s.text, '') <> '' then 5 else 0 end as pairs_update,
    case when coalesce(s.text, '') <> '' then c.words + 5 * len(string_split(s.text, ' ')) else 0 end as tokens_update
  from spans s join (select task_id, sum(len(string_split(claim, ' '))) as words from predicates group by 1) c using (task_id)""")


@query("cost_per_event", """
  select a.task_id, a.seq, a.pairs_update, a.tokens_update, sum(b.pairs_update) as pairs_full, sum(b.tokens_update) as tokens_full
  from cost_step a join cost_step b
    on a.task_id = b.task_id and b.seq <= a.seq and (b.seq_to is null or a.seq < b.seq_to)
  group by 1, 2, 3, 4""")
def cost_per_event(spark, sf):
    f = derived_flow(spark, sf)
    return R.cost_per_event(L.change_intervals(f.events), f.predicates)


@query("affected", """
  select distinct l.task_id, a.action_id
  from links l join (values ('a0', ['p0','p1','p2','p3','p4']), ('a1', ['p0','p1']), ('a2', ['p2','p3'])) a(action_id, leaves)
    on list_contains(a.leaves, l.predicate_id)
  where l.record_id like '%-4'""")
def affected(spark, sf):
    from standpoint.operators import logic as G

    f = derived_flow(spark, sf)
    changed = f.records.filter(F.col("record_id").endswith("-4"))
    return K.affected(changed, f.links, G.leaves_of(f.compiled))


@query("render_context", """
  select task_id, string_agg('[record ' || n || ' | authority ' || authority || ' | time ' || t || '] ' || text, ' ' order by n) as context
  from (select *, row_number() over (partition by task_id order by authority desc, valid_from desc, record_id) as n,
               case when valid_from < 1e6 then cast(valid_from::bigint as varchar)
                    else regexp_replace(regexp_replace(printf('%.5e', valid_from), '\\.?0+e', 'e'), 'x', 'x') end as t
        from usable) group by 1""")
def render_context(spark, sf):
    return K.render_context(derived_flow(spark, sf).records)


@query("confirmation_text", """
  select conv_id, turn, case when trim(role) = '' then 'Someone' else role end || case when turn % 2 = 0 then ' confirmed that this holds: '
         else ' said that this does not hold: ' end || text || case when turn % 3 = 0 then ' Note: seen' else '' end as line
  from conversations""")
def confirmation_text(spark, sf):
    c = D.table(spark, sf, "conversations").withColumn("note", F.when(F.col("turn") % 3 == 0, F.lit(" seen ")))
    return c.select("conv_id", "turn", S.confirmation_text("role", "text", F.col("turn") % 2 == 0, "note").alias("line"))


_ = (BIAS, STATUS, T, beliefs_sql, softmax3, th)


def hashed_model(batch):
    """A reading model as a user would plug it in: a frame of pairs in, a list of logits per row out."""
    import hashlib

    def one(claim, text):
        return [int(x) / 16.0 for x in hashlib.sha256(f"{claim}|{text}".encode()).digest()[:3]]

    return batch.assign(logits=[one(c, t) for c, t in zip(batch["claim"], batch["text"])])


BYTES = ", ".join(f"('0x' || substr(sha256(claim || '|' || text), {1 + 2 * i}, 2))::int / 16.0::double as l{i}" for i in range(3))


@query("score_pairs", f"select distinct pair, {BYTES} from labelled")
def score_pairs(spark, sf):
    return R.score_pairs(derived_flow(spark, sf).pairs, hashed_model, "hash-1").select(
        "pair", *[F.col("logits")[i].alias(f"l{i}") for i in range(3)])


def majority(frame):
    """A user's own rule for one predicate: the label most readings have, unresolved when none is decisive."""
    import pandas as pd

    top = frame[["p_s", "p_r", "p_n"]].to_numpy().argmax(axis=1)
    yes, no = int((top == 0).sum()), int((top == 1).sum())
    status = "UNRESOLVED" if yes == no else "SATISFIED" if yes > no else "VIOLATED"
    return pd.DataFrame({"task_id": [frame["task_id"].iloc[0]], "predicate_id": [frame["predicate_id"].iloc[0]], "status": [status]})


@query("custom_status", """
  select task_id, predicate_id, case when yes = no then 'UNRESOLVED' when yes > no then 'SATISFIED' else 'VIOLATED' end as status from (
    select task_id, predicate_id, sum((p_s >= p_r and p_s >= p_n)::int) as yes, sum((p_r > p_s and p_r >= p_n)::int) as no from edges group by 1, 2)""")
def custom_status(spark, sf):
    e = derived_flow(spark, sf).edges.select("task_id", "predicate_id", "record_id", "p_s", "p_r", "p_n")
    return B.custom_status(e, majority, "task_id string, predicate_id string, status string")


@query("custom_linker", """
  select u.task_id, u.record_id, p.predicate_id from usable u join predicates p using (task_id) left join declared d using (task_id, record_id)
  where case when d.about is not null then list_contains(d.about, p.predicate_id) else split_part(p.claim, ' ', 1) = split_part(u.text, ' ', 1) end""")
def custom_linker(spark, sf):
    def by_first_word(records, predicates):
        every = K.link_all(records, predicates)
        return every.filter(F.substring_index("claim", " ", 1) == F.substring_index("text", " ", 1))

    return derived_flow(spark, sf, linker=by_first_word).links.select("task_id", "record_id", "predicate_id")


@query("write_table", "select user_id % 10 as bucket, count(*) as n, sum(k) as total from ev_raw group by 1")
def write_table(spark, sf):
    from uuid import uuid4

    from standpoint.session import shared_dir
    from standpoint.sources import files as FS

    path = f"{shared_dir(spark)}/table-{uuid4().hex}"
    e = D.table(spark, sf, "events").select((F.col("user_id") % 10).alias("bucket"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    FS.write_table(e, path, partition_by=["bucket"])
    FS.write_table(e.filter("bucket = 3"), path, partition_by=["bucket"])
    return spark.read.parquet(path).groupBy(F.col("bucket").cast("bigint").alias("bucket")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("audit_query", """
  select event_type as kind, cast(cast(ts as date) as varchar) as day, count(*) as n from events
  where event_type = 'signup' and ts >= timestamp '2024-01-10' group by 1, 2""")
def audit_query(spark, sf):
    from uuid import uuid4

    from standpoint.session import shared_dir
    from standpoint.sources import files as FS

    path = f"{shared_dir(spark)}/audit-{uuid4().hex}"
    log = D.table(spark, sf, "events").select(F.col("event_type").alias("kind"), "user_id", (
        F.datediff(F.to_date("ts"), F.to_date(F.lit("1970-01-01"))) * 86400).alias("at"))
    FS.append_audit(log, path)
    return FS.audit_query(spark, path, "signup", "2024-01-10").groupBy("kind", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))
