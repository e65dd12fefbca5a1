"""Registered queries over the event log and the merged ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators import ledger as L
from standpoint.plans.registry import query
from standpoint.plans.sqltext import status_at, th
from standpoint.session import shared_dir
from standpoint.sources import derive as D
from standpoint.sources import files as FS

NOW = D.NOW


@query("read_events", "select task_id, count(*) as deliveries, sum(revision) as revisions, "
                      "count(text) as with_text, sum(len(about)) as declared from ev group by 1")
def read_events(spark, sf):
    path = f"{shared_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    FS.write_table(D.event_log(spark, sf), path)
    return FS.read_events(spark, path).groupBy("task_id").agg(
        F.count("*").alias("deliveries"), F.sum("revision").alias("revisions"), F.count("text").alias("with_text"),
        F.sum(F.when(F.col("about").isNotNull(), F.size("about"))).alias("declared"))


BAD = """
  select seq, concat_ws('; ', case when record_id = '' then 'record_id is empty' end,
    case when revision < 0 then 'revision is negative' end,
    case when valid_until < valid_from then 'valid_until precedes valid_from' end,
    case when authority > 9 then 'authority is out of range' end,
    case when length(text) > 9 then 'text is too long' end) as problems
  from (select seq, case when seq % 11 = 0 then '' else record_id end as record_id, revision - 1 as revision,
               valid_from, case when seq % 13 = 0 then valid_from - 1 else valid_until end as valid_until,
               authority * 5 as authority, text from ev)"""


@query("validate_events", f"select * from ({BAD}) where problems <> ''")
def validate_events(spark, sf):
    damaged = (D.event_log(spark, sf)
               .withColumn("record_id", F.when(F.col("seq") % 11 == 0, F.lit("")).otherwise(F.col("record_id")))
               .withColumn("revision", F.col("revision") - 1)
               .withColumn("valid_until", F.when(F.col("seq") % 13 == 0, F.col("valid_from") - 1)
                           .otherwise(F.col("valid_until")))
               .withColumn("authority", F.col("authority") * 5))
    _, bad = L.split_valid(damaged, max_text=9)
    return bad.select("seq", F.array_join("problems", "; ").alias("problems"))


@query("text_hash", f"select doc_id, {th('source', 'text')} as h from documents")
def text_hash(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", S.text_hash("source", "text").alias("h"))


@query("payload_key", "select seq, task_id, payload_key from ev")
def payload_key(spark, sf):
    return D.event_log(spark, sf).select("seq", "task_id", S.payload_key().alias("payload_key"))


@query("record_status", "select task_id, record_id, "
       + ", ".join(f"{status_at(NOW + d * 86400.0)} as status_{i}" for i, d in enumerate((-10, 0, 10))) + " from summary")
def record_status(spark, sf):
    s = L.record_summary(L.ledger_state(D.event_log(spark, sf)))
    return s.select("task_id", "record_id", *[S.record_status(NOW + d * 86400.0).alias(f"status_{i}")
                                              for i, d in enumerate((-10, 0, 10))])


@query("ledger_state", "select task_id, record_id, revision, payload_key, text, authority, valid_from, valid_until, "
                       "first_seq, n_payloads, stored_status from state")
def ledger_state(spark, sf):
    return L.ledger_state(D.event_log(spark, sf)).select(
        "task_id", "record_id", "revision", "payload_key", "text", "authority", "valid_from", "valid_until", "first_seq",
        "n_payloads", "stored_status")


@query("delivery_outcomes", "select task_id, seq, record_id, revision, payload_key, outcome, changed, status from outcomes")
def delivery_outcomes(spark, sf):
    return L.delivery_outcomes(D.event_log(spark, sf))


@query("active_records", "select task_id, record_id, revision, text, authority, valid_from from usable")
def active_records(spark, sf):
    return L.active_records(L.ledger_state(D.event_log(spark, sf)), NOW).select(
        "task_id", "record_id", "revision", "text", "authority", "valid_from")


KEY_SUM = "concat_ws(':', count(*)::varchar, " + ", ".join(
    f"sum(('0x' || substr(sha256(payload_key), {1 + 13 * i}, 13))::bigint)::varchar" for i in range(5)) + ")"


@query("snapshot", f"select task_id, record_id, revision, {KEY_SUM} as payload_keys from state group by 1, 2, 3")
def snapshot(spark, sf):
    return L.snapshot(L.ledger_state(D.event_log(spark, sf)))


@query("fingerprint", f"""
  select task_id, record_id, {th('record_id', 'cast(revision as varchar)', 'ks', 'status')} as fingerprint
  from (select task_id, record_id, max(revision) as revision, {KEY_SUM} as ks,
               max({status_at(NOW)}) as status from state group by 1, 2)""")
def fingerprint(spark, sf):
    return L.fingerprint(L.ledger_state(D.event_log(spark, sf)), NOW)


@query("next_transition", f"""
  select task_id, min(t) as next_transition
  from (select task_id, unnest([valid_from, valid_until]) as t from state where stored_status = 'active')
  where t > {NOW} group by 1""")
def next_transition(spark, sf):
    return L.next_transition(L.ledger_state(D.event_log(spark, sf)), NOW)


@query("clock_changes", f"""
  select * from (select task_id, record_id, {status_at(NOW)} as status_before,
                        {status_at(NOW + 7 * 86400.0)} as status_after from summary)
  where status_before <> status_after""")
def clock_changes(spark, sf):
    return L.clock_changes(L.ledger_state(D.event_log(spark, sf)), NOW, NOW + 7 * 86400.0)


@query("history", "select task_id, seq, record_id, revision, payload_key, outcome, changed, status, source_id, authority "
                  "from outcomes")
def history(spark, sf):
    return L.history(D.event_log(spark, sf))


PURGED = """
  select task_id, record_id, revision, payload_key, n_payloads, stored_status, text from state
  where record_id not like '%-3'
  union all
  select task_id, record_id, case when s.stored_status = 'withdrawn' then s.revision else s.revision + 1 end,
         '__withdrawn__', 1, 'withdrawn', cast(null as varchar)
  from summary s where record_id like '%-3'"""


@query("purge", PURGED)
def purge(spark, sf):
    ev = D.event_log(spark, sf)
    ids = ev.filter(F.col("record_id").endswith("-3")).select("task_id", "record_id")
    return L.ledger_state(L.purge(ev, ids, 4 * 10**15)).select(
        "task_id", "record_id", "revision", "payload_key", "n_payloads", "stored_status", "text")


@query("ledger_as_of", """
  select task_id, step, count(*) as records, sum((status = 'active')::int) as active,
         sum((status = 'conflicted')::int) as conflicted, sum(revision) as revisions
  from (select task_id, seq as step from outcomes) join spans using (task_id)
  where step >= seq_from and (seq_to is null or step < seq_to) group by 1, 2""")
def ledger_as_of(spark, sf):
    ev = D.event_log(spark, sf)
    steps = ev.select("task_id", F.col("seq").alias("step"))
    return L.ledger_as_of(ev, steps).groupBy("task_id", "step").agg(
        F.count("*").alias("records"), F.sum((F.col("status") == "active").cast("int")).alias("active"),
        F.sum((F.col("status") == "conflicted").cast("int")).alias("conflicted"), F.sum("revision").alias("revisions"))


@query("records_view", f"""
  select task_id, record_id, revision, {status_at(NOW)} as status, text, n_payloads > 1 as competing, source_id, authority,
         valid_from, payload_key from state""")
def records_view(spark, sf):
    return L.records_view(L.ledger_state(D.event_log(spark, sf)), NOW)


@query("ingest_report", """
  select task_id, doc_id, sum((key <> 'w')::int) as passages, sum((key <> 'w' and changed)::int) as applied,
         sum((key <> 'w' and not changed)::int) as unchanged, sum((key = 'w')::int) as withdrawn
  from (select task_id, split_part(record_id, '-', 1) as doc_id, changed,
               case when payload_key = '__withdrawn__' then 'w' else 'p' end as key from outcomes) group by 1, 2""")
def ingest_report(spark, sf):
    ev = D.event_log(spark, sf).withColumn("record_id", F.replace("record_id", F.lit("-"), F.lit("#")))
    return L.ingest_report(L.delivery_outcomes(ev))


@query("next_revision", """
  select task_id, record_id, coalesce(revision, 0) + 1 as next_revision, revision is not null as known
  from (select distinct task_id, split_part(record_id, '-', 1) || '-' || (split_part(record_id, '-', 2)::int + 3) as record_id
        from ev) left join summary using (task_id, record_id)""")
def next_revision(spark, sf):
    ev = D.event_log(spark, sf)
    part = F.split("record_id", "-")
    ids = ev.select("task_id", F.concat(part[0], F.lit("-"), (part[1].cast("int") + 3).cast("string")).alias("record_id"))
    return L.next_revision(L.ledger_state(ev), ids)
