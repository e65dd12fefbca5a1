"""Versioned records: merging deliveries that arrive in any order.

A record's state is its highest revision together with the distinct payloads delivered at it. That is
a join-semilattice, so state is computed with partial aggregates and no ordering; only receipts (what
each delivery did when it arrived) need the order, and those come from a blocked prefix scan.
States are kept one row per payload, so a record with very many competing payloads never becomes one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from standpoint.functions import scalars as S
from standpoint.operators.scan import dense_index, running_before, skew_join
from standpoint.schemas import WITHDRAWN_KEY
from standpoint.session import cut_lineage

REC = ["task_id", "record_id"]
PAYLOAD = ["text", "source_id", "authority", "valid_from", "valid_until", "span"]
BLOCK_ROWS = 65536
SMALL_TASK = 256


def keyed(events: DataFrame) -> DataFrame:
    """Events with their payload key. A key stored at delivery time is kept, because it stays right
    after the text has been erased."""
    if "payload_key" in events.columns:
        return events
    return events.withColumn("payload_key", S.payload_key())


def ledger_state(events: DataFrame) -> DataFrame:
    """One row per (task, record, payload at the top revision), with the record's stored status."""
    ev = keyed(events)
    cells = ev.groupBy(*REC, "revision", "payload_key").agg(
        F.min("seq").alias("first_seq"), F.min_by(F.struct(*PAYLOAD), F.col("seq")).alias("p"))
    per_revision = cells.groupBy(*REC, "revision").agg(F.count("*").alias("n_payloads"))
    top = per_revision.groupBy(*REC).agg(F.max(F.struct("revision", "n_payloads")).alias("t")).select(*REC, "t.*")
    return (cells.join(top, [*REC, "revision"])
            .select(*REC, "revision", "payload_key", "p.*", "first_seq", "n_payloads")
            .withColumn("stored_status",
                        F.when(F.col("n_payloads") > 1, F.lit("conflicted"))
                        .when(F.col("payload_key") == WITHDRAWN_KEY, F.lit("withdrawn")).otherwise(F.lit("active"))))


def record_summary(state: DataFrame) -> DataFrame:
    """One row per record: revision, number of payloads, stored status, validity of a single payload."""
    return state.groupBy(*REC).agg(
        F.max("revision").alias("revision"), F.max("n_payloads").alias("n_payloads"),
        F.max("stored_status").alias("stored_status"),
        F.max(F.when(F.col("n_payloads") == 1, F.col("valid_from"))).alias("valid_from"),
        F.max(F.when(F.col("n_payloads") == 1, F.col("valid_until"))).alias("valid_until"))


def record_heads(events: DataFrame) -> DataFrame:
    """One row per record: top revision, stored status, and the payload when there is a single one. Two nested
    aggregates with map-side combine and no join; enough wherever competing payloads need not be listed."""
    ev = keyed(events)
    per_revision = ev.groupBy(*REC, "revision").agg(
        F.min("payload_key").alias("k0"), F.max("payload_key").alias("k1"),
        F.min_by(F.struct("payload_key", *PAYLOAD), F.col("seq")).alias("p"))
    head = per_revision.groupBy(*REC).agg(
        F.max("revision").alias("revision"),
        F.max_by(F.struct((F.col("k0") != F.col("k1")).alias("clash"), "p"), F.col("revision")).alias("h"))
    clash = F.col("h.clash")
    status = (F.when(clash, F.lit("conflicted")).when(F.col("h.p.payload_key") == WITHDRAWN_KEY, F.lit("withdrawn"))
              .otherwise(F.lit("active")))
    return head.select(*REC, "revision", *[F.when(~clash, F.col(f"h.p.{c}")).alias(c) for c in ("payload_key", *PAYLOAD)],
                       status.alias("stored_status"))


def delivery_outcomes(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What every delivery did when it arrived: outcome, whether anything changed, status afterwards.

    The state of a record is one number, four times its top revision plus what that revision holds: 0 a text,
    1 a withdrawal, 3 competing payloads. A delivery carries the number its own payload proves, and the state
    is the greatest of those so far, so blocks of sequence numbers merge. ``seq`` is unique in a task, so
    ``block_rows`` bounds what a task sorts."""
    slim = keyed(events).select(*REC, "seq", "revision", "payload_key").withColumn("_blk", F.floor(F.col("seq") / F.lit(block_rows)))
    # first delivery of each payload, and of each revision: per block by an aggregate, then over the few blocks
    turn = [*REC, "revision"]
    per_block = slim.groupBy(*turn, "payload_key", "_blk").agg(F.min("seq").alias("_f"))
    firsts = per_block.withColumn("_first", F.min("_f").over(W.partitionBy(*turn, "payload_key"))).drop("_f")
    opened = per_block.groupBy(*turn).agg(F.min("_f").alias("_opened"))
    firsts = skew_join(firsts, opened, turn)
    known = cut_lineage(slim.join(firsts, [*turn, "payload_key", "_blk"]))
    holds = (F.when(F.col("_first") != F.col("_opened"), F.lit(3)).when(F.col("payload_key") == WITHDRAWN_KEY, F.lit(1))
             .otherwise(F.lit(0)))
    own = F.col("revision").cast("bigint") * 4 + holds
    ran = running_before(known, REC, [F.col("_blk")], [F.col("seq")], {"_before": own}, fold=F.max)
    top, rev = F.shiftright("_before", 2), F.col("revision")
    outcome = (F.when(top.isNull() | (rev > top), F.lit("applied")).when(rev < top, F.lit("stale"))
               .when(F.col("seq") == F.col("_first"), F.lit("conflict")).otherwise(F.lit("duplicate")))
    now = F.greatest(F.col("_before"), own) % 4
    status = F.when(now == 3, F.lit("conflicted")).when(now == 1, F.lit("withdrawn")).otherwise(F.lit("active"))
    return (ran.withColumn("outcome", outcome)
            .select("task_id", "seq", "record_id", "revision", "payload_key", "outcome",
                    F.col("outcome").isin("applied", "conflict").alias("changed"), status.alias("status")))


def active_records(state: DataFrame, now: float | None = None) -> DataFrame:
    """Records usable as evidence at a clock: active and with words in them."""
    return state.filter((S.record_status(now) == "active") & (F.coalesce(F.col("text"), F.lit("")) != ""))


def _payload_digest(state: DataFrame) -> DataFrame:
    """Per record, one text for its set of payload keys, the same at every size: their count and the sums of the parts of
    their hashes as numbers. A sum has no order and partial sums merge, so keys never meet in one row."""
    state = state.withColumn("_h", F.sha2("payload_key", 256))
    part = [F.sum(F.conv(F.substring("_h", 1 + 13 * i, 13), 16, 10).cast("decimal(28,0)")).cast("string") for i in range(5)]
    return state.groupBy(*REC, "revision").agg(F.concat_ws(":", F.count("*").cast("string"), *part).alias("payload_keys"))


def snapshot(state: DataFrame) -> DataFrame:
    """Canonical state: two ledgers agree exactly when their snapshots are equal."""
    return _payload_digest(state)


def fingerprint(state: DataFrame, now: float | None = None) -> DataFrame:
    """Per record, a hash that changes exactly when something a decision could depend on changes."""
    status = record_summary(state).select(*REC, S.record_status(now).alias("status"))
    return (_payload_digest(state).join(status, REC)
            .select(*REC, S.text_hash("record_id", F.col("revision").cast("string"), "payload_keys", "status")
                    .alias("fingerprint")))


def next_transition(state: DataFrame, now: float) -> DataFrame:
    """Earliest future validity boundary per task; competing or withdrawn records have none."""
    return (state.filter(F.col("stored_status") == "active")
            .select("task_id", F.explode(F.array("valid_from", "valid_until")).alias("at"))
            .filter(F.col("at") > now).groupBy("task_id").agg(F.min("at").alias("next_transition")))


def clock_changes(state: DataFrame, before: float, after: float) -> DataFrame:
    return (record_summary(state)
            .select(*REC, S.record_status(before).alias("status_before"), S.record_status(after).alias("status_after"))
            .filter(F.col("status_before") != F.col("status_after")))


def history(events: DataFrame, task_id: str | None = None, record_id: str | None = None) -> DataFrame:
    """Deliveries with their outcomes. The filters reach the scan: a record's receipts depend on it alone."""
    ev = keyed(events)
    if task_id is not None:
        ev = ev.filter(F.col("task_id") == task_id)
    if record_id is not None:
        ev = ev.filter(F.col("record_id") == record_id)
    extra = [c for c in ("source_id", "authority") if c in ev.columns]
    return delivery_outcomes(ev).join(ev.select("task_id", "seq", *extra), ["task_id", "seq"])


def purge(events: DataFrame, ids: DataFrame, next_seq: int) -> DataFrame:
    """Honour deletion requests (task_id, record_id): withdraw each record at the next revision unless it is
    withdrawn already, then erase words and span in every stored row. Keys stay, so a rebuild agrees.
    New withdrawals take sequence numbers from ``next_seq`` on (the log's maximum plus one)."""
    ev = keyed(events)
    wanted = ids.select(*REC).distinct()
    summary = record_summary(ledger_state(ev.join(wanted, REC, "left_semi"))).filter(F.col("stored_status") != "withdrawn")
    numbered = dense_index(summary, REC)
    withdrawals = numbered.select(
        "task_id", (F.col("idx") + F.lit(next_seq)).cast("bigint").alias("seq"), "record_id",
        (F.col("revision") + 1).cast("int").alias("revision"), F.lit(None).cast("string").alias("text"),
        F.lit("purge").alias("source_id"), F.lit(0).alias("authority"), F.lit(WITHDRAWN_KEY).alias("payload_key"))
    hit = ev.join(wanted.withColumn("_hit", F.lit(True)), REC, "left")
    erase = F.coalesce(F.col("_hit"), F.lit(False))
    kept = hit.withColumn("text", F.when(erase & F.col("text").isNotNull(), F.lit("")).otherwise(F.col("text")))
    if "span" in ev.columns:
        kept = kept.withColumn("span", F.when(~erase, F.col("span")))
    return kept.drop("_hit").unionByName(withdrawals, allowMissingColumns=True)


def change_intervals(events: DataFrame) -> DataFrame:
    """Spans of sequence numbers [seq_from, seq_to) during which a record's state stayed the same, with
    the single payload then in force (NULL while withdrawn or conflicted)."""
    ev = keyed(events)
    moves = cut_lineage(delivery_outcomes(ev).filter("changed")
                        .join(ev.select("task_id", "seq", *PAYLOAD), ["task_id", "seq"]))
    block = (F.floor(F.col("seq") / F.lit(BLOCK_ROWS)), "desc")
    nxt = running_before(moves, REC, [block], [F.col("seq").desc()], {"seq_to": F.col("seq")}, fold=F.min)
    live = F.col("status") == "active"
    return nxt.select(*REC, "revision", "payload_key", "status", F.col("seq").alias("seq_from"), "seq_to",
                      *[F.when(live, F.col(c)).alias(c) for c in PAYLOAD if c != "span"])


def as_of_sides(steps: DataFrame, spans: DataFrame, bucket: int = BLOCK_ROWS, small: int = SMALL_TASK) -> tuple[DataFrame, DataFrame]:
    """Steps and spans under common keys (task_id, _bk), so that a range condition becomes an equi-join. A task of up to ``small`` steps is one
    bucket, however far apart its steps lie; of others the sequence axis is cut into buckets of equal width, and a span is listed once per bucket
    it touches that holds a step of its task."""
    used = steps.groupBy("task_id", F.floor(F.col("step") / bucket).alias("_bk")).agg(F.count("*").alias("_n"))
    by_task = used.groupBy("task_id").agg(F.sort_array(F.collect_set("_bk")).alias("_bks"), (F.sum("_n") <= small).alias("_small"))
    first, last = F.floor(F.col("seq_from") / bucket), F.floor((F.col("seq_to") - 1) / bucket)
    touched = F.when(F.col("_small"), F.array(F.lit(0).cast("long"))).otherwise(
        F.filter("_bks", lambda b: (b >= first) & (last.isNull() | (b <= last))))
    listed = skew_join(spans, by_task, ["task_id"]).withColumn("_bk", F.explode(touched)).drop("_bks", "_small")
    own = F.when(F.col("_small"), F.lit(0).cast("long")).otherwise(F.floor(F.col("step") / bucket))
    return skew_join(steps, by_task.select("task_id", "_small"), ["task_id"]).withColumn("_bk", own).drop("_small"), listed


def in_force(step, seq_from, seq_to):
    return (step >= seq_from) & (seq_to.isNull() | (step < seq_to))


def ledger_as_of(events: DataFrame, steps: DataFrame, bucket: int = BLOCK_ROWS, spans: DataFrame | None = None) -> DataFrame:
    """State of every record of a task at each step (task_id, step); ``spans`` may hand in ``change_intervals`` that are
    known already."""
    spans = change_intervals(events) if spans is None else spans
    at, listed = as_of_sides(steps, spans, bucket)
    return at.join(listed, ["task_id", "_bk"]).filter(in_force(F.col("step"), F.col("seq_from"), F.col("seq_to"))).drop("_bk")


def records_view(state: DataFrame, now: float | None = None) -> DataFrame:
    """Each record with its status and text, or one row per competing version when conflicted."""
    return state.select(*REC, "revision", S.record_status(now).alias("status"), "text",
                        (F.col("n_payloads") > 1).alias("competing"), "source_id", "authority", "valid_from", "payload_key")


def next_revision(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Revision an add, update or withdrawal of each id should carry."""
    top = state.groupBy(*REC).agg(F.max("revision").alias("_top"))
    return (ids.select(*REC).distinct().join(top, REC, "left")
            .select(*REC, (F.coalesce(F.col("_top"), F.lit(0)) + 1).cast("int").alias("next_revision"),
                    F.col("_top").isNotNull().alias("known")))


# Limits a delivery must respect.
MAX_RECORD_ID, MAX_AUTHORITY, MAX_SPAN, MAX_TEXT = 200, 9, 500, 20000


def validate_events(events: DataFrame, max_text: int = MAX_TEXT) -> DataFrame:
    """Events with the list of reasons each is refused (empty for a good one). Split with a filter."""
    rules = [
        (F.coalesce(F.col("record_id"), F.lit("")) == "", "record_id is empty"),
        (F.length("record_id") > MAX_RECORD_ID, "record_id is too long"),
        (F.col("revision").isNull() | (F.col("revision") < 0), "revision is negative"),
        (F.col("valid_until") < F.col("valid_from"), "valid_until precedes valid_from"),
        ((F.col("authority") < 0) | (F.col("authority") > MAX_AUTHORITY), "authority is out of range"),
        (F.length("text") > max_text, "text is too long"),
        (F.length("span") > MAX_SPAN, "span is too long"),
    ]
    return events.withColumn("problems", F.array_compact(F.array(*[F.when(cond, F.lit(why)) for cond, why in rules])))


def split_valid(events: DataFrame, max_text: int = MAX_TEXT) -> tuple[DataFrame, DataFrame]:
    checked = validate_events(events, max_text)
    return checked.filter(F.size("problems") == 0).drop("problems"), checked.filter(F.size("problems") > 0)


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """Per document (records named document#i): deliveries applied, unchanged, withdrawn."""
    doc = F.regexp_extract("record_id", r"^(.*)#\d+$", 1)
    gone = F.col("payload_key") == WITHDRAWN_KEY
    return (outcomes.withColumn("doc_id", doc).filter(F.col("doc_id") != "").groupBy("task_id", "doc_id").agg(
        F.sum((~gone).cast("int")).alias("passages"),
        F.sum((~gone & F.col("changed")).cast("int")).alias("applied"),
        F.sum((~gone & ~F.col("changed")).cast("int")).alias("unchanged"),
        F.sum(gone.cast("int")).alias("withdrawn")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
