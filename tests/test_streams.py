"""Streams give what a batch over the same log gives."""

from pyspark.sql import functions as F

from standpoint.plans.stream_queries import as_stream, run_to_end
from standpoint.streaming import ledger_stream as LS
from standpoint.operators import feedback as K
from standpoint.operators import ledger as L
from tests.test_ledger import SCHEMA, event, random_events


def test_receipts_equal_batch_outcomes(spark):
    df = spark.createDataFrame(random_events(11), SCHEMA)
    got = run_to_end(LS.ledger_stream(as_stream(df.drop("about"), "seq", 3)))
    want = L.delivery_outcomes(df)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_time_alone_changes_a_status(spark):
    rows = [event(0, "a", 1, "x", vf=10.0, vu=20.0), event(1, "b", 1, "y"), event(2, "c", 1, "z")]
    clock = {0: 0.0, 1: 15.0, 2: 40.0}
    df = spark.createDataFrame([(*r, clock[r[1]]) for r in rows], SCHEMA + ", at double").withColumn(
        "clock", F.timestamp_seconds(F.lit(1704067200) + F.col("at"))).drop("about", "at")
    got = run_to_end(LS.validity_stream(as_stream(df, "seq", 3), 1704067200.0)).filter("record_id = 'a'").orderBy("at").collect()
    assert [(r["at"], r["was"], r["now"]) for r in got] == [(0.0, "absent", "not_yet_valid"), (10.0, "not_yet_valid", "active"), (20.0, "active", "expired")]


def test_endorsements_follow_the_bar(spark):
    rows = [("w", 0, "c1", "case", 0.95, False), ("w", 1, "c2", "case", 0.5, False), ("w", 2, "c1", "verdict", None, True), ("w", 3, "c1", "verdict", None, True),
            ("w", 4, "c3", "case", 0.92, False), ("w", 5, "c4", "case", 0.97, False), ("w", 6, "c4", "verdict", None, False)]
    df = spark.createDataFrame(rows, "workspace string, seq long, case_id string, kind string, confidence double, wrong boolean")
    got = run_to_end(LS.endorsement_stream(as_stream(df, "seq", 2))).orderBy("seq").collect()
    assert [r["accepted"] for r in got] == [True, False, True, False, False, True, True]
    assert got[3]["problem"] is not None and abs(got[6]["tau"] - (0.9 + 0.05 * (1 - 0.05 * 2))) < 1e-12
    log = [("w", r["seq"], "endorsement" if r["kind"] == "case" else "verdict", bool(rows[r["seq"]][5])) for r in got
           if r["accepted"]]
    trace = K.threshold_trace(spark.createDataFrame(log, "workspace string, seq long, kind string, wrong boolean")).orderBy("seq").collect()
    assert trace[-1]["tau"] == got[-1]["tau"]


def test_order_holds_across_arrow_chunks(spark):
    """Rows of one record in reverse order, cut into chunks of four."""
    rows = [event(i, "a", i % 5, f"x{i % 3}") for i in range(24)]
    df = spark.createDataFrame(rows[::-1], SCHEMA)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = run_to_end(LS.ledger_stream(as_stream(df.drop("about"), "seq", 30))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = L.delivery_outcomes(df)
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(map(tuple, want.collect()))


def test_a_micro_batch_is_several_files_and_records_share_a_bucket(spark, monkeypatch):
    from standpoint.plans import stream_queries as Q

    monkeypatch.setattr(LS, "BUCKETS", 1)
    monkeypatch.setattr(Q, "FILE_ROWS", 10)
    rows = [("t", i, f"r{i % 7}", i // 7 % 3, f"text {i // 21}") for i in range(100)]
    df = spark.createDataFrame(rows, "task_id string, seq long, record_id string, revision int, text string").selectExpr(
        "*", "'s' as source_id", "0 as authority", "0.0D as valid_from", "cast(null as double) as valid_until", "cast(null as string) as span")
    seen = []
    Q.as_stream(df, "seq", 2).writeStream.foreachBatch(
        lambda b, i: seen.append((b.select(F.input_file_name()).distinct().count(), sorted(r["seq"] for r in b.collect())))).trigger(availableNow=True).start().awaitTermination()
    assert [s for _, s in seen] == [list(range(50)), list(range(50, 100))] and all(n > 1 for n, _ in seen)
    got = {r["seq"]: (r["outcome"], r["status"]) for r in run_to_end(LS.ledger_stream(as_stream(df, "seq", 2))).collect()}
    state, want = {}, {}
    for _, seq, name, rev, text in rows:
        top, texts = state.get(name, (-1, set()))
        outcome = "applied" if rev > top else "stale" if rev < top else "duplicate" if text in texts else "conflict"
        if outcome == "applied":
            state[name] = (rev, {text})
        elif outcome == "conflict":
            texts.add(text)
        want[seq] = (outcome, "conflicted" if len(state[name][1]) > 1 else "active")
    assert got == want
