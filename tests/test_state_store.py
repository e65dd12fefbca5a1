"""A store advanced batch by batch holds what a run over everything gives, and writes what a batch changes."""

import random

import pytest
from pyspark.sql import functions as F

from standpoint.plans import refresh as X
from standpoint.plans.state_store import StateStore
from standpoint.streaming import decision_stream as DS
from standpoint.plans.stream_queries import as_stream
from tests.test_ledger import SCHEMA, event
from tests.test_refresh import flow, random_log

CHECKED = (("beliefs", X.PRED, ["s", "v", "u", "c", "belief", "status", "n_decisive", "prior"]),
           ("assessments", ["task_id", "action_id"], ["s", "v", "u", "belief", "expected_utility", "disposition"]),
           ("links", [*X.PRED, "record_id"], ["text", "claim", "joint", "authority", "payload_key"]),
           ("edges", [*X.PRED, "record_id"], ["text", "pair", "p_s", "p_r", "p_n"]),
           ("state", ["task_id", "record_id", "payload_key"], ["revision", "n_payloads", "stored_status"]),
           ("declared", X.REC, ["about"]))


def assert_equal(store, full):
    for name, keys, cols in CHECKED:
        r = X.verify(store.table(name), getattr(full, name), keys, cols).first()
        assert r["unequal"] in (0, None), (name, r)
    assert store.table("readings").groupBy("pair").count().filter("count > 1").count() == 0


def redefined(f, now=None):
    """Another claim, prior and way of reading for some, one predicate less, another gate and bar of an action."""
    p = (f.predicates.withColumn("text", F.when((F.col("task_id") == "t1") & (F.col("predicate_id") == "p1"), "another claim").otherwise(F.col("text")))
         .withColumn("prior", F.when((F.col("task_id") == "t1") & (F.col("predicate_id") == "p2"), 0.9).otherwise(F.col("prior")))
         .withColumn("join", F.when((F.col("task_id") == "t1") & (F.col("predicate_id") == "p3"), ~F.col("join")).otherwise(F.col("join"))))
    a = f.actions.withColumn("value_success", F.when(F.col("task_id") == "t2", F.col("value_success") + 1).otherwise(F.col("value_success")))
    return X.Flow(f.events, p, f.gates, a, f.scorer, f.now if now is None else now, f.temperature, f.bias)


@pytest.mark.parametrize("compact", [0.0, 100.0])
def test_versions_equal_one_run(spark, tmp_path, compact):
    log = random_log(3)
    store = StateStore(spark, str(tmp_path), buckets=4, compact=compact)
    store.create(flow(spark, log[:40], now=20.0))
    f = flow(spark, log, now=20.0)
    store.advance(spark.createDataFrame(log[40:70], SCHEMA), f)
    store.advance(spark.createDataFrame(log[70:], SCHEMA), f, now=55.0)
    g = redefined(f, 55.0)
    d = StateStore(spark, str(tmp_path), compact=compact).advance(spark.createDataFrame([], SCHEMA), g, definitions=True)
    assert {r.task_id for r in d.report["touched_actions"].select("task_id").distinct().collect()} == {"t1", "t2"}
    assert all(r.pair for r in d.report["read_pairs"].collect())
    again = StateStore(spark, str(tmp_path))
    assert again.version == 3 and again.buckets == 4 and again.now == 55.0
    assert_equal(again, X.full_run(g))
    if compact == 0.0:
        assert all(s["base"] for s in again.segments if s["table"] in ("beliefs", "assessments"))
    else:
        assert sum(s["table"] == "beliefs" for s in again.segments) == 4


def test_unaffected_readings_survive_a_definition(spark, tmp_path):
    log = random_log(4)
    f = flow(spark, log, now=20.0)
    store = StateStore(spark, str(tmp_path), buckets=2)
    store.create(f)
    d = store.advance(spark.createDataFrame([], SCHEMA), redefined(f), definitions=True)
    texts = {r.text for r in f.records.filter("task_id = 't1'").collect()}
    assert 0 < d.report["read_pairs"].count() <= len(texts) + 1  # each text once against the other claim, and the joint text
    assert store.advance(spark.createDataFrame([], SCHEMA), redefined(f), definitions=True).report["touched_actions"].count() == 0


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    rng = random.Random(1)
    tasks = ["t0", "t1", "t2"]
    log = [event(i, f"r{i}", 1, rng.choice(["alpha", "beta", "gamma"]), task=rng.choice(tasks)) for i in range(300)]
    store = StateStore(spark, str(tmp_path), buckets=8, compact=100.0)
    f = flow(spark, log)
    store.create(f)
    sizes = {s["table"]: s["rows"] for s in store.segments}
    store.advance(spark.createDataFrame([event(900, "r5", 2, "delta", task=log[5][0])], SCHEMA), f)
    late = {s["table"]: s["rows"] for s in store.segments if s["version"] == 1}
    assert late["state"] == 1 and late["links"] <= 30 and late["links"] * 100 < sizes["links"] * 10 and late["edges"] * 20 < sizes["edges"]
    store.advance(spark.createDataFrame([event(901, "r5", 2, "delta", task=log[5][0])], SCHEMA), f)
    assert {s["table"]: s["rows"] for s in store.segments if s["version"] == 2} | {"state": 0, "declared": 0} == dict.fromkeys(late, 0) | {"state": 0, "declared": 0}


def test_old_versions_go(spark, tmp_path):
    log = random_log(6)
    f = flow(spark, log)
    store = StateStore(spark, str(tmp_path), buckets=2, compact=0.0, keep=1)
    store.create(flow(spark, log[:30]))
    for lo in (30, 50, 70):
        store.advance(spark.createDataFrame(log[lo:lo + 20], SCHEMA), f)
    assert len(list((tmp_path / "manifest").glob("version=*"))) == 1
    assert {p.name for p in (tmp_path / "edges").iterdir()} == {s["folder"] for s in store.segments if s["table"] == "edges"}
    assert_equal(store, X.full_run(f))


def test_a_stream_resumes_and_goes_on_under_a_new_checkpoint(spark, tmp_path):
    log = random_log(7)
    f = flow(spark, log, now=20.0)
    path = str(tmp_path)
    one = spark.createDataFrame(log[:45], SCHEMA)
    stream = lambda rows, files: as_stream(rows, "seq", files)
    DS.decision_stream(stream(one, 2), f, path, "a").trigger(availableNow=True).start().awaitTermination()
    store = StateStore(spark, f"{path}/store")
    assert store.version == 1 and store.tag == "a:1"
    assert StateStore(spark, f"{path}/store").advance(one, f, tag="a:1") is None
    DS.decision_stream(stream(spark.createDataFrame(log[45:], SCHEMA), 1), f, path, "b").trigger(availableNow=True).start().awaitTermination()
    store = StateStore(spark, f"{path}/store")
    assert store.version == 2 and store.tag == "b:0"
    assert_equal(store, X.full_run(f))


def test_the_clock_moves_with_the_stream(spark, tmp_path):
    rows = [event(0, "r1", 1, "alpha", vf=30.0, task="t0"), event(1, "r2", 1, "beta", vf=0.0, vu=25.0, task="t0"), event(2, "r3", 1, "gamma", task="t1")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("clock", F.when(F.col("seq") < 2, 10.0).otherwise(40.0))
    DS.decision_stream(as_stream(df, "seq", 3), flow(spark, rows), str(tmp_path), clock="clock").trigger(availableNow=True).start().awaitTermination()
    store = StateStore(spark, f"{tmp_path}/store")
    assert store.now == 40.0
    assert_equal(store, X.full_run(flow(spark, rows, now=40.0)))


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path):
    """A base is dealt by bucket, but its tasks grow with its rows."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(key)
    rows = spark.range(20_000).selectExpr("'t0' AS task_id", "concat('r', id) AS record_id", "array('p0') AS about")
    try:
        spark.conf.set(key, "32k")
        store = StateStore(spark, str(tmp_path), buckets=2)
        store.segments = [store._write("declared", rows.repartition(8), None, True)]
        got = store.table("declared")
        files = got.inputFiles()
    finally:
        spark.conf.set(key, was)
    assert got.count() == got.distinct().count() == 20_000 and len({f.rsplit("/", 1)[0] for f in files}) == 1 and len(files) > 2
