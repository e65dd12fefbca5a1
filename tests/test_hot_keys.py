"""A third of all rows on one key gives the same results as small keys do, block by block."""

from pyspark.sql import functions as F

from standpoint.operators import beliefs as B
from standpoint.operators import corpus as C
from standpoint.operators import ledger as L
from standpoint.operators import links as K
from standpoint.operators import metrics as M
from standpoint.sources import derive as D
from tests.test_ledger import SCHEMA


def hot_log(spark, n=6000):
    rec = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 500))
    return spark.range(n).select(
        F.lit("t").alias("task_id"), F.col("id").alias("seq"), rec.alias("record_id"), F.floor(F.col("id") / 7).cast("int").alias("revision"),
        F.concat(F.lit("x"), F.col("id") % 4).alias("text"), F.lit("s").alias("source_id"), F.lit(1).alias("authority"),
        F.lit(None).cast("double").alias("valid_from"), F.lit(None).cast("double").alias("valid_until"), F.lit(None).cast("string").alias("span"),
        F.when(F.col("id") % 5 == 0, F.array(F.concat(F.lit("p"), F.col("id") % 3))).alias("about"))


def test_outcomes_do_not_depend_on_the_block(spark):
    df = hot_log(spark)
    assert [f.name for f in df.schema] == [f.split()[0] for f in SCHEMA.split(", ")]
    one, many = L.delivery_outcomes(df), L.delivery_outcomes(df, block_rows=64)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_declared_links_do_not_depend_on_the_block(spark):
    df = hot_log(spark)
    a, b = K.declared_links(df).collect(), K.declared_links(df, block_rows=16).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 100
    # the same from receipts: the latest applied delivery that names any
    out = L.delivery_outcomes(df).filter("outcome = 'applied'").join(df.select("seq", "about"), "seq").filter("about is not null")
    want = out.groupBy("task_id", "record_id").agg(F.max_by("about", "seq"))
    assert sorted(map(tuple, a)) == sorted(map(tuple, want.collect()))


def test_joint_texts_are_one_whatever_the_size_of_pieces(spark):
    links = spark.range(40).select(
        F.lit("t").alias("task_id"), F.concat(F.lit("r"), "id").alias("record_id"), F.lit("p").alias("predicate_id"), F.lit("c").alias("claim"),
        F.lit(True).alias("joint"), F.concat(F.lit("w"), "id").alias("text"), F.lit(1).alias("authority"), F.col("id").cast("double").alias("valid_from"),
        F.lit("k").alias("payload_key"), F.lit(1).alias("revision"))
    whole = K.joint_pairs(links).first()
    assert whole["text"].split() == [f"w{i}" for i in range(39, -1, -1)] and whole["record_id"] == "joint:p"
    assert K.joint_pairs(links, max_members=15).collect() == K.joint_pairs(links).collect()
    records = links.drop("predicate_id", "claim", "joint")
    assert K.render_context(records, max_records=7).collect() == K.render_context(records).collect()


def test_precedence_with_many_ranks_on_one_predicate(spark):
    e = spark.range(9000).select(
        F.lit("t").alias("task_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 300)).alias("predicate_id"),
        F.col("id").cast("string").alias("record_id"), (F.col("id") % 4).cast("int").alias("authority"), (F.col("id") * 977.0).alias("valid_from"),
        F.lit(0.0005).alias("p_s"), F.lit(0.0003).alias("p_r"), F.lit(0.9992).alias("p_n"))
    r = B.precedence(e).filter("predicate_id = 'hot'").first()
    n = 3000
    none = 0.9992 ** n
    assert abs(r["u"] - none) < 1e-9 and abs(r["s"] / r["v"] - 5 / 3) < 1e-6 and abs(r["s"] + r["v"] + r["u"] - 1) < 1e-9
    ranks = B.dense_rank_edges(e).filter("predicate_id = 'hot'").agg(F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(ranks) == (n - 1, n)


def test_previous_value_over_blocks(spark):
    df = spark.range(300).select(F.lit("e").alias("k"), F.col("id").alias("t"), (F.col("id") % 7).cast("string").alias("x"))
    got = M.previous_value(df, ["k"], "t", "x", "none", block_rows=16).orderBy("t").collect()
    assert [r["previous"] for r in got] == ["none"] + [str(i % 7) for i in range(299)]


def test_contexts_do_not_depend_on_the_buckets(spark):
    """Far apart steps of one task are one bucket; cut into many, each step twice, the rows are the same."""
    log = hot_log(spark, 400).withColumn("seq", F.col("seq") * 10**9).withColumn("authority", (F.col("revision") % 3).cast("int"))
    spans = L.change_intervals(log)
    steps = spans.select("task_id", F.col("seq_from").alias("step"))
    preds = spark.createDataFrame([("t", f"p{i}", f"claim {i}") for i in range(3)], "task_id string, predicate_id string, text string")
    lone = spark.createDataFrame([("t", -5)], "task_id string, step long")
    steps = steps.unionByName(steps.limit(7)).unionByName(lone)
    whole = C.disposition_contexts(log, steps, preds, D.gold_label, spans, small=10**6)
    cut = C.disposition_contexts(log, steps, preds, D.gold_label, spans, small=0)
    assert whole.count() == 3 * steps.count() and whole.exceptAll(cut).count() == 0 == cut.exceptAll(whole).count()
    assert {tuple(r) for r in whole.filter("step = -5").select("context", "status").collect()} == {("(no records)", "UNRESOLVED")}
    # the listing of spans by bucket does not grow with the distance of steps
    at, listed = L.as_of_sides(steps.filter("step < 200e9"), spans)
    assert listed.count() == spans.count() and at.select("_bk").distinct().count() == 1
    # gold status from the records in force, step by step
    live = C.steps_in_force(log, steps.distinct(), spans).crossJoin(preds.select("predicate_id")).withColumn("l", D.gold_label("text", "predicate_id"))
    top = {}
    for r in live.filter("l < 2").collect():
        top.setdefault((r["step"], r["predicate_id"]), []).append((r["authority"], r["l"]))
    for r in whole.collect():
        got = top.get((r["step"], r["predicate_id"]), [])
        labels = {x for a, x in got if a == max(got)[0]}
        assert r["status"] == ("UNRESOLVED" if not labels else "CONFLICT" if len(labels) > 1 else "VIOLATED" if labels == {1} else "SATISFIED")


def test_a_user_s_rule_runs_in_many_tasks(spark):
    """Readings are few bytes, the rule much work: predicates must not be put together in one task for their size."""
    from standpoint.operators import beliefs as B

    e = spark.createDataFrame([(f"t{i}", "p", f"r{j}", 0.1) for i in range(60) for j in range(3)], "task_id string, predicate_id string, record_id string, p_n double")
    got = B.custom_status(e, lambda f: f.head(1)[["task_id", "predicate_id"]].assign(n=len(f)), "task_id string, predicate_id string, n long")
    rows = got.withColumn("p", F.spark_partition_id()).collect()
    assert len(rows) == 60 and all(r.n == 3 for r in rows) and len({r.p for r in rows}) > 1
