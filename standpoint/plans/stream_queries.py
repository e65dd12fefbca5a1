"""Registered queries that run a stream to its end over the derived log, a few files at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standpoint.plans.flow import derived_flow
from standpoint.plans.link_queries import r
from standpoint.plans.registry import query
from standpoint.plans.state_store import StateStore
from standpoint.plans.sqltext import r6
from standpoint.session import cut_lineage, shared_dir
from standpoint.sources import derive as D
from standpoint.streaming import decision_stream as DS
from standpoint.streaming import ledger_stream as LS


FILE_ROWS, MAX_FILES = 16384, 64


def as_stream(df: DataFrame, order: str, files: int) -> DataFrame:
    """The rows of a frame as a stream of ``files`` micro-batches in the order of a column. Each is written as equally many files,
    none of them empty where there are several: round-robin dealing leaves no task without rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    slices = df.withColumn("_f", F.least(F.lit(files - 1), F.floor((F.col(order) - lo) * files / (hi - lo + 1))))
    rows = {r["_f"]: r["count"] for r in slices.groupBy("_f").count().collect()}
    each = max(1, min(MAX_FILES, min(rows.get(i, 0) for i in range(files)) // FILE_ROWS))
    for i in range(files):
        part = slices.filter(F.col("_f") == i).drop("_f")
        (part.coalesce(1) if each == 1 else part.repartition(each)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def run_to_end(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


@query("ledger_stream", "select task_id, seq, record_id, revision, payload_key, outcome, changed, status from outcomes")
def ledger_stream(spark, sf):
    return run_to_end(LS.ledger_stream(as_stream(D.event_log(spark, sf).drop("about"), "seq", 2)))


@query("validity_stream")
def validity_stream(spark, sf):
    """Deliveries carry the clock of their day, repeated ones that of a month later; time passes with them."""
    ev = D.event_log(spark, sf).drop("about")
    at = F.col("valid_from") + F.when(F.col("seq") >= D.REDELIVERED, 30 * 86400.0).otherwise(0.0)
    ev = ev.withColumn("clock", F.timestamp_seconds(F.lit(1704067200) + at))
    return run_to_end(LS.validity_stream(as_stream(ev, "seq", 2), 1704067200.0)).groupBy("was", "now").agg(F.count("*").alias("n"))


@query("endorsement_stream")
def endorsement_stream(spark, sf):
    """Cases are shown as they come and judged later; every fourth verdict says wrong."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = D.table(spark, sf, "events").select(
        F.concat(F.lit("w"), F.col("user_id") % 10).alias("workspace"), F.col("event_id").alias("seq"),
        F.concat(F.lit("c"), F.col("user_id"), F.lit("-"), F.floor(k / 10)).alias("case_id"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("case")).otherwise(F.lit("verdict")).alias("kind"),
        ((k % 21) / 20.0).alias("confidence"), (k % 4 == 0).alias("wrong"))
    return run_to_end(LS.endorsement_stream(as_stream(e, "seq", 2)))


@query("decision_stream", f"select task_id, action_id, {r6('s')} as s, {r6('belief')} as belief, disposition from assessments")
def decision_stream(spark, sf):
    f = derived_flow(spark, sf)
    path = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    DS.decision_stream(as_stream(f.events, "seq", 2), f, path).trigger(availableNow=True).start().awaitTermination()
    return StateStore(spark, f"{path}/store").table("assessments").select("task_id", "action_id", r("s"), r("belief"), "disposition")


@query("correction_stream", f"select task_id, action_id, {r6('s')} as s, {r6('belief')} as belief, disposition from fixed_acts")
def correction_stream(spark, sf):
    from standpoint.plans.feedback_queries import corrections

    f = derived_flow(spark, sf)
    edges = cut_lineage(f.edges)
    items, gone = corrections(edges)
    n = F.when(F.col("item_id").endswith("-1"), 0).otherwise(1)
    log = (items.select(F.lit("correct").alias("kind"), "item_id", "pair", "label", n.alias("at")).unionByName(
        gone.select(F.lit("retract").alias("kind"), "item_id", F.lit(None).cast("string").alias("pair"), F.lit(None).cast("int").alias("label"), F.lit(1).alias("at"))))
    path = f"{shared_dir(spark)}/corrections-{uuid.uuid4().hex}"
    DS.correction_stream(as_stream(log, "at", 2), edges, f, path).trigger(availableNow=True).start().awaitTermination()
    a = spark.read.parquet(f"{path}/assessments/run=1")
    return a.select("task_id", "action_id", r("s"), r("belief"), "disposition")
