"""Decisions and corrections kept current per micro-batch.

Decisions live in a ``StateStore``: a micro-batch becomes its next version, tagged with the stream and the batch, so a batch that runs
again after a failure changes nothing, a stream that starts over with a new checkpoint goes on from the stored tables, and a batch
writes what it changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from standpoint.operators import beliefs as B
from standpoint.operators import feedback as K
from standpoint.operators import logic as G
from standpoint.plans.flow import Flow
from standpoint.plans.refresh import change_report
from standpoint.plans.state_store import StateStore


def transitions(actions: DataFrame, predicates: DataFrame) -> DataFrame:
    return (actions.select(F.lit("action").alias("kind"), "task_id", F.col("action_id").alias("id"), "was", "now")
            .unionByName(predicates.select(F.lit("predicate").alias("kind"), "task_id", F.col("predicate_id").alias("id"), "was", "now")))


def decision_stream(events: DataFrame, flow: Flow, path: str, name: str | None = None, clock: str | None = None) -> DataStreamWriter:
    """Applies each micro-batch of events to the store under ``path`` and records only transitions of actions and predicates, in
    ``path``/transitions/version=N. ``flow`` supplies everything but the events; where its definitions differ from the stored ones
    the first batch applies them. ``name`` names the checkpoint: the same name goes on where it stopped, a new one takes the
    events it is given as new. ``clock`` (a column of the events) moves the time to the latest of a batch."""
    name = name or uuid.uuid4().hex
    checked = []

    def apply(batch: DataFrame, batch_id: int) -> None:
        store = StateStore(batch.sparkSession, f"{path}/store")
        tag = f"{name}:{batch_id}"
        if store.tag == tag:
            return
        at = f"{path}/transitions/version={store.version + 1}"
        late = batch.agg(F.max(clock)).first()[0] if clock is not None else None
        now = store.now if store.now is not None else flow.now
        now = late if now is None else now if late is None else max(now, late)
        rows = batch if clock is None else batch.drop(clock)
        if store.version < 0:
            f = Flow(rows, flow.predicates, flow.gates, flow.actions, flow.scorer, now, flow.temperature, flow.bias, flow.ready, flow.block, flow.honour_declared, flow.linker)
            t = store.create(f, tag)
            transitions(change_report(t.assessments.limit(0), t.assessments, ["task_id", "action_id"], "disposition", "NEEDS_INFO"),
                        change_report(t.beliefs.limit(0), t.beliefs, ["task_id", "predicate_id"], "status", "UNRESOLVED")).write.mode("overwrite").parquet(at)
        else:
            store.advance(rows, flow, now, tag, definitions=not checked,
                          before=lambda d: transitions(d.report["actions"], d.report["predicates"]).write.mode("overwrite").parquet(at))
        checked.append(batch_id)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/checkpoint-{name}")


def correction_stream(corrections: DataFrame, edges: DataFrame, flow: Flow, path: str) -> DataStreamWriter:
    """Corrections and retractions (kind, item_id, pair, label) take effect with the next micro-batch: they are appended to the
    log, and beliefs and dispositions follow from the stored readings; nothing is read again."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        log = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{path}/log")
        verified = K.correction_log(log.filter("kind = 'correct'").select("item_id", "pair", "label"), log.filter("kind = 'retract'").select("item_id"))
        b = B.beliefs(K.apply_corrections(edges, verified), flow.predicates)
        G.assess(flow.compiled, b, flow.ready, flow.block).write.mode("overwrite").parquet(f"{path}/assessments/run={batch_id}")

    return corrections.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/checkpoint")
