"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from standpoint.plans import catalog  # noqa: E402
from standpoint.plans.flow import derived_flow  # noqa: E402
from standpoint.plans.state_store import StateStore  # noqa: E402
from standpoint.session import build_session, shared_dir  # noqa: E402
from standpoint.sources import derive as D  # noqa: E402

HEADLINE = ["ledger_state", "delivery_outcomes", "link_declared", "precedence", "beliefs", "decisions", "assess", "best_question",
            "certify_stable", "cost_per_event", "refresh", "decision_metrics", "summarise", "knn_blend", "threshold_trace",
            "regression_gate", "overlap_audit", "mined_negatives", "split_passages", "disposition_contexts"]


def updates(spark, sf: str) -> dict[str, float]:
    """A stored run over 89 % of the log, then batches of 10 % and of 1 % alone."""
    f = derived_flow(spark, sf)
    n = D.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    cut = lambda a, b: f.events.filter((F.col("seq") >= int(a * n)) & (F.col("seq") < int(b * n)))
    store = StateStore(spark, f"{shared_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}")
    took = {}
    for name, work in (("full", lambda: store.create(derived_flow(spark, sf, events=f.events.filter(F.col("seq") < int(0.89 * n))))),
                       ("batch_10pct", lambda: store.advance(cut(0.89, 0.99), f)), ("batch_1pct", lambda: store.advance(cut(0.99, 2.0), f))):
        t = time.time()
        work()
        took[name] = round(time.time() - t, 3)
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    qs = catalog.queries()
    spark.read.parquet(f"{sf}/events.parquet").count()
    took = {}
    for name in HEADLINE:
        t = time.time()
        qs[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    alone = updates(spark, sf)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "updates": alone,
                      "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
