"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

from standpoint.plans.registry import QUERIES, SQL, full_sql

MODULES = ["ledger_queries", "link_queries", "logic_queries", "planner_queries", "metric_queries", "feedback_queries",
           "corpus_queries", "refresh_queries", "stream_queries"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"standpoint.plans.{m}")


def queries():
    load()
    return dict(QUERIES)


# Columns that are sums of integers: 128 bits wide in the other engine, long in Spark.
INTEGER_SUMS = {
    "read_events": "revisions declared", "ledger_as_of": "active conflicted revisions",
    "ingest_report": "passages applied unchanged withdrawn", "reading_stats": "pairs_requested pairs_computed cache_hits tokens",
    "beliefs": "n_decisive", "cost_per_event": "tokens_update pairs_full tokens_full", "write_table": "total", "ece": "n",
    "binary_ece": "n", "confusion": "pred_0 pred_1 pred_2", "mcnemar_counts": "only_a only_b", "regression_gate": "negative_flips",
    "threshold_trace": "outstanding verdicts errors max_outstanding", "open_confirmations": "open", "usage_by_day": "chars_used",
    "read_labelled_pairs": "labels", "score_reports": "correct repeats_reported",
    "overlap_audit": "pairs_in_train claims_in_train evidence_in_train pages_in_train",
    "task_state": "active withdrawn conflicted expired not_yet_valid",
}


def oracle_sql() -> dict[str, str]:
    load()
    out = {}
    for name in SQL:
        sql = full_sql(name)
        if name in INTEGER_SUMS:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in INTEGER_SUMS[name].split())
            sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"
        out[name] = sql
    return out
