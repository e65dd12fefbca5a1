"""Registered queries against their SQL. A few always run; all of them with -m slow."""

import importlib.util
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

spec = importlib.util.spec_from_file_location("spark_entry", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
QUICK = ["ledger_state", "delivery_outcomes", "link_declared", "beliefs", "assess", "best_question", "kleene_status", "summarise", "knn_blend",
         "threshold_trace", "revision_atoms", "sync_reports", "explain"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(float(v)) if type(v).__name__ == "Decimal" else str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def check(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    got = bag(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == bag(cols, cur.fetchall())


@pytest.mark.parametrize("name", QUICK)
def test_quick(spark, name):
    check(spark, name)


@pytest.mark.slow
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(QUICK)))
def test_every_query(spark, name):
    check(spark, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
