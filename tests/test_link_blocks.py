"""Links by similarity, compared in blocks."""

import numpy as np
import pytest

from standpoint.operators import feedback as K
from standpoint.operators import links as LK


@pytest.fixture(scope="module")
def sides(spark):
    g = np.random.default_rng(3)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    a, b = unit(g.normal(size=(40, 4))), unit(g.normal(size=(30, 4)))
    rec = [(f"t{i % 2}", i, v) for i, v in enumerate(a)] + [("t0", 40, None), (None, 41, a[0])]
    pred = [(f"t{i % 2}", i, v) for i, v in enumerate(b)] + [("t1", 30, None)]
    return (rec, pred, spark.createDataFrame(rec, "task_id string, record_id long, vec array<double>"),
            spark.createDataFrame(pred, "task_id string, predicate_id long, vec array<double>"))


@pytest.mark.parametrize("blocks", [(100, 100), (7, 4)])
def test_links_are_the_same_in_blocks_of_any_size(sides, blocks):
    rec, pred, records, predicates = sides
    got = {(r["task_id"], r["record_id"], r["predicate_id"]): r["sim"] for r in LK.propose_links(records, predicates, 0.9, 2, *blocks).collect()}
    want = {}
    for t, i, v in rec:
        sims = [(None if v is None or w is None else float(np.dot(v, w)), j) for s, j, w in pred if s == t]
        hit = [x for x in sims if x[0] is not None and x[0] >= 0.9]
        best = hit if len(hit) >= 2 else sorted(sims, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:2]
        want |= {(t, i, j): s for s, j in best}
    assert got.keys() == want.keys() and all(got[k] == (None if s is None else pytest.approx(s, abs=1e-12)) for k, s in want.items())


def test_counts_are_those_of_all_pairs(sides):
    rec, pred, records, predicates = sides
    ts = [-0.5, 0.0, 0.25, 0.8]
    counts = LK.count_links(records, predicates, ts, lambda r, p: r[:, None] % 3 == p[None, :] % 3, ("record_id",), 7, 4)
    pairs = LK.propose_links(records, predicates, -2.0).selectExpr("*", "record_id % 3 = predicate_id % 3 as linked")
    rows = lambda d: {(r["record_id"], r["threshold"]): (round(r["miss"], 9), round(r["kept"], 9)) for r in d.collect()}
    assert rows(K.miss_by_threshold(counts, ts, ("record_id",))) == rows(K.miss_by_threshold(pairs, ts, ("record_id",)))
    assert LK.link_quality(counts, 0.25, ("record_id",)).first() == LK.link_quality(pairs, 0.25, ("record_id",)).first()
