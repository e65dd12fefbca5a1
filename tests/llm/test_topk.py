"""Bit-sliced top-k against plain inner products."""

import math
import random

import numpy as np
import pytest

from standpoint.llm import bit_sliced_topk as bst

ROWS = "vec_id long, embedding array<double>, query string, name string"


def plain(rows, k, every):
    q = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(q):
        if i is not None and i % every == 0:
            near = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), j is None, j or 0) for b, (j, u) in enumerate(q) if b != a and len(u) == len(v))
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(near[:k])]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], ROWS)


@pytest.mark.parametrize("block_values", [300, 1 << 20])
def test_against_plain_products(spark, block_values):
    rng = random.Random(3)
    vec = lambda d, s=1.0: [rng.gauss(0, s) for _ in range(d)]
    rows = [(i, vec(6)) for i in range(120)] + [(200 + i, [1.0, 0.0, -1.0, 0.5, 0.25, 0.0]) for i in range(90)]
    rows += [(20, vec(6)), (20, vec(6)), (None, vec(6)), (None, [1.0] * 6), (-40, vec(6, 1e4)), (41, vec(6, 1e-3)), (-1, [-2.0] * 6)]
    rows += [(500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [math.nan] * 6), (560, [math.inf] * 6), (580, []), (581, []), (600, [1.5]), (601, [2.0]), (620, [1.0, 2.0])]
    index = bst.build(table(spark, rows), block_values=block_values)
    got = sorted((tuple(r) for r in bst.search(index, bst.own_queries(index, 20), 7).collect()), key=str)
    assert got == plain(rows, 7, 20)


def test_all_when_fewer_and_empty(spark):
    rows = [(i, [float(i), 1.0]) for i in range(0, 60, 5)]
    assert sorted((tuple(r) for r in bst.nearest(table(spark, rows)).collect()), key=str) == plain(rows, 20, 20)
    assert bst.nearest(table(spark, rows).limit(0)).count() == 0 and bst.nearest(table(spark, rows[:1])).count() == 0


def test_other_queries(spark):
    rows = [(i, [float(i % 7), -1.0]) for i in range(50)]
    index = bst.build(table(spark, rows))
    got = bst.search(index, bst.queries_from(table(spark, [(1, [1.0, 0.0]), (2, None)])), 3).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(1, 6, 64 * 64 * 6), (1, 13, 64 * 64 * 6), (1, 20, 64 * 64 * 6)]


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(-bst.LIMIT, bst.LIMIT + 1, (130, 9))
    values[5] = bst.LIMIT
    slices, bits = bst.slice_rows(values)
    for w in (values[0], values[5], np.zeros(9, np.int64), np.array([0, 0, -1, 0, 0, 0, 0, 0, 3])):
        total, constant = bst.add_slices(slices, bits, w)
        alive = np.full(3, 2**64 - 1, np.uint64)
        alive[2] = 3
        want = sorted(((-sum(int(a) * int(b) for a, b in zip(w, v, strict=True)), i) for i, v in enumerate(values)))[:20]
        assert sorted((-s, p) for p, s in bst.choose(total, constant, alive, 20)) == want
