"""Exact top-k by inner product over a bit-sliced index.

``build`` quantises each component x to floor(scale * x) and deals rows evenly over buckets of ``BLOCK_VALUES`` components. A task
sorts its rows by id and writes, per dimension and bit of the two's complement, a bitmap over the block's rows to the shared
folder; the table of blocks is written last, so files of failed tasks are never read. ``search`` meets every query with every
block of its dimension (a stated query set against all rows, in blocks): only query vectors and file names are shuffled, bitmaps
are mapped where they lie. Per query the slices of all attributes are added with carry-save adders, one bitmap per power of two,
where a weight's signed binary digits shift them and negative terms are complements; the k best are chosen from the most
significant slice downward, and rows that tie at the boundary are resolved exactly by id. A block gives at most k rows a query.

Memory of a task: the mapped slices of a block and as many bitmaps as the query has terms. Recall is 1 by construction.

Defined cases: vectors that are null, or hold a null or a component that is not finite, take no part; vectors meet those of their own
length only (empty ones score 0); a row with a null id is a candidate, last among ties, and never a query of ``own_queries``;
rows with one id are candidates for each other, only the query's own row is left out; quantised components beyond 2^31 - 1 are
held there and scores beyond a long at its ends; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from standpoint.llm.common import partitions
from standpoint.llm.shared_files import map_array, save_array
from standpoint.session import cut_lineage, shared_dir

SCALE, K, QUERY_EVERY, BLOCK_VALUES = 64, 20, 20, 64 << 16
LIMIT = 2**31 - 1
BLOCKS = "bucket int, dim int, name string, n int"
OWN = "query long, query_id long, dim int, own string, place int, weights binary"
FOUND = "query long, query_id long, vec_id long, score long"


@dataclass
class Index:
    folder: str
    buckets: int
    blocks: DataFrame


def _usable(v: str):
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def slice_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (dimension, bit, words) of the rows' two's complement, and how many bits each dimension needs."""
    n, dim = values.shape
    words = -(-n // 64)
    largest = np.maximum(values, ~values).max(axis=0) if n and dim else np.zeros(dim, np.int64)
    bits = np.array([int(x).bit_length() + 1 for x in largest], np.int64)
    out = np.zeros((dim, max(bits, default=1), words), np.uint64)
    padded = np.zeros((words * 64, dim), np.int64)
    padded[:n] = values
    for b in range(out.shape[1]):
        column = np.ascontiguousarray(((padded >> b) & 1).astype(np.uint8).T)
        out[:, b] = np.packbits(column, axis=1, bitorder="little").view(np.uint64)
    return out, bits


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE, block_values: int = BLOCK_VALUES) -> Index:
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/slices-{uuid.uuid4().hex}"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(_usable("v"))
    values = rows.agg(F.sum(F.size("v").cast("long") + 1)).first()[0] or 0
    buckets = max(1, math.ceil(values / block_values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = TaskContext.get().partitionId(), {}, 0

        def blocks():
            for dim, parts in sorted(held.items()):
                ids = np.concatenate([p[0] for p in parts])
                vec = np.concatenate([p[1] for p in parts])
                order = np.lexsort((ids[:, 1], ids[:, 0]))
                slices, bits = slice_rows(vec[order])
                name = uuid.uuid4().hex
                for what, a in (("slices", slices), ("bits", bits), ("ids", ids[order])):
                    save_array(folder, f"{name}-{what}.npy", a)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "dim": pa.array([dim], pa.int32()), "name": [name], "n": pa.array([len(ids)], pa.int32())})

        for b in batches:
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            lengths, missing = np.diff(offsets), b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = np.stack([missing.astype(np.int64), b.column(0).fill_null(0).to_numpy()], axis=1)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                q = np.clip(np.floor(scale * flat[offsets[at][:, None] + np.arange(dim)]), -LIMIT, LIMIT).astype(np.int64)
                held.setdefault(dim, []).append((ids[at], q))
                size += len(at) * (dim + 1)
            if size >= 3 * block_values // 2:
                yield from blocks()
                held, size = {}, 0
        yield from blocks()

    return Index(folder, buckets, cut_lineage(rows.repartition(buckets).mapInArrow(run, BLOCKS)))


def own_queries(index: Index, every: int = QUERY_EVERY) -> DataFrame:
    """The indexed rows whose id is divisible by ``every``, as queries that leave their own row out."""
    folder = index.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            ids, slices, bits = (map_array(folder, f"{r['name']}-{what}.npy") for what in ("ids", "slices", "bits"))
            places = np.flatnonzero((ids[:, 0] == 0) & (ids[:, 1] % every == 0))
            for at in np.array_split(places, max(1, len(places) // 1024)):
                if not len(at):
                    continue
                on = ((slices[:, :, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
                power = np.where(np.arange(slices.shape[1]) < bits[:, None], 1 << np.arange(slices.shape[1]), 0)
                power[np.arange(len(bits)), bits - 1] *= -1
                q = np.einsum("jbn,jb->nj", on, power)
                yield pa.RecordBatch.from_pydict({"query_id": ids[at, 1], "dim": pa.array([r["dim"]] * len(at), pa.int32()), "own": [r["name"]] * len(at),
                                                  "place": pa.array(at, pa.int32()), "weights": [x.astype("<i8").tobytes() for x in q]})

    found = index.blocks.mapInArrow(run, "query_id long, dim int, own string, place int, weights binary")
    return found.select(F.xxhash64("own", "place").alias("query"), "*")


def queries_from(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Any other vectors as queries against all indexed rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = [np.clip(np.floor(scale * np.array(v, float)), -LIMIT, LIMIT).astype("<i8").tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"query_id": b.column(0), "dim": pa.array([len(x) // 8 for x in q], pa.int32()),
                                              "own": pa.nulls(len(q), pa.string()), "place": pa.nulls(len(q), pa.int32()), "weights": pa.array(q, pa.binary())})

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(_usable("v"))
    return rows.mapInArrow(run, "query_id long, dim int, own string, place int, weights binary").select(F.xxhash64("query_id", "weights").alias("query"), "*")


def signed_digits(w: np.ndarray) -> np.ndarray:
    """Digits -1, 0, 1 with w = sum of digit * 2^k and no two neighbours set: (k, dimension)."""
    w, out = w.astype(np.int64).copy(), []
    while w.any():
        d = np.where(w & 1, 2 - (w & 3), 0)
        out.append(d)
        w = (w - d) >> 1
    return np.array(out, np.int64).reshape(len(out), len(w))


def add_slices(slices: np.ndarray, bits: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps t and a constant c with, for every row, sum of w * value = c + sum of 2^p where t[p] is set."""
    words = slices.shape[2]
    digits = signed_digits(w)
    k, j = np.nonzero(digits)
    sign = digits[k, j]
    reach = bits[j]
    term = np.repeat(np.arange(len(k)), reach)
    b = np.arange(len(term)) - np.repeat(np.cumsum(reach) - reach, reach)
    power = k[term] + b
    minus = (sign[term] < 0) ^ (b == reach[term] - 1)
    constant = -sum(1 << int(p) for p in power[minus])
    waiting: dict[int, list[np.ndarray]] = {}
    for p in np.unique(power).tolist():
        at = np.flatnonzero(power == p)
        maps = slices[j[term[at]], b[at]]
        maps ^= np.where(minus[at], np.uint64(2**64 - 1), np.uint64(0))[:, None]
        waiting[p] = [maps]
    out, p = [], 0
    while waiting:
        cur = waiting.pop(p, [])
        cur = np.concatenate(cur) if len(cur) > 1 else cur[0] if cur else np.zeros((1, words), np.uint64)
        carries = []
        while len(cur) > 1:
            t = max(len(cur) // 3, 1)
            x, y = cur[:t], cur[t:2 * t]
            half = x ^ y
            carry = x & y
            if len(cur) > 2:
                z = cur[2 * t:3 * t]
                carry |= half & z
                half ^= z
            carries.append(carry)
            cur = np.concatenate([half, cur[3 * t:]]) if len(cur) > 3 * t else half
        if carries:
            waiting.setdefault(p + 1, []).extend(carries)
        out.append(cur[0])
        p += 1
    return out, constant


def _places(bitmap: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` set positions."""
    words = np.flatnonzero(bitmap)[:most]
    on = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
    w, b = np.nonzero(on)
    return (words[w] * 64 + b)[:most]


def choose(total: list[np.ndarray], constant: int, alive: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(place, sum) of the k largest sums among the rows alive; ties go to the smaller place."""
    sure, edge = np.zeros_like(alive), alive.copy()
    n_sure = 0
    if int(np.bitwise_count(edge).sum()) > k:
        for t in reversed(total):
            with_bit = edge & t
            n = n_sure + int(np.bitwise_count(with_bit).sum())
            if n > k:
                edge = with_bit
            else:
                sure |= with_bit
                edge &= ~t
                n_sure = n
                if n == k:
                    break
    places = np.concatenate([_places(sure, k), _places(edge, k - n_sure)])
    sums = [constant] * len(places)
    for p, t in enumerate(total):
        for i, on in enumerate(((t[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).tolist()):
            sums[i] += on << p
    return list(zip(places.tolist(), sums, strict=True))


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows."""
    folder, n = index.folder, partitions(queries)
    slots = math.ceil(4 * n / index.buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = ids = slices = bits = everything = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["name"] != name:
                    name = r["name"]
                    ids, slices, bits = (np.asarray(map_array(folder, f"{name}-{what}.npy")) for what in ("ids", "slices", "bits"))
                    everything = np.zeros(slices.shape[2] * 64, np.uint8)
                    everything[:len(ids)] = 1
                    everything = np.packbits(everything, bitorder="little").view(np.uint64)
                alive = everything
                if r["own"] == name:
                    alive = everything.copy()
                    alive[r["place"] >> 6] &= ~(np.uint64(1) << np.uint64(r["place"] & 63))
                total, constant = add_slices(slices, bits, np.frombuffer(r["weights"], "<i8"))
                out += [(r["query"], r["query_id"], None if ids[p, 0] else int(ids[p, 1]), max(-2**63, min(2**63 - 1, s))) for p, s in choose(total, constant, alive, k)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    pairs = queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(index.buckets - 1)))).join(index.blocks.drop("n"), ["bucket", "dim"])
    dealt = pairs.withColumn("slot", F.pmod("query", F.lit(slots))).repartition(n, "bucket", "slot").sortWithinPartitions("bucket", "name")
    found = dealt.select("query", "query_id", "own", "place", "weights", "name").mapInArrow(run, FOUND)
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """Every row whose id is divisible by ``every`` against all other rows."""
    index = build(vectors)
    return search(index, own_queries(index, every), k)
