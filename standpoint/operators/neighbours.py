"""Exact nearest neighbours by pivots: a query is compared only with the parts of the memory that can hold a neighbour.

Vectors have unit length, so a similarity is the cosine of an angle, and angles obey the triangle inequality. Memory items go to the
pivot (one of at most ``PIVOTS`` memory vectors, those with the smallest hashes) they are closest to; of each part the least and the
largest angle to its pivot are kept. A query at angle t from a pivot is at least t - largest and least - t away from all of its part.

Parts are packed into blocks of up to ``MEMORY_BLOCK`` items (a larger part is cut by hash: copies of one vector may be a third of the
memory), and a query travels once to a block, however many of its parts it meets there. A query first meets the block of the part that
can come closest. Its k-th best there, or ``least`` if that is more, is a similarity that every further neighbour has to reach, so in a
second round it meets only the blocks with a part whose bound does. Inside a block, parts out of reach are left out as well. Products
are taken in single precision to find candidates, with room for its error, and again in double precision for those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from standpoint.operators.scan import spread
from standpoint.session import cut_lineage

QUERY_BLOCK, MEMORY_BLOCK, PIVOTS = 65536, 65536, 4096
LAYERS = 64  # so many different turns of the memory are kept apart
GROUPS = 64  # block pairs that a round is cut into at least, where it has rows for them
SLACK = 1e-7  # angles and products err by less in double precision


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a packed column, one a row."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), float).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def packed(df: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows with ``vec`` as the bytes of its doubles, without those that have no vector or one with gaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lists = b.schema.get_field_index("vec"), b.column("vec")
            width = pc.unique(pc.list_value_length(lists)).to_pylist()
            if len(width) == 1 and width[0] and not lists.null_count and not lists.flatten().null_count:
                mat = lists.flatten().to_numpy().astype(float).reshape(len(lists), -1)
            else:
                mat = [np.full(1, np.nan) if v is None else np.asarray(v, float) for v in lists.to_pylist()]
            rows = [v.tobytes() if len(v) and np.isfinite(v).all() else None for v in mat]
            b = b.set_column(at, "vec", pa.array(rows, pa.binary()))
            yield b.filter(pc.is_valid(b.column("vec")))

    types = dict(df.dtypes)
    columns = [key, *more, "vec"]
    return df.select(*columns).mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'vec' else types[c]}" for c in columns))


@dataclass
class _Cells:
    """Parts of the memory, by turn where turns are kept apart: their pivot, angles, first turn, size, and the blocks they lie in."""

    pivots: np.ndarray
    part: np.ndarray
    near: np.ndarray
    far: np.ndarray
    turn: np.ndarray
    size: np.ndarray
    first: np.ndarray
    pieces: np.ndarray

    @property
    def blocks(self) -> int:
        return int((self.first + self.pieces).max())

    def away(self, vectors: np.ndarray, turns: np.ndarray, which: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(least angle, angle to the pivot) of vectors to cells; out of reach where all items are of a later turn."""
        used, place = np.unique(self.part[which], return_inverse=True)
        t = _angles(vectors, self.pivots[used])[:, place]
        away = np.maximum(np.maximum(t - self.far[which], self.near[which] - t), 0.0)
        away[turns[:, None] <= self.turn[which][None, :]] = np.inf
        return away, t


def _cells(parts: DataFrame, pivots: np.ndarray, memory_block: int) -> tuple[_Cells, dict[tuple[int, int], int]]:
    """The cells of a memory, and the number of each (layer, part)."""
    rows = sorted(parts.groupBy("layer", "part").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.min("turn").alias("turn"),
                                                     F.count("*").alias("n")).collect(), key=lambda r: (r.layer, r.part))
    first, pieces, block, filled, layer = [], [], 0, 0, None
    for r in rows:  # at most LAYERS rows a pivot
        if filled and (r.layer != layer or filled + r.n > memory_block):
            block, filled = block + 1, 0
        n = ceil(r.n / memory_block)
        first.append(block)
        pieces.append(n)
        block, filled, layer = (block + n, 0, r.layer) if n > 1 else (block, filled + r.n, r.layer)
    a = lambda xs, kind: np.array(xs, kind)
    return _Cells(pivots, a([r.part for r in rows], int), a([r.lo for r in rows], float), a([r.hi for r in rows], float),
                  a([r.turn for r in rows], int), a([r.n for r in rows], int), a(first, int), a(pieces, int)), {(r.layer, r.part): i for i, r in enumerate(rows)}


def partitioned(memory: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Memory rows with their part and their angle to its pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            angles = _angles(_matrix(b.column("vec")), pivots)
            part = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32)), pa.array(angles[np.arange(len(part)), part])], names=[*b.schema.names, "part", "angle"])

    types = dict(memory.dtypes)
    columns = ["item_id", "label", "vec", "turn", "layer", "hash"]
    return memory.select(*columns).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns) + ", part int, angle double")


def _placed(parts: DataFrame, cells: _Cells, index: dict) -> DataFrame:
    """Memory rows with their cell and block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.array([index[k] for k in zip(b.column("layer").to_pylist(), b.column("part").to_pylist())], np.int64)
            block = cells.first[cell] + b.column("hash").to_numpy() % cells.pieces[cell] if len(cell) else cell
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("item_id", "label", "vec", "turn")), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))],
                                             names=["item_id", "label", "vec", "turn", "cell", "block"])

    types = dict(parts.dtypes)
    return parts.select("item_id", "label", "vec", "turn", "layer", "hash", "part").mapInArrow(
        run, f"item_id {types['item_id']}, label {types['label']}, vec binary, turn long, cell int, block int")


def _homes(queries: DataFrame, cells: _Cells) -> DataFrame:
    """Queries with the cell that can come closest, of several the one with the closest pivot, and a block of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            away, t = cells.away(_matrix(b.column("vec")), b.column("turn").to_numpy())
            home = np.where(away <= away.min(axis=1, keepdims=True), t, np.inf).argmin(axis=1)
            block = cells.first[home] + b.column("hash").to_numpy() % cells.pieces[home]
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(block.astype(np.int32))], names=[*b.schema.names, "home", "block"])
            yield out.filter(pa.array(np.isfinite(away.min(axis=1))))  # nothing is earlier than the others

    types = dict(queries.dtypes)
    return queries.select("qid", "vec", "turn", "hash").mapInArrow(run, f"qid {types['qid']}, vec binary, turn long, hash long, home int, block int")


def _others(asked: DataFrame, cells: _Cells) -> DataFrame:
    """A row for each block but its own where a query meets a cell whose bound lets it reach ``reach``, with the items of those cells there."""
    lies = np.zeros((len(cells.part), cells.blocks), np.float32)
    for c, (first, n) in enumerate(zip(cells.first, cells.pieces)):
        lies[c, first:first + n] = cells.size[c] / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            away, _ = cells.away(_matrix(b.column("vec")), b.column("turn").to_numpy())
            meets = away <= np.arccos(np.clip(b.column("reach").to_numpy(), -1.0, 1.0))[:, None] + SLACK
            items = meets.astype(np.float32) @ lies
            items[np.arange(len(items)), b.column("block").to_numpy()] = 0
            row, block = np.nonzero(items)
            taken = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("qid", "vec", "turn", "hash", "home", "reach")), pa.array(block.astype(np.int32)),
                                              pa.array(np.rint(items[row, block]).astype(np.int64))],
                                             names=["qid", "vec", "turn", "hash", "home", "reach", "block", "compared"])

    types = dict(asked.dtypes)
    return asked.select("qid", "vec", "turn", "hash", "home", "reach", "block").mapInArrow(
        run, f"qid {types['qid']}, vec binary, turn long, hash long, home int, reach double, block int, compared long")


class _Block:
    """The items of one block, by id, against the queries that meet it."""

    def __init__(self, cells: _Cells, b: pa.Table, k: int, exclude_self: bool):
        self.table = b.take(pc.sort_indices(b, sort_keys=[("item_id", "ascending")], null_placement="at_start"))
        self.cells, self.k, self.exclude_self = cells, k, exclude_self
        self.mat = _matrix(self.table["vec"])
        self.small = self.mat.astype(np.float32)
        self.turns = self.table["turn"].to_numpy()
        self.which, self.cell = np.unique(self.table["cell"].to_numpy(), return_inverse=True)
        self.sizes = np.bincount(self.cell)
        self.ids = np.array(self.table["item_id"].to_pylist(), object) if exclude_self else None
        self.error = 4 * self.mat.shape[1] * float(np.finfo(np.float32).eps)

    def sims(self, vec: np.ndarray, turns: np.ndarray, qids, cols: np.ndarray | slice) -> np.ndarray:
        s = vec.astype(np.float32) @ self.small[cols].T
        later = self.turns[cols]
        if len(later) and turns.min() <= later.max():
            s[turns[:, None] <= later[None, :]] = -np.inf
        if self.exclude_self:
            s[np.equal(qids[:, None], self.ids[cols][None, :]).astype(bool)] = -np.inf
        return s

    def floor(self, s: np.ndarray) -> np.ndarray:
        """A similarity that at least k items of each row reach: the k-th largest maximum of groups of items."""
        n = s.shape[1]
        if n < self.k:
            return np.full(len(s), -np.inf)
        wide = n // (16 * self.k)
        if wide > 1:
            s = s[:, :n // wide * wide].reshape(len(s), -1, wide).max(axis=2)
        return np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k].astype(float)

    def best(self, vec: np.ndarray, turns: np.ndarray, qids, reach: np.ndarray, cells: np.ndarray) -> tuple:
        """(row, item, similarity) of the k best of each row among the items of ``cells`` that reach ``reach``."""
        cols = slice(None) if cells.all() else np.nonzero(cells[self.cell])[0]
        s = self.sims(vec, turns, qids, cols)
        least = np.maximum(reach, self.floor(s)) - self.error
        row, col = np.nonzero((s >= least[:, None].astype(np.float32)) & (s > -np.inf))
        if not isinstance(cols, slice):
            col = cols[col]
        exact = np.concatenate([np.einsum("ij,ij->i", vec[row[i:i + 65536]], self.mat[col[i:i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
        order = np.lexsort((-exact, row))
        row, col, exact = row[order], col[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[keep], col[keep], exact[keep]

    def slices(self, home: np.ndarray, meets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of queries of like homes with the cells that any of them meets; runs are joined while that adds little work."""
        cuts = [0, *(np.nonzero(np.diff(home))[0] + 1).tolist(), len(home)]
        begin, cells, done = 0, None, 0
        for lo, hi in ((i, min(i + 256, b)) for a, b in zip(cuts, cuts[1:]) for i in range(a, b, 256)):
            mine = meets[lo:hi].any(axis=0)
            if cells is not None:
                both, cost = cells | mine, done + (hi - lo) * self.sizes[mine].sum()
                if hi - begin <= 512 and (hi - begin) * self.sizes[both].sum() <= 1.1 * cost:
                    cells, done = both, cost
                    continue
                yield begin, lo, cells
            begin, cells, done = lo, mine, (hi - lo) * self.sizes[mine].sum()
        if cells is not None:
            yield begin, len(home), cells


def _compare(visits: DataFrame, placed: DataFrame, cells: _Cells, k: int, exclude_self: bool, least: float, query_block: int) -> DataFrame:
    """A row per query and block with the k best there that are of an earlier turn. Queries without a ``reach`` get one: by the items of
    their home cell first, then by all that is found."""
    spark = visits.sparkSession
    opening = "reach" not in visits.columns
    counts = visits.groupBy("block").agg(F.count("*").alias("n")).collect()  # a row per block
    total = max(1, sum(r.n for r in counts))
    nq = {r.block: max(ceil(r.n / query_block), min(ceil(r.n / 1024), ceil(GROUPS * r.n / total))) for r in counts}
    sizes = spark.createDataFrame([*nq.items()], "block int, nq int")
    keys = ["block", "qb"]
    q = visits.join(F.broadcast(sizes), "block").withColumn("qb", F.pmod("hash", F.col("nq")).cast("int")).drop("nq")
    m = (placed.join(F.broadcast(sizes), "block").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
         .select(*keys, "item_id", "label", "vec", "turn", "cell"))
    qt, it, lt = dict(visits.dtypes)["qid"], dict(placed.dtypes)["item_id"], dict(placed.dtypes)["label"]
    carried = ["qid", "vec", "turn", "hash", "home", "block"] if opening else ["qid"]
    schema = ", ".join(f"{c} {dict(visits.dtypes)[c]}" for c in carried) + ", " + ("reach double, compared long, " if opening else "") + (
        f"items array<{it}>, labels array<{lt}>, sims array<double>")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.take(pc.sort_indices(a["home"]))
        vec, turns, home = _matrix(a["vec"]), a["turn"].to_numpy(), a["home"].to_numpy()
        qids = np.array(a["qid"].to_pylist(), object) if exclude_self else None
        block = _Block(cells, b, k, exclude_self)
        reach = np.full(len(a), least) if opening else a["reach"].to_numpy()
        found, compared = [], np.zeros(len(a), np.int64)
        step = 1024
        for start in range(0, len(a), step):
            at = slice(start, start + step)
            v, t, h, x = vec[at], turns[at], home[at], None if qids is None else qids[at]
            want = reach[at].copy()
            if opening:
                for c in np.unique(h):
                    mine = np.nonzero(h == c)[0]
                    cols = np.nonzero(block.cell == np.searchsorted(block.which, c))[0]
                    for i in range(0, len(mine), 256):
                        some = mine[i:i + 256]
                        s = block.sims(v[some], t[some], None if x is None else x[some], cols)
                        want[some] = np.maximum(want[some], block.floor(s) - block.error)
            away, _ = cells.away(v, t, block.which)
            meets = away <= np.arccos(np.clip(want, -1.0, 1.0))[:, None] + SLACK
            if opening:
                meets[np.arange(len(v)), np.searchsorted(block.which, h)] = True
                compared[at] = meets @ block.sizes
            for lo, hi, some in block.slices(h, meets):
                row, col, sim = block.best(v[lo:hi], t[lo:hi], None if x is None else x[lo:hi], want[lo:hi], some)
                found.append((row + start + lo, col, sim))
        row, col, sim = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        n = np.bincount(row, minlength=len(a))
        ends = np.concatenate([[0], np.cumsum(n)])
        taken = block.table.select(["item_id", "label"]).take(pa.array(col, pa.int64())).combine_chunks()
        flat = lambda c: taken[c].combine_chunks() if taken.num_rows else pa.array([], taken.schema.field(c).type)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), z) for z in (flat("item_id"), flat("label"), pa.array(sim, pa.float64()))]
        columns = [a[c] for c in carried]
        if opening:
            kth = np.where(n >= k, sim[np.maximum(ends[1:] - 1, 0)] if len(sim) else -1.0, -1.0)
            columns += [pa.array(np.maximum(kth, least)), pa.array(compared)]
        out = pa.table([*columns, *lists], names=[*carried, *(["reach", "compared"] if opening else []), "items", "labels", "sims"])
        return out if opening else out.filter(pa.array(n > 0))

    # a memory row per block pair and few, large groups: rows are dealt over all partitions, not over few for their bytes
    return spread(q, *keys).groupBy(*keys).cogroup(spread(m, *keys).groupBy(*keys)).applyInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "item_id"))
    return found.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p")


def search(queries: DataFrame, memory: DataFrame, k: int = 8, exclude_self: bool = False, least: float = -1.0,
           query_block: int = QUERY_BLOCK, memory_block: int = MEMORY_BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(neighbours, work): the k most similar memory items of each query, (qid, item_id, label, sim), and the number of pairs
    that bounds leave to compare in each round. Items below ``least`` may be left out. Where both sides carry a ``turn``, a query has the
    items of earlier turns only. ``qid`` and ``item_id`` are unique; equal similarities go to the smaller item."""
    turn = "turn" in queries.columns and "turn" in memory.columns
    queries = queries.select("qid", "vec", (F.col("turn") if turn else F.lit(1)).cast("long").alias("turn"), F.pmod(F.xxhash64("qid"), F.lit(1 << 40)).alias("hash"))
    memory = memory.select("item_id", "label", "vec", (F.col("turn") if turn else F.lit(0)).cast("long").alias("turn"), F.pmod(F.xxhash64("item_id"), F.lit(1 << 40)).alias("hash"))
    qt, mt = dict(queries.dtypes), dict(memory.dtypes)
    memory = cut_lineage(packed(memory, "item_id", "label", "turn", "hash"))
    n = memory.count()
    layers = memory.select("turn").distinct().limit(LAYERS + 1).count()
    memory = memory.withColumn("layer", F.col("turn") if layers <= LAYERS else F.lit(0).cast("long"))
    # as many pivots as the square root of the memory, so that pivots and parts cost a query alike
    chosen = memory.select("vec").orderBy("hash", "item_id").limit(min(pivots, ceil(n**0.5))).collect() if n else []
    if not chosen:
        spark = queries.sparkSession
        return (spark.createDataFrame([], f"qid {qt['qid']}, item_id {mt['item_id']}, label {mt['label']}, sim double"), spark.createDataFrame([], "round int, compared long"))
    vectors = np.unique(np.array([np.frombuffer(r.vec) for r in chosen], float), axis=0)
    parts = cut_lineage(partitioned(memory, vectors))
    cells, index = _cells(parts, vectors, memory_block)
    placed = _placed(parts, cells, index)
    homes = cut_lineage(_homes(packed(queries, "qid", "turn", "hash"), cells))
    first = cut_lineage(_compare(homes, placed, cells, k, exclude_self, float(least), query_block))
    visits = cut_lineage(_others(first, cells))
    second = _compare(visits, placed, cells, k, exclude_self, float(least), query_block)
    found = first.select("qid", "items", "labels", "sims").unionByName(second).select("qid", F.explode(F.arrays_zip("items", "labels", "sims")).alias("f")).select(
        "qid", F.col("f.items").alias("item_id"), F.col("f.labels").alias("label"), F.col("f.sims").alias("sim"))
    work = [v.agg(F.lit(i + 1).alias("round"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared")) for i, v in enumerate((first, visits))]
    return _ranked(found, k), work[0].unionByName(work[1])
