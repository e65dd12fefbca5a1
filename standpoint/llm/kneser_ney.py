"""Interpolated modified Kneser-Ney language model, counted in Spark, stored as sorted hash arrays, mapped by workers.

Tokens are 64-bit hashes of words. ``train`` counts n-grams of the highest order per partition, packs them by bucket of
their context and adds them up one bucket at a time. The same pass over a bucket writes its arrays (sorted n-gram hashes with
counts; sorted context hashes with their totals and the numbers of n-grams seen once, twice, more often) and hands the
distinct suffixes on as continuation counts of the next lower order. The driver only sees counts of counts, from which the
three discounts of each order follow. ``score`` maps the arrays and looks tokens up in sorted batches; a worker touches
only the pages it needs. There are as many buckets as shuffle partitions, and a task packs what many of its buckets hand
on together, so the number of packed rows stays in proportion to tasks times buckets.

Model of a word w after context h: (max(c(hw) - D(c), 0) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) p(w | h without its first word)) / c(h),
the lowest order ending in 1 / (V + 1), V being the words seen and 1 the unseen. Texts begin after a boundary and end with
a token of their own.

Defined cases: null and empty texts are one end token; a null ``doc_id`` is trained on; repeated rows count as often as they
occur; with nothing to train on every probability is 1 / (V + 1) = 1; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standpoint.llm.common import partitions
from standpoint.llm.shared_files import map_array, save_array
from standpoint.llm.simhash_anchors import LOWER
from standpoint.session import cut_lineage, shared_dir

#: Order 2 keeps shuffle and model within four times the input; higher orders work the same way.
ORDER = 2
FLUSH, SCORE_TOKENS = 1_000_000, 400_000
END, START = (xxhash.xxh64_intdigest(x) for x in (b"\n", b" "))
PACKED = "level int, bucket long, payload binary"
STATS = "c1 long, c2 long, c3 long, c4 long, total long, types long"


def token_hashes(text: str | None) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return [digest(w) for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def context_hash(grams: np.ndarray) -> np.ndarray:
    """Of all columns but the last; of unigrams, zero."""
    h = np.zeros(len(grams), np.uint64)
    for i in range(grams.shape[1] - 1):
        h = mix(h, grams[:, i])
    return h


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    spread = mix(np.zeros(len(grams), np.uint64), grams[:, 0]) if grams.shape[1] == 1 else context_hash(grams)
    return (spread >> np.uint64(24)) % np.uint64(buckets)


def add_up(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, sorted, with the sums of their counts."""
    if not len(grams):
        return grams, counts
    order = np.lexsort(grams.T[::-1])
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
    return grams[first], np.add.reduceat(counts, first)


def pack(level: int, grams: np.ndarray, counts: np.ndarray, buckets: int):
    """A row per bucket: the n-grams by columns and their counts, compressed."""
    grams, counts = add_up(grams, counts)
    at = bucket_of(grams, buckets)
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(buckets + 1, dtype=np.uint64))
    compress = zstandard.ZstdCompressor(level=1).compress
    rows = []
    for b in range(buckets):
        take = order[edges[b]:edges[b + 1]]
        if len(take):
            g = grams[take]
            planes = [np.ascontiguousarray(np.diff(g[:, 0], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()]
            planes += [g[:, i].tobytes() for i in range(1, g.shape[1])]
            c = counts[take]
            small = np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype(np.int64).tobytes()
            rows.append((level, b, len(take).to_bytes(8, "little") + compress(b"".join([*planes, small]))))
    for i in range(0, len(rows), 64):
        part = rows[i:i + 64]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.binary())],
                                         names=["level", "bucket", "payload"])


def unpack(payload: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[8:]), np.uint8)
    first = np.cumsum(np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    rest = [raw[8 * n * i:8 * n * (i + 1)].view(np.uint64) for i in range(1, order)]
    small = raw[8 * n * order:8 * n * order + n].astype(np.int64)
    small[small == 255] = np.frombuffer(raw[8 * n * order + n:].tobytes(), np.int64)
    return np.column_stack([first, *rest]), small


def grams_of(texts: list[str | None], order: int) -> np.ndarray:
    """All n-grams of the texts, one per token."""
    ids: list[int] = []
    for t in texts:
        ids += [START] * (order - 1) + token_hashes(t) + [END]
    x = np.array(ids, np.uint64)
    m = len(x) - order + 1
    g = np.column_stack([x[i:i + m] for i in range(order)])
    return g[g[:, -1] != np.uint64(START)] if order > 1 else g


def _count(order: int, buckets: int):
    def run(batches):
        texts, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                texts.append(t)
                size += len(t or "") // 5 + 1
                if size >= FLUSH:
                    yield from out(texts)
                    texts, size = [], 0
        if texts:
            yield from out(texts)

    def out(texts):
        g = grams_of(texts, order)
        one = np.ones(len(g), np.int64)
        yield from pack(order, g, one, buckets)
        yield from pack(0, g[:, -1:], one, buckets)

    return run


def _by_bucket(batches):
    """(bucket, rows) of a partition sorted by bucket."""
    now, held = None, []
    for b in batches:
        for level, bucket, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((level, payload))
    if held:
        yield now, held


def _gather(rows, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(p, width) for lv, p in rows if lv == level]
    if not parts:
        return np.zeros((0, width), np.uint64), np.zeros(0, np.int64)
    return add_up(np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts]))


def _stats(counts: np.ndarray) -> list[int]:
    return [*(int((counts == i).sum()) for i in range(1, 5)), int(counts.sum()), len(counts)]


OUT = f"{PACKED}, of int, {STATS}"


def _row(level=None, bucket=None, payload=None, of=None, stats=None):
    return pa.RecordBatch.from_arrays(
        [pa.array([level], pa.int32()), pa.array([bucket], pa.int64()), pa.array([payload], pa.binary()), pa.array([of], pa.int32()),
         *[pa.array([None if stats is None else s], pa.int64()) for s in (stats or [0] * 6)]],
        names=["level", "bucket", "payload", "of", "c1", "c2", "c3", "c4", "total", "types"])


def _reduce(level: int, buckets: int, folder: str):
    def suffixes(held):
        g = np.concatenate(held)
        for batch in pack(level - 1, g, np.ones(len(g), np.int64), buckets):
            for lv, b, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield _row(lv, b, p)

    def run(batches):
        held, size = [], 0
        for bucket, rows in _by_bucket(batches):
            g, c = _gather(rows, level, level)
            key = mix(context_hash(g), g[:, -1])
            order = np.argsort(key)
            save_array(folder, f"{level}-{bucket}-keys.npy", key[order])
            save_array(folder, f"{level}-{bucket}-counts.npy", c[order].astype(np.uint32 if c.max(initial=0) < 2**32 else np.uint64))
            if level > 1:
                ctx = context_hash(g)
                names, at = np.unique(ctx, return_inverse=True)
                n = np.zeros((len(names), 4), np.int64)
                np.add.at(n[:, 0], at, c)
                for i in (1, 2, 3):
                    np.add.at(n[:, i], at[(c == i) if i < 3 else (c >= 3)], 1)
                save_array(folder, f"{level}-{bucket}-contexts.npy", names)
                save_array(folder, f"{level}-{bucket}-totals.npy", n)
                held.append(g[:, 1:])
                size += len(g)
                if size >= FLUSH:
                    yield from suffixes(held)
                    held, size = [], 0
                raw, rc = _gather(rows, 0, 1)  # added up here, written with the lowest order
                for batch in pack(0, raw, rc, buckets):
                    yield _row(0, bucket, batch.column(2)[0].as_py())
            else:
                raw, rc = _gather(rows, 0, 1)
                ids = raw[:, 0]
                save_array(folder, f"0-{bucket}-keys.npy", ids)  # sorted
                save_array(folder, f"0-{bucket}-counts.npy", rc)
                yield _row(of=0, stats=_stats(rc))
            yield _row(of=level, stats=_stats(c))
        if held:
            yield from suffixes(held)

    return run


def discounts(c1: int, c2: int, c3: int, c4: int) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen one to four times. Where there are none to estimate from, half the count;
    a tenth at least, so that unseen words keep some probability."""
    ratios = [(c1, c2), (c2, c3), (c3, c4)]
    y = c1 / (c1 + 2 * c2) if c1 else 0.0
    return [min(float(i), max(0.1, i - (i + 1) * y * b / a)) if a and c1 else 0.5 * i for i, (a, b) in enumerate(ratios, 1)]


def _left(stats) -> float:
    """Probability mass, in counts, that discounting takes from the words seen."""
    d = discounts(stats.c1, stats.c2, stats.c3, stats.c4)
    return d[0] * stats.c1 + d[1] * stats.c2 + d[2] * (stats.types - stats.c1 - stats.c2)


def train(texts: DataFrame, order: int = ORDER) -> dict:
    """Counts ``text`` of all rows; returns the small description of the model that ``score`` needs."""
    spark = texts.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/kneser-ney-{uuid.uuid4().hex}"
    width = partitions(texts)
    buckets = width
    packed = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(order, buckets), PACKED)
    model = {"folder": folder, "order": order, "buckets": buckets, "discounts": {}, "totals": {}, "types": {}, "left": 0.0}
    for level in range(order, 0, -1):
        got = cut_lineage(packed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_reduce(level, buckets, folder), OUT))
        for r in got.where("of IS NOT NULL").groupBy("of").agg(*[F.sum(c).alias(c) for c in ("c1", "c2", "c3", "c4", "total", "types")]).collect():
            model["discounts"][r.of] = discounts(r.c1, r.c2, r.c3, r.c4)
            model["totals"][r.of], model["types"][r.of] = r.total, r.types
            if r.of == 1:
                model["left"] = _left(r)
        packed = got.where("of IS NULL").select("level", "bucket", "payload")
    return model


class Reader:
    """Looks hashes up in the mapped arrays of one model."""

    def __init__(self, model: dict):
        self.model, self.open = model, {}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            try:
                self.open[name] = map_array(self.model["folder"], name)
            except FileNotFoundError:
                self.open[name] = None  # a bucket without n-grams
        return self.open[name]

    def find(self, level: int, bucket: np.ndarray, key: np.ndarray, keys: str, values: str, columns: int = 1) -> np.ndarray:
        """Values of the keys, zero where a key is unknown."""
        out = np.zeros((len(key), columns), np.int64)
        order = np.lexsort((key, bucket))
        edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(key) else []
        for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
            take = order[a:b]
            stem = f"{level}-{int(bucket[take[0]])}-"
            table = self.array(f"{stem}{keys}.npy")
            if table is None or not len(table):
                continue
            wanted = key[take]
            at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
            hit = table[at] == wanted
            out[take[hit]] = self.array(f"{stem}{values}.npy")[at[hit]].reshape(-1, columns)
        return out

    def probabilities(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the last word after the others, raw count of the last word) per row."""
        m, order = self.model, self.model["order"]
        p = np.full(len(grams), 1.0 / (m["types"].get(0, 0) + 1))
        for level in range(1, order + 1):
            g = grams[:, order - level:]
            bucket, ctx = bucket_of(g, m["buckets"]), context_hash(g)
            c = self.find(level, bucket, mix(ctx, g[:, -1]), "keys", "counts")[:, 0]
            d = np.array([0.0, *m["discounts"].get(level, [0.0] * 3)])
            less = np.maximum(c - d[np.minimum(c, 3)], 0)
            if level == 1:
                total = m["totals"].get(1, 0)
                p = (less + m["left"] * p) / total if total else p
            else:
                t = self.find(level, bucket, ctx, "contexts", "totals", 4)
                total = t[:, 0]
                mixed = (less + (t[:, 1:] * d[1:]).sum(axis=1) * p) / np.maximum(total, 1)
                p = np.where(total > 0, mixed, p)
        last = grams[:, -1:]
        raw = self.find(0, bucket_of(last, m["buckets"]), last[:, 0], "keys", "counts")[:, 0]
        return p, raw


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``docs``."""
    fields = [docs.schema[c] for c in keep]
    extra = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    schema = T.StructType(fields + extra)
    total, types = model["totals"].get(0, 0), model["types"].get(0, 0)
    order = model["order"]

    def run(batches):
        reader = Reader(model)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            rows, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t or "") // 5 + 1
                if size >= SCORE_TOKENS:
                    rows += of(reader, held)
                    held, size = [], 0
            if held:
                rows += of(reader, held)
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.float64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *columns], names=[f.name for f in schema.fields])

    def of(reader, texts):
        grams = grams_of(texts, order)
        p, raw = reader.probabilities(grams)
        starts = np.flatnonzero(np.concatenate([[True], grams[:-1, -1] == np.uint64(END)]))
        base = np.log10((raw + 0.5) / (total + 0.5 * (types + 1)))
        n = np.diff(np.append(starts, len(grams)))
        known = np.add.reduceat((raw > 0).astype(np.int64), starts)
        return list(zip(n.tolist(), known.tolist(), [total] * len(n), np.add.reduceat(base, starts).tolist(), np.add.reduceat(np.log10(p), starts).tolist(), strict=True))

    return docs.select(*keep, F.col("text").cast("string").alias("__kn_text")).mapInArrow(run, schema)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): the model of the rows that are not held
    out (crc32 of the id modulo 5 is not 1) scores all rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(d, train(d.where("NOT held_out"), order), ["doc_id", "held_out"])
