"""Exact substring deduplication by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id. Two suffixes that agree on
``LENGTH`` bytes agree on a cover sample: positions modulo ``PERIOD`` in the perfect difference set ``COVER`` are sampled, and for any
two positions there is a shift under ``PERIOD`` that brings both onto samples. So the construction is:

1. *Cover sample.* Each chunk of documents sends its distinct sample strings (``LENGTH - PERIOD + 1`` bytes, hashed) to buckets. A
   bucket is sorted alone and tells each chunk which of its samples occur elsewhere. Suffixes whose samples are all
   unique can repeat nothing and are never emitted.
2. *Suffix buckets.* A repeated sample has a rank (its hash; equal strings, equal ranks). The suffixes up to ``PERIOD - 1`` bytes
   before it go, as the sample's rank and the bytes around it, to the bucket of that rank. Buckets are sorted one at a time, shift by
   shift: two suffixes compare by their bytes before the sample, then, instead of by the long tie, by the rank of the
   sample, then by the bytes after it. The smallest id in each class of equal strings decides who is a repeat.
3. Each chunk marks the repeats among its suffixes and measures what remains.

Memory is bounded by a chunk (``CHUNK_BYTES``, or one longer text) and a bucket. Within a chunk equal contexts travel once, with
their smallest id; exact copies of a document never travel at all, as they are settled by a hash of the whole text.
Chunks are kept in a table bucketed by chunk, so the answers join them without moving texts again. Comparison of bytes is by
64-bit hashes within a bucket.

Defined cases: null and empty texts have nothing to remove; a null id counts as larger than all others; rows of one id
do not remove from each other; repeated rows get equal results; texts below ``LENGTH`` bytes stay; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standpoint.llm.common import partitions
from standpoint.llm.kneser_ney import mix
from standpoint.session import cut_lineage, shared_dir

LENGTH, PERIOD, COVER = 50, 31, (0, 1, 3, 8, 12, 18)
SAMPLE = LENGTH - PERIOD + 1
SIDE = PERIOD - 1
CHUNK_BYTES = 4 << 20
NULL_ID = 2**63 - 1
CHUNKS = "chunk long, ids binary, hashes binary, ends binary, body binary"
PACKED = "bucket long, chunk long, payload binary"
RESULT = "k long, hash binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _chunks(batches):
    """Rows (k, hash, text) packed into chunks."""
    ids, hashes, texts, size = [], [], [], 0

    def close():
        body = b"".join(texts)
        name = int.from_bytes(hashlib.sha256(b"".join(hashes)).digest()[:8], "little", signed=True)
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        return _batch(CHUNKS, [(name, np.array(ids, np.int64).tobytes(), b"".join(hashes), ends.tobytes(), zstandard.ZstdCompressor(level=3).compress(body))])

    for b in batches:
        for k, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            ids.append(k)
            hashes.append(h)
            texts.append(t)
            size += len(t)
            if size >= CHUNK_BYTES:
                yield close()
                ids, hashes, texts, size = [], [], [], 0
    if ids:
        yield close()


class Chunk:
    """The texts of a chunk and its cover sample, the same whenever it is opened."""

    def __init__(self, ids: bytes, ends: bytes, body: bytes):
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(body) if self.ends[-1] else b""
        self.n = len(raw)
        # SIDE bytes of padding on either side, so that contexts can be cut anywhere
        self.text = np.frombuffer(b"\0" * LENGTH + raw + b"\0" * (2 * LENGTH), np.uint8)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.ends, prepend=0))
        at = np.concatenate([np.arange(c, max(c, self.n), PERIOD) for c in COVER]) if self.n else np.zeros(0, np.int64)
        at = at[at < self.n]
        at = at[at + SAMPLE <= self.ends[self.doc[at]]]
        key = self.hashed(at)
        order = np.argsort(key, kind="stable")
        self.at, self.key = at[order], key[order]
        self.first = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.unique = self.key[self.first]
        self.copies = np.diff(np.append(self.first, len(self.key)))

    def cut(self, at: np.ndarray, width: int) -> np.ndarray:
        """Rows of ``width`` bytes from each position."""
        return np.lib.stride_tricks.sliding_window_view(self.text, width)[at + LENGTH]

    def hashed(self, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(0, SAMPLE, 8):
            word = np.zeros((len(at), 8), np.uint8)
            word[:, :min(8, SAMPLE - i)] = self.cut(at + i, min(8, SAMPLE - i))
            h = mix(h, word.view(np.uint64)[:, 0])
        return h

    def contexts(self, flags: np.ndarray):
        """Of repeated samples: rank, smallest id, bytes before and after, how many of them belong to the document; then
        the positions, and for each position the number of its context and whether its id is that smallest one."""
        repeated = np.repeat(flags, self.copies)
        at, key = self.at[repeated], self.key[repeated]
        doc = self.doc[at]
        before = np.minimum(SIDE, at - self.starts[doc])
        after = np.minimum(SIDE, self.ends[doc] - at - SAMPLE)
        enough = before + after >= SIDE
        at, key, doc, before, after = (x[enough] for x in (at, key, doc, before, after))
        left, right = self.cut(at - SIDE, SIDE).copy(), self.cut(at + SAMPLE, SIDE).copy()
        left[np.arange(SIDE) < (SIDE - before)[:, None]] = 0
        right[np.arange(SIDE) >= after[:, None]] = 0
        whole = mix(mix(key, _hash_rows(left)), mix(_hash_rows(right), (before * 64 + after).astype(np.uint64)))
        ids = self.ids[doc]
        order = np.lexsort((ids, whole, key))
        at, key, ids, before, after, left, right, whole = (x[order] for x in (at, key, ids, before, after, left, right, whole))
        new = np.concatenate([[True], whole[1:] != whole[:-1]]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        least = ids[first]
        return (key[first], least, left[first], right[first], before[first], after[first]), at, number, ids == least[number] if len(at) else new, before, after


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, :rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for word in padded.view(np.uint64).T:
        h = mix(h, word)
    return h


def _split(keys: np.ndarray, buckets: int):
    """Sorted keys by bucket: (bucket, from, to)."""
    width = np.uint64(-(-(2**64 - 1) // buckets))
    at = keys // width
    edges = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(buckets) if edges[b] < edges[b + 1]]


def _planes(keys: np.ndarray, width: int) -> bytes:
    """Sorted numbers as byte planes of their differences: the upper planes compress to nothing."""
    return np.ascontiguousarray(np.diff(keys, prepend=keys.dtype.type(0)).view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _from_planes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    planes[:width] = raw[:n * width].reshape(width, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _emit(rows: list[tuple]):
    for i in range(0, len(rows), 32):
        yield _batch(PACKED, rows[i:i + 32])


#: Sample hashes travel with 48 bits; a chance meeting only costs a comparison.
DROP = np.uint64(16)


def _send_samples(buckets: int):
    def run(batches):
        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for chunk, ids, _, ends, body in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                keys = Chunk(ids, ends, body).unique
                rows = []
                for bucket, lo, hi in _split(keys, buckets):
                    rows.append((bucket, chunk, (hi - lo).to_bytes(8, "little") + compress(_planes(keys[lo:hi] >> DROP, 7))))
                yield from _emit(rows)

    return run


def _groups(batches):
    """(bucket, [(chunk, payload)]) of a partition sorted by bucket."""
    now, held = None, []
    for b in batches:
        for bucket, chunk, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((chunk, payload))
    if held:
        yield now, held


def _rank_samples(batches):
    decompress = zstandard.ZstdDecompressor().decompress
    for bucket, held in _groups(batches):
        parts = [_from_planes(np.frombuffer(decompress(p[8:]), np.uint8), int.from_bytes(p[:8], "little"), 7) for _, p in held]
        keys = np.concatenate(parts)
        order = np.argsort(keys)
        s = keys[order]
        same = s[1:] == s[:-1]
        repeated = np.zeros(len(s), bool)
        repeated[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at, rows = 0, []
        for (chunk, _), p in zip(held, parts, strict=True):
            mine = repeated[at:at + len(p)]
            at += len(p)
            if mine.any():
                rows.append((bucket, chunk, zstandard.compress(np.packbits(mine).tobytes(), 1)))
        yield from _emit(rows)


def _flags(chunk: Chunk, answers, buckets: int) -> np.ndarray:
    """Which distinct samples of a chunk are repeated: elsewhere, as the buckets told, or in another of its documents."""
    flags = chunk.copies > 1
    told = {a["bucket"]: a["payload"] for a in answers or ()}
    for bucket, lo, hi in _split(chunk.unique, buckets):
        if bucket in told:
            bits = np.unpackbits(np.frombuffer(zstandard.decompress(told[bucket]), np.uint8))
            flags[lo:hi] |= bits[:hi - lo].astype(bool)
    return flags


def _send_suffixes(buckets: int):
    def run(batches):
        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for chunk, ids, _, ends, body, answers in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                c = Chunk(ids, ends, body)
                (key, least, left, right, before, after), *_ = c.contexts(_flags(c, answers, buckets))
                rows = []
                for bucket, lo, hi in _split(key, buckets):
                    raw = _planes(key[lo:hi], 8) + least[lo:hi].tobytes() + before[lo:hi].astype(np.uint8).tobytes() + after[lo:hi].astype(np.uint8).tobytes()
                    rows.append((bucket, chunk, (hi - lo).to_bytes(8, "little") + compress(raw + left[lo:hi].tobytes() + right[lo:hi].tobytes())))
                yield from _emit(rows)

    return run


def _sort_suffixes(batches):
    decompress = zstandard.ZstdDecompressor().decompress
    for bucket, held in _groups(batches):
        parts, sizes = [], []
        for _, p in held:
            n, raw = int.from_bytes(p[:8], "little"), np.frombuffer(decompress(p[8:]), np.uint8)
            cuts = np.cumsum([0, 8 * n, 8 * n, n, n, SIDE * n, SIDE * n])
            fields = [raw[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            parts.append((_from_planes(fields[0], n, 8), fields[1].copy().view(np.int64), fields[2], fields[3], fields[4].reshape(n, SIDE), fields[5].reshape(n, SIDE)))
            sizes.append(n)
        rank, ids, before, after, left, right = (np.concatenate([p[i] for p in parts]) for i in range(6))
        # hashes of the last s bytes before a sample, and of the first s after it, for every s
        tail = [np.zeros(len(rank), np.uint64)]
        head = [rank]
        for s in range(SIDE):
            tail.append(mix(tail[-1], left[:, SIDE - 1 - s].astype(np.uint64) + np.uint64(1)))
            head.append(mix(head[-1], right[:, s].astype(np.uint64) + np.uint64(1)))
        repeats = np.zeros(len(rank), np.uint32)
        for shift in range(SIDE + 1):
            fits = np.flatnonzero((before >= shift) & (after >= SIDE - shift))
            if not len(fits):
                continue
            key = mix(tail[shift][fits], head[SIDE - shift][fits])
            order = np.argsort(key)
            s = key[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            least = np.repeat(np.minimum.reduceat(ids[fits][order], first), np.diff(np.append(first, len(s))))
            hit = fits[order][ids[fits][order] > least]
            repeats[hit] |= np.uint32(1 << shift)
        at, rows = 0, []
        for (chunk, _), n in zip(held, sizes, strict=True):
            mine = repeats[at:at + n]
            at += n
            if mine.any():
                rows.append((bucket, chunk, zstandard.compress(mine.tobytes(), 1)))
        yield from _emit(rows)


def _measure(buckets: int):
    def run(batches):
        for b in batches:
            for _, ids, hashes, ends, body, answers, settled in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                c = Chunk(ids, ends, body)
                (key, *_), at, number, own, before, after = c.contexts(_flags(c, answers, buckets))
                bits = np.zeros(len(key), np.uint32)
                told = {a["bucket"]: a["payload"] for a in settled or ()}
                for bucket, lo, hi in _split(key, buckets):
                    if bucket in told:
                        bits[lo:hi] = np.frombuffer(zstandard.decompress(told[bucket]), np.uint32)
                mine = bits[number] if len(number) else np.zeros(0, np.uint32)
                start = np.zeros(c.n + 1, np.int32)
                for shift in range(SIDE + 1):
                    # who shares a context with a smaller id repeats all strings that fit; the smallest, what it was told
                    hit = ((mine >> np.uint32(shift)) & np.uint32(1)).astype(bool) | (~own & (before >= shift) & (after >= SIDE - shift))
                    start[at[hit] - shift] = 1
                run_up = np.cumsum(start[:c.n])
                gone = run_up.copy()
                gone[LENGTH:] -= run_up[:-LENGTH]
                gone = gone > 0
                rows = []
                for i, (a, z) in enumerate(zip(c.starts, c.ends, strict=True)):
                    g = gone[a:z]
                    kept = c.text[LENGTH + a:LENGTH + z][~g].tobytes()
                    rows.append((int(c.ids[i]), hashes[32 * i:32 * i + 32], int(z - a), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
                yield _batch(RESULT, rows)

    return run


def _answers(df: DataFrame, name: str) -> DataFrame:
    """Answers per chunk, one row each: as many entries as buckets, no more than a chunk's samples."""
    return df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias(name)).withColumnRenamed("chunk", f"{name}_chunk")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row."""
    spark, width = docs.sparkSession, partitions(docs)
    buckets = 4 * width
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.unhex(F.sha2("text", 256)).alias("hash"), F.octet_length("text").cast("long").alias("n"), "text")
    rows = cut_lineage(d.select("doc_id", "k", "hash", "n"))
    firsts = rows.groupBy("hash").agg(F.min("k").alias("k"))
    # one row per distinct text, that of its smallest id; the others are settled by their hash alone
    distinct = d.select("k", "hash", "text").join(firsts, ["k", "hash"], "left_semi").dropDuplicates(["k", "hash"])
    table = f"suffix_chunks_{uuid.uuid4().hex}"
    distinct.select("k", "hash", "text").mapInArrow(_chunks, CHUNKS).write.option("path", f"{shared_dir(spark).rstrip('/')}/{table}").bucketBy(width, "chunk").saveAsTable(table)
    try:
        chunks = spark.table(table)
        samples = cut_lineage(chunks.mapInArrow(_send_samples(buckets), PACKED).repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_rank_samples, PACKED))
        told = chunks.join(_answers(samples, "told"), F.col("chunk") == F.col("told_chunk"), "left").drop("told_chunk")
        settled = cut_lineage(told.mapInArrow(_send_suffixes(buckets), PACKED).repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_suffixes, PACKED))
        last = told.join(_answers(settled, "settled"), F.col("chunk") == F.col("settled_chunk"), "left").drop("settled_chunk")
        result = cut_lineage(last.mapInArrow(_measure(buckets), RESULT))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    found = rows.join(result.select("k", "hash", "n_removed", "n_spans", "kept_sha256"), ["k", "hash"], "left")
    whole = F.col("kept_sha256").isNull() & (F.col("n") >= LENGTH)
    return found.select(
        "doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.when(whole, F.col("n")).otherwise(F.lit(0).cast("long"))).alias("n_removed"),
        F.coalesce("n_spans", F.when(whole, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("hash")))).alias("kept_sha256"))
