"""SimHash near-duplicates by anchor-point covering.

``fingerprints`` makes a 64-bit SimHash of each text. Two fingerprints link when they differ in at most ``THRESHOLD`` bits.
Links are found without comparing all pairs: the 64 bits are cut into three blocks, so that linked fingerprints differ in
at most ``THRESHOLD // 3`` bits of some block. The anchors of a block are the words of a covering code: the perfect Hamming
code on its first 15 bits (covering radius 1) times all words on its other bits. A fingerprint goes to every anchor within
radius + allowance, which is 14.5 of them a block on average. The anchor nearest to one of two linked fingerprints is within
the radius of it and so within radius + allowance of the other: they meet there. Fingerprints are compared per anchor,
after equal ones have been made one, and what leaves a comparison is one link per fingerprint, not all pairs.

A crowded anchor is searched breadth first over what has not been reached yet, so a group of many near copies costs about
its size, not its square, and only eight bytes are held per distinct fingerprint there.

Defined cases: null and empty texts have fingerprint zero and link like others; a null ``doc_id`` takes part, and a
component of null ids only has a null ``component_id``; repeated rows are all returned; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standpoint.llm.common import id_key, partitions
from standpoint.llm.graph import components, stars
from standpoint.session import cut_lineage

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: (first bit, bits) of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
HAMMING = 15
#: Groups up to this size are compared shifted against themselves, larger ones breadth first; both ways are exact.
SHIFTED = 48
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    last = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[k - 1:].tolist(), strict=True)
    total = np.zeros(64, np.int64)
    while chunk := list(itertools.islice(spans, 65536)):
        h = np.fromiter((digest(line[a:b], SEED) for a, b in chunk), np.uint64, len(chunk))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > last).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or the named columns of it) with the fingerprint of ``text`` as a signed long in one more column."""
    columns = docs.columns if columns is None else columns
    schema = T.StructType([f for f in docs.schema.fields if f.name in columns] + [T.StructField(name, T.LongType())])
    at = docs.columns.index("text")
    positions = [i for i, c in enumerate(docs.columns) if c in columns]

    def run(batches):
        for b in batches:
            got = pa.array((fingerprint(t) for t in b.column(at).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in positions), got], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def masks_by_syndrome(bits: int, radius: int) -> list[np.ndarray]:
    """For each syndrome of the Hamming part: what to flip in a block to reach each anchor within ``radius``."""
    out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    free = bits - HAMMING
    tails = [[sum(1 << (HAMMING + i) for i in c) for c in itertools.combinations(range(free), w)] for w in range(radius + 1)]
    for w in range(radius + 1):
        for c in itertools.combinations(range(HAMMING), w):
            s = 0
            for i in c:
                s ^= i + 1
            head = sum(1 << i for i in c)
            out[s] += [head | t for v in range(radius - w + 1) for t in tails[v]]
    return [np.array(sorted(x), np.uint64) for x in out]


def _syndrome(part: np.ndarray) -> np.ndarray:
    s = np.zeros(len(part), np.uint64)
    for i in range(HAMMING):
        s ^= ((part >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def replicate(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for every anchor to which a fingerprint goes. An anchor's number names its block too."""
    keys, owners = [], []
    radius = 1 + threshold // len(BLOCKS)
    for n, (first, bits) in enumerate(BLOCKS):
        part = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        syndrome = _syndrome(part)
        for s, masks in enumerate(masks_by_syndrome(bits, radius)):
            mine = syndrome == s
            if mine.any() and len(masks):
                keys.append(((part[mine][:, None] ^ masks[None, :]) | np.uint64(n << 24)).ravel())
                owners.append(np.repeat(fp[mine], len(masks)))
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (fp[:0], fp[:0])


def _breadth_first(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, rest = [], [], fp
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                frontier.extend(found)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def compare(keys: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """One link per linked fingerprint among those with equal ``keys`` (sorted)."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(edge, len(keys)))
    a, b = [], []
    small = np.repeat(sizes <= SHIFTED, sizes)
    k, f = keys[small], fp[small]
    for shift in range(1, min(SHIFTED, len(k))):
        near = (k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= threshold)
        a.append(f[shift:][near])
        b.append(f[:-shift][near])
    for at, n in zip(edge[sizes > SHIFTED], sizes[sizes > SHIFTED], strict=True):
        x, y = _breadth_first(np.unique(fp[at:at + n]), threshold)
        a.append(x)
        b.append(y)
    if not a:
        return fp[:0], fp[:0]
    return stars(np.concatenate(a), np.concatenate(b))


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links of the distinct ``fp`` do."""

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 20000):
                keys, owners = replicate(fp[i:i + 20000], threshold)
                for j in range(0, len(keys), 100000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[j:j + 100000].view(np.int64)), pa.array(owners[j:j + 100000].view(np.int64))], names=["anchor", "fp"])

    def meet(batches):
        held, held_n = [], 0

        def out(keys, fp):
            a, b = compare(keys, fp, threshold)
            for i in range(0, len(a), 100000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 100000].view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            held_n += batch.num_rows
            if held_n < 400_000:
                continue
            keys, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from out(keys[:cut], fp[:cut])
            held, held_n = [(keys[cut:], fp[cut:])], 0
        if held:
            keys, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(keys):
                yield from out(keys, fp)

    spreaded = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    return (spreaded.repartition(partitions(distinct), "anchor").sortWithinPartitions("anchor", "fp").mapInArrow(meet, "a long, b long"))


def classes(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root, component_id) for every distinct ``fp`` of ``fps(doc_id, fp)``: the smallest fingerprint and the
    smallest id of all that it reaches."""
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(distinct, threshold))
    own = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    own = cut_lineage(own)
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    fps = cut_lineage(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "fp", ["doc_id"]))
    found = classes(fps, threshold)
    return fps.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns. Of rows that share that id
    and fingerprint the one with the smallest hash of its text stays. A component of null ids keeps one row too."""
    fp, key, n = "__sp_fp", "__sp_key", "__sp_n"
    marked = cut_lineage(with_fingerprint(docs, fp))
    found = classes(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp")), threshold)
    # a component's smallest id may occur under several of its fingerprints; one of them is chosen
    heads = (marked.select(F.col(fp).alias("fp"), id_key(F.col("doc_id")).alias("k")).join(found, "fp")
             .where(F.col("k") == id_key(F.col("component_id"))).groupBy("root", "k").agg(F.min("fp").alias("fp")))
    heads = heads.select(F.col("fp").alias("__sp_hfp"), F.col("k").alias("__sp_hk"))
    kept = marked.withColumn(key, id_key(F.col("doc_id"))).join(heads, (F.col(fp) == F.col("__sp_hfp")) & (F.col(key) == F.col("__sp_hk")))
    one = F.row_number().over(Window.partitionBy(fp, key).orderBy(F.xxhash64("text")))
    return kept.withColumn(n, one).where(f"{n} = 1").select(*[F.col(f"`{c}`") for c in docs.columns])

