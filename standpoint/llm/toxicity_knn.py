"""Toxicity from the nearest labelled examples by exact cosine over whole texts, with a block-max inverted index.

``fit`` takes at most ``EXAMPLES`` labelled texts of at most ``EXAMPLE_CHARS`` characters together (in the order of the hashes of
their ids; equal texts count once) and indexes all their words. A word's count in a text (one and its logarithm) is weighted
by the word's idf over all documents and by its evidence: one and the G-test of how it tells the labels apart over the examples,
so telling words weigh most and none is dropped. Words are told apart by 64-bit hashes.

Examples lie in order of likeness (groups of like common words, by length inside a group) and are cut into blocks. A group's
commonest words, whose postings are long, are kept as dense rows with the largest weight per block; all other words as postings.
A text first meets the postings of its rarer words, which gives every example a part of its similarity and every block an upper
bound: the best part inside it and, for the common words, the block's largest weights. The best blocks are scored first and set
a threshold; blocks whose bound is below it are skipped. Examples that single precision could put among the ``NEIGHBOURS`` nearest
are scored again in double precision: the result is that of scoring every example. Neighbours vote with weight
1 / (distance + ``SOFT``); the vote is calibrated by isotonic regression over the examples, each judged by the others. A text
without any word of the examples has the examples' rate of that case. Every score names its neighbours as evidence.

The index is built in one task from the bounded sample, stored as arrays in the shared folder and mapped by the workers; the driver
sees only the examples' votes. Scoring is one map over whole texts.

Defined cases: null and empty texts have no words; rows of a null id or a null label are not learned from, labels without a
document neither; of several labels of one id the larger counts; equally similar examples rank by their number; repeated rows get
equal scores; without any label the score is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from standpoint.llm.shared_files import map_array, save_array
from standpoint.session import cut_lineage, shared_dir

EXAMPLES, EXAMPLE_CHARS, NEIGHBOURS = 20_000, 200_000_000, 16
#: Groups of like examples, common words of a group, examples of a block, texts worked on together, blocks that set the threshold.
GROUPS, COMMON, BLOCK, TOGETHER, FIRST = 8, 512, 64, 64, 3
SOFT = 0.05
REMEMBERED = 200_000
WORD = re.compile(r"\w+")
NAMES = ("vocabulary", "weight", "labels", "ids", "starts", "words", "weights", "groups", "common", "table", "blocks", "largest", "edges", "example", "part")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in small letters."""
    return WORD.findall((text or "").lower().replace("_", " "))


def term_counts(text: str | None) -> Counter:
    return Counter(words_of(text))


def hashed(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, in order, and their counts."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in counts), np.uint64, len(counts))
    order = np.argsort(h)
    return h[order], np.fromiter(counts.values(), np.int32, len(counts))[order]


def evidence(k: np.ndarray, n: np.ndarray, positive: int, total: int) -> np.ndarray:
    """One and twice the log-likelihood ratio (G-test) of words in ``n`` of ``total`` examples, ``k`` of them among the ``positive``."""
    negative, out = total - positive, np.ones(len(n))
    for seen, expected in ((k, n * positive / total), (n - k, n * negative / total), (positive - k, (total - n) * positive / total),
                           (negative - n + k, (total - n) * negative / total)):
        some = seen > 0
        out[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    return np.maximum(out, 1.0)


def spots(edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs ``which`` of an array cut at ``edges``, and the runs' lengths."""
    lo = edges[which]
    n = edges[which + 1] - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), n


def weighted(words: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(counts.astype(np.float64))) * weight[words]
    norm = math.sqrt(float((w * w).sum()))
    return (words, w / norm) if norm else (words[:0], w[:0])


def likeness(words: np.ndarray, weights: np.ndarray, owner: np.ndarray, many: int, terms: int, groups: int) -> np.ndarray:
    """Groups of examples with like common words: k-means over the commonest words, from evenly spread examples."""
    k = max(1, min(groups, many // BLOCK))
    top = np.argsort(-np.bincount(words, minlength=terms), kind="stable")[:2 * COMMON]
    at = np.full(terms, -1, np.int64)
    at[top] = np.arange(len(top))
    there = at[words] >= 0
    d = np.zeros((many, len(top)), np.float32)
    d[owner[there], at[words[there]]] = weights[there]
    d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9)
    centres = d[np.linspace(0, many - 1, k).astype(int)]
    group = np.zeros(many, np.int64)
    for _ in range(8):
        group = (d @ centres.T).argmax(1)
        centres = np.stack([d[group == g].sum(0) if (group == g).any() else centres[g] for g in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return group


def arrays_of(vocabulary: np.ndarray, weight: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """The index of examples given as (words, weights); see ``NAMES``."""
    many, terms = len(vectors), len(weight)
    sizes = np.array([len(w) for w, _ in vectors], np.int64)
    words = np.concatenate([np.zeros(0, np.int32), *[w for w, _ in vectors]]).astype(np.int32)
    weights = np.concatenate([np.zeros(0), *[v for _, v in vectors]])
    group = likeness(words, weights, np.repeat(np.arange(many), sizes), many, terms, GROUPS) if many else np.zeros(0, np.int64)
    order = np.lexsort((np.arange(many), sizes, group))
    at, n = spots(np.concatenate([[0], np.cumsum(sizes)]), order)
    words, weights, sizes, group = words[at], weights[at], sizes[order], group[order]
    owner = np.repeat(np.arange(many, dtype=np.int32), sizes)
    cuts = np.searchsorted(group, np.arange((int(group.max()) if many else 0) + 2))
    common = np.full((len(cuts) - 1, terms), -1, np.int16)
    width = min(COMMON, terms)
    table = np.zeros((many, width), np.float32)
    for g, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        mine = slice(*np.searchsorted(owner, [lo, hi]))
        top = np.argsort(-np.bincount(words[mine], minlength=terms), kind="stable")[:width]
        common[g, top] = np.arange(len(top))
        place = common[g, words[mine]]
        table[owner[mine][place >= 0], place[place >= 0]] = weights[mine][place >= 0]
    blocks = np.unique(np.concatenate([np.arange(lo, hi, BLOCK) for lo, hi in zip(cuts, cuts[1:], strict=False)]) if many else np.zeros(0, np.int64))
    largest = np.maximum.reduceat(table, blocks, axis=0) if many else table
    rare = np.flatnonzero(common[group[owner], words] < 0) if many else np.zeros(0, np.int64)
    rare = rare[np.argsort(words[rare], kind="stable")]
    edges = np.searchsorted(words[rare], np.arange(terms + 1))
    return dict(zip(NAMES, (vocabulary, weight, labels[order], ids[order], np.concatenate([[0], np.cumsum(sizes)]), words, weights, cuts, common, table, blocks, largest,
                            edges, owner[rare], weights[rare].astype(np.float32)), strict=True))


class Numbers:
    """Numbers of words in a sorted vocabulary of hashes, -1 for others; words met before are remembered, up to ``REMEMBERED``."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary, self.seen = vocabulary, {}

    def of(self, words) -> np.ndarray:
        seen = self.seen
        new = [w for w in words if w not in seen]
        if new:
            if len(seen) > REMEMBERED:
                seen.clear()
                new = list(words)
            h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            at = np.searchsorted(self.vocabulary, h)
            at[at == len(self.vocabulary)] = 0
            seen.update(zip(new, np.where(self.vocabulary[at] == h, at, -1).tolist() if len(self.vocabulary) else [-1] * len(new), strict=True))
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


class Index:
    """Examples by number and in postings, over arrays in memory or mapped from a folder."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.query = np.zeros(len(self.weight))
        self.numbers = Numbers(self.vocabulary)
        self.met = self.skipped = 0

    def arrays(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """A text as (words, weights) over the vocabulary."""
        at, n = self.numbers.of(counts), np.fromiter(counts.values(), np.int64, len(counts))
        known = np.flatnonzero(at >= 0)
        known = known[np.argsort(at[known])]
        return weighted(at[known], n[known], self.weight)

    def homes(self, vectors: list) -> np.ndarray:
        """The group whose common words a text has most of."""
        if not len(self.labels):
            return np.zeros(len(vectors), np.int64)
        terms, weights = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
        owner = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        return np.stack([np.bincount(owner, np.where(c[terms] >= 0, weights, 0.0), len(vectors)) for c in self.common]).argmax(axis=0)

    def example_vector(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        mine = slice(self.starts[e], self.starts[e + 1])
        return np.asarray(self.words[mine]), np.asarray(self.weights[mine])

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], but: int = -1, k: int = NEIGHBOURS) -> list[tuple[int, float]]:
        """The k most similar examples with a similarity above zero, exactly; ``but`` is left out."""
        return next(self.nearest_of([vector], [but], k))

    def nearest_of(self, vectors: list, buts: list[int], k: int = NEIGHBOURS):
        """``nearest`` of each vector."""
        many = len(self.labels)
        ends = np.append(self.blocks[1:], many)
        group_of = np.searchsorted(self.groups, self.blocks, side="right") - 1
        for at in range(0, len(vectors), TOGETHER):
            some, own = vectors[at:at + TOGETHER], buts[at:at + TOGETHER]
            if not many:
                yield from ([] for _ in some)
                continue
            terms, weights = (np.concatenate([v[i] for v in some]) for i in (0, 1))
            owner = np.repeat(np.arange(len(some)), [len(t) for t, _ in some])
            where, n = spots(self.edges, terms)
            rough = np.bincount(self.example[where] + np.repeat(owner * many, n), self.part[where] * np.repeat(weights, n), len(some) * many).astype(np.float64, copy=False).reshape(len(some), many)
            bound = np.maximum.reduceat(rough, self.blocks, axis=1)
            dense = []
            for g in range(len(self.groups) - 1):
                place = self.common[g][terms]
                d = np.zeros((len(some), self.table.shape[1]), np.float32)
                d[owner[place >= 0], place[place >= 0]] = weights[place >= 0]
                dense.append(d)
                bound[:, group_of == g] += d @ self.largest[group_of == g].T
            least = np.zeros(len(some))
            for i, b in enumerate(own):
                first = np.argpartition(-bound[i], FIRST)[:FIRST] if len(self.blocks) > FIRST else np.arange(len(self.blocks))
                sims = [rough[i, self.blocks[f]:ends[f]] + self.table[self.blocks[f]:ends[f]] @ dense[group_of[f]][i] for f in first]
                for f, s in zip(first, sims, strict=True):
                    if self.blocks[f] <= b < ends[f]:
                        s[b - self.blocks[f]] = 0.0
                sims = np.concatenate(sims)
                least[i] = np.partition(sims, len(sims) - k)[len(sims) - k] if len(sims) > k else 0.0
            alive = (bound > 0) & (bound * (1 + 1e-4) >= least[:, None])  # sums of few hundred products in single precision err by less
            self.met, self.skipped = self.met + alive.size, self.skipped + int((~alive).sum())
            for g, d in enumerate(dense):
                mine = np.flatnonzero(group_of == g)
                texts = np.flatnonzero(alive[:, mine].any(axis=1))
                if not len(texts):
                    continue
                used = mine[alive[np.ix_(texts, mine)].any(axis=0)]
                if len(used) > 0.7 * len(mine):
                    lo, hi = self.blocks[mine[0]], ends[mine[-1]]
                    rough[texts, lo:hi] += d[texts] @ self.table[lo:hi].T
                else:
                    who = np.concatenate([np.arange(self.blocks[b], ends[b]) for b in used])
                    rough[np.ix_(texts, who)] += d[texts] @ self.table[who].T
            reached = np.stack([alive[:, group_of == g].any(axis=1) for g in range(len(dense))], axis=1)
            for i, ((t, w), but) in enumerate(zip(some, own, strict=True)):
                if but >= 0:
                    rough[i, but] = 0.0
                who = [(self.groups[g], rough[i, self.groups[g]:self.groups[g + 1]]) for g in np.flatnonzero(reached[i])]
                row = np.concatenate([np.zeros(0), *[r for _, r in who]])
                limit = max(float(np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else 0.0, 0.0) * (1 - 1e-4)
                who = np.concatenate([np.zeros(0, np.int64), *[lo + np.flatnonzero((r > 0) & (r >= limit)) for lo, r in who]])
                where, n = spots(self.starts, who)
                self.query[t] = w
                sims = np.round(np.bincount(np.repeat(np.arange(len(who)), n), self.query[self.words[where]] * self.weights[where], len(who)), 12)
                self.query[t] = 0.0
                best = np.lexsort((who, -sims))[:k]
                yield [(int(e), float(s)) for e, s in zip(who[best], sims[best], strict=True) if s > 0]

    def vote(self, near: list[tuple[int, float]]) -> float:
        w = np.array([1 / (1 - min(1.0, s) + SOFT) for _, s in near])
        return float((w * self.labels[[e for e, _ in near]]).sum() / w.sum())


_LOADED: dict[str, Index] = {}


def load(folder: str) -> Index:
    """The index of a folder, mapped once a worker."""
    if folder not in _LOADED:
        _LOADED.clear()
        _LOADED[folder] = Index({n: map_array(folder, f"{n}.npy") for n in NAMES})
    return _LOADED[folder]


def calibrated(pairs: list[tuple[float, float]], rate: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Isotonic regression of (vote, label), in any order; equal votes are one point. Steps as (votes, scores)."""
    points: dict[float, list[float]] = {}
    for x, y in pairs:
        p = points.setdefault(round(x, 9), [0.0, 0.0])
        p[0] += y
        p[1] += 1.0
    stack: list[list[float]] = []
    for x in sorted(points):
        stack.append([*points[x], x])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1]:
            y2, n2, x2 = stack.pop()
            stack[-1] = [stack[-1][0] + y2, stack[-1][1] + n2, x2]
    return (np.array([s[2] for s in stack]), np.array([(s[0] + rate) / (s[1] + 1) for s in stack])) if stack else None


@dataclass
class Model:
    """Where the index lies, the score of texts without neighbours, and the calibration."""

    folder: str | None
    silent: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, index: Index, texts: list[str | None]):
        """(score, neighbours) of each text. Texts of one home group are worked on together, since they skip the same blocks."""
        vectors = [index.arrays(term_counts(t)) for t in texts]
        order = np.argsort(index.homes(vectors), kind="stable") if vectors else []
        found = dict(zip(order, index.nearest_of([vectors[i] for i in order], [-1] * len(order)), strict=True))
        for near in (found[i] for i in range(len(texts))):
            if not near:
                yield self.silent, []
                continue
            v = index.vote(near)
            yield v if self.steps is None else float(self.steps[1][min(np.searchsorted(self.steps[0], round(v, 9)), len(self.steps[0]) - 1)]), near


def sample(docs: DataFrame, labels: DataFrame, examples: int, chars: int) -> DataFrame:
    """The labelled texts to learn from (id, y, text)."""
    label = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    distinct = (d.select("id", "h", F.length("text").alias("n")).join(label, "id").groupBy("h").agg(F.min_by(F.struct("id", "y", "n"), "id").alias("r"))
                .select("h", "r.*").orderBy(F.xxhash64("id"), "id").limit(examples))
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy(F.xxhash64("id"), "id"))  # over at most ``examples`` rows
    chosen = distinct.withColumn("so_far", so_far).where(F.col("so_far") <= chars).select("id", "h", "y")
    return cut_lineage(d.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["h"]).select("id", "y", "text"))


def _vectors(batches):
    for b in batches:
        got = [hashed(term_counts(t)) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([v[i].tobytes() for v in got], pa.binary()) for i in (0, 1)]], names=["id", "y", "hashes", "counts"])


def _gather(folder: str):
    """One task: all examples, by id, with their words numbered in a common vocabulary."""
    def run(batches):
        rows = sorted(((i, y, np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)) for b in batches for i, y, h, c in zip(*(x.to_pylist() for x in b.columns), strict=True)), key=lambda r: r[0])
        every = np.concatenate([np.zeros(0, np.uint64), *[r[2] for r in rows]])
        vocabulary, words = np.unique(every, return_inverse=True)
        for name, a in (("vocabulary", vocabulary), ("all_words", words.astype(np.int32)), ("all_counts", np.concatenate([np.zeros(0, np.int32), *[r[3] for r in rows]])),
                        ("all_sizes", np.array([len(r[2]) for r in rows], np.int64)), ("all_ids", np.array([r[0] for r in rows], np.int64)), ("all_labels", np.array([r[1] for r in rows], float))):
            save_array(folder, f"{name}.npy", a)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})
    return run


def document_counts(docs: DataFrame, folder: str) -> DataFrame:
    """In how many rows of ``docs`` each word of the vocabulary occurs: (term, n)."""
    def run(batches):
        vocabulary = np.asarray(map_array(folder, "vocabulary.npy"))
        n, numbers = np.zeros(len(vocabulary), np.int64), Numbers(vocabulary)
        for b in batches:
            for t in b.column(0).to_pylist():
                at = numbers.of(set(words_of(t)))
                n[at[at >= 0]] += 1
        some = np.flatnonzero(n)
        for i in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i:i + 50_000].astype(np.int32)), pa.array(n[some[i:i + 50_000]])], names=["term", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _build(folder: str, documents: int):
    """One task: document counts in, the index out."""
    def run(batches):
        vocabulary, words, counts, sizes, ids, y = (np.asarray(map_array(folder, f"{n}.npy")) for n in ("vocabulary", "all_words", "all_counts", "all_sizes", "all_ids", "all_labels"))
        df = np.ones(len(vocabulary), np.int64)
        for b in batches:
            df[b.column(0).to_numpy()] = np.maximum(b.column(1).to_numpy(), 1)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        toxic = np.repeat(y, sizes)
        n, k = np.bincount(words, minlength=len(vocabulary)).astype(float), np.bincount(words, toxic, len(vocabulary))
        weight = np.log(1 + documents / df) * evidence(k, n, int(y.sum()), len(y))
        heard = np.flatnonzero(sizes > 0)
        vectors = [weighted(words[starts[e]:starts[e + 1]], counts[starts[e]:starts[e + 1]], weight) for e in heard]
        for name, a in arrays_of(vocabulary, weight, vectors, y[heard], ids[heard]).items():
            save_array(folder, f"{name}.npy", np.ascontiguousarray(a))
        yield pa.RecordBatch.from_pydict({"heard": pa.array([len(heard)], pa.int64()), "toxic": pa.array([float(y[heard].sum())]), "positive": pa.array([float(y.sum())])})
    return run


def votes(spark: SparkSession, folder: str, many: int) -> list[tuple[float, float]]:
    """(vote, label) of each example, judged by the others; as many rows as examples at most."""
    def run(batches):
        ix = load(folder)
        for b in batches:
            of = b.column(0).to_pylist()
            got = [(ix.vote(near), float(ix.labels[e])) for e, near in zip(of, ix.nearest_of([ix.example_vector(e) for e in of], of), strict=True) if near]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.float64()) for i in (0, 1)], names=["vote", "label"])

    return [tuple(r) for r in spark.range(many).repartition(16).mapInArrow(run, "vote double, label double").collect()]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> Model:
    """``labels``: doc_id, toxic (0 or 1). Learns from its rows that have a document."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/nearest-{uuid.uuid4().hex}"
    vectors = cut_lineage(sample(docs, labels, examples, chars).mapInArrow(_vectors, "id long, y int, hashes binary, counts binary"))
    total = vectors.repartition(1).mapInArrow(_gather(folder), "n long").agg(F.sum("n")).first()[0]
    if not total:
        return Model(None)
    counts = cut_lineage(document_counts(docs, folder))
    built = counts.repartition(1).mapInArrow(_build(folder, docs.count()), "heard long, toxic double, positive double").collect()
    heard, toxic, positive = built[0] if built else (0, 0.0, 0.0)
    if not heard:
        return Model(None, positive / total)
    steps = calibrated(votes(spark, folder, heard), toxic / heard)
    return Model(folder, (positive - toxic) / (total - heard) if total > heard else positive / total, steps)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row per row of ``docs(doc_id, held_out, text)``."""
    evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        ix = None if model.folder is None else load(model.folder)
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            texts = b.column(2).to_pylist()
            got = [(model.silent, [])] * len(texts) if ix is None else list(model.scores(ix, texts))
            near = [[{"doc_id": int(ix.ids[e]), "similarity": s, "toxic": int(ix.labels[e])} for e, s in n] for _, n in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()),
                                              pa.array(near, evidence_type)], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled rows whose crc32(id) modulo 5 is not 0 and scores all documents."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(d, fit(docs, labels.where(~held_out(F.col("doc_id").cast("long")))))
