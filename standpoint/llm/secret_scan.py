"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern names.

A token is a run of 20 or more letters, digits and ``+/_-`` with at most two ``=`` behind it, so what follows ``name=`` is a
token of its own. Its encoding is inferred as the smallest alphabet that holds
it (hex, base32, base36, base62, base64). Under the hypothesis that its symbols are drawn at random from that alphabet,
three p-values are made: chi-squared of the symbol counts against uniformity (with the exact mean and variance of the
statistic, as counts are small), the number of runs above and below the alphabet's middle, and the lag-one serial
correlation. They are combined by Fisher's method. Written words fail these tests, keys and hashes pass.

Discovery control is length-aware: tokens are divided into strata by encoding and length, and within each stratum, over
the whole corpus, Benjamini-Hochberg decides at level ``ALPHA`` which tokens are *not* random. The rest are reported if
they carry ``MIN_BITS`` bits, so that the tests had power to reject. The step-up threshold of a stratum comes from counts of
p-values in 512 logarithmic bins, so what is collected has a fixed bound (strata times bins) whatever the corpus.

Both passes are maps over the documents: nothing is shuffled but bin counts. A token found by the battery is added only
where it overlaps no span of a pattern; ``span``s are code points, end exclusive.

Defined cases: null and empty texts have no spans; repeated rows repeat their results; null ids stay null; an empty table
gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
ALPHA, MIN_BITS = 0.01, 80
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
SIZES = {"hex": 16, "base32": 32, "base36": 36, "base62": 62, "base64": 64}
RANKS = {n: {c: i for i, c in enumerate(a)} for n, a in ALPHABETS.items()}
BINS, LOWEST = 512, -40.0


def encoding(token: str) -> str | None:
    """The smallest alphabet of a token, or None for what carries no key: letters only of one case, digits only."""
    t = token.strip("=")
    if len(t) < 20 or t.isdigit() or t.isalpha() and (t.islower() or t.isupper() or t.istitle()):
        return None
    letters = set(t)
    for name, alphabet in ALPHABETS.items():
        if letters <= set(alphabet):
            return name
        if name == "hex" and letters <= set("0123456789ABCDEF"):
            return name
    return None


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def log_p(token: str, name: str) -> float:
    """log10 of the combined p-value of the battery: small for structured tokens."""
    t = token.strip("=")
    if name == "hex":
        t = t.lower()
    x = np.array([RANKS[name][c] for c in t], np.float64)
    n, k = len(x), SIZES[name]
    counts = np.bincount(x.astype(int), minlength=k).astype(float)
    chi = float((counts ** 2).sum() * k / n - n)
    spread = math.sqrt(2 * (k - 1) * (n - 1) / n)
    p1 = _upper_tail((chi - (k - 1)) / spread)
    high = x >= (len(ALPHABETS[name]) / 2)
    ups = int(high.sum())
    if ups in (0, n):
        p2 = 2.0 ** (1 - n)
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * ups * (n - ups) / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    d = x - x.mean()
    total = float((d * d).sum())
    p3 = 2 * _upper_tail(abs(float((d[1:] * d[:-1]).sum()) / total * math.sqrt(n) + 1 / math.sqrt(n))) if total > 0 else 2.0 ** (1 - n)
    s = -sum(math.log(min(1.0, max(p, 1e-300))) for p in (p1, p2, p3))
    tail = math.exp(-s) * (1 + s + s * s / 2)
    return math.log10(max(tail, 1e-40))


def band(n: int) -> int:
    """Length classes: 20, 24, 32, 48, 64, 96, 128, ... symbols and more."""
    b = int(math.log2(n / 16))
    return 2 * b + (n >= 24 * 2 ** b)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, log10 p) of tokens that overlap none of the base spans, which come sorted."""
    out, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():  # both are in order of their starts
            reach = max(reach, taken[at][2])
            at += 1
        if reach > m.start():
            continue
        name = encoding(m.group())
        if name is not None:
            out.append((m.start(), m.end(), name, log_p(m.group(), name)))
    return out


def thresholds(docs: DataFrame, alpha: float = ALPHA) -> dict[tuple[str, int], float]:
    """Per stratum the log10 p below which a token counts as structured (Benjamini-Hochberg over binned p-values, each
    taken at its bin's upper end)."""

    def run(batches):
        for b in batches:
            bins: dict[tuple[str, int, int], int] = {}
            for t in b.column(0).to_pylist():
                if t:
                    for start, end, name, p in candidates(t, base_spans(t)):
                        key = (name, band(end - start), min(BINS - 1, int((p - LOWEST) / -LOWEST * BINS)))
                        bins[key] = bins.get(key, 0) + 1
            rows = [(*k, v) for k, v in bins.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["encoding", "band", "bin", "n"])

    counts = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "encoding string, band long, bin long, n long")
              .groupBy("encoding", "band", "bin").agg(F.sum("n").alias("n")).collect())
    out = {}
    for stratum in {(r.encoding, r.band) for r in counts}:
        bins = sorted((r.bin, r.n) for r in counts if (r.encoding, r.band) == stratum)
        m, seen, limit = sum(n for _, n in bins), 0, -math.inf
        for at, n in bins:
            seen += n
            edge = LOWEST + (at + 1) * -LOWEST / BINS
            if 10 ** edge <= alpha * seen / m:
                limit = edge
        out[stratum] = limit
    return out


def random_spans(text: str, taken, limits: dict[tuple[str, int], float]) -> list[tuple[int, int, int]]:
    return [(s, 3, e) for s, e, name, p in candidates(text, taken)
            if p >= limits.get((name, band(e - s)), -math.inf) and (e - s) * math.log2(SIZES[name]) >= MIN_BITS]


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), one row per input row."""
    limits = thresholds(docs, alpha)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t) if t else []
                added = random_spans(t, base, limits) if t else []
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(added), hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(base + added))))
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, alpha: float = ALPHA, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one), ``n_chars`` following where there is one.
    Documents without spans are unchanged."""
    limits = thresholds(docs, alpha)
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = docs.columns
    chars_type = None if chars_at is None else docs.schema.fields[chars_at].dataType
    follow = isinstance(chars_type, T.IntegralType)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        out, last = [], 0
        for s, _, e in sorted(base + random_spans(t, base, limits)):
            if s >= last:
                out += [t[last:s], mark]
            last = max(last, e)
        return "".join([*out, t[last:]]) if out else t

    def run(batches):
        for b in batches:
            columns = list(b.columns)
            old = columns[text_at].to_pylist()
            new = [clean(t) for t in old]
            columns[text_at] = pa.array(new, pa.string())
            if follow:
                was = columns[chars_at].to_pylist()
                columns[chars_at] = pa.array([len(x) if x is not None and x != o else c for x, o, c in zip(new, old, was, strict=True)], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
