"""Fill-in-the-middle over texts stored as seekable compressed frames.

``store`` keeps each whole text as independent Zstandard frames of at most ``FRAME_BYTES`` of UTF-8, cut between code points,
with the units, code points and bytes that lie before each frame. A unit is a token ``[A-Za-z]+|[^A-Za-z]``; letters that go on
over a frame's edge are one unit, counted where it starts. ``transform`` finds a cut by the cumulative counts, decompresses the
one frame that holds it, and puts the output together from stored frames as they lie; only the two cut frames are compressed
again. Concatenated Zstandard frames are one Zstandard stream, so the output is such a stream too. ``digests`` and ``texts``
stream the frames in order; ``restore`` rebuilds the text from output and form alone. Everything happens in the row's task: no
shuffle, and beside the row itself a task holds one frame. The store is written to the shared folder once.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a null id counts as no digits in
the hash; repeated rows are transformed alike, a row each; tables without rows give none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standpoint.session import cut_lineage

FRAME_BYTES, BATCH_BYTES, LEVEL = 32 << 10, 8 << 20, 3
#: Fixed values of the transformation.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20

FRAME = "struct<units: long, chars: long, bytes: long, joined: boolean, data: binary>"
STORE = f"doc_id long, n long, marked boolean, frames array<{FRAME}>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(data: np.ndarray, joined: bool) -> np.ndarray:
    """Byte positions at which units start; ``joined``: the byte before was a letter."""
    letter = _LETTER[data]
    goes_on = np.empty(len(data), bool)
    goes_on[0] = joined
    goes_on[1:] = letter[:-1]
    goes_on &= letter
    goes_on |= (data & 0xC0) == 0x80
    return np.flatnonzero(~goes_on)


def _chars(data: np.ndarray) -> int:
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


def frames_of(text: bytes, frame_bytes: int, compress) -> tuple[int, list[dict]]:
    """Number of units, and the frames of a text."""
    out, units, chars, at, joined = [], 0, 0, 0, False
    while at < len(text):
        end = min(at + frame_bytes, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        piece = text[at:end]
        data = np.frombuffer(piece, np.uint8)
        out.append({"units": units, "chars": chars, "bytes": at, "joined": joined, "data": compress(piece)})
        units += len(unit_starts(data, joined))
        chars += _chars(data)
        at, joined = end, bool(_LETTER[data[-1]])
    return units, out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The seekable store: a row per document with its frames, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(LEVEL).compress

        def rows():
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = text.as_py() or b""
                    n, frames = frames_of(data, frame_bytes, compress)
                    yield {"doc_id": i, "n": n, "marked": any(s in data for s in (PREFIX, SUFFIX, MIDDLE)), "frames": frames}
        yield from _batches(rows(), lambda r: sum(len(f["data"]) for f in r["frames"]), _STORE_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return cut_lineage(rows.mapInArrow(run, STORE))


class Cuts:
    """Cut places in a stored text; a frame is decompressed when a cut falls into it."""

    def __init__(self, n: int, frames: list[dict], decompress):
        self.n, self.frames, self.decompress, self.open = n, frames, decompress, {}
        self.before = [f["units"] for f in frames]

    def frame(self, f: int) -> bytes:
        if f not in self.open:
            self.open[f] = self.decompress(self.frames[f]["data"])
        return self.open[f]

    def place(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) of the start of a unit, or of the end of the text."""
        if unit == self.n:
            f = len(self.frames) - 1
            data = self.frame(f)
            return f, len(data), self.frames[f]["chars"] + _chars(np.frombuffer(data, np.uint8))
        f = int(np.searchsorted(self.before, unit, side="right")) - 1
        data = np.frombuffer(self.frame(f), np.uint8)
        at = int(unit_starts(data, self.frames[f]["joined"])[unit - self.before[f]])
        return f, at, self.frames[f]["chars"] + _chars(data[:at])

    def between(self, a: tuple, b: tuple, compress) -> list[bytes]:
        """Frames of the text from one place to another: whole ones as they are stored, parts compressed anew."""
        out = []
        for f in range(a[0], b[0] + 1):
            lo, hi = a[1] if f == a[0] else 0, b[1] if f == b[0] else None
            if lo == 0 and (hi is None or hi == len(self.frame(f))):
                out.append(self.frames[f]["data"])
            else:
                part = self.frame(f)[lo:hi]
                if part:
                    out.append(compress(part))
        return out


def choose(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form and the two cuts, in units."""
    h = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if n == 0 or marked or h3 % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    return "spm" if h4 % 100 < SPM_BELOW else "psm", *sorted((h1 % (n + 1), h2 % (n + 1)))


def transform(stored: DataFrame) -> DataFrame:
    """A row per document: form, lengths and the output as ordered frames."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, decompress = zstandard.ZstdCompressor(LEVEL).compress, zstandard.ZstdDecompressor().decompress
        marks = {s: compress(s) for s in (PREFIX, SUFFIX, MIDDLE)}

        def rows():
            for r in (r.as_py() for b in batches for r in pa.StructArray.from_arrays(b.columns, names=b.schema.names)):
                form, lo, hi = choose(r["doc_id"], r["n"], r["marked"])
                out = {"doc_id": r["doc_id"], "n": r["n"], "form": form, "prefix_chars": None, "middle_chars": None}
                if form == "plain":
                    yield out | {"output": [f["data"] for f in r["frames"]]}
                    continue
                cuts = Cuts(r["n"], r["frames"], decompress)
                start, a, b, end = (0, 0, 0), cuts.place(lo), cuts.place(hi), cuts.place(r["n"])
                prefix, middle, suffix = (cuts.between(x, y, compress) for x, y in ((start, a), (a, b), (b, end)))
                parts = ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))
                yield out | {"prefix_chars": a[2], "middle_chars": b[2] - a[2], "output": [x for s, p in parts for x in (marks[s], *p)]}
        yield from _batches(rows(), lambda r: sum(map(len, r["output"])), _OUTPUT_ARROW)

    return stored.select("doc_id", "n", "marked", "frames").mapInArrow(run, OUTPUT)


def restore(pieces: Iterable[bytes], again, form: str) -> Iterator[bytes]:
    """The text's pieces in order, from the output's pieces and the form. ``again()`` gives the pieces a second time. A sentinel
    may lie across pieces."""
    if form == "plain":
        yield from pieces
        return
    names = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    found, at, tail = [], 0, b""
    for p in pieces:
        seen = tail + p
        k = 0
        while len(found) < 3 and (k := seen.find(names[len(found)], k)) >= 0:
            found.append(at - len(tail) + k)
            k += len(names[0])
        tail, at = seen[-2:], at + len(p)
    first, second, third = ((x + len(names[0]), y) for x, y in zip(found, found[1:] + [at], strict=True))
    for lo, hi in ((first, third, second) if form == "psm" else (second, third, first)):
        x = 0
        for p in again():
            if x < hi and x + len(p) > lo:
                yield p[max(lo - x, 0):hi - x]
            x += len(p)
            if x >= hi:
                break


def digests(transformed: DataFrame) -> DataFrame:
    """Hashes of the output and of the text rebuilt from it, both streamed frame by frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress

        def rows():
            for r in (r.as_py() for b in batches for r in pa.StructArray.from_arrays(b.columns, names=b.schema.names)):
                frames = r.pop("output")
                out, text = hashlib.sha256(), hashlib.sha256()

                def first(frames=frames, out=out):
                    for f in frames:
                        p = decompress(f)
                        out.update(p)
                        yield p
                for p in restore(first(), lambda frames=frames: map(decompress, frames), r["form"]):
                    text.update(p)
                yield r | {"output_sha256": out.hexdigest(), "restored_sha256": text.hexdigest()}
        yield from _batches(rows(), lambda r: 200, _DIGESTS_ARROW)

    return transformed.mapInArrow(run, DIGESTS)


def texts(transformed: DataFrame) -> DataFrame:
    """The outputs as plain text: doc_id, form, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        rows = ({"doc_id": i, "form": f, "text": b"".join(map(decompress, o)).decode()}
                for b in batches for i, f, o in zip(*(b.column(c).to_pylist() for c in ("doc_id", "form", "output")), strict=True))
        yield from _batches(rows, lambda r: len(r["text"]), _TEXTS_ARROW)

    return transformed.mapInArrow(run, "doc_id long, form string, text string")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    return transform(store(docs, id_col, text_col, frame_bytes))


def _batches(rows: Iterable[dict], size, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_KEYS = [("doc_id", pa.int64()), ("n", pa.int64())]
_LENGTHS = [("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_STORE_ARROW = pa.schema([*_KEYS, ("marked", pa.bool_()), ("frames", pa.list_(pa.struct(
    [("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("joined", pa.bool_()), ("data", pa.binary())])))])
_OUTPUT_ARROW = pa.schema([*_KEYS, *_LENGTHS, ("output", pa.list_(pa.binary()))])
_DIGESTS_ARROW = pa.schema([*_KEYS, *_LENGTHS, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
_TEXTS_ARROW = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])
