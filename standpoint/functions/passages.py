"""Cutting a document into passages. One document is one row; the helper here works on one text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Where a paragraph ends and where a sentence does.
BLANK_LINE = re.compile(r"\n\s*\n")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")
MAX_CHARS, MIN_CHARS = 600, 40


def cut_points(para: str, limit: int) -> Iterator[tuple[int, int]]:
    """Where the passages of a paragraph start and end: each reaches for the farthest sentence end within ``limit``, else for
    the last space before it, else for ``limit`` itself."""
    ends = [m.start() for m in SENTENCE_END.finditer(para)] + [len(para)]
    start = 0
    while start < len(para):
        stop = ends[max(0, bisect_right(ends, start + limit) - 1)]
        if not start < stop <= start + limit:
            space = para.rfind(" ", start + 1, start + limit)
            stop = space if space > start else start + limit
        yield start, stop
        start = stop + para.startswith(" ", stop)


def passages_of(text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> list[str]:
    """Passages in order; a short one joins the passage before it, and a passage joins a short one before it, where both fit."""
    paras = (" ".join(p.split()) for p in BLANK_LINE.split((text or "").replace("\r\n", "\n")))
    pieces = [p[a:b] for p in paras for a, b in cut_points(p, max_chars)]
    if not pieces:
        return []
    starts, size = [0], len(pieces[0])
    for i, piece in enumerate(pieces[1:], 1):
        joined = size + 1 + len(piece)
        if joined > max_chars or min(size, len(piece)) >= min_chars:
            starts.append(i)
            size = len(piece)
        else:
            size = joined
    return [" ".join(pieces[a:b]) for a, b in zip(starts, [*starts[1:], len(pieces)], strict=True)]


def split_passages(docs: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents (any columns, among them ``text``) to one row per passage with ``pos``, ``passage`` and ``n_passages``."""
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = b["text"].map(lambda t: passages_of(t, max_chars, min_chars))
            n = cut.map(len)
            rows = b.loc[b.index.repeat(n), keep].reset_index(drop=True)
            rows["pos"] = [i for k in n for i in range(k)]
            rows["passage"] = [p for ps in cut for p in ps]
            rows["n_passages"] = [k for k in n for _ in range(k)]
            yield rows

    return docs.select(*keep, "text").mapInPandas(run, f"{schema}, pos int, passage string, n_passages int")
