"""Fill-in-the-middle against plain Python: units by a regular expression, pieces by joining lists."""

import hashlib
import random
import re
from collections import Counter

import pytest

from standpoint.llm import seekable_fim

LONG = 700


def plain(doc_id, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, sha(t), sha(t)), t
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, len(units), form, len(p), len(m), sha(out), sha(t)), out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice(["a", "Bc", " ", "é", "漢", "🙂", "\n", "<", ">", "P", "1"]) for _ in range(n))
    out = [(i, text(rng.randint(1, 60))) for i in range(150)]
    out += [(1000 + i, text(LONG)) for i in range(20)] + [(2000 + i, "x" * 500 + text(30) + "y" * 300) for i in range(20)]
    return out + [(3000, None), (3001, ""), (None, "no id at all"), (7, "same id, other text"), (7, "same id, other text"), (3002, "holds <M> already"), (3003, "🙂" * 200)]


@pytest.mark.parametrize("frame_bytes", [7, 64, 32 << 10])
def test_against_plain_python(spark, rows, frame_bytes):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, frames string, n int")
    for r in seekable_fim.store(docs, frame_bytes=frame_bytes).collect():
        assert all(0 < f.bytes - e.bytes <= frame_bytes for e, f in zip(r.frames, r.frames[1:], strict=False))
        assert frame_bytes > 64 or r.doc_id != 3003 or len(r.frames) >= 800 / frame_bytes
    made = seekable_fim.fill_in_middle(docs, frame_bytes=frame_bytes)
    assert Counter(tuple(r) for r in seekable_fim.digests(made).collect()) == Counter(plain(i, t)[0] for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in seekable_fim.texts(made).collect()) == Counter((i, plain(i, t)[1]) for i, t in rows)
    assert seekable_fim.digests(seekable_fim.fill_in_middle(docs.limit(0))).count() == 0


def test_frames_have_all_forms_and_keep_their_counts(rows):
    assert {plain(i, t)[0][2] for i, t in rows} == {"plain", "psm", "spm"}
    for _, t in rows:
        data = (t or "").encode()
        n, frames = seekable_fim.frames_of(data, 16, compress=bytes)
        assert n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t or "")) and b"".join(f["data"] for f in frames) == data
        for f in frames:
            before = data[:f["bytes"]].decode()
            assert f["chars"] == len(before) and f["units"] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", before))


def test_a_sentinel_across_pieces_is_found():
    for form, out in (("psm", b"<P>pre<S>suf<M>mid"), ("spm", b"<S>suf<P>pre<M>mid"), ("psm", b"<P><S><M>"), ("plain", b"abc")):
        for k in (1, 2, 4, 50):
            pieces = [out[i:i + k] for i in range(0, len(out), k)]
            assert b"".join(seekable_fim.restore(iter(pieces), lambda p=pieces: iter(p), form)) == {18: b"premidsuf", 9: b"", 3: b"abc"}[len(out)]
