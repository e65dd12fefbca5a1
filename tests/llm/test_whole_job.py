"""Cases in which an operator once did less than its whole job."""

import json
import random
from collections import Counter

import numpy as np

from standpoint.llm import secret_scan, template_decontamination, tool_calls, toxicity_knn


def test_equal_votes_are_one_point():
    votes, scores = toxicity_knn.calibrated([(0.0, 0.0)] * 1000 + [(1.0, 0.0)] + [(1.0, 1.0)] * 100, 1.0)
    assert len(votes) == len(set(votes.tolist())) == 2
    assert abs(scores[np.searchsorted(votes, 1.0 - 1e-9)] - 100 / 101) < 0.02


def test_no_word_is_dropped(spark):
    """Too few examples for any word to reach much evidence: rare insults and plain texts find neighbours all the same."""
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice("tree sun house river stone bread cloud road".split()) for _ in range(20))
    rows = [(i, plain() + (" foul grubworm" if i < 4 else "")) for i in range(40)] + [(100, plain() + " grubworm"), (101, plain()), (102, None)]
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(40)], "doc_id long, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity_knn.fit(d, labels)
    known = toxicity_knn.load(model.folder).vocabulary
    assert set(toxicity_knn.hashed(Counter(["grubworm", "foul", "tree", "road"]))[0].tolist()) <= set(known.tolist())
    got = {r.doc_id: r for r in toxicity_knn.score(d.selectExpr("doc_id", "false AS held_out", "text"), model).collect()}
    assert all(r.evidence for i, r in got.items() if i != 102) and not got[102].evidence
    assert got[100].score > got[101].score and sum(e.toxic for e in got[100].evidence[:4]) == 4


def test_nearest_with_rare_words_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity_knn, "COMMON", 5)
    index, vectors = vectors_over(np.linspace(1, 4, 60), 500, 9)
    assert_exact(index, vectors, 17)
    assert 0 < len(index.example) < len(index.words)


def vectors_over(weight, many, longest):
    """An index of random texts over numbered words, and the vector behind each of its example ids."""
    rng = random.Random(len(weight))
    terms = len(weight)
    counts = [sorted(Counter(rng.choices(range(terms), k=rng.randint(1, longest))).items()) for _ in range(many)]
    vectors = [toxicity_knn.weighted(np.array([t for t, _ in c]), np.array([n for _, n in c]), weight) for c in counts]
    return toxicity_knn.Index(toxicity_knn.arrays_of(np.arange(terms, dtype=np.uint64), weight, vectors, np.zeros(many), np.arange(many))), vectors


def assert_exact(index, vectors, step):
    numbers = index.ids.tolist()
    asked = list(range(0, len(vectors), step))
    for e, near in zip(asked, index.nearest_of([vectors[numbers[e]] for e in asked], asked), strict=True):
        own = dict(zip(*(x.tolist() for x in vectors[numbers[e]]), strict=True))
        sims = sorted((-round(sum(own.get(t, 0) * w for t, w in zip(*(x.tolist() for x in vectors[i]), strict=True)), 12), n) for n, i in enumerate(numbers) if n != e)
        assert [n for n, _ in near] == [n for s, n in sims if s < 0][:16]


def test_block_max_skips_blocks_and_is_exact(monkeypatch):
    for name, value in (("BLOCK", 8), ("GROUPS", 4), ("COMMON", 12), ("TOGETHER", 10)):
        monkeypatch.setattr(toxicity_knn, name, value)
    rng = random.Random(6)
    vectors, weight = [], np.array([1.0 + i % 7 for i in range(160)])
    for i in range(700):  # four kinds of texts with words of their own, so that most blocks are out of reach
        words = Counter(40 * (i % 4) + min(int(rng.expovariate(0.15)), 39) for _ in range(rng.randint(2, 30)))
        words = sorted((words + Counter([rng.randrange(160)])).items())
        vectors.append(toxicity_knn.weighted(np.array([t for t, _ in words]), np.array([n for _, n in words]), weight))
    index = toxicity_knn.Index(toxicity_knn.arrays_of(np.arange(160, dtype=np.uint64), weight, vectors, np.zeros(700), np.arange(700)))
    assert_exact(index, vectors, 13)
    assert index.skipped > index.met / 3


def test_keys_behind_an_unquoted_name(spark):
    key, padded = "q7Zt9XvL2mKp4RsW8nYb3CdF6gHj1QaE5uTiOoPx", "DWLac2+pECzSpSc7crVje2kZH/rSishuNnQvs46B=="
    text = f"GET /?auth={key}&sig={padded} AccountKey={padded};session={key[::-1]}"
    got = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = [(text.index(n) + len(n), len(x)) for n, x in (("auth=", key), ("sig=", padded), ("AccountKey=", padded), ("session=", key[::-1]))]
    assert got.spans == ",".join(f"random:{s}:{s + n}" for s, n in at)
    clean = secret_scan.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == "GET /?auth=[SECRET]&sig=[SECRET] AccountKey=[SECRET];session=[SECRET]"


def test_messages_with_calls_keep_their_content(spark):
    search = {"id": "a", "name": "search", "arguments": {"query": "x"}}
    bodies = [{"content": "Let me look", "tool_calls": [search]}, {"content": "Done", "tool_calls": []}, {"tool_calls": []}, {"content": None, "tool_calls": [search | {"id": "b"}]},
              {"content": [{"type": "text", "text": "part"}], "tool_calls": [search | {"id": "c"}]}]
    m = spark.createDataFrame([(1, i, "assistant", json.dumps(b)) for i, b in enumerate(bodies)], "conv_id long, turn long, role string, text string")
    out = tool_calls.format_messages(m, tool_calls.TOOLS).orderBy("turn", "depth").collect()
    assert [(r.turn, r.role) for r in out] == [(0, "assistant"), (0, "call"), (1, "assistant"), (2, "assistant"), (3, "call"), (4, "assistant"), (4, "call")]
    assert [json.loads(r.json)["content"] for r in out if r.role == "assistant"] == ["Let me look", "Done", "", '[{"text":"part","type":"text"}]']


def test_short_items_and_names_at_sentence_starts(spark):
    names = "Tom has 5 pens. Tom buys 3 more. Tom sells 2 now. How many has Tom?"
    b = spark.createDataFrame([(1, "Name the capital of Peru"), (2, names), (3, "42")], "item_id long, text string")
    d = spark.createDataFrame([(1, "first some words, Name the capital of Chile then more words follow here"), (2, names.replace("Tom", "Zoe").replace("5", "9")),
                               (3, names.lower()), (4, "of 41 other things not a word is taken from anywhere"), (5, "name the capital")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in template_decontamination.leaks(d, b).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert [r.doc_id for r in template_decontamination.remove(d, b).orderBy("doc_id").collect()] == [4, 5]


def test_names_of_several_words_and_verbatim(spark):
    item = "Maria Lopez drove 120 km in 2 hours from New York to Boston. How fast did Maria Lopez drive on the way to Boston?"
    b = spark.createDataFrame([(1, item), (2, "A box holds 1 200 pens and 35 books for each of the 12 teachers in the school")], "item_id long, text string")
    one = item.replace("Maria Lopez", "Ann").replace("New York", "Rome").replace("Boston", "Oslo")
    docs = [(1, "Before. " + item + " After."), (2, one), (3, one.replace("Ann", "Mary Ann")), (4, item.replace("120 km", "one hundred km").replace("2 hours", "two hours")),
            (6, "a box holds 7 pens and 9 books for each of the 4 teachers in the school"), (8, "Nothing of the kind stands here at all in this text.")]
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, text_key string, leaked_id int")
    got = {(r.doc_id, r.item_id): (r.verbatim, r.share) for r in template_decontamination.leaks(d, b).collect()}
    assert {k: v for k, (v, _) in got.items()} == {(1, 1): True, (2, 1): False, (3, 1): False, (4, 1): False, (6, 2): False}
    assert got[2, 1][1] == got[3, 1][1] == got[1, 1][1] == 1.0 and got[4, 1][1] < 1
    kept = template_decontamination.remove(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [8]


def test_one_window_in_many_items_and_documents(spark):
    line = "choose the right answer from the list given below and"
    items = [(i, f"{line} mind that item{i} asks a thing of its own number{i} which differs from all the other items{i} in the list by more than a few words{i} of the whole text") for i in range(60)]
    d = [(i, f"{line} go on with other words x{i}") for i in range(300)] + [(1000 + i, t.upper()) for i, t in items]
    got = template_decontamination.leaks(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1000 + i, i) for i, _ in items}
