"""Passages, mail, reports and documents as events."""

from hypothesis import given, settings
from hypothesis import strategies as st

from standpoint.functions.passages import passages_of
from standpoint.operators import corpus as C
from standpoint.operators import ingest as I
from standpoint.operators import ledger as L
from standpoint.schemas import ISSUE
from standpoint.sources import files as FS
from standpoint.sources import tasks as TS


def test_short_pieces_join_their_neighbour():
    text = "Hello,\n\nThe design you sent on Monday has been approved by everyone here.\n\nPlease note that the invoice is still open and needs attention.\n\nBest"
    got = passages_of(text)
    assert len(got) == 2 and got[0].startswith("Hello, The design") and got[1].endswith("Best")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\nCD", max_size=400), st.integers(20, 80))
def test_nothing_is_lost(text, limit):
    got = passages_of(text, max_chars=limit, min_chars=10)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert all(len(p) <= limit for p in got) and got == passages_of(text, limit, 10)


def test_long_paragraph_is_cut_at_sentences(spark):
    text = " ".join(f"Sentence number {i} says a little more than the one before." for i in range(30))
    got = passages_of(text)
    assert len(got) > 1 and all(p.endswith(".") and len(p) <= 600 for p in got)


MAIL = (b"From: Dana Doe <dana@example.com>\nSubject:  Re:  design\nDate: Tue, 02 Jan 2024 10:00:00 +0000\nMessage-ID: <abc#1@x>\n"
        b"Content-Type: text/plain; charset=utf-8\n\nApproved.\n> old\n\nOn Mon, someone at work wrote:\n> please\n")


def test_mail_files(spark):
    box = b"From a@b Tue Jan  2 10:00:00 2024\n" + MAIL + b"\nFrom a@b Tue Jan  2 11:00:00 2024\n" + MAIL.replace(b"Approved", b"Second")
    html = b"From: x@y\nContent-Type: text/html\n\n<p>no</p>\n"
    files = spark.createDataFrame([("/d/one.eml", bytearray(MAIL)), ("/d/box.mbox", bytearray(box)), ("/d/note v1.txt", bytearray(b" plain words ")),
                                   ("/d/scan.pdf", bytearray(b"%PDF")), ("/d/h.eml", bytearray(html)), ("/d/README", bytearray(b"x"))], "path string, content binary")
    rows = FS.parse_files(files).collect()
    by = {}
    for r in rows:
        by.setdefault(r["file"], []).append(r)
    one = by["/d/one.eml"][0]
    assert (one["doc_id"], one["text"], one["valid_from"]) == ("abc1@x", "Approved.", 1704189600.0)
    assert one["attribution"] == "Email from Dana Doe on 2024-01-02, subject: Re: design"
    assert [r["text"] for r in by["/d/box.mbox"]] == ["Approved.", "Second."]
    assert by["/d/note v1.txt"][0]["doc_id"] == "note-v1" and by["/d/note v1.txt"][0]["text"] == "plain words"
    assert "unsupported" in by["/d/scan.pdf"][0]["error"] and "/d/h.eml" not in by and by["/d/README"][0]["doc_id"] == "README"


def test_mail_in_parts_and_odd_files(spark):
    parts = (b"From: ann@x\nDate: never\nMessage-ID: <" + b"i" * 120 + b">\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=b\n\n"
             b"--b\nContent-Type: text/html\n\n<p>rich</p>\n--b\nContent-Type: text/plain; charset=utf-8\n\nPlain words.\n-- \nAnn\n--b--\n")
    unknown = b"From: ann@x\nContent-Type: text/plain; charset=nosuch\n\nlost\n"
    bare = b"Content-Type: text/plain\n\nNo header at all.\n"
    files = spark.createDataFrame([("/d/p.eml", bytearray(parts)), ("/d/u.eml", bytearray(unknown)), ("/d/b.EML", bytearray(bare)), ("/d/bad.md", bytearray(b"\xffok\n")),
                                   ("/d/empty.txt", bytearray(b" \n")), ("/d/none.mbox", bytearray(b"no message"))], "path string, content binary")
    by = {r["file"]: r for r in FS.parse_files(files).collect()}
    assert sorted(by) == ["/d/b.EML", "/d/bad.md", "/d/p.eml"]
    assert by["/d/p.eml"][1:5] == ("i" * 120, "Email from ann@x", "Plain words.", None)
    assert by["/d/b.EML"]["attribution"] == "Email from unknown sender" and by["/d/b.EML"]["doc_id"].startswith("msg-")
    assert by["/d/bad.md"]["text"] == "\ufffdok"


def body(requirement="A is done", message="A was done", got="Refutes", should="Supports", licence="Yes", extra=""):
    h = list(I.HEADINGS.values())
    return (f"### {h[0]}\n\n{requirement}\n\n### {h[1]}\n\n{message}{extra}\n\n### {h[2]}\n\n{got}\n\n### {h[3]}\n\n{should}\n\n"
            f"### {h[4]}\n\n{I.NO_RESPONSE}\n\n### {h[5]}\n\n{licence}\n")


def test_reports(spark):
    bodies = [body(), body(requirement="A  is done"), body(message="B", should="Supports"), body(message="B", got="Supports", should="Refutes"),
              body(licence="No"), body(got="Supports"), body(message=I.NO_RESPONSE), body(message="C", extra="\n### notes\nkept"), body(message="D")]
    rows = [(i + 1, "u", ("me",), "2024-01-02T00:00:00Z", [("Duplicate",)] if i == 8 else [("x",)], b) for i, b in enumerate(bodies)]
    got, counts = I.sync_reports(spark.createDataFrame(rows, ISSUE))
    by = {r["issue"]: r for r in got.collect()}
    assert sorted(by) == [1, 8] and "### notes" in by[8]["passage"] and by[1]["model"] == "" and by[1]["created"] == "2024-01-02"
    assert {r["reason"]: r["n"] for r in counts.collect()} == {
        "public": 2, "repeat": 1, "conflict": 2, "no_consent": 1, "same_label": 1, "unreadable": 1, "kept_out": 1}
    score = I.score_reports(got, spark.createDataFrame([("gh-1", "SUPPORTS"), ("gh-8", "REFUTES")], "id string, predicted string")).first()
    assert (score["cases"], score["correct"], score["repeats_reported"]) == (2, 1, 1)


DOC = "task_id string, doc_id string, revision int, text string, source_id string, authority int, attribution string, valid_from double"
LONG = "This paragraph is certainly long enough to stand alone as a passage."


def test_document_revision_withdraws_what_is_gone(spark):
    empty = spark.createDataFrame([], "task_id string, record_id string, revision int, stored_status string")
    first = I.ingest_documents(spark.createDataFrame([("t", "d", 1, "\n\n".join([LONG + str(i) for i in range(3)]), "s", 1, "Ann:", 5.0)], DOC), empty)
    rows = {r["record_id"]: r for r in first.collect()}
    assert sorted(rows) == ["d#0", "d#1", "d#2"] and rows["d#0"]["text"] == f"Ann: {LONG}0" and rows["d#1"]["span"] == "d, passage 2 of 3"
    from standpoint.operators.scan import dense_index

    state = L.ledger_state(dense_index(first, ["record_id"], "seq"))
    second = I.ingest_documents(spark.createDataFrame([("t", "d", 2, LONG + "0", "s", 1, "Ann", 5.0)], DOC), state)
    assert {r["record_id"]: r["text"] is None for r in second.collect()} == {"d#0": False, "d#1": True, "d#2": True}


def test_atoms(spark):
    rows = [("c1", "claim a", "ev2", 1, "P", 0), ("c1", "claim a", "ev1", 0, "P", 1), ("c1", "claim a", "ev1", 2, "P", 2), ("c1", "claim b", "ev", 0, "P", 3),
            ("c2", "claim a", "ev9", 1, None, 4)]
    a = {r["atom_id"]: r for r in C.revision_atoms(spark.createDataFrame(
        rows, "case_id string, claim string, evidence string, label int, page string, ord long"), "x").collect()}
    assert sorted(a) == ["vitc:x:c1:0", "vitc:x:c1:1", "vitc:x:c2:0"]
    first = a["vitc:x:c1:0"]
    assert first["kind"] == "revision" and [(v["text"], v["label"]) for v in first["versions"]] == [("ev1", 2), ("ev2", 1)]
    assert a["vitc:x:c1:1"]["kind"] == "static" and a["vitc:x:c2:0"]["page"] == "c2"


def test_unrelated_pairs_reach_their_number(spark):
    rows = [(i, f"c{i % 3}", f"e{i}", "hot" if i % 3 else f"p{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, claim string, evidence string, page string")
    got = C.mined_negatives(df, "id", 200, seed=4, candidates=2).collect()
    assert len(got) == 200 and {r["i"] for r in got} == set(range(200))
    page = {f"e{i}": p for i, _, _, p in rows}
    assert all(r["label"] == 2 and not r["page"].endswith("hot|hot") and page[r["evidence"]] for r in got)


def test_draws_carry_no_texts(spark):
    """What is ranked per candidate holds numbers, pages and hashes; the texts are those of the rows it names."""
    rows = [(i, f"claim words {i % 4} a{i % 7}", f"evidence words a{i % 7} {i}", f"p{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, claim string, evidence string, page string")
    index = C.dense_index(df, ["id"])
    assert C._crossings(index, 40, 64, 1, 4, True).columns == ["t", "_ia", "_ib", "shared", "_pa", "_pb"]
    got = C.mined_negatives(df, "id", 30, seed=1, candidates=4).collect()
    claims, evidence = {r[1] for r in rows}, {r[2] for r in rows}
    assert len(got) == 30 and all(r["claim"] in claims and r["evidence"] in evidence for r in got)
    assert all(r["shared"] == len((set(r["claim"].split()) & set(r["evidence"].split())) - {str(i) for i in range(10)}) for r in got)


def test_mixture_repeats_small_sources(spark):
    df = spark.range(110).selectExpr("id", "case when id < 10 then 'small' else 'big' end as source")
    got = {(r["source"]): r["count"] for r in C.weighted_mixture(df, "id", {"small": 1, "big": 3}, 100).groupBy("source").count().collect()}
    assert got == {"small": 25, "big": 75}


def test_task_documents_round_trip(spark, tmp_path):
    doc = ('{"task_id":"t","predicates":[{"id":"a","text":"A"}],"gates":[{"id":"g","op":"NOT","children":["a"]}],'
           '"actions":[{"id":"x","description":"d","requires":"g"}]}')
    (tmp_path / "t.json").write_text(doc)
    p, g, a = TS.read_tasks(spark, str(tmp_path))
    assert (p.first()["prior"], p.first()["ask_cost"], a.first()["reliability"], g.first()["k"]) == (0.5, 1.0, 1.0, 0)
    again = TS.parse_tasks(TS.document_json(p, g, a), "document")
    assert again[0].collect() == p.collect() and again[2].first()["requires"] == "g"


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, words in (("a", "first words"), ("b/c", "other words"), ("", "top words")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "notes.txt").write_text(words)
    (tmp_path / "b" / "one.eml").write_bytes(MAIL)
    got = {r["text"]: r["doc_id"] for r in FS.import_messages(spark, str(tmp_path)).filter("error is null").collect()}
    assert (got["first words"], got["other words"], got["top words"]) == ("a-notes", "b-c-notes", "notes") and len(got) == 4


def test_claims_with_one_beginning_are_numbered_in_order(spark):
    rows = [(1, f"the same beginning of a claim {i:03d}", f"evidence {j}", j % 3, f"page{i}", 10 * i + j) for i in range(120) for j in range(3)]
    df = spark.createDataFrame(rows, "case_id long, claim string, evidence string, label int, page string, ord long")
    atoms = C.revision_atoms(df, "x").collect()
    assert {a["atom_id"]: a["claim"] for a in atoms} == {f"vitc:x:1:{i}": f"the same beginning of a claim {i:03d}" for i in range(120)}
    assert all(a["kind"] == "revision" and [v["text"] for v in a["versions"]] == ["evidence 0", "evidence 1"] and a["page"] == "page0" for a in atoms)


def test_premises_with_one_beginning_are_two_groups(spark):
    long = "The beginning that these two premises have in common is longer than sixty-four letters, "
    df = spark.createDataFrame([("h", long + "one.", "entailment"), ("h", long + "two.", "entailment"), ("g", long + "one.", "not_entailment")], "hypothesis string, premise string, label string")
    got = C.normalise_source(df, "docnli").collect()
    assert len({r["group"] for r in got}) == len({r["page"] for r in got}) == 2 and got[0]["group"] == got[2]["group"]
