"""Quality rules, decontamination, mixing and tool calls: small cases, nulls, ties, clashing names, brute force."""

import json
import math

import pytest
from pyspark.sql import functions as F

from standpoint.llm import pfair_mixing, quality_rules, template_decontamination, tool_calls

DOCS = "doc_id long, text string, source string, n_words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], DOCS)


def brute_repeats(words):
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    return len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)})


def test_measures_by_brute_force(spark):
    texts = ["a b c a b c a b", "x\x0by\x1cz q", "one\n\none\n \ntwo #|", "w " * 60, "", None, "a b c d " * 30, "é ü ß é ü ß"]
    led = {r.doc_id: r for r in quality_rules.ledger(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    import re

    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (led[i].n_words, led[i].n_repeat_words, led[i].n_dup_lines) == (len(words), brute_repeats(words), len(lines) - len(set(lines)))


def test_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    d = docs(spark, [(1, good, "a"), (2, "short", "a"), (3, "spam eggs ham " * 40, "b"), (4, good.upper(), "b"), (None, None, None), (1, good, "a")])
    led = quality_rules.apply_policy(quality_rules.ledger(d))
    assert sorted((r.doc_id or 0, r.base_failed, r.kept) for r in led.collect()) == [(0, True, False), (1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, False, False)]
    kept = quality_rules.keep(d)
    assert kept.columns == d.columns and kept.count() == 2
    row = quality_rules.ablations(led, ["web-2"]).where("rule = 'upper_case'").first()
    assert (row.documents, row.kept, row.rejected, row.only_rejected, row.kept_without) == (6, 2, 1, 1, 3)
    assert quality_rules.keep(d.limit(0)).count() == 0


ITEM = "So, Tim has 3 apples and gives 2 to the boy, then Tim has 3 more pears than 2 of them in total"


def test_templates(spark):
    swapped = ITEM.replace("3", "40").replace("2", "7").replace("Tim", "Zoe")
    broken = ITEM.replace("has 3 more", "has 9 more").replace("than 2", "than 8")
    d = docs(spark, [(1, "Before. " + ITEM + " after.", "a"), (2, swapped, "a"), (3, broken, "a"), (4, "nothing of it", "a"), (5, None, None), (None, ITEM, "b"), (2, "clean text", "a")])
    b = spark.createDataFrame([(9, ITEM), (10, None), (11, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in template_decontamination.leaks(d, b).collect()}
    assert got == {(1, 9, True), (2, 9, False), (None, 9, True)}
    kept = template_decontamination.remove(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, "clean text"), (3, broken), (4, "nothing of it"), (5, "")]
    assert template_decontamination.leaks(d.limit(0), b).count() == 0 and template_decontamination.leaks(d, b.limit(0)).count() == 0


def test_removal_does_not_shuffle_texts(spark):
    """What leaked is known to be little before whole documents are joined with it."""
    d = docs(spark, [(1, "Before. " + ITEM + " after.", "a"), (2, "clean text", "a")])
    kept = template_decontamination.remove(d, spark.createDataFrame([(9, ITEM)], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def edf(content):
    """Earliest deadline first, slot by slot."""
    total, placed, out = sum(n for _, n in content), {s: 0 for s, _ in content}, []
    for slot in range(total):
        ready = [(math.ceil((placed[s] + 1) * total / n), i, s) for i, (s, n) in enumerate(content) if placed[s] < n and placed[s] * total // n <= slot]
        s = min(ready)[2]
        out.append((s, placed[s]))
        placed[s] += 1
    return out


def test_schedule_is_edf(spark):
    for content in ([("a", 3), ("b", 5), ("c", 1)], [("a", 1)], [("a", 7), ("b", 7), ("c", 7), ("d", 2)]):
        row = spark.createDataFrame([(content,)], "c array<struct<name:string,n:bigint>>").select(pfair_mixing.schedule(F.col("c")).alias("s")).first()
        assert [(x.name, x.j) for x in row.s] == edf(content)


def test_mix_stays_within_a_block(spark):
    rows = [(i, "t", "abc"[i % 3] if i % 2 else "a") for i in range(600)] + [(None, None, None)] * 5
    d = docs(spark, rows).withColumn("mix_slot", F.lit("taken"))
    m = pfair_mixing.mix(d, {"a": 3, "b": 1, "c": 2}, block=10, per_bucket=50).collect()
    assert len(m) == 605 and m[0].mix_slot == "taken"
    slots = {}
    for r in m:
        slots.setdefault(r["_mix_slot"], set()).add(r.source)
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    weights, placed = {"a": 3, "b": 1, "c": 2, None: 1}, {"a": 0, "b": 0, "c": 0, None: 0}
    for t in range(7):
        placed[next(iter(slots[t]))] += 1
        assert all(abs(placed[s] - (t + 1) * w / 7) < 1 for s, w in weights.items())
    assert len({(r["_mix_slot"], r.mix_row) for r in m}) == 605
    assert pfair_mixing.mix(d.limit(0)).count() == 0
    taken = d
    for c in ("s", "b", "w", "n", "j", "slot", "offset", "before", "fs", "ff", "fn", "first", "next", "weight", "mx_source", "frame_slots"):
        taken = taken.withColumn(c, F.lit(c))
    again = pfair_mixing.mix(taken, {"a": 3, "b": 1, "c": 2}, block=10, per_bucket=50).collect()
    place = lambda rs: sorted((r.doc_id or -1, r.source or "", r["_mix_slot"], r.mix_row) for r in rs)
    assert place(again) == place(m) and all(r.offset == "offset" and r.w == "w" for r in again)
    with pytest.raises(ValueError):
        pfair_mixing.mix(d, {"a": 0})


MESSAGES = "conv_id long, turn long, role string, text string"


def call(id_, name, arguments, after=None):
    return {"id": id_, "name": name, "arguments": arguments} | ({"after": after} if after else {})


def test_tool_calls(spark):
    calls = [call("b", "measure", {"value": 2}, "a"), call("a", "search", {"query": "x"}), call("c", "lookup", {"key": 1, "more": 0}, "b"), call("d", "none", {}), call("e", "search", {"query": "y"}, "f"),
             call("f", "search", {"query": "y"}, "e"), call("a", "search", {"query": "again"})]
    m = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", json.dumps({"tool_calls": calls})), (1, 3, "tool", '{"tool_call_id":"a","content":{"z":1,"b":[2, 3]}}'),
                               (1, 4, "tool", '{"tool_call_id":"a","content":1}'), (1, 5, "tool", '{"tool_call_id":"q","content":1}'), (None, None, None, None), (2, 1, "assistant", "{no json")], MESSAGES)
    got = {(r.id, r.at): r for r in tool_calls.link(m, tool_calls.TOOLS).collect()}
    assert [(k[0], got[k].depth, got[k].cyclic) for k in sorted(got, key=lambda k: k[1])][:6] == [("b", 1, False), ("a", 0, False), ("c", 2, False), ("d", 0, False), ("e", None, True), ("f", None, True)]
    assert got["a", 1].result == '{"b":[2,3],"z":1}' and got["a", 1].n_results == 2 and got["a", 6].repeated
    assert got["c", 2].faults == ["missing exact", "type of key", "unknown more"] and got["d", 3].faults == ["no such tool"] and got["e", 4].faults == ["cycle"]
    out = tool_calls.format_messages(m, tool_calls.TOOLS).collect()
    assert len(out) == 3 + 7 + 1 and all(r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in out)


def test_long_chains_of_calls(spark):
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [call(f"c{i}", "search", {"query": "x"}, f"c{i - 1}" if i else None)]})) for i in range(70)]
    got = {r.id: r.depth for r in tool_calls.link(spark.createDataFrame(rows, MESSAGES), tool_calls.TOOLS).collect()}
    assert got == {f"c{i}": i for i in range(70)}
