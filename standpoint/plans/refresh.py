"""Keeping decisions current: apply a batch of deliveries to stored tables and recompute only what it reaches.

Stored per run: the merged ledger, declared links, links, readings, edges, beliefs and assessments. A refresh touches
records named by the new deliveries (or whose validity the clock passed, or whose task has another definition), drops those
that did not really change, and follows record -> predicate -> action, cutting off again where a belief came out the same. Sums
are exact and order-free, so a refreshed table equals a rebuilt one bit for bit. ``delta`` gives the changes alone, which is what
``state_store`` writes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators import beliefs as B
from standpoint.operators import ledger as L
from standpoint.operators import links as K
from standpoint.operators import logic as G
from standpoint.operators import readings as R
from standpoint.operators.scan import skew_join
from standpoint.plans.flow import Flow
from standpoint.session import cut_lineage

REC, PRED = ["task_id", "record_id"], ["task_id", "predicate_id"]
EDGE = [*PRED, "record_id", "claim", "text", "authority", "valid_from", "members", "pair", "logits", "p_s", "p_r", "p_n"]
BELIEF = [*PRED, "prior", "s", "v", "u", "c", "n_decisive", "status", "belief"]


def early_cutoff(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows of ``new`` that are not equal, NULL equal to NULL, to the row of the same key in ``old``."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_there"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in cols], F.lit(True))
    j = new.join(o, keys, "left")
    return j.filter(~(F.coalesce("_there", F.lit(False)) & same)).select(*new.columns)


def change_report(before: DataFrame, after: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """Transitions of a value per key; a key that was not there before starts from ``default``."""
    b, a = before.select(*keys, F.col(value).alias("was")), after.select(*keys, F.col(value).alias("now"))
    return (a.join(b, keys, "left").withColumn("was", F.coalesce("was", F.lit(default)))
            .filter(F.col("was") != F.col("now")).select(*keys, "was", "now"))


def verify(cached: DataFrame, full: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Compare stored rows with a rebuild: rows compared, rows not equal in every bit, largest difference and where."""
    a = cached.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(1).alias("_ia"))
    b = full.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(1).alias("_ib"))
    j = a.join(b, keys, "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in cols])
    both = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    numeric = [c for c in cols if dict(full.dtypes)[c] in ("double", "float", "int", "bigint")]
    gap = F.greatest(F.lit(0.0), F.lit(0.0), *[F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")).cast("double") for c in numeric])
    j = j.withColumn("_same", both & same).withColumn("_gap", gap)
    return j.agg(F.count("*").alias("rows"), F.sum((~F.col("_same")).cast("long")).alias("unequal"), F.max("_gap").alias("max_difference"),
                 F.max_by(F.concat_ws("|", *keys), F.when(~F.col("_same"), F.col("_gap"))).alias("worst"))


@dataclass
class Tables:
    """The stored tables of a run, at clock ``now``."""

    state: DataFrame
    declared: DataFrame
    links: DataFrame
    readings: DataFrame
    edges: DataFrame
    beliefs: DataFrame
    assessments: DataFrame
    now: float | None = None


def full_run(f: Flow) -> Tables:
    edges = cut_lineage(f.edges.select(*EDGE))
    beliefs = cut_lineage(B.beliefs(edges, f.predicates).select(*BELIEF))
    a = cut_lineage(G.assess(f.compiled, beliefs, f.ready, f.block))
    return Tables(cut_lineage(f.state), f.declared, f.links, f.readings.select("pair", "logits"), edges, beliefs, a, f.now)


def _usable(state: DataFrame, now: float | None) -> DataFrame:
    return L.active_records(state, now)


#: What a delta replaces in each table: all rows of a key at once. Readings are only ever added. A joint edge goes by its own name
#: (``joint:`` and the predicate), so it is replaced like a record's.
KEYS = {"state": REC, "declared": REC, "links": REC, "edges": REC, "beliefs": PRED, "assessments": ["task_id", "action_id"], "readings": ["pair"]}


@dataclass
class Delta:
    """What a batch changes: per table the keys whose rows go and the rows that come."""

    gone: dict[str, DataFrame]
    rows: dict[str, DataFrame]
    report: dict[str, DataFrame]
    now: float | None


def changed_definitions(old: tuple[DataFrame, DataFrame, DataFrame], f: Flow) -> DataFrame:
    """Tasks whose definition (predicates, gates, actions) is not the one stored."""
    a, b = G.schema_version(*old).withColumnRenamed("version", "_was"), G.schema_version(f.predicates, f.gates, f.actions)
    return a.join(b, "task_id", "full_outer").filter(~F.col("version").eqNullSafe(F.col("_was"))).select("task_id")


def passed_by(prev_state: DataFrame, before: float | None, now: float | None) -> DataFrame:
    """Records whose validity the clock alone has changed. Only those with a boundary between the two clocks can be among them,
    a filter that reaches the files."""
    if now == before:
        return prev_state.limit(0).select(*REC)
    if before is None or now is None:
        return prev_state.select(*REC).distinct()
    lo, hi = min(before, now), max(before, now)
    near = F.col("valid_from").between(lo, hi) | F.col("valid_until").between(lo, hi)
    return L.clock_changes(prev_state.filter(near), before, now).select(*REC)


def delta(prev: Tables, new_events: DataFrame, f: Flow, now: float | None = None, redefined: DataFrame | None = None) -> Delta:
    """What a batch of deliveries, a moved clock and new definitions change. Every frame is as large as what the batch reaches;
    ``prev`` needs only the tasks concerned. ``redefined`` (task_id): tasks whose definition in ``f`` is another than before."""
    now = prev.now if now is None else now
    # 1. the ledger, for touched records only: merging is a semilattice, so their stored payloads count as deliveries
    named = cut_lineage(new_events.select(*REC).distinct())
    old = prev.state.join(named, REC, "left_semi").join(prev.declared, REC, "left")
    cols = [*REC, "seq", "revision", "payload_key", *L.PAYLOAD, "about"]
    log = cut_lineage(old.withColumn("seq", F.col("first_seq")).select(*cols).unionByName(L.keyed(new_events).select(*cols)))
    state_part = cut_lineage(L.ledger_state(log))
    declared_part = cut_lineage(K.declared_links(log))
    others = passed_by(prev.state, prev.now, now)
    if redefined is not None:
        redefined = cut_lineage(redefined.select("task_id").distinct())
        others = others.unionByName(prev.state.join(redefined, "task_id", "left_semi").select(*REC))
    others = cut_lineage(others.distinct().join(named, REC, "left_anti"))
    seen = named.unionByName(others)
    # 2. links of records that really changed
    current = state_part.unionByName(prev.state.join(others, REC, "left_semi"))
    declared = declared_part.unionByName(prev.declared.join(others, REC, "left_semi"))
    links_new = cut_lineage(f.link(_usable(current, now), declared).select(*K.LINK))
    links_old = prev.links.join(seen, REC, "left_semi")
    both = links_new.withColumn("_side", F.lit(1)).unionByName(links_old.select(*K.LINK).withColumn("_side", F.lit(0)))
    ident = [*PRED, "record_id", "payload_key", "claim", "joint"]
    moved = cut_lineage(both.groupBy(*ident).agg(F.min("_side").alias("lo"), F.max("_side").alias("hi")).filter("lo = hi")
                        .select(*PRED, "record_id").distinct())
    changed_records = cut_lineage(moved.select(*REC).distinct())
    links_part = links_new.join(changed_records, REC, "left_semi").select(*K.LINK)
    touched = moved.select(*PRED).distinct()
    if redefined is not None:
        touched = (touched.unionByName(f.predicates.join(redefined, "task_id", "left_semi").select(*PRED))
                   .unionByName(prev.beliefs.join(redefined, "task_id", "left_semi").select(*PRED)).distinct())
    touched = cut_lineage(touched)
    # 3. readings: all links of changed records, joint texts of touched predicates, of which only pairs never read are read
    joint_kept = prev.links.filter("joint").join(touched, PRED, "left_semi").join(changed_records, REC, "left_anti").select(*K.LINK)
    pairs = cut_lineage(K.reading_pairs(links_part.filter(~F.col("joint")).unionByName(joint_kept).unionByName(
        links_part.filter("joint").join(touched, PRED, "left_semi"))))
    known = prev.readings.join(pairs.select("pair").distinct(), "pair", "left_semi")
    new_readings = cut_lineage(f.scorer(R.distinct_pairs(pairs).join(prev.readings, "pair", "left_anti")).select("pair", "logits"))
    # 4. edges and beliefs of touched predicates
    fresh = cut_lineage(R.attach(pairs, known.select("pair", "logits").unionByName(new_readings), f.temperature, f.bias).select(*EDGE))
    old_edges = prev.edges.join(touched, PRED, "left_semi")
    edges_gone = cut_lineage(changed_records.unionByName(old_edges.filter(F.col("record_id").startswith("joint:")).select(*REC)).distinct())
    edges = old_edges.join(edges_gone, REC, "left_anti").select(*EDGE).unionByName(fresh.join(touched, PRED, "left_semi"))
    b_part = cut_lineage(B.beliefs(edges, f.predicates.join(touched, PRED, "left_semi")).select(*BELIEF))
    b_old = prev.beliefs.join(touched, PRED, "left_semi")
    b_moved = early_cutoff(b_old, b_part, PRED, ["s", "v", "u", "c", "belief"])
    # 5. actions above beliefs that moved, compiled for their tasks alone
    tasks = b_moved.select("task_id") if redefined is None else b_moved.select("task_id").unionByName(redefined)
    tasks = cut_lineage(tasks.distinct())
    mine = [d.join(tasks, "task_id", "left_semi") for d in (f.predicates, f.gates, f.actions)]
    compiled = G.compile_actions(*mine)
    ak = ["task_id", "action_id"]
    acts = G.leaves_of(compiled).join(b_moved.select(*PRED), PRED, "left_semi").select(*ak)
    if redefined is not None:
        acts = acts.unionByName(compiled.join(redefined, "task_id", "left_semi").select(*ak)).unionByName(
            prev.assessments.join(redefined, "task_id", "left_semi").select(*ak))
    acts = cut_lineage(acts.distinct())
    beliefs = b_part.unionByName(prev.beliefs.join(touched, PRED, "left_anti").select(*BELIEF)).join(acts.select("task_id").distinct(), "task_id", "left_semi")
    a_part = cut_lineage(G.assess(compiled.join(acts, ak, "left_semi"), beliefs, f.ready, f.block))
    report = {
        "changed_records": changed_records, "touched_predicates": touched, "touched_actions": acts, "read_pairs": new_readings,
        "predicates": change_report(b_old, b_part, PRED, "status", "UNRESOLVED"),
        "actions": change_report(prev.assessments.join(acts, ak, "left_semi"), a_part, ak, "disposition", "NEEDS_INFO"),
    }
    gone = {"state": named, "declared": named, "links": changed_records, "edges": edges_gone, "beliefs": touched, "assessments": acts}
    rows = {"state": state_part, "declared": declared_part, "links": links_part, "edges": fresh, "beliefs": b_part, "assessments": a_part, "readings": new_readings}
    return Delta(gone, rows, report, now)


def refresh(prev: Tables, new_events: DataFrame, f: Flow, now: float | None = None, redefined: DataFrame | None = None) -> tuple[Tables, dict[str, DataFrame]]:
    """(new tables, report). ``f`` supplies predicates, gates, actions, scorer, calibration and bars. Tables stay lazy over what
    was stored; ``state_store`` keeps them over many batches."""
    d = delta(prev, new_events, f, now, redefined)
    new = {}
    for n, keys in KEYS.items():
        was = getattr(prev, n)
        kept = was.join(d.gone[n], keys, "left_anti") if n in d.gone else was
        new[n] = kept.select(*d.rows[n].columns).unionByName(d.rows[n])
    return Tables(**new, now=d.now), d.report


def recalibrate(t: Tables, f: Flow, temperature: float, bias=(0.0, 0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(beliefs, assessments) under another calibration, from the stored logits: nothing is read again."""
    e = t.edges.drop("p_s", "p_r", "p_n").withColumn("_p", S.calibrate_probs("logits", temperature, bias)).select("*", "_p.*").drop("_p")
    b = B.beliefs(e, f.predicates)
    return b, G.assess(f.compiled, b, f.ready, f.block)


def set_bars(t: Tables, f: Flow, ready: float | Column, block: float) -> DataFrame:
    """Dispositions under other bars, from the stored status distributions."""
    return t.assessments.withColumn("disposition", S.disposition("s", "v", ready, block))


# ---------------------------------------------------------------- views


def task_state(f: Flow) -> DataFrame:
    """One row per task: what each action and predicate stands at, records by status, next time anything changes by
    itself. Lists are of a task's declared actions and predicates, which are few."""
    acts = f.assessments.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("action_id", F.lit("="), "disposition"))), ",").alias("actions"))
    preds = f.beliefs.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("predicate_id", F.lit("="), "status"))), ",").alias("predicates"))
    heads = L.record_heads(f.events).withColumn("status", S.record_status(f.now))
    names = ("active", "withdrawn", "conflicted", "expired", "not_yet_valid")
    recs = heads.groupBy("task_id").agg(*[F.sum((F.col("status") == n).cast("long")).alias(n) for n in names])
    nxt = L.next_transition(heads, f.now) if f.now is not None else None
    out = acts.join(preds, "task_id").join(recs, "task_id", "left")
    return out.join(nxt, "task_id", "left") if nxt is not None else out


def explain(f: Flow) -> DataFrame:
    """What each action rests on: a row per predicate under it and decisive record (none: one row without a record). A
    joint reading lists each of its members."""
    leaves = G.leaves_of(f.compiled).select("task_id", "action_id", "predicate_id")
    compared = f.links.groupBy(*PRED).agg(F.count("*").alias("records_compared"))
    decisive = (f.edges.filter(1.0 - F.col("p_n") >= 0.5)
                .select(*PRED, "logits", (F.size("members") > 1).alias("read_jointly"), F.explode("members").alias("record_id")))
    heads = f.records.select(*REC, "revision", "source_id", "authority", "valid_from", "text")
    rec = decisive.join(heads, REC)
    b = f.beliefs.select(*PRED, "status", "belief")
    known = cut_lineage(leaves.join(b, PRED).join(compared, PRED, "left"))
    rec = cut_lineage(rec)
    with_record = skew_join(rec, known, PRED)
    bare = known.join(rec.select(*PRED).distinct(), PRED, "left_anti")
    return with_record.unionByName(bare, allowMissingColumns=True)
