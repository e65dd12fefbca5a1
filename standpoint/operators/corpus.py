"""Preparing labelled claim/evidence rows: atoms, unrelated pairs, mixtures, splits, batches and audits.

Random choices are hashes of (seed, identity), so a rerun or a lost executor repeats them. Positions in an
order come from hash buckets or blocked scans, never from a window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from standpoint.functions import scalars as S
from standpoint.operators.ledger import SMALL_TASK, as_of_sides, change_intervals, in_force
from standpoint.operators.links import ranked_item, rendered
from standpoint.operators.logic import let
from standpoint.operators.scan import dense_index, ordered_index, running_before, skew_join, spread
from standpoint.schemas import NEI, NOT_SUPPORTS, REFUTES, SUPPORTS
from standpoint.session import cut_lineage

BLOCK = 65536

# How each corpus names its columns and labels (0 supports, 1 refutes, 2 not enough, 3 not supported).
SOURCES = {
    "vitaminc": ("claim", "evidence", "case_id", "page", {"SUPPORTS": SUPPORTS, "REFUTES": REFUTES, "NOT ENOUGH INFO": NEI}),
    "mnli": ("hypothesis", "premise", "pairID", "promptID", {"0": SUPPORTS, "1": NEI, "2": REFUTES}),
    "snli": ("hypothesis", "premise", "premise", None, {"0": SUPPORTS, "1": NEI, "2": REFUTES}),
    "wanli": ("hypothesis", "premise", "pairID", None, {"entailment": SUPPORTS, "neutral": NEI, "contradiction": REFUTES}),
    "anli": ("hypothesis", "premise", "uid", None, {"0": SUPPORTS, "1": NEI, "2": REFUTES}),
    "docnli": ("hypothesis", "premise", "premise", None, {"entailment": SUPPORTS, "not_entailment": NOT_SUPPORTS}),
}


def normalise_source(df: DataFrame, source: str, label: str = "label") -> DataFrame:
    """One corpus in the common schema (claim, evidence, label, source, group, page). A row without an accepted label or
    without text is dropped."""
    claim, evidence, group, page, labels = SOURCES[source]
    lookup = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    g = S.text_hash(group) if source == "docnli" else F.col(group)  # a whole premise is its group
    key = F.coalesce(F.col(page).cast("string"), g.cast("string")) if page else g.cast("string")
    out = df.select(S.clean_text(claim).alias("claim"), S.clean_text(evidence).alias("evidence"),
                    F.try_element_at(lookup, F.col(label).cast("string")).alias("label"), F.lit(source).alias("source"),
                    g.cast("string").alias("group"), F.concat(F.lit(source + ":"), key).alias("page"))
    return out.filter(F.col("label").isNotNull() & (F.coalesce("claim", F.lit("")) != "") & (F.coalesce("evidence", F.lit("")) != ""))


def position(df: DataFrame, order: str, name: str = "pos", block: int = BLOCK) -> DataFrame:
    """Number rows 0.. in the order of a unique integer column."""
    one = df.withColumn("_one", F.lit(1))
    return (running_before(one, ["_one"], [F.floor(F.col(order) / F.lit(block))], [F.col(order)], {name: F.lit(1)})
            .withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint")).drop("_one"))


def _number(*parts) -> Column:
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")


# ---------------------------------------------------------------- atoms


def revision_atoms(rows: DataFrame, tag: str = "") -> DataFrame:
    """Claims of a case with the first two distinct evidences, in order: rows (case_id, claim, evidence, label, page, ord).
    Of identical pairs the last label stands. Counts and the two smallest texts are limited before the
    shuffle, so a case of any size is no single task's burden."""
    pairs = rows.groupBy("case_id", "claim", "evidence").agg(F.max_by("label", "ord").alias("label"))
    key = ["case_id", "claim"]
    n = pairs.groupBy(*key).agg(F.count("*").alias("n_versions"))
    place = F.row_number().over(W.partitionBy(*key).orderBy("evidence"))
    two = pairs.withColumn("i", place).filter(F.col("i") <= 2)
    v = two.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("evidence").alias("text"), "label"))),
                                          lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"))).alias("versions"))
    number = ordered_index(n, ["case_id"], ["claim"], "ci")
    page = rows.groupBy("case_id").agg(F.min_by("page", "ord").alias("page"))
    return (number.join(v, key).join(page, "case_id").select(
        F.concat(F.lit(f"vitc:{tag}:"), F.col("case_id").cast("string"), F.lit(":"), F.col("ci").cast("string")).alias("atom_id"),
        F.when(F.col("n_versions") >= 2, F.lit("revision")).otherwise(F.lit("static")).alias("kind"), "claim", "versions",
        F.coalesce(F.col("page"), F.col("case_id").cast("string")).alias("page"), F.lit("vitaminc").alias("source")))


def static_atoms(rows: DataFrame, source: str, tag: str = "", index: str = "pos") -> DataFrame:
    return rows.select(
        F.concat(F.lit(f"{source}:{tag}:"), F.col(index).cast("string")).alias("atom_id"), F.lit("static").alias("kind"), "claim",
        F.array(F.struct(F.col("evidence").alias("text"), "label")).alias("versions"),
        F.concat(F.lit(f"{source}:{tag}:"), F.col("group").cast("string")).alias("page"), F.lit(source).alias("source"))


# ---------------------------------------------------------------- unrelated pairs


def unrelated_pairs(pairs: DataFrame, key: str, n: int, seed: int = 0, candidates: int = 1, mined: bool = False) -> DataFrame:
    """``n`` draws of a claim with the evidence of another row, labelled as settling nothing. Draw t takes its claim row and
    its candidates by hash; a candidate from the same page, or with the same claim or evidence, does not
    count. The first candidate is used, or, if ``mined``, the one sharing most content words, ties to the
    first. More draws are made than needed, twice as many again while too few worked, and the first ``n``
    that worked are kept; rows (t, claim, evidence, ...)."""
    many = 2 * n + 64
    index = cut_lineage(dense_index(pairs.select(key, "claim", "evidence", "page"), [key]))
    total = index.count()
    best = cut_lineage(_crossings(index, total, many, seed, candidates, mined))
    while best.count() < n and many < 256 * n:
        many *= 2
        best = cut_lineage(_crossings(index, total, many, seed, candidates, mined))
    kept = position(best, "t", "i").filter(F.col("i") < n)
    kept = (kept.join(index.select(F.col("idx").alias("_ia"), "claim"), "_ia")
            .join(index.select(F.col("idx").alias("_ib"), "evidence"), "_ib"))
    return kept.select("t", "i", "claim", "evidence", F.lit(NEI).alias("label"), F.lit("unrelated").alias("source"), "shared",
                       F.concat(F.lit("unrelated:"), "_pa", F.lit("|"), "_pb").alias("page"))


def _crossings(index: DataFrame, total: int, many: int, seed: int, candidates: int, mined: bool) -> DataFrame:
    """The draws among the first ``many`` for which some candidate counted, each with the two rows (``_ia``, ``_ib``) it takes. Texts stay
    where they are: a draw carries their 128-bit hashes and the claim's words, and meets the words of each candidate's evidence."""
    def digest(c):
        return F.unhex(F.substring(F.sha2(c, 256), 1, 32))

    n = F.lit(max(total, 1))
    t = index.sparkSession.range(0, many).withColumnRenamed("id", "t")
    slim = index.select("idx", "page", digest("claim").alias("_claim"), digest("evidence").alias("_evidence"),
                        *([S.content_words("claim").alias("_claim_words")] if mined else []))
    a = t.withColumn("idx", _number(seed, "a", F.col("t")) % n).join(slim, "idx").select(
        "t", F.col("idx").alias("_ia"), F.col("page").alias("_pa"), F.col("_claim").alias("_ca"), F.col("_evidence").alias("_ea"),
        *([F.col("_claim_words").alias("_wa")] if mined else []))
    c = a.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))).withColumn(
        "idx", _number(seed, "b", F.col("t"), F.col("j")) % n)
    b = index.select("idx", F.col("page").alias("_pb"), digest("claim").alias("_cb"), digest("evidence").alias("_eb"),
                     *([S.content_words("evidence").alias("_wb")] if mined else []))
    ok = (F.col("_pa") != F.col("_pb")) & (F.col("_ca") != F.col("_cb")) & (F.col("_ea") != F.col("_eb"))
    j = c.join(b, "idx").filter(ok)
    shared = F.size(F.array_intersect("_wa", "_wb")) if mined else F.lit(0)
    return (j.withColumn("shared", shared).groupBy("t").agg(F.max_by(F.struct("_ia", F.col("idx").alias("_ib"), "shared", "_pa", "_pb"),
                                                                    F.struct("shared", (-F.col("j")).alias("j"))).alias("x")).select("t", "x.*"))


def mined_negatives(pairs: DataFrame, key: str, n: int, seed: int = 0, candidates: int = 8) -> DataFrame:
    return unrelated_pairs(pairs, key, n, seed, candidates, mined=True)


# ---------------------------------------------------------------- mixtures, orders, splits


def shuffled(df: DataFrame, key: str, seed: int = 0, epoch: int = 0, within: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Position of every row in a permutation of the whole corpus, decided by a hash of (seed, epoch, key)."""
    k = df.withColumn("_k", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")).cast("binary")))
    return dense_index(k, ["_k"], name, within).drop("_k")


def global_shuffle(df: DataFrame, key: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    return shuffled(df, key, seed, epoch)


def weighted_mixture(rows: DataFrame, key: str, weights: dict[str, float], n: int, seed: int = 0) -> DataFrame:
    """About ``n`` rows with each source's share as weighted: round(w * n) rows of a source in its own shuffled order,
    starting again when a source is smaller than its share (``pass`` counts the rounds)."""
    total = sum(w for w in weights.values() if w > 0)
    quota = F.create_map(*[F.lit(x) for s, w in weights.items() if w > 0 for x in (s, round(w / total * n))])
    r = rows.filter(F.col("source").isin([s for s, w in weights.items() if w > 0]))
    sizes = r.groupBy("source").agg(F.count("*").alias("_size"))
    d = shuffled(r, key, seed, within=["source"], name="_i").join(F.broadcast(sizes), "source")
    copies = F.floor((F.element_at(quota, F.col("source")) - F.col("_i") - 1) / F.col("_size")) + 1
    return (d.withColumn("_copies", copies).filter(F.col("_copies") > 0)
            .withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int")))).drop("_i", "_size", "_copies"))


def eval_split(rows: DataFrame, limit: int, order: str = "ord", group: str = "group") -> DataFrame:
    """The first ``limit`` rows, and after them rows that finish groups already begun, up to the first row that does not."""
    p = position(rows, order)
    begun = p.filter(F.col("pos") < limit).select(group).distinct()
    stop = p.filter(F.col("pos") >= limit).join(begun, group, "left_anti").agg(F.min("pos")).scalar()
    return p.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))).drop("_stop")


def length_buckets(rows: DataFrame, key: str, length: str, batch: int, pool: int, seed: int = 0) -> DataFrame:
    """Batches of similar length: pools of ``pool`` rows in shuffled order, sorted by length and cut, the batches of a pool
    in hashed order. A pool is bounded, so its windows are."""
    p = shuffled(rows, key, seed).withColumn("pool", F.floor(F.col("pos") / pool))
    inside = W.partitionBy("pool").orderBy(length, key)
    p = p.withColumn("batch", F.floor((F.row_number().over(inside) - 1) / batch))
    tag = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pool").cast("string"), F.col("batch").cast("string")).cast("binary"))
    return p.withColumn("_tag", tag).withColumn(
        "batch_order", F.dense_rank().over(W.partitionBy("pool").orderBy("_tag")) - 1).drop("_tag", "pos")


def label_mix(rows: DataFrame, window: int, order: str = "pos", tolerance: float = 0.12, min_rows: int = 200) -> DataFrame:
    """Share of each label per source and window of the stream, and whether it strays from the share so far. Windows under
    ``min_rows`` are reported with ``enough`` false and never stray."""
    c = rows.withColumn("win", F.floor(F.col(order) / window)).groupBy("source", "win").agg(
        *[F.sum((F.col("label") == k).cast("long")).alias(f"n{k}") for k in range(3)], F.count("*").alias("n"))
    values = {f"_t{k}": F.col(f"n{k}") for k in range(3)} | {"_t": F.col("n")}
    t = running_before(c, ["source"], [F.floor(F.col("win") / 4096)], [F.col("win")], values)
    total = F.coalesce("_t", F.lit(0)) + F.col("n")
    share = [F.col(f"n{k}") / F.col("n") for k in range(3)]
    gap = [F.abs(share[k] - (F.coalesce(f"_t{k}", F.lit(0)) + F.col(f"n{k}")) / total) for k in range(3)]
    enough = F.col("n") >= min_rows
    drift = enough & (total > 4 * F.col("n")) & (F.greatest(*gap) > tolerance)
    return t.select("source", "win", "n", *[share[k].alias(f"share_{k}") for k in range(3)], enough.alias("enough"), drift.alias("drift"))


def source_counts_licences(rows: DataFrame, licences: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("rows_drawn")).join(licences, "source", "left").withColumn(
        "licence", F.coalesce("licence", F.lit("derived: texts drawn from the real sources above")))


def stride_sample(rows: DataFrame, every: int, limit: int, order: str = "ord") -> DataFrame:
    """Every ``every``-th row in file order, at most ``limit`` of them."""
    p = position(rows, order)
    return p.filter((F.col("pos") % every == 0) & (F.col("pos") < every * limit))


def replay_rows(atoms: DataFrame, n: int, seed: int = 0, unrelated_share: float = 0.2) -> DataFrame:
    """Labelled pairs from atoms: mostly a claim with one of its own versions, the rest with a version of an atom from
    another page, which settles nothing."""
    flat = atoms.select(
        "atom_id", "claim", "page", F.posexplode("versions").alias("vi", "v")).select(
        "claim", "page", F.concat("atom_id", F.lit("/"), F.col("vi").cast("string")).alias("key"), F.col("v.text").alias("evidence"), F.col("v.label").alias("label"))
    n_cross = round(n * unrelated_share)
    idx = dense_index(flat, ["key"])
    total = flat.agg(F.count("*")).scalar()
    own = (atoms.sparkSession.range(0, n - n_cross).withColumn("idx", _number(seed, "own", F.col("id")) % total)
           .join(idx, "idx").select("claim", "evidence", "label"))
    return own.unionByName(unrelated_pairs(flat, "key", n_cross, seed).select("claim", "evidence", "label"))


def overlap_audit(train: DataFrame, pool: DataFrame, by: str = "pool") -> DataFrame:
    """Per pool: pairs, and how many of its pairs, claims, evidences and pages also occur in training. Each is a semi-join
    on a hash of the distinct values; copies are removed before they are shuffled."""
    def key(*cols):
        return F.substring(S.text_hash(*cols), 1, 32)

    p = pool.withColumn("_pair", key("claim", "evidence")).withColumn("_claim", key("claim")).withColumn("_ev", key("evidence")).withColumn("_page", F.col("page"))
    t = train.withColumn("_pair", key("claim", "evidence")).withColumn("_claim", key("claim")).withColumn("_ev", key("evidence")).withColumn("_page", F.col("page"))
    out = p.groupBy(by).agg(F.count("*").alias("pairs"))
    for c, name in (("_pair", "pairs_in_train"), ("_claim", "claims_in_train"), ("_ev", "evidence_in_train"), ("_page", "pages_in_train")):
        counts = p.groupBy(by, c).agg(F.count("*").alias("_n"))
        seen = counts.join(t.select(c).distinct(), c, "left_semi").groupBy(by).agg(F.sum("_n").alias(name))
        out = out.join(seen, by, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


# ---------------------------------------------------------------- states over time as examples


def steps_in_force(events: DataFrame, steps: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Usable records of a task at each step: one row per (task_id, step, record)."""
    from standpoint.operators.ledger import ledger_as_of

    return ledger_as_of(events, steps, spans=spans).filter((F.col("status") == "active") & (F.coalesce("text", F.lit("")) != ""))


def _status_of(items: Column, i: Column) -> Column:
    """Gold status of the i-th predicate under the records in force: the decisive labels of the top rank; disagreement is a conflict."""
    decisive = F.filter(items, lambda x: F.get(x["labels"], i) < 2)

    def read(d):
        top = F.array_max(F.transform(d, lambda x: F.struct(x["au"].alias("au"), x["vf"].alias("vf"))))
        first = F.filter(d, lambda x: x["au"].eqNullSafe(top["au"]) & x["vf"].eqNullSafe(top["vf"]))
        return let(F.transform(first, lambda x: F.get(x["labels"], i)), lambda labels: F.when(F.size(labels) == 0, F.lit("UNRESOLVED"))
                   .when(F.array_min(labels) != F.array_max(labels), F.lit("CONFLICT")).when(F.array_min(labels) == 0, F.lit("SATISFIED"))
                   .otherwise(F.lit("VIOLATED")))

    return let(decisive, read)


def disposition_contexts(events: DataFrame, steps: DataFrame, predicates: DataFrame, label, spans: DataFrame | None = None,
                         bucket: int = 4096, small: int = SMALL_TASK) -> DataFrame:
    """One row per changed step and predicate: claim, all usable records rendered highest rank first, gold status; ``label`` maps columns
    (text, predicate_id) to 0-2. A task holds at most 5,000 records, which bounds a context. Records are labelled once a span and ranked once a
    bucket of steps; a step then takes those in force from its bucket's list, inside its row, so records are never shuffled once a step."""
    spans = change_intervals(events) if spans is None else spans
    claims = predicates.groupBy("task_id").agg(F.collect_list(F.struct("predicate_id", F.col("text").alias("claim"))).alias("_claims"))
    live = skew_join(spans.filter((F.col("status") == "active") & (F.coalesce("text", F.lit("")) != "")), claims, ["task_id"])
    item = F.struct(ranked_item().alias("o"), F.coalesce("valid_from", F.lit(float("-inf"))).alias("vf"), "seq_from", "seq_to",
                    F.transform("_claims", lambda c: label(F.col("text"), c["predicate_id"])).alias("labels"))
    live = live.select("task_id", "seq_from", "seq_to", item.alias("item"))
    times = steps.groupBy("task_id", "step").agg(F.count("*").cast("int").alias("_times"))
    at, listed = as_of_sides(skew_join(times, claims, ["task_id"]), live, bucket, small)
    # few bytes, much work in the row: dealt over all partitions
    at, listed = spread(at, "task_id", "_bk"), spread(listed, "task_id", "_bk")
    lists = listed.groupBy("task_id", "_bk").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = F.transform(F.filter("items", lambda x: in_force(F.col("step"), x["seq_from"], x["seq_to"])), lambda x: F.struct(
        *[x["o"][n].alias(n) for n in ("au", "t", "x")], x["vf"].alias("vf"), x["labels"].alias("labels")))
    none = F.col("items").isNull() | (F.size("m") == 0)
    rows = at.join(lists, ["task_id", "_bk"], "left").withColumn("m", F.when(F.col("items").isNotNull(), found))
    again = F.when(F.col("_times") == 1, F.col("m")).otherwise(F.flatten(F.transform("m", lambda x: F.array_repeat(x, F.col("_times")))))
    read = F.transform("_claims", lambda c, i: F.struct(c["predicate_id"].alias("predicate_id"), c["claim"].alias("claim"), F.when(
        none, F.lit("UNRESOLVED")).otherwise(_status_of(F.col("m"), i)).alias("status")))
    rows = rows.select("task_id", "step", F.when(none, F.lit("(no records)")).otherwise(rendered(again)).alias("context"),
                       F.flatten(F.array_repeat(read, F.col("_times"))).alias("read"))
    return rows.select("task_id", "step", "context", F.explode("read").alias("r")).select(
        "task_id", "step", "r.predicate_id", "r.claim", "context", "r.status")


def set_suite_from_trace(events: DataFrame, steps: DataFrame, predicates: DataFrame, limit: int, seed: int = 0,
                         spans: DataFrame | None = None) -> DataFrame:
    """A sample of (step, predicate) examples with every reading pair in force for them and its rank (0 highest). Which examples
    are drawn is the order of a hash of (seed, example)."""
    from standpoint.operators.beliefs import dense_rank_edges

    grid = steps.join(predicates.select("task_id", "predicate_id", F.col("text").alias("claim")), "task_id")
    tag = F.md5(F.concat_ws("|", F.lit(str(seed)), "task_id", F.col("step").cast("string"), "predicate_id").cast("binary"))
    drawn = grid.withColumn("_tag", tag).orderBy("_tag").limit(limit).drop("_tag")
    drawn = cut_lineage(drawn)
    live = steps_in_force(events, drawn.select("task_id", "step").distinct(), spans)
    sets = cut_lineage(drawn.join(live, ["task_id", "step"]))
    return dense_rank_edges(sets, ["task_id", "step", "predicate_id"]).select(
        "task_id", "step", "predicate_id", "record_id", "claim", "text", "authority", "valid_from", "rank")
