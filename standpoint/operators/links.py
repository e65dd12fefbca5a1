"""Which records are read against which requirements."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators.scan import running_before, salted_join, skew_join, spread

REC = ["task_id", "record_id"]
MAX_RECORDS_PER_TASK = 5000  # fixed value: the most records a task may hold; here the size of a piece that is ranked at once
LINK = [*REC, "predicate_id", "claim", "joint", "text", "authority", "valid_from", "payload_key", "revision"]


def claims_by_task(predicates: DataFrame) -> DataFrame:
    """One row per task with its declared predicates, a bounded list: a task has at most 200."""
    return predicates.groupBy("task_id").agg(F.collect_list(
        F.struct("predicate_id", F.col("text").alias("claim"), F.col("join").alias("joint"))).alias("claims"))


def declared_links(events: DataFrame, block_rows: int = 65536) -> DataFrame:
    """The predicates a record's latest applied delivery named. (Derived from the log, so reopening a task
    keeps what was declared.) A delivery was applied exactly when it is the first of its revision and no
    higher revision came before it; revisions of applied deliveries only grow."""
    first = events.groupBy(*REC, "revision").agg(F.min("seq").alias("seq"), F.min_by("about", "seq").alias("about"))
    higher = running_before(first, REC, [(F.floor(F.col("revision") / F.lit(block_rows)), "desc")], [F.col("revision").desc()],
                            {"_earliest_higher": F.col("seq")}, fold=F.min)
    applied = F.col("_earliest_higher").isNull() | (F.col("seq") < F.col("_earliest_higher"))
    return (higher.filter(applied & F.col("about").isNotNull())
            .groupBy(*REC).agg(F.max_by("about", "revision").alias("about")))


def _spread(records: DataFrame, predicates: DataFrame, keep) -> DataFrame:
    """Records with their task's predicates: an equi-join on the task, then one row per kept predicate."""
    joined = skew_join(records, claims_by_task(predicates), ["task_id"])
    claims = F.col("claims") if keep is None else F.filter("claims", keep)
    return (joined.withColumn("claim_row", F.explode(claims))
            .select(*REC, "claim_row.predicate_id", "claim_row.claim", "claim_row.joint", "text", "authority", "valid_from",
                    "payload_key", "revision"))


def link_all(records: DataFrame, predicates: DataFrame) -> DataFrame:
    return _spread(records, predicates, None)


def link_declared(records: DataFrame, declared: DataFrame, predicates: DataFrame) -> DataFrame:
    """Declared predicates where a record named any (unknown names dropped), all of its task's otherwise."""
    named = records.join(declared, REC, "left")
    return _spread(named, predicates,
                   lambda c: F.col("about").isNull() | F.array_contains("about", c["predicate_id"]))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of a column, one a row; NaN where there is none."""
    lists = column.combine_chunks()
    width = int(pc.max(pc.list_value_length(lists)).as_py() or 1)
    if not lists.null_count and not lists.flatten().null_count and len(lists.flatten()) == width * len(lists):
        return lists.flatten().to_numpy().astype(float).reshape(-1, width)
    return np.array([np.full(width, np.nan) if v is None or len(v) != width else v for v in lists.to_pylist()], float)


def _compared(records: DataFrame, predicates: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, record_block: int,
              predicate_block: int) -> DataFrame:
    """``fn`` over every block of a task's records with every block of its predicates; both are cut by hash."""
    def cut(df, key, size):
        sizes = df.filter("task_id is not null").groupBy("task_id").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("n"))
        return df.select("task_id", key, "vec"), sizes, F.pmod(F.xxhash64(key), F.col("n")).cast("int")

    a, na, at = cut(records, "record_id", record_block)
    b, nb, bt = cut(predicates, "predicate_id", predicate_block)
    both = na.select("task_id", F.col("n").alias("nr")).join(nb.select("task_id", F.col("n").alias("np")), "task_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["task_id", "rb", "pb"]
    left = skew_join(a, both.withColumnRenamed("nr", "n"), ["task_id"]).withColumn("rb", at).withColumn("pb", each("np")).select(*keys, "record_id", "vec")
    right = skew_join(b, both.withColumnRenamed("np", "n"), ["task_id"]).withColumn("pb", bt).withColumn("rb", each("nr")).select(
        *[F.col(c).alias(f"_{c}") for c in keys], "predicate_id", F.col("vec").alias("claim_vec"))  # both may be of one table
    # few large groups of much work: dealt over all partitions
    return spread(left, *keys).groupBy(*keys).cogroup(spread(right, *[f"_{c}" for c in keys]).groupBy(*[f"_{c}" for c in keys])).applyInArrow(fn, schema)


def propose_links(records: DataFrame, predicates: DataFrame, threshold: float, min_links: int = 1, record_block: int = 8192,
                  predicate_block: int = 8192) -> DataFrame:
    """Links by similarity of ``vec`` columns of unit length: every predicate at or above the threshold, or the
    ``min_links`` closest when fewer reach it. Both inputs carry task_id. Blocks of records meet blocks of predicates, and only links,
    and the closest of a record in a block where fewer reach the threshold, leave a block."""
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b, sort_keys=[("predicate_id", "ascending")], null_placement="at_start"))
        mat, names, vec = _vectors(b["claim_vec"]), b["predicate_id"].combine_chunks(), _vectors(a["vec"])
        out = []
        for i in range(0, len(a), 256):
            sims = _products(vec[i:i + 256], mat)
            hit = sims >= threshold
            reached = hit.sum(axis=1)
            short = np.nonzero(reached < min_links)[0]
            if len(short):  # the closest below the threshold, those without a similarity last
                rest = np.where(hit[short], np.inf, -np.nan_to_num(sims[short], nan=-1e300))
                best = np.argsort(rest, axis=1, kind="stable")[:, :min_links]
                room = np.arange(best.shape[1])[None, :] < (sims.shape[1] - reached[short])[:, None]
                hit[np.repeat(short, best.shape[1])[room.ravel()], best.ravel()[room.ravel()]] = True
            row, col = np.nonzero(hit)
            ends = np.searchsorted(row, np.arange(len(sims) + 1))
            sim = pa.array(sims[row, col], from_pandas=True)
            links = pa.StructArray.from_arrays([names.take(pa.array(col, pa.int64())), sim], names=["predicate_id", "sim"])
            part = a.slice(i, 256)
            out.append(pa.table([part["task_id"], part["record_id"], pa.array(reached.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links)],
                                names=["task_id", "record_id", "reached", "links"]))
        return pa.concat_tables(out)

    types = dict(records.dtypes) | {"predicate_id": dict(predicates.dtypes)["predicate_id"]}
    found = _compared(records, predicates, run, f"task_id {types['task_id']}, record_id {types['record_id']}, reached long, "
                      f"links array<struct<predicate_id: {types['predicate_id']}, sim: double>>", record_block, predicate_block)
    per = found.groupBy(*REC).agg(F.sum("reached").alias("reached"), F.flatten(F.collect_list("links")).alias("links"))
    ranked = F.transform(F.array_sort(F.transform("links", lambda x: F.struct(
        F.coalesce(-x["sim"], F.lit(float("inf"))).alias("o"), x["predicate_id"].alias("predicate_id"), x["sim"].alias("sim")))),
        lambda x: F.struct(x["predicate_id"].alias("predicate_id"), x["sim"].alias("sim")))
    kept = F.when(F.col("reached") >= min_links, F.filter("links", lambda x: x["sim"] >= threshold)).otherwise(F.slice(ranked, 1, min_links))
    return per.select(*REC, F.explode(kept).alias("l")).select(*REC, "l.predicate_id", "l.sim")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T if a.shape[1] == b.shape[1] else np.full((len(a), len(b)), np.nan)


def count_links(records: DataFrame, predicates: DataFrame, thresholds: list[float], linked: Callable[[np.ndarray, np.ndarray], np.ndarray],
                keys: tuple = ("task_id",), record_block: int = 8192, predicate_block: int = 8192) -> DataFrame:
    """All links of ``propose_links(records, predicates, -2.0)``, counted where they are compared: per ``keys`` and threshold the pairs
    and the true links (``linked``: record ids and predicate ids to a matrix), how many pairs are at or above the threshold (``above``) and
    how many true links below it (``missed``)."""
    ts = np.array(sorted(set(map(float, thresholds))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        mat, names, vec, ids = _vectors(b["claim_vec"]), b["predicate_id"].to_numpy(), _vectors(a["vec"]), a["record_id"].to_numpy()
        t, out = len(ts), []
        for i in range(0, len(a), 256):
            sims = _products(vec[i:i + 256], mat)
            n, ok = len(sims), ~np.isnan(sims)
            place = np.arange(n)[:, None] * (t + 1) + np.searchsorted(ts, sims, side="right")
            true = ok & linked(ids[i:i + 256], names)
            count = lambda m: np.bincount(place[m], minlength=n * (t + 1)).reshape(n, t + 1)
            everything, yes = count(ok), count(true)
            above = everything.sum(axis=1, keepdims=True) - np.cumsum(everything, axis=1)[:, :t]
            missed = np.cumsum(yes, axis=1)[:, :t]
            whole = lambda m: np.repeat(m.sum(axis=1), t)
            part = a.slice(i, 256).take(pa.array(np.repeat(np.arange(n), t)))
            out.append(pa.table([part["task_id"], part["record_id"], pa.array(np.tile(ts, n)), pa.array(whole(everything)), pa.array(whole(yes)),
                                 pa.array(above.ravel()), pa.array(missed.ravel())], names=["task_id", "record_id", "threshold", "pairs", "true", "above", "missed"]))
        return pa.concat_tables(out)

    types = dict(records.dtypes)
    counts = ["pairs", "true", "above", "missed"]
    found = _compared(records, predicates, run, f"task_id {types['task_id']}, record_id {types['record_id']}, threshold double, " + ", ".join(f"`{c}` long" for c in counts),
                      record_block, predicate_block)
    return found.groupBy(*keys, "threshold").agg(*[F.sum(c).alias(c) for c in counts])


def link_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = [*REC, "predicate_id"]
    a = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    return (a.join(b, keys, "full_outer").filter(F.col("_old").isNull() | F.col("_new").isNull())
            .select(*keys, F.when(F.col("_old").isNull(), F.lit("added")).otherwise(F.lit("removed")).alias("change")))


def _rank_text() -> Column:
    before_all = F.lit(float("-inf"))
    return F.array_sort(F.collect_list(F.struct(
        (-F.col("authority")).alias("a"), (-F.coalesce("valid_from", before_all)).alias("v"), F.col("record_id").alias("r"),
        F.col("text").alias("t"), F.col("payload_key").alias("k"))))


def joint_pairs(links: DataFrame, max_members: int = MAX_RECORDS_PER_TASK) -> DataFrame:
    """Predicates that weigh all their texts together: the linked texts joined highest rank first, as one pair whatever their
    number. Pieces of at most about ``max_members`` are ranked apart, by record hash, and then merged by rank."""
    group = ["task_id", "predicate_id"]
    rows = links.filter("joint")
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(max_members)).cast("int").alias("parts"))
    rows = (salted_join(rows, sizes, group, ["record_id"])
            .withColumn("part", F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int")))
    pieces = rows.groupBy(*group, "claim", "part").agg(_rank_text().alias("m"), F.max("authority").alias("authority"), F.max("valid_from").alias("valid_from"))
    return (pieces.groupBy(*group, "claim")
            .agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"), F.max("authority").alias("authority"), F.max("valid_from").alias("valid_from"))
            .select(*group, "claim", F.concat(F.lit("joint:"), "predicate_id").alias("record_id"),
                    F.array_join(F.transform("m", lambda x: x["t"]), " ").alias("text"), "authority", "valid_from",
                    F.transform("m", lambda x: x["r"]).alias("members"),
                    F.array_join(F.transform("m", lambda x: x["k"]), "|").alias("member_keys")))


def reading_pairs(links: DataFrame) -> DataFrame:
    """All (claim, text) pairs to read: one per link, and one per predicate read jointly."""
    single = links.filter(~F.col("joint")).select("task_id", "record_id", "predicate_id", "claim", "text", "authority",
                                                  "valid_from", F.array("record_id").alias("members"))
    joint = joint_pairs(links).select("task_id", "record_id", "predicate_id", "claim", "text", "authority", "valid_from",
                                      "members")
    return single.unionByName(joint).withColumn("pair", S.pair_key("claim", "text"))


def affected(changed: DataFrame, links: DataFrame, action_leaves: DataFrame) -> DataFrame:
    """Actions that can be reached from changed records (task_id, record_id): two semi-joins, since a change
    travels record -> predicate -> action only."""
    touched = links.join(changed.select(*REC).distinct(), REC, "left_semi").select("task_id", "predicate_id").distinct()
    return (action_leaves.join(touched, ["task_id", "predicate_id"], "left_semi")
            .select("task_id", "action_id").distinct())


def link_quality(sims: DataFrame, threshold: float, keys: tuple = ("task_id",)) -> DataFrame:
    """Rows (task_id, sim, linked), or the counts of ``count_links``: missed-link rate over tasks with true links, share with any miss, share of
    pairs kept."""
    if "above" in sims.columns:  # counted by count_links
        per = sims.filter(F.col("threshold") == threshold).select(*keys, F.try_divide("missed", "true").alias("miss"), F.try_divide("above", "pairs").alias("kept"))
    else:
        per = sims.groupBy(*keys).agg(
            F.avg(F.when(F.col("linked"), (F.col("sim") < threshold).cast("double"))).alias("miss"),
            F.avg((F.col("sim") >= threshold).cast("double")).alias("kept"))
    return per.agg(F.avg("miss").alias("missed_link_rate"),
                   F.avg((F.col("miss") > 0).cast("double")).alias("tasks_with_any_miss"),
                   F.avg("kept").alias("share_of_pairs_compared"), F.count("miss").alias("tasks"))


def ranked_item() -> Column:
    """What a context needs of a record, ordered highest rank first."""
    return F.struct((-F.col("authority")).alias("a"), (-F.coalesce("valid_from", F.lit(float("-inf")))).alias("v"),
                    F.col("record_id").alias("r"), F.col("authority").alias("au"),
                    S.short_number("valid_from").alias("t"), F.col("text").alias("x"))


def rendered(items: Column) -> Column:
    """Ranked items as one text."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(
        F.lit("[record "), (i + 1).cast("string"), F.lit(" | authority "), x["au"].cast("string"), F.lit(" | time "), x["t"],
        F.lit("] "), x["x"])), " ")


def render_context(records: DataFrame, max_records: int = MAX_RECORDS_PER_TASK) -> DataFrame:
    """All usable records of a task as one text, highest rank first, whatever their number. Pieces of at most about
    ``max_records`` are ranked apart, by record hash, and then merged by rank."""
    sizes = records.groupBy("task_id").agg(F.ceil(F.count("*") / F.lit(max_records)).cast("int").alias("parts"))
    rows = (salted_join(records, sizes, ["task_id"], ["record_id"])
            .withColumn("part", F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int")))
    pieces = rows.groupBy("task_id", "part").agg(F.array_sort(F.collect_list(ranked_item())).alias("m"))
    out = pieces.groupBy("task_id").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    return out.select("task_id", rendered(F.col("m")).alias("context"))
