"""From readings to beliefs: the exact precedence policy over rank groups.

Higher authority first, then later validity; the first rank group that is not silent decides. Readings
of one rank group combine by products of probabilities, so a predicate is reduced to its rank groups by
map-side combined sums of logarithms before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from standpoint.functions import scalars as S
from standpoint.operators.scan import running_before, salted_join, skew_join, spread

PRED = ["task_id", "predicate_id"]
EPS = 1e-12
NEVER = float("-inf")
RANK_BLOCK_SECONDS = 3600.0


def _hour() -> Column:
    """Blocks of validity time; a block of one authority and hour holds few distinct times."""
    return F.when(F.col("vf") == NEVER, F.lit(NEVER)).otherwise(F.floor(F.col("vf") / RANK_BLOCK_SECONDS).cast("double"))


def dense_rank_edges(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges with ``rank``, 0 for the highest (authority, valid_from); a missing time ranks before all."""
    keys = keys or PRED
    e = edges.withColumn("vf", F.coalesce(F.col("valid_from"), F.lit(NEVER)))
    groups = e.select(*keys, "authority", "vf").distinct()
    ranked = running_before(groups, keys, [(F.col("authority"), "desc"), (_hour(), "desc")], [F.col("vf").desc()],
                            {"rank": F.lit(1)}).withColumn("rank", F.coalesce("rank", F.lit(0)).cast("int"))
    return skew_join(e, ranked, [*keys, "authority", "vf"]).drop("vf")


def precedence(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outcome distribution (s, v, u, c) and number of decisive readings per predicate that has a reading
    (p_s, p_r, p_n).

    Ordered pieces of a rank list combine like one rank group: (silent, supports, refutes, clashes), the later
    piece weighing as much as the earlier is silent. So a predicate is reduced in three steps, each with
    partial results: rank groups, blocks of rank groups, whole. Nothing is joined back and no task orders
    more than a block's groups or a predicate's blocks."""
    keys = keys or PRED

    def log_of(x):
        return S.exact_sum(F.log(F.greatest(x, F.lit(EPS))))

    groups = (edges.withColumn("vf", F.coalesce(F.col("valid_from"), F.lit(NEVER)))
              .groupBy(*keys, "authority", "vf")
              .agg(log_of(F.col("p_n")).alias("ln_n"), log_of(F.col("p_s") + F.col("p_n")).alias("ln_sn"),
                   log_of(F.col("p_r") + F.col("p_n")).alias("ln_rn"),
                   F.sum((1.0 - F.col("p_n") >= 0.5).cast("long")).alias("n_decisive"))
              .withColumn("none", F.exp("ln_n"))
              .withColumn("s", F.greatest(F.exp("ln_sn") - F.col("none"), F.lit(0.0)))
              .withColumn("v", F.greatest(F.exp("ln_rn") - F.col("none"), F.lit(0.0)))
              .withColumn("c", F.greatest(1.0 - F.col("none") - F.col("s") - F.col("v"), F.lit(0.0)))
              .withColumn("ln_none", F.log(F.greatest(F.col("none"), F.lit(EPS))).cast("decimal(28,18)"))
              .withColumn("hour", _hour()))

    def combine(df, by, order):
        before = F.sum("ln_none").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
        weighed = df.withColumn("_w", F.exp(F.coalesce(before.cast("double"), F.lit(0.0))))
        return weighed.groupBy(*by).agg(*[S.exact_sum(F.col("_w") * F.col(x)).alias(x) for x in "svc"],
                                        F.sum("ln_none").cast("decimal(38,18)").alias("ln_none"),
                                        F.sum("n_decisive").alias("n_decisive"))

    blocks = combine(groups, [*keys, "authority", "hour"], [F.col("vf").desc()])
    whole = combine(blocks, keys, [F.col("authority").desc(), F.col("hour").desc()])
    whole = whole.withColumn("u", F.exp(F.col("ln_none").cast("double")))
    total = F.greatest(F.col("s") + F.col("v") + F.col("u") + F.col("c"), F.lit(EPS))
    return whole.select(*keys, *[(F.col(x) / total).alias(x) for x in "svuc"], "n_decisive")


def harden(edges: DataFrame) -> DataFrame:
    """Replace each reading by its top label alone."""
    top = S.top_label()
    return edges.withColumn("_t", top).withColumns({
        n: (F.col("_t") == i).cast("double") for i, n in enumerate(("p_s", "p_r", "p_n"))}).drop("_t")


def precedence_hard(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return precedence(harden(edges), keys)


def beliefs(edges: DataFrame, predicates: DataFrame, hard: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Every declared predicate with its status distribution, most likely status, belief and the number of
    decisive records. A predicate nothing was read about is unresolved."""
    keys = keys or PRED
    dist = precedence_hard(edges, keys) if hard else precedence(edges, keys)
    zero = F.lit(0.0)
    return (predicates.select(*keys, "prior").join(dist, keys, "left")
            .withColumns({"s": F.coalesce("s", zero), "v": F.coalesce("v", zero), "u": F.coalesce("u", F.lit(1.0)),
                          "c": F.coalesce("c", zero), "n_decisive": F.coalesce("n_decisive", F.lit(0).cast("long"))})
            .withColumn("status", S.status_name()).withColumn("belief", S.belief_from_status("prior")))


def decisive_records(edges: DataFrame) -> DataFrame:
    """The records a belief rests on, one row each with its rank: at least even odds of settling something.
    The best come first when ordered by (rank, record_id)."""
    return dense_rank_edges(edges).filter(1.0 - F.col("p_n") >= 0.5)


def gold_status(edges: DataFrame, predicates: DataFrame) -> DataFrame:
    """The policy applied to known labels: decisive ones at the top rank; disagreement there is a conflict."""
    top = (edges.filter(F.col("label").isin(0, 1))
           .withColumn("vf", F.coalesce(F.col("valid_from"), F.lit(NEVER)))
           .groupBy(*PRED, "authority", "vf").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
           .groupBy(*PRED).agg(F.max(F.struct("authority", "vf", "lo", "hi")).alias("t")))
    status = (F.when(F.col("t").isNull(), F.lit("UNRESOLVED")).when(F.col("t.lo") != F.col("t.hi"), F.lit("CONFLICT"))
              .when(F.col("t.lo") == 0, F.lit("SATISFIED")).otherwise(F.lit("VIOLATED")))
    return predicates.select("task_id", "predicate_id").join(top, PRED, "left").select(*PRED, status.alias("status"))


def describe(outcomes: DataFrame, beliefs_df: DataFrame, assessments: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of event kinds, delivery outcomes, statuses and dispositions, with their share."""
    kind = F.when(F.col("text").isNull(), F.lit("withdrawal")).when(F.col("revision") > 0, F.lit("revision")).otherwise(F.lit("first"))
    parts = [events.groupBy(kind.alias("value")).count().withColumn("what", F.lit("event")),
             outcomes.groupBy(F.col("outcome").alias("value")).count().withColumn("what", F.lit("outcome")),
             beliefs_df.groupBy(F.col("status").alias("value")).count().withColumn("what", F.lit("status")),
             assessments.groupBy(F.col("disposition").alias("value")).count().withColumn("what", F.lit("disposition"))]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    totals = allp.groupBy("what").agg(F.sum("count").alias("total"))
    return allp.join(totals, "what").select("what", "value", F.col("count").alias("n"),
                                            (F.col("count") / F.col("total")).alias("share"))


def custom_status(edges: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Hook for a user's own combination rule over the readings of one predicate. Groups are limited to
    what a task may hold (5,000 records); larger ones must use ``precedence``."""
    from standpoint.operators.links import MAX_RECORDS_PER_TASK

    sizes = edges.groupBy(*PRED).agg((F.count("*") <= MAX_RECORDS_PER_TASK).alias("_fits"))
    checked = salted_join(edges, sizes, PRED, ["record_id"])
    bounded = checked.filter(F.when(F.col("_fits"), F.lit(True)).otherwise(
        F.raise_error(F.lit("more readings for one predicate than a task may hold")).cast("boolean"))).drop("_fits")

    def rule(frame: pd.DataFrame) -> pd.DataFrame:
        del frame["_deal"]
        return fn(frame)

    # few bytes, much work: dealt over all partitions, by a key of its own, since a repartition by keys the rows lie by already is left out
    return spread(bounded.withColumn("_deal", F.xxhash64(*PRED)), "_deal").groupBy("_deal", *PRED).applyInPandas(rule, schema)
