"""Readings: what a text establishes about a claim, as three logits, looked up or scored once per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators.scan import running_before, skew_join
from standpoint.schemas import NEI
from standpoint.session import cut_lineage


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once, whatever the number of copies: partial aggregation removes them before the shuffle."""
    extra = [c for c in ("predicate_id",) if c in pairs.columns]
    return pairs.groupBy("pair").agg(*[F.min(c).alias(c) for c in ("claim", "text", *extra)])


def oracle_readings(pairs: DataFrame, gold: DataFrame, margin: float = 8.0) -> DataFrame:
    """Readings from known labels (claim, text, label); a pair without one settles nothing."""
    known = gold.select(S.pair_key("claim", "text").alias("pair"), "label").dropDuplicates(["pair"])
    return (skew_join(pairs, known, ["pair"], how="left")
            .withColumn("logits", S.label_logits(F.coalesce(F.col("label"), F.lit(NEI)), F.lit(margin))).drop("label"))


def table_readings(pairs: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs found in a table of readings, pairs missing from it)."""
    found = skew_join(pairs, readings, ["pair"])
    missing = distinct_pairs(pairs).join(readings, "pair", "left_anti")
    return found, missing


def token_count(claim="claim", text="text"):
    """Length of a pair in white-space tokens, the unit of reading cost."""
    return (F.size(F.split(F.trim(F.col(claim)), r"\s+")) + F.size(F.split(F.trim(F.col(text)), r"\s+"))).cast("long")


def cached_readings(pairs: DataFrame, cache: DataFrame, scorer: Callable[[DataFrame], DataFrame],
                    version: str) -> tuple[DataFrame, DataFrame]:
    """(readings of all distinct pairs, the newly computed ones to append). Only pairs this weights version has not
    read are scored, and each only once: the new ones are a written table, from which both results read."""
    wanted = distinct_pairs(pairs)
    old = cache.filter(F.col("version") == version).select("pair", "logits", "version", "tokens")
    new = cut_lineage(scorer(wanted.join(old, "pair", "left_anti"))
                      .select("pair", "logits", F.lit(version).alias("version"), token_count().alias("tokens")))
    return old.join(wanted, "pair", "left_semi").unionByName(new), new


def reading_stats(pairs: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Pairs requested, computed and found, and tokens read, of one call."""
    wanted = pairs.groupBy("pair").agg(F.count("*").alias("n"), F.min("claim").alias("claim"), F.min("text").alias("text"))
    held = cache.filter(F.col("version") == version).select("pair", F.lit(1).alias("_hit"))
    j = wanted.join(held, "pair", "left")
    new = F.col("_hit").isNull()
    return j.agg(F.sum("n").alias("pairs_requested"), F.sum(new.cast("long")).alias("pairs_computed"),
                 (F.sum("n") - F.sum(new.cast("long"))).alias("cache_hits"),
                 F.sum(F.when(new, token_count()).otherwise(F.lit(0))).alias("tokens"))


def score_pairs(pairs: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], version: str,
                batch_sort: bool = True) -> DataFrame:
    """Hook for a reading model. ``fn`` maps a frame (pair, claim, text) to one with a ``logits`` list per row; it is
    called per Arrow batch, so it can load a model once per worker. Pairs are spread by their own hash,
    never by task, and sorted by length inside a partition so that batches are even."""
    todo = distinct_pairs(pairs).select("pair", "claim", "text")
    if batch_sort:
        todo = todo.sortWithinPartitions(F.length("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = fn(b)
            yield pd.DataFrame({"pair": b["pair"], "claim": b["claim"], "text": b["text"],
                                "logits": [list(map(float, x)) for x in out["logits"]]})

    scored = todo.mapInPandas(run, "pair string, claim string, text string, logits array<double>")
    return scored.withColumn("version", F.lit(version))


def attach(pairs: DataFrame, readings: DataFrame, temperature: float = 1.0, bias=(0.0, 0.0, 0.0)) -> DataFrame:
    """Edges: every pair with its calibrated reading. A pair may be shared by very many records."""
    return (skew_join(pairs, readings.select("pair", "logits"), ["pair"])
            .withColumn("_p", S.calibrate_probs("logits", temperature, bias)).select("*", "_p.*").drop("_p"))


def cost_per_event(spans: DataFrame, predicates: DataFrame, block_rows: int = 65536) -> DataFrame:
    """Per delivery that changed the ledger: pairs and tokens an incremental update reads (the delivered record's
    own) against a full re-read of everything in force then. The full cost is a running sum of what each
    change adds and removes, so no record is visited once per step."""
    claim_tokens = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    per_task = predicates.groupBy("task_id").agg(F.count("*").alias("n_claims"), F.sum(claim_tokens).alias("claim_tokens"))
    words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    read = F.coalesce(F.col("text"), F.lit("")) != ""
    s = cut_lineage(skew_join(spans.select("task_id", "record_id", "seq_from", "seq_to", "text"), per_task, ["task_id"])
         .withColumn("pairs", F.when(read, F.col("n_claims")).otherwise(F.lit(0)))
         .withColumn("tokens", F.when(read, F.col("n_claims") * words + F.col("claim_tokens")).otherwise(F.lit(0))))
    moves = s.select("task_id", F.explode(F.array(
        F.struct(F.col("seq_from").alias("seq"), F.col("pairs").alias("p"), F.col("tokens").alias("t")),
        F.struct(F.col("seq_to").alias("seq"), (-F.col("pairs")).alias("p"), (-F.col("tokens")).alias("t")))).alias("m"))
    steps = (moves.select("task_id", "m.*").filter(F.col("seq").isNotNull())
             .groupBy("task_id", "seq").agg(F.sum("p").alias("p"), F.sum("t").alias("t")))
    run = running_before(steps, ["task_id"], [F.floor(F.col("seq") / F.lit(block_rows))], [F.col("seq")],
                         {"p0": F.col("p"), "t0": F.col("t")})
    full = run.select("task_id", "seq", (F.col("p") + F.coalesce("p0", F.lit(0))).alias("pairs_full"),
                      (F.col("t") + F.coalesce("t0", F.lit(0))).alias("tokens_full"))
    own = s.select("task_id", F.col("seq_from").alias("seq"), F.col("pairs").alias("pairs_update"),
                   F.col("tokens").alias("tokens_update"))
    return own.join(full, ["task_id", "seq"])
