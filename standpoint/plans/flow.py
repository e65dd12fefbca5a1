"""The decision flow: events -> ledger -> links -> readings -> beliefs -> assessments.

Every stage is a lazy DataFrame over all tasks at once; ``Flow`` only names them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.operators import beliefs as B
from standpoint.operators import ledger as L
from standpoint.operators import links as K
from standpoint.operators import logic as G
from standpoint.operators import readings as R
from standpoint.session import cut_lineage
from standpoint.sources import derive as D


@dataclass
class Flow:
    events: DataFrame
    predicates: DataFrame
    gates: DataFrame
    actions: DataFrame
    scorer: Callable[[DataFrame], DataFrame]
    now: float | None = None
    temperature: float = 1.0
    bias: tuple = (0.0, 0.0, 0.0)
    ready: float = 0.5
    block: float = 0.5
    honour_declared: bool = True
    linker: Callable[[DataFrame, DataFrame], DataFrame] | None = None  # (records, predicates) -> links, for undeclared records

    @cached_property
    def outcomes(self) -> DataFrame:
        return L.delivery_outcomes(self.events)

    @cached_property
    def state(self) -> DataFrame:
        return L.ledger_state(self.events)

    @cached_property
    def records(self) -> DataFrame:
        return L.active_records(L.record_heads(self.events), self.now)

    @cached_property
    def declared(self) -> DataFrame:
        """A table of its own, since links and stored tables take it from here."""
        return cut_lineage(K.declared_links(self.events))

    def link(self, records: DataFrame, declared: DataFrame) -> DataFrame:
        """Which record is read against which predicate. A full run and a refresh both ask here."""
        if not self.honour_declared:
            return K.link_all(records, self.predicates)
        if self.linker is None:
            return K.link_declared(records, declared, self.predicates)
        named = records.join(declared.select(*K.REC), K.REC, "left_semi")
        rest = records.join(declared.select(*K.REC), K.REC, "left_anti")
        return K.link_declared(named, declared, self.predicates).unionByName(self.linker(rest, self.predicates).select(*K.LINK))

    @cached_property
    def links(self) -> DataFrame:
        """A table of its own, since pairs, readings and beliefs all start from it."""
        return cut_lineage(self.link(self.records, self.declared))

    @cached_property
    def pairs(self) -> DataFrame:
        return K.reading_pairs(self.links)

    @cached_property
    def readings(self) -> DataFrame:
        """A table of its own: a pair is read once, however many steps ask for its reading."""
        return cut_lineage(self.scorer(R.distinct_pairs(self.pairs)))

    @cached_property
    def edges(self) -> DataFrame:
        return R.attach(self.pairs, self.readings, self.temperature, self.bias)

    @cached_property
    def beliefs(self) -> DataFrame:
        return B.beliefs(self.edges, self.predicates)

    @cached_property
    def compiled(self) -> DataFrame:
        return G.compile_actions(self.predicates, self.gates, self.actions)

    @cached_property
    def assessments(self) -> DataFrame:
        return G.assess(self.compiled, self.beliefs, self.ready, self.block)


def gold_scorer(pairs: DataFrame) -> DataFrame:
    """Stand-in reading model: the hash label of each pair as logits."""
    return pairs.withColumn("logits", S.label_logits(D.gold_label("text", "predicate_id"),
                                                     D.gold_margin("text", "predicate_id")))


def derived_flow(spark: SparkSession, sf_dir: str, **changes) -> Flow:
    t, bias = D.CALIBRATION
    args = dict(events=D.event_log(spark, sf_dir), predicates=D.predicates(spark, sf_dir), gates=D.gates(spark, sf_dir),
                actions=D.actions(spark, sf_dir), scorer=gold_scorer, now=D.NOW, temperature=t, bias=bias)
    args.update(changes)
    return Flow(**args)


def disposition_counts(flow: Flow) -> DataFrame:
    return flow.assessments.groupBy("action_id", "disposition").agg(
        F.count("*").alias("n"), F.avg("belief").alias("mean_belief"))
