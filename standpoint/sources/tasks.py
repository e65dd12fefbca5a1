"""Task definitions as JSON documents, read into predicate, gate and action tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standpoint.schemas import TASK_DOCUMENT


def _default(c: str, value):
    return F.coalesce(F.col(c), F.lit(value)).alias(c.split(".")[-1])


def tables_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predicates, gates, actions) of parsed documents, with defaults for what a document leaves out."""
    p = docs.select("task_id", F.explode("predicates").alias("x")).select(
        "task_id", F.col("x.id").alias("predicate_id"), "x.text", _default("x.prior", 0.5), _default("x.ask_cost", 1.0),
        _default("x.join", False))
    g = docs.select("task_id", F.explode("gates").alias("x")).select(
        "task_id", F.col("x.id").alias("gate_id"), "x.op", "x.children", _default("x.k", 0))
    a = docs.select("task_id", F.explode("actions").alias("x")).select(
        "task_id", F.col("x.id").alias("action_id"), "x.description", "x.requires", _default("x.value_success", 1.0),
        _default("x.cost_failure", 1.0), _default("x.reliability", 1.0), _default("x.leak", 0.0),
        _default("x.needs_approval", False))
    return p, g, a


def parse_tasks(docs: DataFrame, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables_of(docs.select(F.from_json(column, TASK_DOCUMENT).alias("d")).select("d.*"))


def read_tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables_of(spark.read.schema(TASK_DOCUMENT).json(path, multiLine=True))


def document_json(predicates: DataFrame, gates: DataFrame, actions: DataFrame) -> DataFrame:
    """The tables as one JSON document per task again (a document is bounded: at most 200 predicates)."""
    p = predicates.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("predicate_id").alias("id"), "text", "prior", "ask_cost", "join"))).alias("predicates"))
    g = gates.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("gate_id").alias("id"), "op", "children", "k"))).alias("gates"))
    a = actions.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("action_id").alias("id"), "description", "requires", "value_success", "cost_failure", "reliability", "leak",
        "needs_approval"))).alias("actions"))
    j = p.join(g, "task_id", "left").join(a, "task_id", "left")
    return j.select("task_id", F.to_json(F.struct("task_id", "predicates", "gates", "actions")).alias("document"))
