"""Decision-tracking inputs derived from the driver's tables.

Every user of ``events`` is one task, so tasks grow with the data. Times are seconds since the start
of 2024. A hash stands in for a reading model: it gives every (claim, text) pair a fixed label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standpoint.functions import scalars as S

NOW = 15 * 86400.0
REDELIVERED, LATE_COPY = 10**15, 2 * 10**15

# Fixed values of the derived task: (id, claim, prior, cost of asking, texts read together)
PREDICATES = [
    ("p0", "view happened", 0.2, 0.5, False),
    ("p1", "signup happened", 0.5, 1.0, False),
    ("p2", "click happened", 0.5, 2.0, False),
    ("p3", "purchase happened", 0.8, 1.0, False),
    ("p4", "no error open", 0.5, 0.5, True),
]
GATES = [
    ("g0", "AND", ["p0", "p1"], 0),
    ("g1", "OR", ["p2", "p3"], 0),
    ("g2", "NOT", ["p4"], 0),
    ("g3", "ATLEAST", ["g0", "g1", "g2"], 2),
    ("g4", "AND", ["g0", "p0"], 0),
    ("g5", "OR", ["g1", "p3"], 0),
]
ACTIONS = [
    ("a0", "send the offer", "g3", 10.0, 25.0, 1.0, 0.0, False),
    ("a1", "open the account", "g4", 2.0, 5.0, 0.95, 0.05, False),
    ("a2", "ship the order", "g5", 5.0, 10.0, 0.9, 0.0, True),
]
CALIBRATION = (1.2, (0.1, 0.0, -0.1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("double") * 86400.0
    revision = F.pmod(k, F.lit(4)).cast("int")
    copies = F.array(
        F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(0).alias("back")),
        F.when(F.col("event_id") % 10 == 0, F.struct(F.lit(REDELIVERED).alias("shift"), F.lit(0).alias("back"))),
        F.when((F.col("event_id") % 10 == 5) & (revision > 0),
               F.struct(F.lit(LATE_COPY).alias("shift"), F.lit(1).alias("back"))))
    return (table(spark, sf_dir, "events")
            .select("event_id", "user_id", "event_type", k.alias("k"), day.alias("day"), revision.alias("rev"),
                    F.explode(F.array_compact(copies)).alias("copy"))
            .select(F.concat(F.lit("t"), F.col("user_id")).alias("task_id"),
                    (F.col("event_id") + F.col("copy.shift")).alias("seq"),
                    F.concat(F.lit("r"), F.col("user_id"), F.lit("-"), F.col("event_id") % 20).alias("record_id"),
                    (F.col("rev") - F.col("copy.back")).alias("revision"),
                    F.when(F.col("event_type") != "error",
                           F.concat("event_type", F.lit(" #"), F.col("k").cast("string"))).alias("text"),
                    F.concat(F.lit("s"), F.col("event_id") % 3).alias("source_id"),
                    (F.col("event_id") % 3).cast("int").alias("authority"),
                    F.col("day").alias("valid_from"),
                    F.when(F.col("k") % 5 == 0, F.col("day") + 7 * 86400.0).alias("valid_until"),
                    F.lit(None).cast("string").alias("span"),
                    F.when(F.col("k") % 7 == 0,
                           F.array(F.concat(F.lit("p"), F.col("k") % 5))).alias("about")))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("t"), F.col("user_id")).alias("task_id")).distinct()


def _rows(spark, names: list[str], types: list[str], rows: list[tuple]):
    return F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) if not isinstance(v, list)
                                else F.array(*[F.lit(x) for x in v]).alias(n)
                                for n, t, v in zip(names, types, row)]) for row in rows])


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, ["predicate_id", "text", "prior", "ask_cost", "join"],
                 ["string", "string", "double", "double", "boolean"], PREDICATES)
    return tasks(spark, sf_dir).select("task_id", F.explode(rows).alias("r")).select("task_id", "r.*")


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, ["gate_id", "op", "children", "k"], ["string", "string", "", "int"], GATES)
    return tasks(spark, sf_dir).select("task_id", F.explode(rows).alias("r")).select("task_id", "r.*")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, ["action_id", "description", "requires", "value_success", "cost_failure", "reliability", "leak",
                         "needs_approval"],
                 ["string", "string", "string", "double", "double", "double", "double", "boolean"], ACTIONS)
    return tasks(spark, sf_dir).select("task_id", F.explode(rows).alias("r")).select("task_id", "r.*")


def gold_label(text, claim_id):
    h = F.conv(F.substring(F.sha2(F.concat(S.col(text), F.lit("|"), S.col(claim_id)), 256), 1, 8), 16, 10).cast("bigint")
    return F.when(h % 10 < 3, 0).when(h % 10 < 5, 1).otherwise(2)


def gold_margin(text, claim_id):
    h = F.conv(F.substring(F.sha2(F.concat(S.col(text), F.lit("|"), S.col(claim_id)), 256), 1, 8), 16, 10).cast("bigint")
    return (2 + F.floor(h / 16) % 5).cast("double")
