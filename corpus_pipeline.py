"""A training-data pipeline in five stages. Each is ``(spark, docs, sf_dir) -> DataFrame``; what one returns is written as
Parquet and read again as the next one's documents.

1. quality: documents that policy ``web-2`` of the rule ledger rejects go;
2. near_duplicates: of each SimHash component the document with the smallest id stays;
3. decontamination: documents that hold a benchmark item, verbatim or with other numbers and names, go;
4. secrets: spans are replaced in the text, every document stays;
5. mixing: every document gets its place in the mixture (block, slot and row), all columns stay.

Rows of equal content are judged alike; empty tables pass through; the first four stages return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from standpoint.llm import pfair_mixing, quality_rules, secret_scan, simhash_anchors, template_decontamination
from standpoint.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_anchors.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair_mixing.mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]
#: The second stage hashes with XXH64, which the other engine does not have; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
