"""Explicit schemas of every table the operators read. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("task_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("record_id", T.StringType()),
        T.StructField("revision", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("authority", T.IntegerType()),
        T.StructField("valid_from", T.DoubleType()),
        T.StructField("valid_until", T.DoubleType()),
        T.StructField("span", T.StringType()),
        T.StructField("about", T.ArrayType(T.StringType())),
    ]
)

_PREDICATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("prior", T.DoubleType()),
        T.StructField("ask_cost", T.DoubleType()),
        T.StructField("join", T.BooleanType()),
    ]
)
_GATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("children", T.ArrayType(T.StringType())),
        T.StructField("k", T.IntegerType()),
    ]
)
_ACTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("requires", T.StringType()),
        T.StructField("value_success", T.DoubleType()),
        T.StructField("cost_failure", T.DoubleType()),
        T.StructField("reliability", T.DoubleType()),
        T.StructField("leak", T.DoubleType()),
        T.StructField("needs_approval", T.BooleanType()),
    ]
)
TASK_DOCUMENT = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("predicates", T.ArrayType(_PREDICATE)),
        T.StructField("gates", T.ArrayType(_GATE)),
        T.StructField("actions", T.ArrayType(_ACTION)),
    ]
)

LABELLED_PAIR = T.StructType(
    [
        T.StructField("claim", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("page", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("attribution", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("valid_from", T.DoubleType()),
        T.StructField("subject", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

ISSUE = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("author", T.StructType([T.StructField("login", T.StringType())])),
        T.StructField("createdAt", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("body", T.StringType()),
    ]
)

# Relation of a piece of evidence to a claim. NOT_SUPPORTS occurs only as a supervision label.
SUPPORTS, REFUTES, NEI, NOT_SUPPORTS = 0, 1, 2, 3
STATUS4 = ("SATISFIED", "VIOLATED", "UNRESOLVED", "CONFLICT")
READY, BLOCKED, NEEDS_INFO = "READY", "BLOCKED", "NEEDS_INFO"
WITHDRAWN_KEY = "__withdrawn__"
