"""Files in and out: event logs, mail and text files, labelled pairs, and the tables the operators write."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.schemas import EVENT, LABELLED_PAIR, MESSAGE


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(EVENT).format(fmt).load(path)


def stream_events(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


# ---------------------------------------------------------------- mail and text files

# What is read as text, and the words callers look for.
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".text", "")
UNSUPPORTED = "unsupported file type '%s': use .eml, .mbox, .txt or .md"
NO_SENDER = "unknown sender"

#: The line that begins a message of a mailbox, at its top or after an empty line.
MAILBOX_LINE = r"(?:\A|(?<=\n\n)|(?<=\n\r\n))From [^\n]*\n"
MIME = "name string, address string, subject string, sent string, ident string, body string"
SPACES = " \t\n\r\f\x0b"


def mime_fields(raw: bytes) -> tuple[str | None, ...]:
    """The fields of ``MIME``, decoded; null where a message lacks one or it cannot be decoded."""
    msg = email.message_from_bytes(raw, policy=email.policy.default)
    plain = msg.get_body(("plain",))
    try:
        body = None if plain is None else plain.get_content()
    except LookupError:  # an unknown character set
        body = None
    name, address = email.utils.parseaddr(msg.get("From", ""))
    sent = getattr(msg.get("Date"), "datetime", None)
    return name, address, msg.get("Subject"), sent and sent.isoformat(), msg.get("Message-ID"), body


def decode_mail(messages: DataFrame) -> DataFrame:
    """``messages`` (with binary ``raw``, null for what is no mail) with the fields of ``MIME`` instead of it."""
    fields = [f.split()[0] for f in MIME.split(", ")]
    others = [c for c in messages.columns if c != "raw"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(None,) * len(fields) if raw is None else tuple(v if v is None else str(v) for v in mime_fields(bytes(raw))) for raw in b["raw"]]
            yield pd.concat([b[others].reset_index(drop=True), pd.DataFrame(got, columns=fields, dtype=object)], axis=1)

    kept = ", ".join(f"`{n}` {t}" for n, t in messages.select(*others).dtypes)
    return messages.mapInPandas(run, f"{kept}, {MIME}")


def parse_files(files: DataFrame, root: str | None = None) -> DataFrame:
    """Files (path, content) to attributed messages; a file of another type gives a row with ``error``. A mailbox is cut into
    one row per message before any of them is decoded, and only decoding runs in Python. Ids are kept whole; a text file's is
    its path below ``root`` (not given: its name), so that files of one name in two folders stay two documents."""
    part = F.regexp_extract("path", r"[^/]*\z", 0)
    has_suffix = F.col("title").rlike(r"(?s)^.+\.[^.]*\z")
    f = (files.select(F.col("path").alias("file"), part.alias("title"), "content")
         .withColumn("suffix", F.when(has_suffix, F.lower(F.concat(F.lit("."), F.substring_index("title", ".", -1)))).otherwise(""))
         .withColumn("stem", F.when(has_suffix, F.regexp_replace("title", r"\.[^.]*\z", "")).otherwise(F.col("title"))))
    if root is not None:
        below = F.regexp_replace("file", r"^[a-z0-9]+:/+", "/")
        top = re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/") + "/"
        folder = F.when(below.startswith(top), F.substr(below, F.lit(len(top) + 1))).otherwise(below)
        f = f.withColumn("stem", F.concat(F.regexp_replace(folder, r"[^/]*\z", ""), "stem"))
    letters = F.decode("content", "ISO-8859-1")  # one letter per byte, so that bytes can be cut by pattern
    box = F.transform(F.filter(F.split(letters, MAILBOX_LINE, -1), lambda _, i: i > 0),
                      lambda m: F.encode(F.concat(F.rtrim(m, F.lit("\r\n")), F.lit("\n")), "ISO-8859-1"))
    none = F.array(F.lit(None).cast("binary"))
    mail = F.when(F.col("suffix") == ".eml", F.array("content")).when(F.col("suffix") == ".mbox", box).otherwise(none)
    is_text = F.col("suffix").isin(*TEXT_SUFFIXES)
    words = F.when(is_text, F.btrim(F.make_valid_utf8(F.col("content").cast("string")), F.lit(SPACES)))
    m = decode_mail(f.select("file", "title", "suffix", "stem", words.alias("words"), F.explode(mail).alias("raw")).withColumn("hash", F.sha2("raw", 256)))

    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    sender = F.coalesce(filled(F.col("name")), filled(F.col("address")), F.lit(NO_SENDER))
    subject = F.coalesce(S.clean_text("subject"), F.lit(""))
    by_mail = F.concat(F.lit("Email from "), sender, F.coalesce(F.concat(F.lit(" on "), F.substring("sent", 1, 10)), F.lit("")),
                       F.coalesce(F.concat(F.lit(", subject: "), filled(subject)), F.lit("")))
    ident = F.coalesce(filled(F.regexp_replace("ident", "[^A-Za-z0-9._@-]", "")), F.concat(F.lit("msg-"), F.substring("hash", 1, 16)))
    is_mail = F.col("suffix").isin(".eml", ".mbox")
    columns = {
        "file": F.col("file"),
        "doc_id": F.when(is_mail, ident).when(is_text, F.coalesce(filled(F.regexp_replace("stem", "[^A-Za-z0-9._-]", "-")), F.lit("document"))),
        "text": F.when(is_mail, S.clean_mail_body("body")).otherwise(F.col("words")),
        "attribution": F.when(is_mail, by_mail).when(is_text, F.concat(F.lit("Document "), "title")),
        "valid_from": F.unix_micros(F.try_to_timestamp("sent")) / 1e6,
        "subject": F.when(is_mail, subject).when(is_text, F.col("title")),
        "sender": F.when(is_mail, sender).when(is_text, F.lit("")),
        "error": F.when(~is_mail & ~is_text, F.format_string(UNSUPPORTED, "suffix")),
    }
    return m.select(*[columns[n].alias(n) for n in MESSAGE.fieldNames()]).filter((F.col("text") != "") | F.col("error").isNotNull())


def import_messages(spark: SparkSession, path: str) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), path)


# ---------------------------------------------------------------- labelled pairs


def clean_pairs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable pairs with white space normalised, refused rows): claim, evidence and a label of 0-2 are required."""
    ok = (F.col("label").isin(0, 1, 2) & (F.coalesce("claim", F.lit("")) != "") & (F.coalesce("evidence", F.lit("")) != ""))
    good = raw.filter(F.coalesce(ok, F.lit(False))).select(
        S.clean_text("claim").alias("claim"), S.clean_text("evidence").alias("evidence"), "label", "page")
    return good, raw.filter(~F.coalesce(ok, F.lit(False)))


def read_labelled_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return clean_pairs(spark.read.schema(LABELLED_PAIR).option("columnNameOfCorruptRecord", "_corrupt").json(path))


# ---------------------------------------------------------------- sinks


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Replace a table, or only the partitions at hand when it is partitioned. Spark's commit protocol makes either
    all of a job's files visible or none."""
    w = df.write.format(fmt).mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.save(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit rows (kind, at in seconds, ...) partitioned by day, so that reads of a period prune."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(F.col("at") / 86400).cast("int"))
    df.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def audit_query(spark: SparkSession, path: str, kind: str, since: str | None = None) -> DataFrame:
    a = spark.read.parquet(path).filter(F.col("kind") == kind)
    return a.filter(F.col("day") >= F.lit(since).cast("date")) if since else a
