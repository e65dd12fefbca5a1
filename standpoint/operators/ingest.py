"""Documents and form reports turned into events and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.functions.passages import split_passages
from standpoint.schemas import WITHDRAWN_KEY
from standpoint.session import cut_lineage


def ingest_documents(docs: DataFrame, state: DataFrame, max_chars: int = 600) -> DataFrame:
    """Events for documents (task_id, doc_id, revision, text, source_id, authority, attribution, valid_from): passage i
    becomes record doc#i, and records of passages that no longer exist are withdrawn at this revision if
    theirs is lower and they are not withdrawn yet. ``state`` is the ledger's. Ids with '#' are refused."""
    checked = docs.withColumn("doc_id", F.when(F.col("doc_id").contains("#"), F.raise_error(
        F.concat(F.lit("doc_id may not contain '#': "), "doc_id")).cast("string")).otherwise(F.col("doc_id")))
    p = cut_lineage(split_passages(checked, max_chars))  # cut once: events and sizes both read them
    events = p.select(
        "task_id", F.concat("doc_id", F.lit("#"), F.col("pos").cast("string")).alias("record_id"), "revision",
        S.attribute("passage", "attribution").alias("text"), "source_id", "authority", "valid_from",
        F.lit(None).cast("double").alias("valid_until"),
        F.format_string("%s, passage %d of %d", "doc_id", F.col("pos") + 1, "n_passages").alias("span"))
    held = (state.groupBy("task_id", "record_id").agg(F.max("revision").alias("held"), F.max("stored_status").alias("status"))
            .withColumn("doc_id", F.regexp_extract("record_id", r"^(.*)#\d+$", 1))
            .withColumn("i", F.regexp_extract("record_id", r"#(\d+)$", 1)).filter((F.col("i") != "") & (F.col("status") != "withdrawn")))
    sizes = p.groupBy("task_id", "doc_id").agg(F.max("n_passages").alias("n"))
    heads = checked.select("task_id", "doc_id", "revision", "source_id", "authority").join(sizes, ["task_id", "doc_id"], "left")
    gone = (held.join(heads, ["task_id", "doc_id"])
            .filter((F.col("i").cast("bigint") >= F.coalesce("n", F.lit(0))) & (F.col("held") < F.col("revision"))))
    none = F.lit(None)
    withdrawals = gone.select("task_id", "record_id", "revision", none.cast("string").alias("text"), "source_id", "authority",
                              none.cast("double").alias("valid_from"), none.cast("double").alias("valid_until"), none.cast("string").alias("span"))
    return events.unionByName(withdrawals).withColumn(
        "payload_key", F.when(F.col("text").isNull(), F.lit(WITHDRAWN_KEY)).otherwise(S.payload_key()))


# Headings of the report form, the answers it accepts, and labels that keep a report out.
HEADINGS = {
    "requirement": "Requirement",
    "message": "Message",
    "got": "What it said",
    "should": "What it should have said",
    "model": "Model",
    "licence": "May this example be added to a public evaluation set (CC BY 4.0)?",
}
NO_RESPONSE = "_No response_"
ANSWERS = {"supports": "SUPPORTS", "refutes": "REFUTES", "not enough info": "NOT_ENOUGH_INFO"}
KEEP_OUT = ["invalid", "duplicate"]
REASONS = ["public", "no_consent", "kept_out", "unreadable", "same_label", "repeat", "conflict"]


def form_sections(body) -> Column:
    """Map from heading to answer. Only the form's own headings, each the first time, open a section."""
    lines = F.split(F.replace(F.coalesce(S.col(body), F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    known = F.array(*[F.lit(h) for h in HEADINGS.values()])
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("seen"),
                     F.array().cast("array<struct<h:string,line:string>>").alias("rows"))

    def step(acc, line):
        head = F.when(line.startswith("### "), F.trim(F.substr(line, F.lit(5))))
        opens = F.coalesce(F.array_contains(known, head) & ~F.array_contains(acc["seen"], head), F.lit(False))
        inside = acc["now"] != ""
        return F.when(opens, F.struct(head.alias("now"), F.concat(acc["seen"], F.array(head)).alias("seen"), acc["rows"].alias("rows"))).when(
            inside, F.struct(acc["now"].alias("now"), acc["seen"].alias("seen"),
                             F.concat(acc["rows"], F.array(F.struct(acc["now"].alias("h"), line.alias("line")))).alias("rows"))).otherwise(acc)

    r = F.aggregate(lines, start, step)

    def answer(h):
        text = F.array_join(F.transform(F.filter(r["rows"], lambda x: x["h"] == h), lambda x: x["line"]), "\n")
        text = F.regexp_replace(text, r"^\s+|\s+$", "")
        return F.when(text == NO_RESPONSE, F.lit("")).otherwise(text)

    return F.struct(*[answer(F.lit(h)).alias(k) for k, h in HEADINGS.items()])


def to_label(answer: Column) -> Column:
    a = F.lower(S.clean_text(answer))
    out = F.lit(None).cast("string")
    for text, label in ANSWERS.items():
        out = F.when(a == text, F.lit(label)).otherwise(out)
    return out


def read_reports(issues: DataFrame) -> DataFrame:
    """Every report with its fields and the reason it is kept or stays out."""
    f = issues.withColumn("f", form_sections("body"))
    got, should = to_label(F.col("f.got")), to_label(F.col("f.should"))
    names = F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: F.lower(x["name"]))
    reason = (F.when(F.arrays_overlap(names, F.array(*[F.lit(x) for x in KEEP_OUT])), F.lit("kept_out"))
              .when(F.lower(F.trim("f.licence")) != "yes", F.lit("no_consent"))
              .when((F.col("f.requirement") == "") | (F.col("f.message") == "") | got.isNull() | should.isNull(), F.lit("unreadable"))
              .when(got == should, F.lit("same_label")).otherwise(F.lit("public")))
    return f.select(
        F.col("number").alias("issue"), F.concat(F.lit("gh-"), F.col("number").cast("string")).alias("id"), "url",
        F.coalesce("author.login", F.lit("")).alias("author"), F.substring(F.coalesce("createdAt", F.lit("")), 1, 10).alias("created"),
        F.col("f.requirement").alias("claim"), F.col("f.message").alias("passage"), got.alias("reported_label"), should.alias("gold_label"),
        F.col("f.model").alias("model"), reason.alias("reason"))


def sync_reports(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(public rows, counts by reason). Of repeats of one case the first is kept; a case given two different answers is
    left out altogether."""
    r = read_reports(issues)
    keys = ["_c", "_p"]
    ok = r.filter("reason = 'public'").withColumn("_c", S.clean_text("claim")).withColumn("_p", S.clean_text("passage"))
    rest = [c for c in r.columns if c not in ("issue", "reason")]
    cases = ok.groupBy(*keys).agg(F.min("gold_label").alias("_lo"), F.max("gold_label").alias("_hi"), F.count("*").alias("_n"),
                                  F.min("issue").alias("issue"), F.min_by(F.struct(*rest), "issue").alias("x"))
    clash = F.col("_lo") != F.col("_hi")
    rows = cases.filter(~clash).select("issue", "x.*")
    kept = cases.agg(F.sum((~clash).cast("long")).alias("public"), F.sum(F.when(~clash, F.col("_n") - 1).otherwise(0)).alias("repeat"),
                     F.sum(F.when(clash, F.col("_n")).otherwise(0)).alias("conflict"))
    kept = kept.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
                                           for n in ("public", "repeat", "conflict")])).alias("r")).select("r.*")
    out = r.filter("reason <> 'public'").groupBy("reason").agg(F.count("*").alias("n"))
    return rows, out.unionByName(kept)


def score_reports(rows: DataFrame, preds: DataFrame) -> DataFrame:
    """Accuracy of predictions (id, predicted) over reported cases, and how often the reported mistake is repeated."""
    j = preds.join(rows.select("id", "gold_label", "reported_label"), "id")
    right = F.sum((F.col("predicted") == F.col("gold_label")).cast("long"))
    return j.agg(F.count("*").alias("cases"), right.alias("correct"), (right / F.count("*")).alias("accuracy"),
                 F.sum((F.col("predicted") == F.col("reported_label")).cast("long")).alias("repeats_reported"))
