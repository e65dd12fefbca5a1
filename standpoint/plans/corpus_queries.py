"""Registered queries for documents, mail, reports and corpus preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from standpoint.functions import scalars as S
from standpoint.functions.passages import split_passages as cut_passages
from standpoint.operators import corpus as C
from standpoint.operators import ingest as I
from standpoint.operators import ledger as L
from standpoint.plans.feedback_queries import hash32
from standpoint.plans.link_queries import r
from standpoint.plans.registry import cte, query
from standpoint.plans.sqltext import r6, th
from standpoint.session import shared_dir
from standpoint.sources import derive as D
from standpoint.sources import files as FS

cte("nbench", "select count(*) as nb from benchmark")
cte("doc_pairs", """
  select doc_id, b.text as claim, d.text as evidence, doc_id % 3 as label, lang, source as page, doc_id // 5 as grp, n_chars, doc_id // 6 as case_id
  from documents d, nbench join benchmark b on b.item_id = d.doc_id % nb""")


def pairs(spark, sf):
    b = D.table(spark, sf, "benchmark")
    nb = b.agg(F.count("*")).scalar()
    return (D.table(spark, sf, "documents").withColumn("item_id", F.col("doc_id") % nb)
            .join(b.withColumnRenamed("text", "claim"), "item_id")
            .select("doc_id", "claim", F.col("text").alias("evidence"), (F.col("doc_id") % 3).cast("int").alias("label"), "lang",
                    F.col("source").alias("page"), F.floor(F.col("doc_id") / 5).alias("grp"), "n_chars",
                    F.floor(F.col("doc_id") / 6).alias("case_id")))


@query("clean_text", r"select doc_id, sha256(trim(regexp_replace(text, '[\s\x{00a0}\x{2000}-\x{200a}\x{3000}\x{0085}\x{2028}\x{2029}\x{000b}]+', ' ', 'g'))) as h from documents")
def clean_text(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.sha2(S.clean_text("text"), 256).alias("h"))


WORDS = ("list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), "
         "lambda w: length(w) > 1 and not list_contains(" + str(S.STOP_WORDS) + ", w)))")


@query("content_words", f"select doc_id, len(w) as n_words, sha256(array_to_string(list_sort(w), ' ')) as h from (select doc_id, {WORDS.format('text')} as w from documents)")
def content_words(spark, sf):
    w = S.content_words("text")
    return D.table(spark, sf, "documents").withColumn("w", w).select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join(F.array_sort("w"), " "), 256).alias("h"))


@query("claim_kind", f"""
  select kind, count(*) as n from (select case when regexp_matches(text, '\\d') and regexp_matches(text, '(?i)' || '{S.COMPARATIVE.replace(chr(92) + 'b(', '(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(').replace(')' + chr(92) + 'b', ')($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')}') then 'number with comparison'
    when regexp_matches(text, '\\d') then 'number, no comparison' else 'no number' end as kind from documents) group by 1""")
def claim_kind(spark, sf):
    return D.table(spark, sf, "documents").groupBy(S.claim_kind("text").alias("kind")).agg(F.count("*").alias("n"))


@query("attribute", "select conv_id, turn, case when turn % 4 = 0 then '' else role || ': ' end || text as passage from conversations")
def attribute(spark, sf):
    who = F.when(F.col("turn") % 4 == 0, F.lit(" ")).when(F.col("turn") % 4 == 1, F.concat(F.lit(" "), "role", F.lit(":"))).otherwise(F.col("role"))
    return D.table(spark, sf, "conversations").select("conv_id", "turn", S.attribute("text", who).alias("passage"))


QUOTE = r"(On .{5,200} wrote:|-{2,}\s*Original Message\s*-{2,}|From: .+)"
MAIL = r"""case turn % 4 when 0 then text || chr(13) || chr(10) || '> old line' || chr(10) || 'On Monday the user wrote:' || chr(10) || 'gone'
  when 1 then 'On Tuesday they wrote:' || chr(10) || text || chr(10) || '-- ' || chr(10) || 'sender'
  when 2 then text || chr(10) || '---- Original Message ----' || chr(10) || 'x' else '  > q' || chr(10) || text end"""


@query("clean_mail_body", f"""
  select conv_id, turn, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(c, chr(10)), lambda x: not starts_with(ltrim(x), '>')), chr(10)),
    '^\\s+', ''), '\\s+$', '') as body
  from (select conv_id, turn, regexp_replace(case when regexp_matches(b, '^(?m:{QUOTE}$)') then b else regexp_replace(b, '(?m)^{QUOTE}$[\\s\\S]*', '') end,
    '(?m)^-- \\s*$[\\s\\S]*', '') as c from (select conv_id, turn, replace({MAIL}, chr(13) || chr(10), chr(10)) as b from conversations))""")
def clean_mail_body(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", S.clean_mail_body(mail_text()).alias("body"))


def mail_text():
    nl = F.lit("\n")
    t = F.col("turn") % 4
    return (F.when(t == 0, F.concat("text", F.lit("\r\n> old line\nOn Monday the user wrote:\ngone")))
            .when(t == 1, F.concat(F.lit("On Tuesday they wrote:\n"), "text", F.lit("\n-- \nsender")))
            .when(t == 2, F.concat("text", F.lit("\n---- Original Message ----\nx"))).otherwise(F.concat(F.lit("  > q"), nl, "text")))


@query("split_passages")
def split_passages(spark, sf):
    """Passages of every document; the generated texts have no blank lines, so single ones become blank."""
    d = D.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return cut_passages(d)


@query("import_messages", """
  select 'm' || conv_id || '-' || turn || '.eml' as file, 'id' || conv_id || '.' || turn || '@x' as doc_id,
    'Email from ' || role || ' on 2024-01-02, subject: Conversation ' || conv_id as attribution,
    regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as text, 1704189600.0::double as valid_from, cast(null as varchar) as error
  from conversations where turn % 5 <> 4 and regexp_matches(text, '\\S')
  union all select 'm' || conv_id || '-' || turn || '.pdf', null, null, null, null, 'unsupported file type ''.pdf'': use .eml, .mbox, .txt or .md'
  from conversations where turn % 5 = 4""")
def import_messages(spark, sf):
    c = D.table(spark, sf, "conversations")
    head = F.format_string("From: %s <%s@example.com>\nSubject: Conversation %d\nDate: Tue, 02 Jan 2024 10:00:00 +0000\nMessage-ID: <id%d.%d@x>\n"
                           "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n", "role", "role", "conv_id", "conv_id", "turn")
    suffix = F.when(F.col("turn") % 5 == 4, F.lit(".pdf")).otherwise(F.lit(".eml"))
    files = c.select(F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), suffix).alias("path"),
                     F.encode(F.concat(head, "text"), "utf-8").alias("content"))
    return FS.parse_files(files).select("file", "doc_id", "attribution", "text", "valid_from", "error")


@query("read_labelled_pairs", """
  select 'good' as part, count(*) as n, sum(label) as labels from doc_pairs where doc_id % 7 <> 0
  union all select 'bad', count(*), sum(case when doc_id % 14 <> 0 then 7 end) from doc_pairs where doc_id % 7 = 0""")
def read_labelled_pairs(spark, sf):
    """Lines of a file: good ones, ones with a label that does not exist, and ones cut off."""
    line = F.to_json(F.struct("claim", "evidence", F.when(F.col("doc_id") % 7 == 0, 7).otherwise(F.col("label")).alias("label"), "page"))
    path = f"{shared_dir(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}"
    pairs(spark, sf).select(F.when(F.col("doc_id") % 14 == 0, F.concat(F.substring(line, 1, 20), F.lit('"'))).otherwise(line).alias("value")).write.text(path)
    good, bad = FS.read_labelled_pairs(spark, path)
    agg = lambda d, n: d.agg(F.lit(n).alias("part"), F.count("*").alias("n"), F.sum("label").alias("labels"))
    return agg(good, "good").unionByName(agg(bad, "bad"))


@query("normalise_source", f"""
  select {th('claim', 'evidence')} as h, label, source, "group", page from (
    select trim(regexp_replace(claim, '\\s+', ' ', 'g')) as claim, trim(regexp_replace(evidence, '[\\s\\x{{00a0}}]+', ' ', 'g')) as evidence,
      case doc_id % 5 when 0 then 0 when 1 then 2 when 2 then 1 end as label, 'wanli' as source, doc_id::varchar as "group", 'wanli:' || doc_id as page from doc_pairs)
  where label is not null and evidence <> ''""")
def normalise_source(spark, sf):
    names = F.array(*[F.lit(x) for x in ("entailment", "neutral", "contradiction", "other")])
    p = pairs(spark, sf).select(F.col("claim").alias("hypothesis"), F.col("evidence").alias("premise"), F.col("doc_id").alias("pairID"),
                                F.get(names, (F.col("doc_id") % 5).cast("int")).alias("gold"))
    n = C.normalise_source(p, "wanli", "gold")
    return n.select(S.text_hash("claim", "evidence").alias("h"), "label", "source", "group", "page")


# ---- reports

LAB = "['supports', 'REFUTES', 'not enough  info', 'maybe']"
cte("reports", f"""
  select number, claim, passage, got, should, kept_out, consent,
    case when kept_out then 'kept_out' when not consent then 'no_consent' when passage = '' or got is null or should is null then 'unreadable'
         when got = should then 'same_label' else 'public' end as reason from (
    select conv_id * 100 + turn as number, 'Claim ' || (conv_id % 7) as claim,
      case when turn % 2 = 0 then 'same words ' || (conv_id % 3) else regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') end as passage,
      ['SUPPORTS', 'REFUTES', 'NOT_ENOUGH_INFO', null][(conv_id + turn) % 4 + 1] as got,
      ['SUPPORTS', 'REFUTES', 'NOT_ENOUGH_INFO', null][(conv_id + turn // 2) % 3 + 1] as should,
      turn % 6 = 5 as kept_out, conv_id % 5 <> 0 as consent from conversations)""")
cte("report_cases", r"""
  select trim(regexp_replace(claim, '\s+', ' ', 'g')) as c, trim(regexp_replace(passage, '[\s\x{00a0}]+', ' ', 'g')) as p, min(number) as issue, count(*) as n,
    count(distinct should) as k, arg_min(claim, number) as claim, arg_min(passage, number) as passage, arg_min(got, number) as got, arg_min(should, number) as should
  from reports where reason = 'public' group by 1, 2""")


def issues(spark, sf):
    """Each conversation turn as a filled-in report form."""
    names = F.array(*[F.lit(x) for x in ("supports", "REFUTES", "not enough  info", "maybe")])
    h = list(I.HEADINGS.values())
    passage = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("same words "), (F.col("conv_id") % 3).cast("string"))).otherwise(F.col("text"))
    body = F.concat(
        F.lit(f"### {h[0]}\r\n\r\nClaim "), (F.col("conv_id") % 7).cast("string"), F.lit(f"\n\n### {h[1]}\n\n"), passage, F.lit(f"\n\n### {h[2]}\n\n"),
        F.get(names, ((F.col("conv_id") + F.col("turn")) % 4).cast("int")), F.lit(f"\n\n### {h[3]}\n\n"),
        F.get(names, ((F.col("conv_id") + F.floor(F.col("turn") / 2)) % 3).cast("int")), F.lit(f"\n\n### {h[4]}\n\n{I.NO_RESPONSE}\n\n### {h[5]}\n\n"),
        F.when(F.col("conv_id") % 5 != 0, F.lit("Yes ")).otherwise(F.lit("No")))
    label = F.when(F.col("turn") % 6 == 5, F.array(F.struct(F.lit("Invalid").alias("name")))).otherwise(F.array(F.struct(F.lit("misreading").alias("name"))))
    return D.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("number"), F.lit("u").alias("url"), F.struct(F.col("role").alias("login")).alias("author"),
        F.lit("2024-05-06T00:00:00Z").alias("createdAt"), label.alias("labels"), body.alias("body"))


@query("sync_reports", "select issue, claim, sha256(passage) as passage_hash, got as reported_label, should as gold_label from report_cases where k = 1")
def sync_reports(spark, sf):
    rows, _ = I.sync_reports(issues(spark, sf))
    return rows.select("issue", "claim", F.sha2("passage", 256).alias("passage_hash"), "reported_label", "gold_label")


@query("report_counts", """
  select reason, count(*) as n from reports where reason <> 'public' group by 1
  union all select 'public', count(*) from report_cases where k = 1
  union all select 'repeat', coalesce(sum(n - 1), 0)::bigint from report_cases where k = 1
  union all select 'conflict', coalesce(sum(n), 0)::bigint from report_cases where k > 1""")
def report_counts(spark, sf):
    return I.sync_reports(issues(spark, sf))[1]


@query("score_reports", f"""
  select count(*) as cases, sum((pred = should)::int) as correct, {r6('avg((pred = should)::int)')} as accuracy, sum((pred = got)::int) as repeats_reported
  from (select *, ['SUPPORTS', 'REFUTES', 'NOT_ENOUGH_INFO'][('0x' || substr(sha256('gh-' || issue), 1, 8))::bigint % 3 + 1] as pred from report_cases where k = 1)""")
def score_reports(spark, sf):
    rows, _ = I.sync_reports(issues(spark, sf))
    names = F.array(*[F.lit(x) for x in ("SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO")])
    preds = rows.select("id", F.get(names, (hash32(F.col("id")) % 3).cast("int")).alias("predicted"))
    return I.score_reports(rows, preds).select("cases", "correct", r("accuracy"), "repeats_reported")


@query("ingest_documents")
def ingest_documents(spark, sf):
    """Every document at revision 1 whole, then at revision 2 without its second half: passages applied and withdrawn."""
    d = D.table(spark, sf, "documents").select(
        F.lit("lib").alias("task_id"), F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
        F.lit("archive").alias("source_id"), F.lit(1).alias("authority"), F.col("source").alias("attribution"), F.lit(0.0).alias("valid_from"))
    empty = spark.createDataFrame([], "task_id string, record_id string, revision int, stored_status string")
    from standpoint.operators.scan import dense_index
    from standpoint.session import cut_lineage

    first = cut_lineage(I.ingest_documents(d.withColumn("revision", F.lit(1)), empty))
    state = L.ledger_state(dense_index(first, ["record_id"], "seq"))
    half = d.withColumn("text", F.expr("substring(text, 1, length(text) div 2)")).withColumn("revision", F.lit(2))
    both = first.unionByName(I.ingest_documents(half, state))
    return both.groupBy("revision").agg(F.count("text").alias("passages"), F.sum(F.col("text").isNull().cast("long")).alias("withdrawn"),
                                        F.countDistinct("payload_key").alias("payloads"))


# ---- atoms and pairs

cte("atom_pairs", """
  select case_id, claim, evidence, arg_max(label, doc_id) as label from (
    select doc_id, case_id, label, evidence, b.text as claim from (select *  exclude (claim) from doc_pairs), nbench
    join benchmark b on b.item_id = (doc_id // 3) % nb) group by 1, 2, 3""")


def atom_rows(spark, sf):
    b = D.table(spark, sf, "benchmark")
    nb = b.agg(F.count("*")).scalar()
    p = pairs(spark, sf).drop("claim").withColumn("item_id", F.floor(F.col("doc_id") / 3) % nb)
    return p.join(b.withColumnRenamed("text", "claim"), "item_id").withColumn("ord", F.col("doc_id"))


@query("revision_atoms", f"""
  select 'vitc:x:' || case_id || ':' || ci as atom_id, case when nv >= 2 then 'revision' else 'static' end as kind, claim, nv2 as n_versions,
    {th('t1', 'coalesce(t2, chr(45))')} as texts, l1, l2, page
  from (select case_id, claim, max(nv) as nv, least(max(nv), 2) as nv2, max(case when i = 1 then evidence end) as t1, max(case when i = 2 then evidence end) as t2,
          max(case when i = 1 then label end) as l1, max(case when i = 2 then label end) as l2, any_value(ci) as ci from (
          select *, row_number() over (partition by case_id, claim order by evidence) as i, count(*) over (partition by case_id, claim) as nv,
            dense_rank() over (partition by case_id order by claim) - 1 as ci from atom_pairs) group by 1, 2)
  join (select case_id, arg_min(page, doc_id) as page from doc_pairs group by 1) using (case_id)""")
def revision_atoms(spark, sf):
    a = C.revision_atoms(atom_rows(spark, sf), "x")
    v = F.col("versions")
    return a.select("atom_id", "kind", "claim", F.size(v).cast("long").alias("n_versions"),
                    S.text_hash(v[0]["text"], F.coalesce(F.get(v, 1)["text"], F.lit("-"))).alias("texts"), v[0]["label"].alias("l1"),
                    F.get(v, 1)["label"].alias("l2"), "page")


@query("static_atoms", f"""select 'docs:x:' || doc_id as atom_id, 'static' as kind, {th('claim', 'evidence')} as h, label, 'docs:x:' || grp as page from doc_pairs""")
def static_atoms(spark, sf):
    p = pairs(spark, sf).withColumn("group", F.col("grp"))
    a = C.static_atoms(p, "docs", "x", "doc_id")
    return a.select("atom_id", "kind", S.text_hash("claim", F.col("versions")[0]["text"]).alias("h"), F.col("versions")[0]["label"].alias("label"), "page")


NUM = "('0x' || substr(md5({0}), 1, 12))::bigint"
cte("pair_idx", "select *, row_number() over (order by md5(doc_id::varchar), doc_id) - 1 as idx, count(*) over () as n from doc_pairs")


def draws_sql(cands: int, mined: bool) -> str:
    shared = f"len(list_intersect({WORDS.format('a.claim')}, {WORDS.format('b.evidence')}))" if mined else "0"
    a_i, b_i = NUM.format("'0|a|' || t"), NUM.format("'0|b|' || t || '|' || j")
    return f"""
    select t, row_number() over (order by t) - 1 as i, claim, evidence, shared from (
      select * from (
        select t, j, a.claim, b.evidence, {shared} as shared
        from (select unnest(range(0, (select 2 * (count(*) // 2) + 64 from documents))) as t), (select unnest(range(0, {cands})) as j)
        join pair_idx a on a.idx = {a_i} % (select max(n) from pair_idx) join pair_idx b on b.idx = {b_i} % (select max(n) from pair_idx)
        where a.page <> b.page and a.claim <> b.claim and a.evidence <> b.evidence)
      qualify row_number() over (partition by t order by shared desc, j) = 1)
    qualify i < (select count(*) // 2 from documents)"""


@query("unrelated_pairs", f"select t, i, {th('claim', 'evidence')} as h from ({draws_sql(1, False)})")
def unrelated_pairs(spark, sf):
    n = D.table(spark, sf, "documents").count() // 2
    return C.unrelated_pairs(pairs(spark, sf), "doc_id", n).select("t", "i", S.text_hash("claim", "evidence").alias("h"))


@query("mined_negatives", f"select t, i, shared, {th('claim', 'evidence')} as h from ({draws_sql(8, True)})")
def mined_negatives(spark, sf):
    n = D.table(spark, sf, "documents").count() // 2
    return C.mined_negatives(pairs(spark, sf), "doc_id", n).select("t", "i", F.col("shared").cast("long").alias("shared"), S.text_hash("claim", "evidence").alias("h"))


MIX = {"en": 0.2, "fr": 0.5, "de": 0.2, "es": 0.1}
SHUF = "md5(md5('0|0|' || doc_id))"


@query("weighted_mixture", f"""
  select doc_id, source, unnest(range(0, ((q - i - 1) // size + 1)::bigint)) as pass from (
    select doc_id, lang as source, row_number() over (partition by lang order by {SHUF}) - 1 as i, count(*) over (partition by lang) as size,
      round(w * (select count(*) from documents))::bigint as q
    from documents join (values ('en', 0.2::double), ('fr', 0.5), ('de', 0.2), ('es', 0.1)) v(lang, w) using (lang)) where i < q""")
def weighted_mixture(spark, sf):
    p = pairs(spark, sf).select("doc_id", F.col("lang").alias("source"))
    n = D.table(spark, sf, "documents").count()
    return C.weighted_mixture(p, "doc_id", MIX, n).select("doc_id", "source", "pass")


@query("global_shuffle", f"select doc_id, row_number() over (order by md5(md5('7|2|' || doc_id))) - 1 as pos from documents")
def global_shuffle(spark, sf):
    return C.global_shuffle(D.table(spark, sf, "documents").select("doc_id"), "doc_id", 7, 2)


@query("eval_split", """
  with p as (select doc_id, (doc_id // 3) * 7 % 50 as grp, row_number() over (order by doc_id) - 1 as pos from documents)
  select doc_id, grp, pos from p where pos < coalesce((select min(pos) from p where pos >= 100 and grp not in (select grp from p where pos < 100)), 1e18)""")
def eval_split(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", (F.floor(F.col("doc_id") / 3) * 7 % 50).alias("grp"))
    return C.eval_split(d, 100, "doc_id", "grp").select("doc_id", "grp", "pos")


@query("length_buckets", f"""
  select doc_id, pool, batch, dense_rank() over (partition by pool order by md5('0|' || pool || '|' || batch)) - 1 as batch_order from (
    select *, (row_number() over (partition by pool order by n_chars, doc_id) - 1) // 8 as batch from (
      select doc_id, n_chars, (row_number() over (order by {SHUF}) - 1) // 64 as pool from documents))""")
def length_buckets(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "n_chars")
    return C.length_buckets(d, "doc_id", "n_chars", 8, 64).select("doc_id", "pool", "batch", "batch_order")


@query("label_mix", f"""
  select source, win, n, {r6('n0 / n')} as share_0, {r6('n1 / n')} as share_1, {r6('n2 / n')} as share_2, n >= 10 as enough,
    n >= 10 and t > 4 * n and greatest(abs(n0 / n - t0 / t), abs(n1 / n - t1 / t), abs(n2 / n - t2 / t)) > 0.02 as drift
  from (select *, sum(n) over w as t, sum(n0) over w as t0, sum(n1) over w as t1, sum(n2) over w as t2 from (
    select lang as source, doc_id // 100 as win, count(*) as n, sum((label = 0)::int) as n0, sum((label = 1)::int) as n1, sum((label = 2)::int) as n2
    from doc_pairs group by 1, 2) window w as (partition by source order by win))""")
def label_mix(spark, sf):
    p = pairs(spark, sf).select("doc_id", F.col("lang").alias("source"), "label")
    return C.label_mix(p, 100, "doc_id", 0.02, 10).select("source", "win", "n", r("share_0"), r("share_1"), r("share_2"), "enough", "drift")


@query("source_counts_licences", """
  select source, count(*) as rows_drawn, case when source in ('src1', 'src2') then 'CC BY' else 'derived: texts drawn from the real sources above' end as licence
  from documents group by 1""")
def source_counts_licences(spark, sf):
    d = D.table(spark, sf, "documents").select("source")
    known = d.distinct().filter(F.col("source").isin("src1", "src2")).withColumn("licence", F.lit("CC BY"))
    return C.source_counts_licences(d, known)


@query("stride_sample", "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) where pos % 3 = 0 and pos < 3 * 150")
def stride_sample(spark, sf):
    return C.stride_sample(D.table(spark, sf, "documents").select("doc_id"), 3, 150, "doc_id").select("doc_id")


@query("replay_rows")
def replay_rows(spark, sf):
    n = D.table(spark, sf, "documents").count()
    return C.replay_rows(C.revision_atoms(atom_rows(spark, sf), "x"), n)


@query("overlap_audit", """
  with t as (select * from doc_pairs where doc_id % 4 <> 0), p as (select * from doc_pairs where doc_id % 4 = 0)
  select lang as pool, count(*) as pairs, sum(((claim, evidence) in (select (claim, evidence) from t))::int) as pairs_in_train,
    sum((claim in (select claim from t))::int) as claims_in_train, sum((evidence in (select evidence from t))::int) as evidence_in_train,
    sum((page in (select page from t))::int) as pages_in_train from p group by 1""")
def overlap_audit(spark, sf):
    p = pairs(spark, sf)
    return C.overlap_audit(p.filter("doc_id % 4 <> 0"), p.filter("doc_id % 4 = 0").withColumnRenamed("lang", "pool"))


# ---- states over time

cte("live_at", """
  select o.task_id, o.seq as step, s.record_id, s.text, s.authority, s.valid_from
  from (select task_id, seq from outcomes where changed) o join spans s
    on s.task_id = o.task_id and s.seq_from <= o.seq and (s.seq_to is null or o.seq < s.seq_to)
  where s.status = 'active' and coalesce(s.text, '') <> ''""")
LAB_AT = "('0x' || substr(sha256(text || '|' || predicate_id), 1, 8))::bigint % 10"
cte("gold_at", f"""
  select task_id, step, predicate_id, case when count(distinct lab) > 1 then 'CONFLICT' when min(lab) = 0 then 'SATISFIED' else 'VIOLATED' end as status
  from (select *, rank() over (partition by task_id, step, predicate_id order by authority desc, valid_from desc) as rk from (
          select l.*, predicate_id, case when {LAB_AT} < 3 then 0 else 1 end as lab from live_at l, (select unnest(['p0','p1','p2','p3','p4']) as predicate_id)
          where {LAB_AT} < 5)) where rk = 1 group by 1, 2, 3""")


def changed_steps(spark, sf):
    """The log, the steps at which it changed, and the spans between them (written once)."""
    from standpoint.session import cut_lineage

    ev = D.event_log(spark, sf)
    spans = cut_lineage(L.change_intervals(ev))
    return ev, spans.select("task_id", F.col("seq_from").alias("step")), spans


@query("disposition_contexts", """
  select o.task_id, o.seq as step, p.predicate_id, p.claim, md5(coalesce(c.ctx, '(no records)')) as context, coalesce(g.status, 'UNRESOLVED') as status
  from outcomes o join predicates p using (task_id) left join (
    select task_id, step, string_agg('[record ' || n || ' | authority ' || authority || ' | time ' || t || '] ' || text, ' ' order by n) as ctx
    from (select *, row_number() over (partition by task_id, step order by authority desc, valid_from desc, record_id) as n,
            case when valid_from < 1e6 then cast(valid_from::bigint as varchar)
                 else regexp_replace(printf('%.5e', valid_from), '\\.?0+e', 'e') end as t from live_at) group by 1, 2) c
    on c.task_id = o.task_id and c.step = o.seq
  left join gold_at g on g.task_id = o.task_id and g.step = o.seq and g.predicate_id = p.predicate_id where o.changed""")
def disposition_contexts(spark, sf):
    ev, steps, spans = changed_steps(spark, sf)
    return C.disposition_contexts(ev, steps, D.predicates(spark, sf), D.gold_label, spans).withColumn("context", F.md5(F.col("context").cast("binary")))


@query("set_suite_from_trace", """
  select task_id, step, predicate_id, record_id, claim, text,
    dense_rank() over (partition by task_id, step, predicate_id order by authority desc, valid_from desc) - 1 as rank
  from (select o.task_id, o.seq as step, p.predicate_id, p.claim from outcomes o join predicates p using (task_id) where o.changed
        order by md5('0|' || o.task_id || '|' || o.seq || '|' || p.predicate_id) limit 300) d join live_at using (task_id, step)""")
def set_suite_from_trace(spark, sf):
    ev, steps, spans = changed_steps(spark, sf)
    return C.set_suite_from_trace(ev, steps, D.predicates(spark, sf), 300, spans=spans).drop("authority", "valid_from")
