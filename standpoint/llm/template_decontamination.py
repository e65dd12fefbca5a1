"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are typed placeholders; each placeholder remembers the
value it stands for, and a run of capitalised words or of digit groups is one placeholder. A capitalised word at the start of a
sentence is read under two rules: as the word it is (so lower-cased copies match) and as a name (so copies with other names match).
Windows of ``WINDOW`` tokens are hashed under both rules from one tokenisation and hash-joined with the windows of the benchmark
(an item with fewer tokens is one window of all of them, met by document windows of that length). Matches are grouped by
document, item and alignment (position in the document minus position in the item). An alignment is a candidate when it holds
``SHARE`` of the item's windows under a rule; candidates are read again beside the item, and count when their slots are consistent:
a value of the item always corresponds to the same value of the document. Equal tokens over the whole item make it verbatim,
other values a re-parameterised copy. Windows made of placeholders alone take no part, unless the item has no other.

Only expressions, explode, equi-joins and groupings are used. The benchmark side of the join is left to Spark: its size
decides between a broadcast and a shuffle of (document, position, hash). Candidates are written, so that Spark knows their size when
it joins them with the documents: texts are shuffled only where candidates are too many to be sent around.

Defined cases: null and empty texts match nothing; documents are told apart by id and text hash, so rows with one id and
other texts are judged one by one and repeated rows together; a null ``doc_id`` is an id like any other; items without
tokens are ignored; repeated items each report; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standpoint.llm.common import fresh, let
from standpoint.session import cut_lineage

WINDOW, SHARE = 8, 0.25
#: Units that count as such after a number.
UNITS = "km|cm|mm|nm|m|kg|mg|g|lb|oz|ml|l|s|ms|min|h|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|v|a|usd|eur|dollars|euros|percent|metres|meters|miles|hours|minutes|seconds|days|years|grams|litres|liters"
NUMBER = r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*(?:[.,][0-9]+| [0-9]{3}(?![\p{L}\p{N}]))*"
#: Capitalised words in a row. Those inside a sentence (after a small letter, a comma or a semicolon, and one blank) are names
#: under both rules, those elsewhere under the second only.
NAMES = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+(?: \p{Lu}\p{Ll}+)*(?![\p{L}\p{N}])"
INSIDE = r"<\^(?<=[\p{Ll},;] <\^)"
TOKEN = r"<[^>]*|[\p{L}\p{N}]+"


def encoded(text: Column) -> Column:
    """The text in small letters with placeholders ``<#value>``, ``<@value>``, ``<$value>``, and ``<^value>`` for names by the
    second rule alone."""

    def numbers(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, NUMBER, "<#$0>"), rf"(<#[^>]*> ?)((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", r"$1<\$$2>")

    t = F.coalesce(text, F.lit(""))
    t = F.when(t.contains("<") | t.contains(">"), F.translate(t, "<>", "  ")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, NAMES, "<^$0>"), INSIDE, "<@")
    return F.lower(let(t, lambda x: F.when(x.rlike("[0-9]"), numbers(x)).otherwise(x)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(encoded(text), F.lit(TOKEN), 0)


def value(x: Column) -> Column:
    """What a token says, placeholder or not."""
    return F.when(x.startswith("<"), F.substring(x, 3, 1 << 30)).otherwise(x)


def _typed(x: Column, rule: int) -> Column:
    """Hash of a token under rule 1 or 2."""
    alone = x.startswith("<^")
    kind = F.when(alone, F.substring(x, 3, 1 << 30) if rule == 1 else F.lit("<@")).otherwise(F.substring(x, 1, 2))
    return F.xxhash64(F.when(x.startswith("<"), kind).otherwise(x))


def windows(toks: Column, widths: list[int]) -> Column:
    """Array of (len, pos, first, second) of the windows of each width: their hashes under the two rules; ``second`` is null where
    it equals the first, as in all windows of texts without names by the second rule. Token hashes are made once for all widths."""

    def cut(first: Column, second: Column | None, n: int) -> Column:
        def window(hashes: Column, i: Column) -> Column:
            return F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])

        def one(i: Column) -> Column:
            a = window(first, i)
            b = F.lit(None).cast("long") if second is None else F.nullif(window(second, i), a)
            return F.struct(F.lit(n).alias("len"), i.alias("pos"), a.alias("first"), b.alias("second"))

        some = F.size(first) >= n
        return F.when(some, F.transform(F.sequence(F.lit(0), F.greatest(F.size(first) - n, F.lit(0))), one)).otherwise(F.array().cast("array<struct<len:int,pos:int,first:bigint,second:bigint>>"))

    def all_widths(first: Column, second: Column | None) -> Column:
        parts = [cut(first, second, n) for n in widths]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def hashed(v: Column) -> Column:
        plain = F.transform(v, lambda x: _typed(x, 1))
        both = F.exists(v, lambda x: x.startswith("<^"))
        return F.when(both, let(plain, lambda a: let(F.transform(v, lambda x: _typed(x, 2)), lambda b: all_widths(a, b)))).otherwise(let(plain, lambda a: all_widths(a, None)))

    return let(toks, hashed)


def _by_hash(df: DataFrame, keys: list[str], w: str) -> DataFrame:
    """A row per window and hash; ``rules`` has bit 1 for the first rule and bit 2 for the second."""
    def row(h: Column, rules: int) -> Column:
        return F.struct(h.alias("hash"), F.lit(rules).alias("rules"))

    w = F.col(w)
    out = df.select(*keys, w["len"].alias("len"), w["pos"].alias("pos"), F.explode(
        F.when(w["second"].isNull(), F.array(row(w["first"], 3))).otherwise(F.array(row(w["first"], 1), row(w["second"], 2)))).alias("h"))
    return out.select(*keys, "len", "pos", "h.hash", "h.rules")


def item_windows(items: DataFrame) -> DataFrame:
    """Windows that take part, and how many an item has under each rule. ``items``: item_key, toks, len."""
    rows = None
    for n in range(1, WINDOW + 1):
        part = items.where(F.col("len") == n).select("item_key", "toks", F.explode(windows(F.col("toks"), [n])).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    cut = F.slice("toks", F.col("w.pos") + 1, F.col("w.len"))
    literal = [F.exists(cut, lambda x: ~x.rlike("^<[@#$]")).alias("literal1"), F.exists(cut, lambda x: ~x.startswith("<")).alias("literal2")]
    rows = rows.select("item_key", "w", *literal)
    sizes = rows.groupBy("item_key").agg(F.count("*").alias("all_windows"), *[F.count(F.when(F.col(f"literal{r}"), 1)).alias(f"n{r}") for r in (1, 2)])
    used = [F.when(F.col(f"literal{r}") | (F.col(f"n{r}") == 0), r).otherwise(0) for r in (1, 2)]
    rows = _by_hash(rows.join(sizes, "item_key").withColumn("used", used[0] + used[1]), ["item_key", "used", "all_windows", "n1", "n2"], "w")
    total = [F.when(F.col(f"n{r}") > 0, F.col(f"n{r}")).otherwise(F.col("all_windows")).alias(f"total{r}") for r in (1, 2)]
    only = [((F.col(f"n{r}") == 0) & (F.col("len") < WINDOW)).alias(f"only{r}") for r in (1, 2)]
    return (rows.select("item_key", "len", F.col("pos").alias("item_pos"), "hash", F.col("rules").bitwiseAND(F.col("used")).alias("item_rules"), *total, *only)
            .where("item_rules > 0"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, n_item_windows, share, verbatim) for every leaked pair."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).dropna(subset=["text"]).select("item_id", tokens(F.col("text")).alias("toks")).where(F.size("toks") > 0)
    items = cut_lineage(items.select("item_id", "toks", F.least(F.lit(WINDOW), F.size("toks")).alias("len"), F.xxhash64("item_id", F.concat_ws(" ", "toks")).alias("item_key")))
    lengths = sorted({WINDOW} | {r.len for r in items.select("len").distinct().collect()})  # at most WINDOW of them
    source = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    keys = ["doc_id", "text_key", "item_key", "shift"]
    # the outer form, or Spark would work the windows out twice more to see whether there are any
    cut = source.select("doc_id", "text_key", F.explode_outer(windows(tokens(F.col("text")), lengths)).alias("w")).where("w.len is not null")
    met = (_by_hash(cut, ["doc_id", "text_key"], "w")
           .join(item_windows(items.dropDuplicates(["item_key"])), ["len", "hash"])
           .withColumn("rules", F.col("rules").bitwiseAND(F.col("item_rules"))).where("rules > 0"))
    # the windows of one alignment are at most those of one item
    found = met.groupBy(*keys[:3], (F.col("pos") - F.col("item_pos")).alias("shift"), "len", "total1", "total2", "only1", "only2").agg(
        *[F.collect_set(F.when(F.col("rules").bitwiseAND(r) > 0, F.col("item_pos"))).alias(f"places{r}") for r in (1, 2)])
    enough = [F.size(f"places{r}") >= F.ceil(F.lit(share) * F.col(f"total{r}")) for r in (1, 2)]
    candidates = cut_lineage(found.where(enough[0] | enough[1]))
    beside = (source.join(candidates, source["doc_id"].eqNullSafe(candidates["doc_id"]) & (source["text_key"] == candidates["text_key"]))
              .select(source["*"], *[candidates[c] for c in candidates.columns if c not in ("doc_id", "text_key")])
              .join(items.select("item_key", "item_id", F.col("toks").alias("item")), "item_key")
              .withColumn("toks", tokens(F.col("text"))))
    there = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda q: F.struct(
        F.get("item", q).startswith("<").alias("slot"), value(F.get("item", q)).alias("i"), value(F.when(q + F.col("shift") >= 0, F.get("toks", q + F.col("shift")))).alias("d")))
    beside = beside.withColumn("there", there)
    verbatim = F.forall("there", lambda x: x.d.isNotNull() & (x.i == x.d))
    none = F.struct(F.lit(0.0).alias("share"), F.lit(0).alias("n_windows"), F.lit(0).cast("long").alias("n_item_windows"))
    best = none
    for r, some in zip((2, 1), reversed(enough), strict=True):
        covered = F.array_distinct(F.flatten(F.transform(f"places{r}", lambda p: F.sequence(p, p + F.col("len") - 1))))
        pairs = F.array_distinct(F.filter(F.transform(covered, lambda q: F.get("there", q)), lambda x: x.slot))
        # a short item of placeholders alone, such as a number, would else be found wherever there is one
        good = some & let(pairs, lambda p: F.size(F.array_distinct(F.transform(p, lambda x: x.i))) == F.size(p)) & (~F.col(f"only{r}") | verbatim)
        this = F.struct((F.size(f"places{r}") / F.col(f"total{r}")).alias("share"), F.size(f"places{r}").alias("n_windows"), F.col(f"total{r}").alias("n_item_windows"))
        best = F.when(good, F.greatest(this, best)).otherwise(best)
    checked = beside.select("doc_id", "text_key", "item_id", best.alias("best"), verbatim.alias("verbatim"))
    # the condition comes after the grouping: before it, Spark would move it down and work the tokens out again for every use
    found = checked.groupBy("doc_id", "text_key", "item_id").agg(F.max("best").alias("best"), F.max(F.when(F.col("best.n_windows") > 0, F.col("verbatim"))).alias("verbatim"))
    return found.where("best.n_windows > 0").select(
        "doc_id", "text_key", "item_id", F.col("best.n_windows").cast("long").alias("n_windows"), "best.n_item_windows", "verbatim", "best.share")


def remove(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the leaked ones, with all their columns. What leaked is written first: its size is then known before whole
    documents are joined with it, which are shuffled only where it is too much to be sent around."""
    key, id_, key_ = fresh(docs.columns, "text_key", "leaked_id", "leaked_key")
    bad = cut_lineage(leaks(docs, benchmark, share).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_)).distinct())
    marked = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    clean = marked.join(bad, marked["doc_id"].eqNullSafe(bad[id_]) & (marked[key] == bad[key_]), "left_anti")
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
