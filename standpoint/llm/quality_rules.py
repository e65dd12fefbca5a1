"""Rule bitmask ledger: every rule is evaluated once per document, policies and ablations only read bits.

``ledger`` returns one row per input row: the document's id, the measurements, and ``failures``, a long in which bit
``r`` is set when rule ``r`` fails. ``apply_policy`` keeps a document when none of the bits in a policy's mask is set, so
another policy, or a new version of one, needs no second look at the texts. ``ablations`` tells for each rule of a policy
how many documents it rejects, how many it alone rejects, and how many the policy would keep without it; it groups the
masked bits first (at most two to the number of rules distinct values), so nothing per document is shuffled.

Everything is an expression within the row: no join, no shuffle, no Python. Work per text is n log n in its words.

Defined cases: a null text is an empty one (no words, fails ``few_words``); a null ``doc_id`` stays null; repeated rows
give repeated results; an empty table gives an empty ledger; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standpoint.llm.common import fresh, let, words_of

#: Rule number -> (name, condition over the measurements under which a document fails).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 15 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    ("upper_case", "100 * n_upper > 40 * word_chars"),
    ("exclamations", "100 * n_exclamations > 30 * n_words"),
]
BASE = 0b11
#: Policy version -> mask of the rules that count.
POLICIES: dict[str, int] = {"base-1": BASE, "web-1": BASE | 0b1100, "web-2": 0b1111111}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclamations"]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more: equal windows are neighbours once their hashes are
    sorted, and the starts found are sorted again to add up the union of their spans."""

    def starts(hashes: Column) -> Column:
        return F.filter(
            hashes, lambda x, i: (F.try_element_at(hashes, i + 2).h.eqNullSafe(x.h)) | ((i > 0) & F.get(hashes, i - 1).h.eqNullSafe(x.h))
        )

    def union(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(pairs, lambda s: F.transform(starts(s), lambda x: x.i))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(repeated), union))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def measure(text: Column) -> Column:
    """A struct of all measurements of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclamations"),
        )

    return let(words_of(text), lambda w: let(lines, lambda ls: of(w, ls)))


def failure_bits(measures: dict[str, str]) -> Column:
    """All rules as one long. ``measures`` names the columns that hold the measurements."""
    bits = F.lit(0).cast("long")
    for r, (_, condition) in enumerate(RULES):
        for name, column in measures.items():
            condition = condition.replace(name, column)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    m = docs.select(F.col("doc_id"), measure(F.col("text")).alias("m")).select("doc_id", *[F.col("m")[n].alias(n) for n in MEASURES])
    return m.withColumn("failures", failure_bits({}))


def passes(failures: Column, policy: str) -> Column:
    return failures.bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(led: DataFrame, policy: str = "web-2") -> DataFrame:
    return led.select("*", (F.col("failures").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
                      passes(F.col("failures"), policy).alias("kept"), F.lit(policy).alias("policy"))


def ablations(led: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """Per policy and rule in it: documents, kept, rejected by the rule, by the rule alone, and kept without the rule."""
    groups = led.groupBy("failures").agg(F.count("*").alias("n"))
    masks = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(POLICIES[p]).cast("long").alias("mask")) for p in policies or POLICIES])
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << r).cast("long").alias("bit")) for r, (name, _) in enumerate(RULES)])
    wide = (groups.select("failures", "n", F.explode(masks).alias("p")).select("failures", "n", "p.*", F.explode(rules).alias("r"))
            .where(F.col("mask").bitwiseAND(F.col("r.bit")) != 0)
            .withColumn("hit", F.col("failures").bitwiseAND(F.col("mask"))))

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    without = F.col("hit").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return wide.groupBy("policy", F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("documents"), count(F.col("hit") == 0).alias("kept"),
        count(F.col("hit").bitwiseAND(F.col("r.bit")) != 0).alias("rejected"), count(F.col("hit") == F.col("r.bit")).alias("only_rejected"),
        count(without == 0).alias("kept_without"))


def keep(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The documents a policy keeps, with all their columns and nothing else."""
    m, = fresh(docs.columns, "measures")
    judged = docs.withColumn(m, measure(F.col("text")))
    return judged.where(passes(failure_bits({n: f"{m}.{n}" for n in MEASURES}), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
