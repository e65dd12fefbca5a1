"""Scalar column functions. All stay in the JVM; none is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from standpoint.schemas import BLOCKED, NEEDS_INFO, NEI, READY, STATUS4, WITHDRAWN_KEY

# The words that carry no content when claims and evidence are compared.
STOP_WORDS = (
    "a an the of in on at to for from by with and or not no is are was were be been being it its "
    "this that these those as has have had he she they we you i his her their our your do does did "
    "there than then so if but which who whom what when where will would can could may might"
).split()

# Words that make a number in a claim a comparison.
COMPARATIVE = (
    r"\b(more than|less than|fewer than|greater than|higher than|lower than|at least|at most|no more than|"
    r"no less than|over|under|above|below|exceeds?|exceeded|before|after|prior to|earlier than|later than|"
    r"up to|nearly|almost|approximately|about|around)\b"
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c) -> Column:
    """A sum of doubles that does not depend on the order or grouping of rows.

    Terms go to fixed point first, so partial sums are exact and a refreshed result equals a rebuilt
    one bit for bit. A plain ``sum(double)`` changes in its last bits with the partitioning.
    """
    return F.sum(col(c).cast("decimal(28,18)")).cast("double")


def _length_prefixed(c: Column) -> Column:
    size = F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0"))
    return F.concat(size, F.encode(c, "utf-8"))


def text_hash(*cols) -> Column:
    """sha256 over the parts, each led by its byte length as 8 big-endian bytes."""
    return F.sha2(F.concat(*[_length_prefixed(col(c)) for c in cols]), 256)


def seconds_key(c) -> Column:
    """A time as text for hashing: microseconds as an integer, '' for none."""
    return F.coalesce(F.round(col(c) * 1e6).cast("bigint").cast("string"), F.lit(""))


def payload_key(text="text", source_id="source_id", authority="authority", valid_from="valid_from",
                valid_until="valid_until") -> Column:
    """Identity of what a delivery asserts. Arrival time, span and free-form metadata do not count."""
    return F.when(col(text).isNull(), F.lit(WITHDRAWN_KEY)).otherwise(
        text_hash(text, F.coalesce(col(source_id), F.lit("")), col(authority).cast("string"),
                  seconds_key(valid_from), seconds_key(valid_until)))


def pair_key(claim, evidence) -> Column:
    return F.substring(text_hash(F.lit("pair"), claim, evidence), 1, 24)


def clean_text(c) -> Column:
    """Collapse every run of white space (Unicode included) to one space and trim."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def calibrate_probs(logits, temperature: float = 1.0, bias=(0.0, 0.0, 0.0)) -> Column:
    """softmax(logits / T + b) as struct (p_s, p_r, p_n), shifted by the maximum."""
    z = [F.get(col(logits), F.lit(i)).cast("double") / F.lit(float(temperature)) + F.lit(float(bias[i])) for i in range(3)]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = e[0] + e[1] + e[2]
    return F.struct((e[0] / total).alias("p_s"), (e[1] / total).alias("p_r"), (e[2] / total).alias("p_n"))


def top_label(p_s="p_s", p_r="p_r", p_n="p_n") -> Column:
    """Index of the largest of three probabilities, the first one on ties."""
    s, r, n = col(p_s), col(p_r), col(p_n)
    return F.when((s >= r) & (s >= n), F.lit(0)).when(r >= n, F.lit(1)).otherwise(F.lit(2))


def argmax_first(array) -> Column:
    return F.array_position(col(array), F.array_max(col(array))).cast("int") - 1


def content_words(c) -> Column:
    """The set of lower-case alphanumeric words longer than one character that are not stop words."""
    words = F.split(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.array_except(F.filter(words, lambda w: F.length(w) > 1),
                                           F.array(*[F.lit(w) for w in STOP_WORDS])))


def attribution_prefix(who) -> Column:
    """'who: ' without a doubled colon, '' when nobody is named."""
    named = F.regexp_replace(F.trim(col(who)), r":+$", "")
    return F.when(F.coalesce(F.trim(col(who)), F.lit("")) == "", F.lit("")).otherwise(F.concat(named, F.lit(": ")))


def attribute(passage, who) -> Column:
    return F.concat(attribution_prefix(who), col(passage))


# How a quoted earlier message, and a signature, begin.
QUOTE_START = r"(?m)^(On .{5,200} wrote:|-{2,}\s*Original Message\s*-{2,}|From: .+)$"
SIGNATURE = r"(?m)^-- \s*$"


def clean_mail_body(c) -> Column:
    """Keep what the sender wrote: cut at a quoted earlier message unless the body opens with it, cut
    at the signature line, drop lines marked as quotes."""
    body = F.replace(col(c), F.lit("\r\n"), F.lit("\n"))
    quote = F.regexp_instr(body, F.lit(QUOTE_START))
    body = F.when(quote > 1, F.substring(body, F.lit(1), quote - 1)).otherwise(body)
    sign = F.regexp_instr(body, F.lit(SIGNATURE))
    body = F.when(sign > 0, F.substring(body, F.lit(1), sign - 1)).otherwise(body)
    kept = F.filter(F.split(body, "\n"), lambda line: ~F.ltrim(line).startswith(">"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def record_status(now: float | Column | None, stored="stored_status", valid_from="valid_from",
                  valid_until="valid_until") -> Column:
    """Only an active record can be not yet valid or expired, and only when a clock is supplied."""
    if now is None:
        return col(stored)
    clock = now if isinstance(now, Column) else F.lit(float(now))
    return (F.when(col(stored) != "active", col(stored))
            .when(clock < col(valid_from), F.lit("not_yet_valid"))
            .when(clock >= col(valid_until), F.lit("expired"))
            .otherwise(F.lit("active")))


def status_name(s="s", v="v", u="u", c="c") -> Column:
    """Name of the most likely of four statuses, the first one on ties."""
    a, b, d, e = col(s), col(v), col(u), col(c)
    return (F.when((a >= b) & (a >= d) & (a >= e), F.lit(STATUS4[0]))
            .when((b >= d) & (b >= e), F.lit(STATUS4[1]))
            .when(d >= e, F.lit(STATUS4[2])).otherwise(F.lit(STATUS4[3])))


def belief_from_status(prior, s="s", u="u", c="c") -> Column:
    return col(s) + (col(u) + col(c)) * col(prior)


def disposition(p_sat, p_vio, ready: float | Column = 0.5, block: float | Column = 0.5) -> Column:
    r = ready if isinstance(ready, Column) else F.lit(float(ready))
    b = block if isinstance(block, Column) else F.lit(float(block))
    return (F.when((col(p_sat) >= r) & (col(p_sat) >= col(p_vio)), F.lit(READY))
            .when(col(p_vio) >= b, F.lit(BLOCKED)).otherwise(F.lit(NEEDS_INFO)))


def p_success(belief, reliability, leak) -> Column:
    return col(belief) * col(reliability) + (1.0 - col(belief)) * col(leak)


def expected_utility(p, value, cost) -> Column:
    return col(p) * col(value) - (1.0 - col(p)) * col(cost)


def hash_fraction(*parts, denominator: float = 4294967295.0) -> Column:
    """A reproducible number in [0, 1] from text: the first 32 bits of sha256."""
    joined = reduce(lambda a, b: F.concat(a, b), [col(p) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("bigint") / F.lit(denominator)


def in_holdout(pair, frac: float) -> Column:
    """An item falls on the held-out side by its own identity, so it never changes side."""
    return hash_fraction(F.lit("holdout:"), pair) < F.lit(float(frac))


def claim_kind(c) -> Column:
    digit = col(c).rlike(r"(?U)\d")
    return (F.when(digit & col(c).rlike("(?iU)" + COMPARATIVE), F.lit("number with comparison"))
            .when(digit, F.lit("number, no comparison")).otherwise(F.lit("no number")))


def short_number(c) -> Column:
    """A number as '%g' would print it for the times used here: whole seconds plainly, -inf by name."""
    x = col(c)
    return (F.when(x.isNull() | (x == F.lit(float("-inf"))), F.lit("-inf"))
            .when((x == F.floor(x)) & (F.abs(x) < 1e6), x.cast("bigint").cast("string"))
            .otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e"), "e([+-])", "e$1")))


def confirmation_text(name, claim, holds, note) -> Column:
    said = F.when(col(holds), F.lit("confirmed that this holds")).otherwise(F.lit("said that this does not hold"))
    remark = F.trim(F.coalesce(col(note), F.lit("")))
    return F.concat(F.when(F.trim(col(name)) == "", F.lit("Someone")).otherwise(F.trim(col(name))), F.lit(" "), said,
                    F.lit(": "), col(claim), F.when(remark == "", F.lit("")).otherwise(F.concat(F.lit(" Note: "), remark)))


def label_logits(label, margin) -> Column:
    """Logits with the margin at one label and zero elsewhere."""
    return F.array(*[F.when(col(label) == i, col(margin).cast("double")).otherwise(F.lit(0.0)) for i in (0, 1, NEI)])


def dot(a, b) -> Column:
    """Inner product of two float arrays in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def unit_vector(v) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(col(v), lambda x: x.cast("double") / norm)
