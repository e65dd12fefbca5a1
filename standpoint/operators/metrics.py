"""Evaluation: counts and ratios from one pass of partial aggregates, exact quantiles and rank statistics from
blocked scans, and intervals from resampling whole clusters with reproducible draws."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from standpoint.functions import scalars as S
from standpoint.operators.scan import deal, running_before, spread

BINS = 15
BLOCKS = 2 ** 20  # pieces of the unit interval that running counts are kept over
DISPOSITIONS = ("READY", "BLOCKED", "NEEDS_INFO")


def _hit() -> Column:
    return (S.top_label("p0", "p1", "p2") == F.col("label")).cast("double")


def p_of_label() -> Column:
    return F.when(F.col("label") == 0, F.col("p0")).when(F.col("label") == 1, F.col("p1")).otherwise(F.col("p2"))


def nll_of(p: Column) -> Column:
    return -F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))


# ---------------------------------------------------------------- classification


def classification_report(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (p0, p1, p2, label): n, accuracy, macro F1 over classes that occur, NLL and multiclass Brier score."""
    top = S.top_label("p0", "p1", "p2")
    e = preds.withColumn("_t", top)
    aggs = [F.count("*").alias("n"), F.avg(_hit()).alias("accuracy"), F.avg(nll_of(p_of_label())).alias("nll"),
            F.avg(sum((F.col(f"p{c}") - (F.col("label") == c).cast("double")) ** 2 for c in range(3))).alias("brier")]
    for c in range(3):
        t, y = F.col("_t") == c, F.col("label") == c
        aggs += [F.sum((t & y).cast("long")).alias(f"_tp{c}"), F.sum((t != y).cast("long")).alias(f"_miss{c}")]
    r = e.groupBy(*(by or [])).agg(*aggs)
    f1 = F.array_compact(F.array(*[F.when(F.col(f"_tp{c}") + F.col(f"_miss{c}") > 0, 2.0 * F.col(f"_tp{c}")
                                          / (2.0 * F.col(f"_tp{c}") + F.col(f"_miss{c}"))) for c in range(3)]))
    macro = F.aggregate(f1, F.lit(0.0), lambda a, x: a + x) / F.size(f1)
    return r.select(*(by or []), "n", "accuracy", macro.alias("macro_f1"), "nll", "brier")


def _bin(c: str, bins: int) -> Column:
    """Equal-width bins closed on the right; the first also holds zero."""
    return F.when(F.col(c) <= 0, F.lit(0)).otherwise(F.ceil(F.col(c) * bins).cast("int") - 1)


def binary_ece(df: DataFrame, p: str, y: str, bins: int = BINS) -> DataFrame:
    """Weighted gap between stated probability and observed frequency over probability bins."""
    b = df.withColumn("_b", _bin(p, bins)).groupBy("_b").agg(
        F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("_y"), F.avg(p).alias("_p"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("_y") - F.col("_p"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def ece(preds: DataFrame, bins: int = BINS) -> DataFrame:
    return binary_ece(preds.select(F.greatest("p0", "p1", "p2").alias("conf"), _hit().alias("hit")), "conf", "hit", bins)


def contrast_set_accuracy(preds: DataFrame, group: str) -> DataFrame:
    """Share of groups of two or more rows in which every row is right."""
    g = preds.groupBy(group).agg(F.min(_hit()).alias("all_right"), F.count("*").alias("size")).filter("size >= 2")
    return g.agg(F.count("*").alias("n_sets"), F.avg("all_right").alias("set_accuracy"))


def confusion(preds: DataFrame) -> DataFrame:
    t = preds.withColumn("_t", S.top_label("p0", "p1", "p2"))
    return (t.groupBy("label").pivot("_t", [0, 1, 2]).agg(F.count(F.lit(1))).na.fill(0)
            .select("label", *[F.col(str(i)).alias(f"pred_{i}") for i in range(3)])
            .withColumn("recall", F.when(F.col("label") == 0, F.col("pred_0")).when(F.col("label") == 1, F.col("pred_1"))
                        .otherwise(F.col("pred_2")) / (F.col("pred_0") + F.col("pred_1") + F.col("pred_2"))))


def false_decisive_rate(preds: DataFrame) -> DataFrame:
    """Over unrelated pairs: share not read as settling nothing, and the chance that none of 10 / 30 is misread."""
    rate = F.avg((S.top_label("p0", "p1", "p2") != 2).cast("double"))
    return preds.agg(rate.alias("rate"), F.avg("p2").alias("mean_p_nei"), F.pow(1.0 - rate, F.lit(10.0)).alias("none_of_10"),
                     F.pow(1.0 - rate, F.lit(30.0)).alias("none_of_30"))


def mcnemar_counts(preds_a: DataFrame, preds_b: DataFrame, key: str) -> DataFrame:
    a = preds_a.select(key, _hit().alias("a"))
    b = preds_b.select(key, _hit().alias("b"))
    return a.join(b, key).agg(F.sum(((F.col("a") == 1) & (F.col("b") == 0)).cast("long")).alias("only_a"),
                              F.sum(((F.col("a") == 0) & (F.col("b") == 1)).cast("long")).alias("only_b"),
                              F.count("*").alias("n"))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k successes in n fair trials: outcomes no likelier than k."""
    if n == 0:
        return 1.0

    def log_p(i):
        return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)

    here = log_p(k)
    return min(1.0, sum(math.exp(log_p(i)) for i in range(n + 1) if log_p(i) <= here + 1e-7))


def mcnemar(preds_a: DataFrame, preds_b: DataFrame, key: str) -> DataFrame:
    """Counts of rows only one of two models gets right and the exact p of their difference. The tail is a sum over
    the possible counts, cut into pieces of 4096 that are dealt over all tasks and added up where they lie."""
    c = mcnemar_counts(preds_a, preds_b, key)
    n = F.col("only_a") + F.col("only_b")
    lg = lambda x: F.log(F.lit(1.0)) + _lgamma(x)
    pieces = spread(c.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / 4096)))), "_piece")
    terms = pieces.withColumn("i", F.explode(F.sequence(F.col("_piece") * 4096, F.least(n, F.col("_piece") * 4096 + 4095)))).drop("_piece")

    def log_p(i):
        return lg(n + 1) - lg(i + 1) - lg(n - i + 1) - n * F.log(F.lit(2.0))

    here, each = log_p(F.col("only_b")), log_p(F.col("i"))
    p = F.least(F.lit(1.0), F.sum(F.when(each <= here + 1e-7, F.exp(each)).otherwise(F.lit(0.0))))
    return terms.groupBy("only_a", "only_b", "n").agg(p.alias("p_value"))


def _lgamma(x: Column) -> Column:
    """log Gamma for x >= 1 by Stirling's series, shifted by eight so that it is good to 1e-12."""
    z = x.cast("double") + 8.0
    series = ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * z) - 1.0 / (360.0 * z ** 3)
              + 1.0 / (1260.0 * z ** 5) - 1.0 / (1680.0 * z ** 7))
    shift = sum((F.log(x.cast("double") + float(i)) for i in range(8)), F.lit(0.0))
    return series - shift


# ---------------------------------------------------------------- ranks and quantiles


def _value_counts(df: DataFrame, keys: list[str], value: str, counts: dict[str, Column], block: Column) -> DataFrame:
    """Distinct values with their counts and the counts of all smaller values."""
    v = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    return running_before(v, keys, [block], [F.col(value)], {f"before_{n}": F.col(n) for n in counts})


def auroc(scores: DataFrame, score: str, positive: str, block: Column | None = None) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half. Scores are counted per distinct value, so ties
    vanish before the shuffle, and compared through running counts over blocks of the score axis."""
    one = scores.withColumn("_k", F.lit(1))
    block = block if block is not None else F.floor(F.col(score) * BLOCKS)
    c = _value_counts(one, ["_k"], score, {"pos": F.col(positive).cast("long"), "neg": (~F.col(positive)).cast("long")}, block)
    wins = F.col("pos") * (F.coalesce("before_neg", F.lit(0)) + F.col("neg") / 2.0)
    return c.agg((F.sum(wins) / (F.sum("pos") * F.sum("neg"))).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], block: Column | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key and q, over any number of rows."""
    base = df if keys else df.withColumn("_k", F.lit(1))
    ks = keys or ["_k"]
    block = block if block is not None else F.floor(F.col(value) * BLOCKS)
    c = _value_counts(base, ks, value, {"n": F.lit(1)}, block).withColumn("lo", F.coalesce("before_n", F.lit(0)))
    totals = c.groupBy(*ks).agg(F.sum("n").alias("total"))
    at = totals.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("h", F.col("q") * (F.col("total") - 1))
    hits = c.join(F.broadcast(at) if not keys else at, ks).filter(
        ((F.col("lo") <= F.floor("h")) & (F.floor("h") < F.col("lo") + F.col("n")))
        | ((F.col("lo") <= F.ceil("h")) & (F.ceil("h") < F.col("lo") + F.col("n"))))
    ends = hits.groupBy(*ks, "q", "h").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return ends.select(*keys, "q", (F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a"))).alias("value"))


def detection_at_fpr(scores: DataFrame, fpr: float = 0.05) -> DataFrame:
    """Rows (score, kind) with kind 'control' or a positive type: detection rate of each type above the
    score that all but ``fpr`` of the controls stay under."""
    thr = quantiles(scores.filter("kind = 'control'"), [], "score", [1.0 - fpr]).agg(F.max("value")).scalar()
    return (scores.withColumn("threshold", thr).groupBy("kind")
            .agg(F.count("*").alias("n"), F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("rate"),
                 F.max("threshold").alias("threshold")))


def latency_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    base = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    q = quantiles(df, [by], value, [0.5, 0.95], F.floor(F.col(value) * 64.0))
    p = q.groupBy(by).agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"),
                          F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    return base.join(p, by)


# ---------------------------------------------------------------- resampling


#: Chances of up to k draws of a Poisson variable with mean one, as the first 12 digits of a hash.
POISSON = [f"{int(2**48 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))):012x}" for k in range(13)]


SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
ONE_BLOCK, TOGETHER = 55, 16  # longest text of one md5 block; clusters worked on together


def md5_heads(texts: np.ndarray) -> np.ndarray:
    """The first 48 bits of the md5 of each row of bytes; rows are of one length, of one block at most."""
    many, size = texts.shape
    block = np.zeros((many, 64), np.uint8)
    block[:, :size] = texts
    block[:, size] = 128
    block[:, 56:58] = [size * 8 % 256, size * 8 // 256]
    words = np.ascontiguousarray(block.view("<u4").T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(many, x, np.uint32) for x in start)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, at = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[at]
        f += np.uint32(SINES[i])
        n = SHIFTS[turn, i % 4]
        a, d, c, b = d, c, b, b + ((f << n) | (f >> (np.uint32(32) - n)))
    head, tail = (a + start[0]).byteswap().astype(np.uint64), (b + start[1]).byteswap().astype(np.uint64)
    return (head << np.uint64(16)) | (tail >> np.uint64(16))


def weights_of(clusters: list[str], n_boot: int, seed: int) -> np.ndarray:
    """How often each replicate (column) draws each cluster (row)."""
    heads = np.zeros((len(clusters), n_boot), np.uint64)
    names = [c.encode() for c in clusters]
    starts: dict[int, list[int]] = {}
    for b in range(n_boot):
        starts.setdefault(len(f"{seed}|{b}"), []).append(b)
    for size, bs in starts.items():
        first = np.frombuffer("".join(f"{seed}|{b}" for b in bs).encode(), np.uint8).reshape(len(bs), size)
        for n in {len(x) for x in names}:
            which = [i for i, x in enumerate(names) if len(x) == n]
            if size + n > ONE_BLOCK:
                for i in which:
                    heads[i, bs] = [int.from_bytes(hashlib.md5(f.tobytes() + names[i]).digest()[:6], "big") for f in first]
                continue
            texts = np.empty((len(which), len(bs), size + n), np.uint8)
            texts[:, :, :size] = first
            texts[:, :, size:] = np.frombuffer(b"".join(names[i] for i in which), np.uint8).reshape(len(which), 1, n)
            heads[np.ix_(which, bs)] = md5_heads(texts.reshape(-1, size + n)).reshape(len(which), len(bs))
    return np.searchsorted(np.array([int(t, 16) for t in POISSON], np.uint64), heads, side="right").astype(float)


def replicate_sums(parts: DataFrame, keys: list[str], by: list[str], cols: list[str], n_boot: int, seed: int = 0) -> DataFrame:
    """Per ``by`` and replicate ``b`` that draws any of its clusters, the sums of ``cols`` over the drawn clusters (rows of equal
    ``keys``), each as often as it is drawn: a Poisson variable with mean one that is a hash of (seed, b, cluster), so any engine
    repeats it. A cluster's rows stay together and are drawn once for all of them; a task adds up by replicate before anything is
    shuffled."""
    text = F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in keys])
    row = F.struct(*[F.col(c) for c in by], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    d = deal(parts.groupBy(*keys).agg(F.collect_list(row).alias("_rows")).select(text.alias("_text"), "_rows"), "_text")
    schema = parts.select(*by, F.lit(0).alias("b"), *[F.lit(None).cast("double").alias(c) for c in cols]).schema
    types = [to_arrow_type(schema[c].dataType) for c in by]

    def out(found):
        for key, sums in found.items():
            drawn = np.flatnonzero(sums[:, -1] > 0)
            got = sums[drawn]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k] * len(drawn), t) for k, t in zip(key, types, strict=True)), pa.array(drawn.astype(np.int32)),
                 *(pa.array(got[:, i], pa.float64(), mask=got[:, len(cols) + i] == 0) for i in range(len(cols)))], names=schema.names)

    def run(batches):
        found: dict[tuple, np.ndarray] = {}
        for b in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
            w = weights_of(b.column(0).to_pylist(), n_boot, seed)
            owner, rows = pc.list_parent_indices(b.column(1)).to_numpy(), pc.list_flatten(b.column(1))
            x = [rows.field(len(by) + i) for i in range(len(cols))]
            there = np.stack([*(v.is_valid().to_numpy(zero_copy_only=False) for v in x), np.ones(len(rows), bool)], axis=1).astype(float)
            values = np.concatenate([np.stack([v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in x], axis=1), there], axis=1)
            groups = list(zip(*(rows.field(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * len(rows)
            for key in dict.fromkeys(groups):
                mine = [i for i, g in enumerate(groups) if g == key]
                mw, mv = w[owner[mine]], values[mine]
                if np.isfinite(mv).all():
                    sums = mw.T @ mv
                else:  # what is not drawn does not count, be it infinite
                    sums = np.stack([np.where(mw > 0, mw * mv[:, [i]], 0.0).sum(axis=0) for i in range(mv.shape[1])], axis=1)
                found[key] = found[key] + sums if key in found else sums
            if len(found) > 500:
                yield from out(found)
                found = {}
        yield from out(found)

    return d.mapInArrow(run, schema).groupBy(*by, "b").agg(*[F.sum(c).alias(c) for c in cols])


def bootstrap_ci(df: DataFrame, clusters: list[str], num: Column, den: Column | None = None, by: list[str] | None = None,
                 n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Ratio sum(num)/sum(den) (a mean when den is absent) with a percentile interval over whole clusters."""
    by = by or []
    den = den if den is not None else F.lit(1.0)
    parts = df.groupBy(*clusters, *by).agg(F.sum(num.cast("double")).alias("num"), F.sum(den.cast("double")).alias("den"))
    return interval(parts, clusters, by, n_boot, alpha, seed)


def interval(parts: DataFrame, clusters: list[str], by: list[str], n_boot: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """The same for parts already summed per cluster (num, den)."""
    boot = replicate_sums(parts, clusters, by, ["num", "den"], n_boot, seed).withColumn("x", F.col("num") / F.greatest("den", F.lit(1e-12)))
    ends = boot.groupBy(*by).agg(F.percentile("x", F.lit(alpha / 2)).alias("lo"), F.percentile("x", F.lit(1 - alpha / 2)).alias("hi"))
    point = parts.groupBy(*by).agg((F.sum("num") / F.sum("den")).alias("value"), F.sum("den").alias("n")).filter("n > 0")
    return point.join(ends, by) if by else point.withColumn("_k", F.lit(1)).join(ends.withColumn("_k", F.lit(1)), "_k").drop("_k")


def accuracy_by(preds: DataFrame, bucket: Column, name: str, cluster: list[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    return bootstrap_ci(preds.withColumn(name, bucket), cluster, _hit(), by=[name], n_boot=n_boot, seed=seed)


# ---------------------------------------------------------------- decisions over steps


def previous_value(df: DataFrame, keys: list[str], seq: str, value: str, default, block_rows: int = 65536) -> DataFrame:
    """Add ``previous``: the value at the step before, or ``default``. The last earlier (step, value) is a running
    maximum, so long histories are scanned in blocks."""
    out = running_before(df, keys, [F.floor(F.col(seq) / F.lit(block_rows))], [F.col(seq)],
                         {"_prev": F.struct(F.col(seq).alias("at"), F.col(value).alias("x"))}, fold=F.max)
    return out.withColumn("previous", F.coalesce(F.col("_prev.x"), F.lit(default))).drop("_prev")


def metric_parts(actions: DataFrame, predicates: DataFrame | dict[str, Column] | None = None,
                 events: DataFrame | dict[str, Column] | None = None, event_rows: Column | None = None) -> DataFrame:
    """Every decision metric as per-episode numerator and denominator, in long form (ep, metric, num, den). Predicates and events are
    frames of their own, or the columns that make one of a row of ``actions`` (of ``event_rows`` only, for events): then the actions are
    gone through once for all metrics."""
    def long(df, *sets):
        aggs, found = [], []
        for i, (items, rows) in enumerate(sets):
            aggs.append(F.max(rows).alias(f"_in{i}"))
            for name, num, den in items:
                aggs += [F.sum(F.when(rows, x.cast("double"))).alias(f"{k}_{name}") for k, x in (("n", num), ("d", den))]
                found.append(F.when(F.col(f"_in{i}"), F.struct(
                    F.lit(name).alias("metric"), F.col(f"n_{name}").alias("num"), F.col(f"d_{name}").alias("den"))))
        return df.groupBy("ep").agg(*aggs).select("ep", F.explode(F.array_compact(F.array(*found))).alias("r")).select("ep", "r.*")

    one, every = F.lit(1), F.lit(True)
    wrong, ok = F.col("pred") != F.col("true"), F.col("pred") == F.col("true")
    tc, pc, ready, said = F.col("true_changed"), F.col("pred_changed"), F.col("true") == "READY", F.col("pred") == "READY"
    ch = F.col("ledger_changed")
    of_actions = [
        ("disposition_accuracy", ~wrong, one), ("stale_decision_rate", wrong & tc, tc),
        ("spurious_change_rate", pc & ~tc, ~tc), ("false_ready_rate", said & ~ready, ~ready),
        ("missed_ready_rate", ~said & ready, ready),
        ("success_brier", (F.col("p_success") - F.col("success").cast("double")) ** 2, one)]
    of_predicates = [
        ("status_accuracy", ok, one), ("status_nll", nll_of(F.col("p_true")), one),
        ("status_accuracy_on_change", ok & tc, tc)]
    of_events = [
        ("tokens_per_changed_event", F.col("tokens") * ch.cast("int"), ch),
        ("encodes_per_changed_event", F.col("encodes") * ch.cast("int"), ch),
        ("tokens_per_unchanged_event", F.col("tokens") * (~ch).cast("int"), ~ch)]
    here, sets, others = actions, [(of_actions, every)], []
    for given, items, rows in ((predicates, of_predicates, every), (events, of_events, every if event_rows is None else event_rows)):
        if isinstance(given, dict):
            here = here.withColumns(given)
            sets.append((items, rows))
        elif given is not None:
            others.append(long(given, (items, every)))
    out = long(here, *sets)
    for o in others:
        out = out.unionByName(o)
    return out


def decision_metrics(parts: DataFrame) -> DataFrame:
    return parts.groupBy("metric").agg((F.sum("num") / F.sum("den")).alias("value"), F.sum("den").alias("n")).filter("n > 0")


def summarise(parts: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    return interval(parts, ["ep"], ["metric"], n_boot, seed=seed)


def compare(parts_a: DataFrame, parts_b: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Paired difference of every metric on the same resampled episodes; for costs also the ratio."""
    def whole(parts, name):  # by episode alone: its few metrics lie together already, here and where they are drawn
        return parts.groupBy("ep").agg(F.collect_list(F.struct("metric", "num", "den")).alias(name))

    def both(x, y):
        return F.struct(x.metric, x.num.alias("na"), x.den.alias("da"), y.num.alias("nb"), y.den.alias("db"))

    pairs = F.transform("_a", lambda x: F.transform(F.filter("_b", lambda y: y.metric == x.metric), lambda y: both(x, y)))
    j = whole(parts_a, "_a").join(whole(parts_b, "_b"), "ep").select("ep", F.inline(F.flatten(pairs)))
    tiny = F.lit(1e-12)

    def ratio(n, d):
        return F.sum(F.col(n)) / F.greatest(F.sum(F.col(d)), tiny)

    boot = replicate_sums(j, ["ep"], ["metric"], ["na", "da", "nb", "db"], n_boot, seed).select(
        "metric", (F.col("na") / F.greatest("da", tiny)).alias("a"), (F.col("nb") / F.greatest("db", tiny)).alias("b_"))
    d = F.col("a") - F.col("b_")
    q = F.col("a") / F.greatest(F.col("b_"), tiny)
    ends = boot.groupBy("metric").agg(F.percentile(d, F.lit(0.025)).alias("lo"), F.percentile(d, F.lit(0.975)).alias("hi"),
                                      F.percentile(q, F.lit(0.025)).alias("ratio_lo"), F.percentile(q, F.lit(0.975)).alias("ratio_hi"))
    point = j.groupBy("metric").agg(ratio("na", "da").alias("a"), ratio("nb", "db").alias("b"))
    cost = F.col("metric").rlike("^(tokens|encodes)") & (F.col("b") > 0)
    return point.join(ends, "metric").select(
        "metric", "a", "b", (F.col("a") - F.col("b")).alias("difference"), "lo", "hi", F.when(cost, F.col("a") / F.col("b")).alias("ratio"),
        F.when(cost, F.col("ratio_lo")).alias("ratio_lo"), F.when(cost, F.col("ratio_hi")).alias("ratio_hi"))


def worst_episodes(parts: DataFrame, k: int = 5) -> DataFrame:
    p = parts.filter("metric = 'disposition_accuracy'")
    acc = F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(1.0))
    return p.select("ep", acc.alias("disposition_accuracy"), F.col("den").cast("long").alias("rows")).orderBy(
        "disposition_accuracy", "ep").limit(k)


def threshold_sweep(actions: DataFrame, bars: list[float], n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Rows (ep, s, v, true): false and missed READY rates, with intervals, for every ready bar."""
    e = actions.withColumn("bar", F.explode(F.array(*[F.lit(float(b)) for b in bars])))
    said = S.disposition("s", "v", F.col("bar")) == "READY"
    ready = F.col("true") == "READY"
    parts = e.groupBy("ep", "bar").agg(F.sum((said & ~ready).cast("double")).alias("fn"), F.sum((~ready).cast("double")).alias("fd"),
                                       F.sum((~said & ready).cast("double")).alias("mn"), F.sum(ready.cast("double")).alias("md"))
    long = parts.select("ep", "bar", F.explode(F.array(
        F.struct(F.lit("false_ready_rate").alias("metric"), F.col("fn").alias("num"), F.col("fd").alias("den")),
        F.struct(F.lit("missed_ready_rate").alias("metric"), F.col("mn").alias("num"), F.col("md").alias("den")))).alias("r")).select(
        "ep", "bar", "r.*")
    return interval(long, ["ep"], ["bar", "metric"], n_boot, seed=seed)


def choose_threshold(sweep: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Smallest bar whose upper bound of false READY is at most alpha; otherwise the largest bar."""
    f = sweep.filter("metric = 'false_ready_rate'")
    ok = F.min(F.when(F.col("hi") <= alpha, F.col("bar")))
    return f.agg(F.coalesce(ok, F.max("bar")).alias("chosen"), ok.isNotNull().alias("met_alpha"))


def version_reading_table(cases: DataFrame, kind: str = "kind", status: str = "status", truth: str = "truth") -> DataFrame:
    """Per kind of case: share of each status, share correct, share read satisfied although it is not."""
    names = ("SATISFIED", "VIOLATED", "UNRESOLVED", "CONFLICT")
    return cases.groupBy(kind).agg(
        F.count("*").alias("n"), *[F.avg((F.col(status) == s).cast("double")).alias(s.lower()) for s in names],
        F.avg((F.col(status) == F.col(truth)).cast("double")).alias("correct"),
        F.avg(F.when(F.col(truth) != "SATISFIED", (F.col(status) == "SATISFIED").cast("double"))).alias("unsafe"))


# ---------------------------------------------------------------- fitting


def _nll_at(df: DataFrame, candidates: list[tuple[float, float, float, float]]) -> list[float]:
    """Mean NLL of logits (l0, l1, l2) against label for several (T, b0, b1, b2), in one pass."""
    aggs = []
    for i, (t, *b) in enumerate(candidates):
        z = [F.col(f"l{c}") / t + b[c] for c in range(3)]
        m = F.greatest(*z)
        zy = F.when(F.col("label") == 0, z[0]).when(F.col("label") == 1, z[1]).otherwise(z[2])
        aggs.append(F.avg(F.least(m + F.log(sum(F.exp(x - m) for x in z)) - zy, F.lit(-math.log(1e-12)))).alias(f"c{i}"))
    row = df.agg(*aggs).first()
    return [row[f"c{i}"] for i in range(len(candidates))]


def fit_temperature(df: DataFrame, lo: float = 0.05, hi: float = 20.0, points: int = 17, rounds: int = 5) -> float:
    """Temperature of least NLL. NLL is convex in 1/T, so each pass tries a grid and narrows to the best point's
    neighbours; only the grid's means reach the driver."""
    a, b = math.log(lo), math.log(hi)
    best = 1.0
    for _ in range(rounds):
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]
        scores = _nll_at(df, [(math.exp(g), 0.0, 0.0, 0.0) for g in grid])
        j = min(range(points), key=lambda i: scores[i])
        best, a, b = math.exp(grid[j]), grid[max(0, j - 1)], grid[min(points - 1, j + 1)]
    return best


def fit_rule_calibration(edges: DataFrame, truth: DataFrame, rounds: int = 3) -> tuple[float, tuple[float, float, float], float]:
    """Temperature and class bias that minimise the NLL of predicate statuses *through* the precedence policy.
    Coordinate search; the candidates of a round are rows beside the edges, evaluated in one distributed pass.
    ``edges`` carry logits, ``truth`` (task_id, predicate_id, label 0-3)."""
    from standpoint.operators.beliefs import PRED, precedence

    cur, step, best = [1.0, 0.0, 0.0, 0.0], [0.5, 0.5, 0.5, 0.5], float("inf")
    for _ in range(rounds):
        for axis in range(4):
            tries = []
            for k in (-1, 0, 1):
                c = list(cur)
                c[axis] = c[axis] * math.exp(k * step[0]) if axis == 0 else c[axis] + k * step[axis]
                tries.append(c)
            cand = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(n) for n, v in zip(("t", "b0", "b1", "b2"), c)])
                             for i, c in enumerate(tries)])
            e = edges.withColumn("cand", F.explode(cand))
            z = [F.get("logits", F.lit(j)) / F.col("cand.t") + F.col(f"cand.b{j}") for j in range(3)]
            m = F.greatest(*z)
            ex = [F.exp(x - m) for x in z]
            e = e.select(*PRED, "authority", "valid_from", F.col("cand.i").alias("i"),
                         *[(x / (ex[0] + ex[1] + ex[2])).alias(n) for x, n in zip(ex, ("p_s", "p_r", "p_n"))])
            d = precedence(e, ["i", *PRED]).join(truth, PRED)
            p = F.when(F.col("label") == 0, F.col("s")).when(F.col("label") == 1, F.col("v")).when(F.col("label") == 2, F.col("u")).otherwise(F.col("c"))
            scores = {r["i"]: r["x"] for r in d.groupBy("i").agg(F.avg(nll_of(p)).alias("x")).collect()}
            j = min(scores, key=lambda i: (scores[i], i != 1))
            cur, best = tries[j], scores[j]
        step = [s / 2 for s in step]
    return cur[0], (cur[1], cur[2], cur[3]), best
