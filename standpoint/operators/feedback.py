"""Learning from people: corrections, similar verified readings, an error-tracking bar, and the gate a change of the
reading side must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from standpoint.functions import scalars as S
from standpoint.operators import metrics as M
from standpoint.operators.neighbours import MEMORY_BLOCK, QUERY_BLOCK, search
from standpoint.operators.scan import running_before, skew_join
from standpoint.session import cut_lineage

EXACT_CONFIDENCE = 0.995
TAUS, LAMS = (0.6, 0.7, 0.8, 0.9, 0.95), (0.2, 0.4, 0.6, 0.8, 0.95)


# ---------------------------------------------------------------- corrections


def active_corrections(corrections: DataFrame, retractions: DataFrame) -> DataFrame:
    return corrections.join(retractions.select("item_id").distinct(), "item_id", "left_anti")


def correction_log(corrections: DataFrame, retractions: DataFrame) -> DataFrame:
    """The verified label in force per pair: the latest item not retracted, so retracting one restores the one before."""
    rest = [c for c in corrections.columns if c not in ("pair", "item_id")]
    latest = active_corrections(corrections, retractions).groupBy("pair").agg(
        F.max("item_id").alias("item_id"), F.max_by(F.struct(*rest), "item_id").alias("x"))
    return latest.select("pair", "item_id", "x.*")


def apply_corrections(edges: DataFrame, verified: DataFrame, confidence: float = EXACT_CONFIDENCE) -> DataFrame:
    """A pair a person has verified is read as they said, whatever the model says."""
    v = verified.select("pair", F.col("label").alias("_lab"))
    j = skew_join(edges, v, ["pair"], how="left")

    def fixed(i, name):
        return F.when(F.col("_lab").isNull(), F.col(name)).when(F.col("_lab") == i, F.lit(confidence)).otherwise(
            F.lit((1.0 - confidence) / 2.0))

    return j.withColumns({"p_s": fixed(0, "p_s"), "p_r": fixed(1, "p_r"), "p_n": fixed(2, "p_n"),
                          "corrected": F.col("_lab").isNotNull()}).drop("_lab")


def feedback_readings(verified: DataFrame, audit: DataFrame) -> DataFrame:
    """Verified pairs with the logits that were logged when each was corrected (item_id, logits)."""
    return verified.join(audit.select("item_id", "logits"), "item_id").select("pair", "item_id", "label", "logits")


def export_feedback(verified_items: DataFrame, audit: DataFrame, records: DataFrame, predicates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claim, evidence, label, page) of corrections whose record still says what was corrected, the latest per text
    pair, and a one-row count of kept and skipped. ``audit``: (item_id, task_id, record_id, predicate_id)."""
    claims = predicates.select("task_id", "predicate_id", F.col("text").alias("claim"))
    texts = records.select("task_id", "record_id", F.col("text").alias("evidence"))
    j = (audit.join(verified_items.select("item_id", "pair", "label"), "item_id")
         .join(claims, ["task_id", "predicate_id"], "left").join(texts, ["task_id", "record_id"], "left")
         .withColumn("_ok", F.coalesce(S.pair_key("claim", "evidence") == F.col("pair"), F.lit(False))))
    rows = j.filter("_ok").groupBy("claim", "evidence").agg(F.max_by(F.struct(
        "label", F.concat("task_id", F.lit(":"), "record_id").alias("page")), "item_id").alias("x")).select("claim", "evidence", "x.*")
    counts = j.agg(F.countDistinct(F.when(F.col("_ok"), F.struct("claim", "evidence"))).alias("rows"),
                   F.sum((~F.col("_ok")).cast("long")).alias("skipped"))
    return rows, counts


# ---------------------------------------------------------------- similar verified pairs


def top_neighbours(queries: DataFrame, memory: DataFrame, k: int = 8, exclude_self: bool = False, least: float = -1.0,
                   query_block: int = QUERY_BLOCK, memory_block: int = MEMORY_BLOCK) -> DataFrame:
    """The k most similar memory items of each query: (qid, item_id, label, sim). Vectors (``vec``) have unit length. Exact
    for all similarities of ``least`` or more; a query meets only the parts of the memory that can hold one."""
    return search(queries, memory, k, exclude_self, least, query_block, memory_block)[0]


def _weight(tau) -> Column:
    tau = tau if isinstance(tau, Column) else F.lit(float(tau))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sim") - tau) / F.greatest(F.lit(1e-9), 1.0 - tau)))


def _votes(neighbours: DataFrame, keys: list[str], tau, lam_max) -> DataFrame:
    """Per query: label shares of its neighbours, how much they may move its reading, how many count."""
    lam = lam_max if isinstance(lam_max, Column) else F.lit(float(lam_max))
    w = neighbours.withColumn("w", _weight(tau))
    total = F.sum("w")
    return w.groupBy(*keys).agg(
        F.sum((F.col("w") > 0).cast("int")).alias("votes"), total.alias("wsum"),
        *[F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(F.lit(0.0))).alias(f"y{c}") for c in range(3)],
        (F.max(lam) * (1.0 - F.product(1.0 - F.col("w")))).alias("lam"))


def _blended(name: str, c: int, min_votes: int) -> Column:
    ok = (F.col("votes") >= min_votes) & (F.col("wsum") > 0)
    return F.when(ok, (1.0 - F.col("lam")) * F.col(name) + F.col("lam") * F.col(f"y{c}") / F.greatest(F.col("wsum"), F.lit(1e-12))).otherwise(F.col(name))


def knn_blend(queries: DataFrame, memory: DataFrame, k: int = 8, tau: float = 0.8, lam_max: float = 0.0, min_votes: int = 1,
              exclude_self: bool = False, neighbours: DataFrame | None = None) -> DataFrame:
    """Pull readings (qid, vec, p_s, p_r, p_n) toward the labels of similar verified pairs. With ``lam_max`` of zero, the
    starting value, nothing is compared at all: generalising has to be earned at the gate first."""
    if lam_max <= 0:
        return queries.withColumn("touched", F.lit(False))
    # what is no more similar than tau has no weight
    near = neighbours if neighbours is not None else top_neighbours(queries, memory, k, exclude_self, least=tau)
    v = _votes(near, ["qid"], tau, lam_max)
    j = queries.join(v, "qid", "left").withColumns({"votes": F.coalesce("votes", F.lit(0)), "wsum": F.coalesce("wsum", F.lit(0.0))})
    new = {n: _blended(n, c, min_votes) for c, n in enumerate(("p_s", "p_r", "p_n"))}
    j = j.withColumn("touched", (F.col("votes") >= min_votes) & (F.col("wsum") > 0)).withColumns(new)
    total = F.col("p_s") + F.col("p_r") + F.col("p_n")
    return (j.withColumn("_t", total).withColumns({n: F.col(n) / F.col("_t") for n in new})
            .drop("_t", "votes", "wsum", "y0", "y1", "y2", "lam"))


def evolving_edges(edges: DataFrame, memory: DataFrame, verified: DataFrame, vectors: DataFrame | None = None, **knn) -> DataFrame:
    """Readings as the engine uses them: calibrated, pulled toward similar verified pairs, exact where verified.
    ``edges`` carry ``pair``, and ``vec`` unless ``vectors`` (pair, vec) has one row a pair; each distinct pair is compared once."""
    if knn.get("lam_max", 0.0) > 0:
        q = edges.groupBy("pair").agg(*[F.min(c).alias(c) for c in ("p_s", "p_r", "p_n")],
                                      *([F.min("vec").alias("vec")] if vectors is None else []))
        q = q if vectors is None else q.join(vectors, "pair", "left")
        moved = knn_blend(q.withColumnRenamed("pair", "qid"), memory, **knn).select(
            F.col("qid").alias("pair"), "p_s", "p_r", "p_n")
        edges = skew_join(edges.drop("p_s", "p_r", "p_n"), moved, ["pair"])
    return apply_corrections(edges, verified)


# ---------------------------------------------------------------- the readiness bar


def threshold_trace(log: DataFrame, alpha: float = 0.05, eta: float = 0.05, tau0: float = 0.9, block_rows: int = 65536) -> DataFrame:
    """State of the bar after each logged endorsement or verdict (workspace, seq, kind, wrong).

    A verdict that finds nothing outstanding is refused. With S the running count of endorsements less
    verdicts, the number refused so far is how far S has ever fallen below zero, so refusals need only
    running sums and minima, and everything after them only running sums and maxima."""
    key, block, order = ["workspace"], [F.floor(F.col("seq") / F.lit(block_rows))], [F.col("seq")]
    step = F.when(F.col("kind") == "endorsement", 1).otherwise(-1)
    a = log.withColumn("_d", step)
    a = running_before(a, key, block, order, {"_s0": F.col("_d")})
    a = cut_lineage(a.withColumn("_s", F.coalesce("_s0", F.lit(0)) + F.col("_d")))
    a = running_before(a, key, block, order, {"_m0": F.col("_s")}, fold=F.min)
    zero = F.lit(0)
    low0, low = F.least(zero, F.coalesce("_m0", zero)), F.least(zero, F.coalesce("_m0", zero), F.col("_s"))
    a = a.withColumn("accepted", low == low0).withColumn("outstanding", F.col("_s") - low)
    a = cut_lineage(a.select(*log.columns, "accepted", "outstanding"))
    ok = F.col("accepted") & (F.col("kind") == "verdict")
    v, e = ok.cast("int"), (ok & F.col("wrong")).cast("int")
    sums = running_before(a, key, block, order, {"_v": v, "_e": e})
    sums = sums.withColumn("verdicts", F.coalesce("_v", zero) + v).withColumn("errors", F.coalesce("_e", zero) + e).drop("_v", "_e")
    peak = running_before(a.select("workspace", "seq", "outstanding"), key, block, order, {"_x": F.col("outstanding")}, fold=F.max)
    peak = peak.select("workspace", "seq", F.greatest(F.lit(1), F.coalesce("_x", zero), F.col("outstanding")).alias("max_outstanding"))
    out = sums.join(peak, ["workspace", "seq"])
    tau = F.lit(tau0) + F.lit(eta) * (F.col("errors") - F.lit(alpha) * F.col("verdicts"))
    slack = 1.0 + F.col("max_outstanding") * (eta * (1.0 - alpha)) - tau0
    return out.select(*log.columns, "accepted", "verdicts", "errors", "outstanding", "max_outstanding", tau.alias("tau"),
                      F.when(F.col("verdicts") > 0, F.col("errors") / F.col("verdicts")).otherwise(F.lit(0.0)).alias("error_rate"),
                      F.when(F.col("verdicts") == 0, F.lit(1.0)).otherwise(
                          F.least(F.lit(1.0), alpha + slack / (eta * F.col("verdicts")))).alias("bound"),
                      (tau > 1.0).alias("stalled"))


# ---------------------------------------------------------------- the gate


def tune_memory(fit: DataFrame, k: int = 8, taus=TAUS, lams=LAMS, min_votes: int = 1) -> DataFrame:
    """Leave-one-out NLL of every (tau, lam_max) over verified items (qid, vec, label, p_s, p_r, p_n), beside the NLL
    without memory; ``adopt`` marks the first best setting if it is better at all. Neighbours are found once."""
    memory = fit.select(F.col("qid").alias("item_id"), "label", "vec")
    near = cut_lineage(top_neighbours(fit, memory, k, exclude_self=True, least=min(taus)))
    grid = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(float(t)).alias("tau"), F.lit(float(lam)).alias("lam_max"))
                     for i, (t, lam) in enumerate((t, lam) for t in taus for lam in lams)])
    n = near.withColumn("c", F.explode(grid)).select("qid", "label", "sim", "c.*")
    v = _votes(n, ["g", "qid"], F.col("tau"), F.col("lam_max"))
    base = fit.select("qid", F.col("label").alias("truth"), "p_s", "p_r", "p_n")
    j = base.withColumn("c", F.explode(grid)).select("qid", "truth", "p_s", "p_r", "p_n", "c.*").join(v, ["g", "qid"], "left").withColumns(
        {"votes": F.coalesce("votes", F.lit(0)), "wsum": F.coalesce("wsum", F.lit(0.0))})
    p = [_blended(nm, c, min_votes) for c, nm in enumerate(("p_s", "p_r", "p_n"))]
    pick = lambda xs: F.when(F.col("truth") == 0, xs[0]).when(F.col("truth") == 1, xs[1]).otherwise(xs[2])
    scored = j.groupBy("g", "tau", "lam_max").agg(
        F.avg(M.nll_of(pick(p) / (p[0] + p[1] + p[2]))).alias("loo_nll"),
        F.avg(M.nll_of(pick([F.col("p_s"), F.col("p_r"), F.col("p_n")]))).alias("no_memory_nll"),
        F.avg(((F.col("votes") >= min_votes) & (F.col("wsum") > 0)).cast("double")).alias("touched"))
    everywhere = W.partitionBy(F.lit(1))  # the grid only: 25 rows
    best = F.min(F.round("loo_nll", 9)).over(everywhere)
    first = F.min(F.when(F.round("loo_nll", 9) == F.col("_best"), F.col("g"))).over(everywhere)
    return (scored.withColumn("_best", best).withColumn("_first", first)
            .withColumn("adopt", (F.col("g") == F.col("_first")) & (F.col("loo_nll") < F.col("no_memory_nll") - 1e-9))
            .drop("_best", "_first", "g"))


def regression_gate(champion: DataFrame, candidates: DataFrame, max_accuracy_drop: float = 0.005, max_nll_rise: float = 0.01,
                    max_negative_flip_rate: float | None = None) -> DataFrame:
    """Per candidate and suite: change in accuracy and NLL against the champion, readings newly got wrong, pass or not.
    ``champion``: (suite, item, label, p0, p1, p2); ``candidates`` also name the candidate."""
    hit = M._hit()
    loss = M.nll_of(M.p_of_label())
    a = champion.select("suite", "item", hit.alias("h0"), loss.alias("n0"))
    b = candidates.select("candidate", "suite", "item", hit.alias("h1"), loss.alias("n1"))
    g = b.join(a, ["suite", "item"]).groupBy("candidate", "suite").agg(
        F.count("*").alias("n"), F.avg("h1").alias("accuracy"), F.avg("n1").alias("nll"),
        (F.avg("h0") - F.avg("h1")).alias("accuracy_drop"), (F.avg("n1") - F.avg("n0")).alias("nll_rise"),
        F.sum(((F.col("h0") == 1) & (F.col("h1") == 0)).cast("long")).alias("negative_flips"))
    rate = F.col("negative_flips") / F.greatest(F.lit(1), F.col("n"))
    good = (F.col("accuracy_drop") <= max_accuracy_drop) & (F.col("nll_rise") <= max_nll_rise)
    if max_negative_flip_rate is not None:
        good = good & (rate <= max_negative_flip_rate)
    return g.withColumn("negative_flip_rate", rate).withColumn("passes", good)


def paired_gain(champion: DataFrame, candidates: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Mean NLL gained on held-out items per candidate, with its interval over resampled items."""
    loss = M.nll_of(M.p_of_label())
    a = champion.select("item", loss.alias("n0"))
    b = candidates.select("candidate", "item", loss.alias("n1"))
    d = b.join(a, "item").withColumn("gain", F.col("n0") - F.col("n1"))
    return M.bootstrap_ci(d, ["item"], F.col("gain"), by=["candidate"], n_boot=n_boot, seed=seed).withColumnRenamed("value", "gain")


def choose_candidate(gate: DataFrame, gain: DataFrame, holdout: DataFrame, n_feedback: int | Column, n_fit: int | Column,
                     n_held: int | Column, min_gain: float = 0.0, min_feedback: int = 200, min_side: int = 30) -> DataFrame:
    """The passing candidate with the least held-out NLL (candidate, nll), or the champion with the reasons."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    g = gate.groupBy("candidate").agg(F.min("passes").alias("ok"), F.array_join(F.sort_array(
        F.collect_set(F.when(~F.col("passes"), F.col("suite")))), ", ").alias("bad"))
    j = g.join(gain.select("candidate", "gain", "lo"), "candidate").join(holdout, "candidate")
    passing = F.col("ok") & (F.col("lo") > min_gain)
    why = F.when(~F.col("ok"), F.concat("candidate", F.lit(": fails regression on "), "bad")).when(
        ~(F.col("lo") > min_gain), F.concat("candidate", F.lit(": no reliable held-out gain (lower bound "), F.format_string("%.4f", "lo"), F.lit(")")))
    r = j.agg(F.min_by("candidate", F.when(passing, F.struct("nll", "candidate"))).alias("best"), F.max(passing.cast("int")).alias("any"),
              F.array_join(F.sort_array(F.collect_set(why)), "; ").alias("why"))
    few, side = c(n_feedback) < min_feedback, (c(n_fit) < min_side) | (c(n_held) < min_side)
    adopted = ~few & ~side & (F.col("any") == 1)
    return r.select(adopted.alias("adopted"), F.when(adopted, F.col("best")).otherwise(F.lit("champion")).alias("chosen"),
                    F.when(few, F.concat(F.lit("only "), c(n_feedback).cast("string"), F.lit(f" verified readings; {min_feedback} are required")))
                    .when(side, F.lit("too few readings on one side of the split"))
                    .when(adopted, F.lit("passed the regression gate and improved held-out NLL")).otherwise(F.col("why")).alias("reason"))


def set_suite_scores(statuses: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Status accuracy and NLL over whole reading sets: distributions (s, v, u, c) against labels 0-3. A set nothing
    was read for is unresolved."""
    j = labels.join(statuses, keys, "left").withColumns({"s": F.coalesce("s", F.lit(0.0)), "v": F.coalesce("v", F.lit(0.0)),
                                                         "u": F.coalesce("u", F.lit(1.0)), "c": F.coalesce("c", F.lit(0.0))})
    names = F.array(*[F.lit(x) for x in ("SATISFIED", "VIOLATED", "UNRESOLVED", "CONFLICT")])
    truth = F.element_at(names, F.col("label") + 1)
    p = F.when(F.col("label") == 0, F.col("s")).when(F.col("label") == 1, F.col("v")).when(F.col("label") == 2, F.col("u")).otherwise(F.col("c"))
    return j.agg(F.count("*").alias("n"), F.avg((S.status_name() == truth).cast("double")).alias("accuracy"), F.avg(M.nll_of(p)).alias("nll"))


# ---------------------------------------------------------------- link calibration


def crc_threshold(miss: DataFrame, alpha: float) -> DataFrame:
    """Largest threshold whose corrected mean miss rate over calibration tasks is at most alpha (task_id, threshold,
    miss); minus infinity when none is feasible."""
    r = miss.groupBy("threshold").agg(F.avg("miss").alias("mean"), F.count("*").alias("n"))
    corrected = F.col("n") / (F.col("n") + 1.0) * F.col("mean") + 1.0 / (F.col("n") + 1.0)
    ok = F.max(F.when(F.col("corrected") <= alpha, F.struct("threshold", "corrected", "mean")))
    return r.withColumn("corrected", corrected).agg(ok.alias("b"), F.min_by("corrected", "threshold").alias("first"), F.max("n").alias("n")).select(
        F.coalesce("b.threshold", F.lit(float("-inf"))).alias("threshold"), F.col("b").isNotNull().alias("feasible"),
        F.coalesce("b.corrected", "first").alias("corrected_risk"), F.col("b.mean").alias("empirical_risk"), "n")


def miss_by_threshold(sims: DataFrame, thresholds: list[float], keys: tuple = ("task_id",)) -> DataFrame:
    """Per task with true links and per threshold: share of true links missed and of all pairs kept. ``sims`` are pairs (sim, linked),
    or the counts of ``links.count_links`` at these thresholds."""
    if "above" in sims.columns:
        return (sims.filter(F.col("threshold").isin([float(x) for x in thresholds]))
                .select(*keys, "threshold", F.try_divide("missed", "true").alias("miss"), F.try_divide("above", "pairs").alias("kept")).filter("miss is not null"))
    t = sims.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return t.groupBy(*keys, "threshold").agg(
        F.avg(F.when(F.col("linked"), (F.col("sim") < F.col("threshold")).cast("double"))).alias("miss"),
        F.avg((F.col("sim") >= F.col("threshold")).cast("double")).alias("kept")).filter("miss is not null")


def calibrate_links(sims: DataFrame, alpha: float = 0.05, thresholds: list[float] | None = None, keys: tuple = ("task_id",)) -> DataFrame:
    ts = thresholds or [-0.2 + 1.1 * i / 220 for i in range(221)]
    m = cut_lineage(miss_by_threshold(sims, ts, keys))
    kept = m.groupBy("threshold").agg(F.avg("kept").alias("fraction_of_pairs_kept"))
    return crc_threshold(m, alpha).join(kept, "threshold", "left")


# ---------------------------------------------------------------- confirmations and quotas


def confirmations_to_events(answers: DataFrame, predicates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answered requests become one event naming its predicate, and one exact correction. Only the first yes/no answer
    given before the request expired counts, and only if the predicate still reads as it was asked.
    ``answers``: token, task_id, predicate_id, predicate_text, to_name, authority, expires, answer, note, answered."""
    first = answers.groupBy("token").agg(F.min_by(F.struct(*[c for c in answers.columns if c != "token"]), "answered").alias("x")).select("token", "x.*")
    live = first.filter(F.col("answer").isin("yes", "no") & (F.col("answered") <= F.col("expires")))
    now = predicates.select("task_id", "predicate_id", F.col("text").alias("predicate_text"))
    j = live.join(now, ["task_id", "predicate_id", "predicate_text"])
    holds = F.col("answer") == "yes"
    ev = j.select("task_id", F.concat(F.lit("confirmation-"), F.sha2("token", 256)).alias("record_id"), F.lit(1).alias("revision"),
                  S.confirmation_text("to_name", "predicate_text", holds, "note").alias("text"),
                  F.concat(F.lit("confirmation:"), "to_name").alias("source_id"), "authority", F.col("answered").alias("valid_from"),
                  F.lit(None).cast("double").alias("valid_until"), F.array("predicate_id").alias("about"))
    fix = j.select("task_id", F.concat(F.lit("confirmation-"), F.sha2("token", 256)).alias("record_id"), "predicate_id",
                   S.pair_key("predicate_text", S.confirmation_text("to_name", "predicate_text", holds, "note")).alias("pair"),
                   F.when(holds, 0).otherwise(1).alias("label"))
    return ev, fix


def open_confirmations(requests: DataFrame, now: float, quota: int) -> DataFrame:
    live = F.col("answer").isNull() & (F.col("expires") > now)
    return requests.groupBy("workspace").agg(F.sum(live.cast("long")).alias("open")).withColumn("over_quota", F.col("open") > quota)


def usage_by_day(events: DataFrame, max_events: int, max_chars: int, block_rows: int = 65536) -> DataFrame:
    """Rows (workspace, day, seq, chars) with the day's running use and whether a row passes a limit."""
    key = ["workspace", "day"]
    u = running_before(events, key, [F.floor(F.col("seq") / F.lit(block_rows))], [F.col("seq")],
                       {"_n": F.lit(1), "_c": F.col("chars")})
    u = u.withColumn("events_used", F.coalesce("_n", F.lit(0)) + 1).withColumn("chars_used", F.coalesce("_c", F.lit(0)) + F.col("chars"))
    return u.drop("_n", "_c").withColumn("refused", (F.col("events_used") > max_events) | (F.col("chars_used") > max_chars))


def prequential_eval(readings: DataFrame, blocks: int, k: int = 8, tau: float = 0.8, **knn) -> DataFrame:
    """Accuracy over time of a frozen reading and of one helped by the verified items of earlier blocks.
    ``readings``: (qid, seq, vec, label, p_s, p_r, p_n). One search serves all blocks: a reading finds its nearest among the
    items of earlier blocks only."""
    lo, hi = readings.agg(F.min("seq"), F.max("seq")).first()
    if lo is None:
        return readings.sparkSession.createDataFrame([], "block int, n long, frozen double, with_memory double, touched double")
    width = (hi - lo + 1) / blocks
    r = cut_lineage(readings.withColumn("turn", F.least(F.lit(blocks - 1), F.floor((F.col("seq") - lo) / width)).cast("long")))
    past = r.select(F.col("qid").alias("item_id"), "label", "vec", "turn")
    near = search(r, past, k, least=tau)[0] if knn.get("lam_max", 0.0) > 0 else None
    helped = knn_blend(r, past, k, tau, neighbours=near, **knn).select("qid", S.top_label().alias("_h"), "touched")
    j = r.select("qid", "turn", "label", S.top_label().alias("_f")).join(helped, "qid")
    return j.groupBy(F.col("turn").cast("int").alias("block")).agg(
        F.count("*").alias("n"), F.avg((F.col("_f") == F.col("label")).cast("double")).alias("frozen"),
        F.avg((F.col("_h") == F.col("label")).cast("double")).alias("with_memory"), F.avg(F.col("touched").cast("double")).alias("touched"))
