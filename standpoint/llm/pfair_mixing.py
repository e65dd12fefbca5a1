"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in the order of a hash of their id, are cut into blocks of ``block`` documents. Target weights are
positive integers ``a_s``: in every frame of ``F = sum a_s`` slots source ``s`` gets ``a_s`` blocks. Block ``j`` of a frame has
the release time ``floor(j * F / a_s)`` and the deadline ``ceil((j + 1) * F / a_s)``, and earliest-deadline-first (ties: the first
source by name) gives one released block to each slot. Every block is then inside its window, so after any number of slots
each source is within less than one block of its share. Frames are alike as long as no source has run out, so a schedule is
computed per distinct composition of a frame only (at most two for each source and one more), whatever the number of blocks.
When a source runs out, later frames hold the remaining ones in their own proportions; no document is dropped or repeated.

Document positions within a source come from counts per (source, hash bucket) added up over buckets, so no source passes
through one task, however large; ``per_bucket`` documents a bucket bound what one window sorts.

Without given weights the targets are the sources' sizes raised to ``TEMPER``, scaled to about ``SLOTS`` slots a frame.

Defined cases: a null source is a source of its own, first by name; sources without a given weight get weight 1; null ids and
repeated rows are documents like others (equal rows may swap places); empty tables give empty results; other columns stay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standpoint.llm.common import fresh
from standpoint.session import cut_lineage

BLOCK, TEMPER, SLOTS, PER_BUCKET = 64, 0.5, 100, 2_000


def source_sizes(docs: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """(source, n_docs, weight): one row per source."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is not None:
        chosen = F.lit(1)
        for name, w in weights.items():
            if int(w) != w or w < 1:
                raise ValueError(f"the weight of {name!r} is not a positive integer: {w}")
            chosen = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(int(w))).otherwise(chosen)
        return sizes.withColumn("weight", chosen.cast("long"))
    total = sizes.agg(F.sum(F.pow("n_docs", F.lit(TEMPER))).alias("total"))
    scaled = F.greatest(F.lit(1), F.round(F.lit(SLOTS) * F.pow("n_docs", F.lit(TEMPER)) / F.col("total")))
    return sizes.join(F.broadcast(total)).withColumn("weight", scaled.cast("long")).drop("total")


def schedule(content: Column) -> Column:
    """Slots of one frame. ``content``: array of (name, n) with n > 0, in the order of ties. Returns an array of
    (name, j) in slot order: a fold over the slots whose state is how many blocks of each source were placed."""
    width = F.aggregate(content, F.lit(0).cast("long"), lambda a, x: a + x.n)

    def place(n_slots: Column) -> Column:
        def step(state: Column, slot: Column) -> Column:
            ready = F.transform(content, lambda x, i: F.struct(
                F.when((F.get(state.placed, i) < x.n) & (F.floor(F.get(state.placed, i) * n_slots / x.n) <= slot),
                       F.ceil((F.get(state.placed, i) + 1) * n_slots / x.n)).otherwise(F.lit(2**62)).alias("deadline"), i.alias("i")))
            best = F.array_min(ready).i
            return F.struct(
                F.transform(state.placed, lambda p, i: p + F.when(i == best, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("placed"),
                F.concat(state.out, F.array(F.struct(F.get(content, best)["name"].alias("name"), F.get(state.placed, best).alias("j")))).alias("out"))

        start = F.struct(F.transform(content, lambda x: F.lit(0).cast("long")).alias("placed"), F.array().cast("array<struct<name:string,j:bigint>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), n_slots - 1), start, step, lambda s: s.out)

    return F.transform(F.array(width), place).getItem(0)


def frames(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, first_frame, last_frame, first_slot, frame_slots, j, slot): what slot of a frame block ``j`` of a source has, for
    runs of frames with one composition. ``sizes``: one row per source, so everything here is small."""
    s = sizes.select("source", "weight", F.ceil(F.col("n_docs") / block).cast("long").alias("n"))
    s = s.withColumn("full", F.floor(F.col("n") / F.col("weight"))).withColumn("rest", F.col("n") % F.col("weight"))
    cuts = s.select("full").union(s.where("rest > 0").select(F.col("full") + 1)).union(s.select(F.lit(0).cast("long"))).distinct()
    order = Window.partitionBy(F.lit(1)).orderBy("full")
    earlier = Window.partitionBy(F.lit(1)).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    runs = cuts.select(F.col("full").alias("first"), F.lead("full").over(order).alias("next")).where("next IS NOT NULL")
    parts = (runs.join(s, (F.col("first") < F.col("full")) | ((F.col("first") == F.col("full")) & (F.col("rest") > 0)))
             .withColumn("c", F.when(F.col("first") < F.col("full"), F.col("weight")).otherwise(F.col("rest"))))
    runs = (parts.groupBy("first", "next").agg(
        F.sort_array(F.collect_list(F.struct(F.col("source").alias("name"), F.col("c").alias("n")))).alias("content"), F.sum("c").alias("frame_slots"))
        .withColumn("before", F.coalesce(F.sum((F.col("next") - F.col("first")) * F.col("frame_slots")).over(earlier), F.lit(0))))
    slots = runs.select("first", "next", "frame_slots", "before", F.posexplode(schedule(F.col("content"))).alias("slot", "x"))
    return slots.select(F.col("x.name").alias("source"), "first", "next", "frame_slots", "before", F.col("x.j").alias("j"), F.col("slot").cast("long").alias("slot"))


def named(source: Column) -> Column:
    """A source as a key that is never null, so that ranking and joins share one distribution; null sorts first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, block: int = BLOCK, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``docs`` with ``mix_block`` (of its source), ``mix_slot`` (of the mixture) and ``mix_row`` (in the block). Sorting by
    slot and row reads the mixture; other columns keep their names, clashing ones make the new names start with ``_``."""
    (out_block, out_slot, out_row, key, bucket, rank, source, offset, weight, first, following, width, before, j, place) = fresh(
        docs.columns, "mix_block", "mix_slot", "mix_row", "mx_key", "mx_bucket", "mx_rank", "mx_source", "mx_offset", "mx_weight",
        "mx_first", "mx_next", "mx_width", "mx_before", "mx_j", "mx_place")
    sizes = cut_lineage(source_sizes(docs, weights))
    top = sizes.agg(F.max("n_docs")).first()[0] or 0
    buckets = max(1, -(-top // per_bucket))
    d = (docs.withColumn(source, named(F.col("source"))).withColumn(key, F.xxhash64(F.col("doc_id").cast("string")))
         .withColumn(bucket, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("long")))
    counted = d.groupBy(source, bucket).agg(F.count("*").alias("n"))
    offsets = counted.select(source, bucket, F.coalesce(F.sum("n").over(
        Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(offset))
    known = sizes.withColumn("source", named(F.col("source")))
    offsets = offsets.join(known.select(F.col("source").alias(source), F.col("weight").alias(weight)), source)
    within = d.withColumn(rank, F.row_number().over(Window.partitionBy(source, bucket).orderBy(key, "doc_id")) - 1)
    # the window has dealt the documents by source and bucket already, so this join does not deal them again
    placed = (within.join(offsets, [source, bucket]).withColumn(rank, F.col(rank) + F.col(offset))
              .withColumn(out_block, F.floor(F.col(rank) / block)).withColumn(out_row, F.col(rank) % block)
              .withColumn(j, F.col(out_block) % F.col(weight)))
    f = frames(known, block).select(F.col("source").alias(source), F.col("first").alias(first), F.col("next").alias(following), F.col("frame_slots").alias(width),
                                    F.col("before").alias(before), F.col("j").alias(j), F.col("slot").alias(place))
    frame = F.floor(F.col(out_block) / F.col(weight))
    got = placed.join(f, [source, j]).where((frame >= F.col(first)) & (frame < F.col(following)))
    slot = F.col(before) + (frame - F.col(first)) * F.col(width) + F.col(place)
    return got.withColumn(out_slot, slot.cast("long")).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(out_block).cast("long").alias(out_block), F.col(out_slot), F.col(out_row).cast("long").alias(out_row))
