"""Ordered computations over groups of any size.

A window over ``partitionBy(key)`` puts a whole key in one task. A key may hold a third of all rows,
so running values are computed here as prefix scans: rows are cut into ordered blocks of bounded size,
each block is summarised with ordinary (map-side combined) aggregates, the running value is taken
over the few summaries, and rows only meet the other rows of their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from standpoint.session import cut_lineage

SALTS = 16
BUCKETS, SHARE = 4096, 1024  # hash buckets that rows are counted by; one that holds more than one in SHARE rows is hot
BLOCK_ROWS = 65536


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose left side may have hot keys and whose right side has one row, or few, per key. Left to adaptive
    execution, which splits an oversized left partition and repeats only the right rows that belong to it;
    salting by hand would repeat a right side of any size for keys that are not hot. Callers go on to shuffle by
    other keys or write, so the split is free to happen."""
    return left.join(right, on, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt_by: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """The same where the next step groups by the join key, which would keep adaptive execution from splitting, and the
    right rows are a few bytes. Left rows of one key spread over ``salts`` partitions, right rows are
    repeated once per salt."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, on + ["_salt"], how).drop("_salt")


def running_before(df: DataFrame, keys: list[str], block: list[Column], order: list[Column],
                   values: dict[str, Column], fold=F.sum, uncut: Column | None = None) -> DataFrame:
    """Add, per row, the fold of each value over all *earlier* rows of its key (NULL when there is none).

    ``block`` are the leading ordering expressions that cut a key into blocks, ``order`` orders rows
    within a block. ``fold`` must be an aggregate that can be applied to partial results (sum, max, min).
    Rows that are ``uncut`` lie in the only block of their key: they are ordered inside it and need no summaries, nor a join with them.
    """
    names = list(values)
    marks = [f"_b{i}" for i in range(len(block))]
    base = df
    descending = []
    for mark, expr in zip(marks, block):
        base = base.withColumn(mark, expr[0] if isinstance(expr, tuple) else expr)
        descending.append(isinstance(expr, tuple) and expr[1] == "desc")
    if uncut is not None:
        base = base.withColumn("_uncut", uncut)
        alone, base = (base.filter(c).drop("_uncut") for c in ("_uncut", "not _uncut"))
        alone = alone.dropna(subset=keys)  # as the join with summaries does
    for n in names:
        base = base.withColumn(f"_v_{n}", values[n])
    block_order = [F.col(m).desc() if d else F.col(m).asc() for m, d in zip(marks, descending)]
    earlier_blocks = W.partitionBy(*keys).orderBy(*block_order).rowsBetween(W.unboundedPreceding, -1)
    earlier_rows = W.partitionBy(*keys, *marks).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summary = base.groupBy(*keys, *marks).agg(*[fold(f"_v_{n}").alias(f"_s_{n}") for n in names])
    offsets = summary.select(*keys, *marks, *[fold(f"_s_{n}").over(earlier_blocks).alias(f"_o_{n}") for n in names])
    out = base.join(offsets, keys + marks)
    for n in names:
        inside = fold(f"_v_{n}").over(earlier_rows)
        if fold is F.sum:
            both = F.when(inside.isNull() & F.col(f"_o_{n}").isNull(), F.lit(None)).otherwise(
                F.coalesce(inside, F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
        elif fold is F.max:
            both = F.greatest(inside, F.col(f"_o_{n}"))
        else:
            both = F.least(inside, F.col(f"_o_{n}"))
        out = out.withColumn(n, both)
    out = out.drop(*marks, *[f"_v_{n}" for n in names], *[f"_o_{n}" for n in names])
    if uncut is None:
        return out
    return out.unionByName(alone.withColumns({n: fold(values[n]).over(earlier_rows) for n in names}).drop(*marks))


def deal_blocks(df: DataFrame, keys: list[str], block: Column, name: str, least: int = BLOCK_ROWS) -> DataFrame:
    """Add ``name``: ``block`` for rows whose key may be hot, NULL for all others, so that a key of few rows is not cut however far its
    rows lie apart. Hot are keys whose hash bucket holds more than ``least`` rows and more than a ``SHARE``-th of all, at most as many
    buckets. Rows of one key and block are dealt to one task, once: what is worked out from them afterwards need not travel."""
    marked = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    counts = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_all", F.sum("_n").over(W.partitionBy(F.lit(0))))
    hot = counts.filter((F.col("_n") > least) & (F.col("_n") * SHARE > F.col("_all"))).select("_bucket", F.lit(True).alias("_hot"))
    cut = marked.join(F.broadcast(hot), "_bucket", "left").withColumn(name, F.when(F.col("_hot"), block))
    return spread(cut.drop("_bucket", "_hot"), *keys, name)


def dense_index(df: DataFrame, keys: list[str], name: str = "idx", within: list[str] | None = None) -> DataFrame:
    """Number rows 0..n-1 in the order of md5 of their (unique) key, per ``within`` group if given.

    The hash spreads rows evenly over 16^5 ordered buckets, so no task sees more than its share and
    the offsets are a window over at most that many counts per group."""
    within = within or []
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    base = df.withColumn("_h", F.md5(text.cast("binary"))).withColumn("_bucket", F.substring("_h", 1, 5))
    counts = base.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(before.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    inside = F.row_number().over(W.partitionBy(*within, "_bucket").orderBy("_h", *keys))
    return (base.join(offsets, within + ["_bucket"])
            .withColumn(name, (F.col("_off") + inside - 1).cast("bigint")).drop("_h", "_bucket", "_off"))


def ordered_index(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Number the rows of a key 0..n-1 in the order of ``order``, whatever its values share: rows are dealt by sampled ranges of
    (keys, order), so a hot key, or values with one beginning, spread over many tasks. The ranges are written, since a task that is
    repeated must find the same ones."""
    ranged = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    return (ranged.withColumn("_inside", inside).join(offsets, [*keys, "_range"])
            .withColumn(name, (F.col("_off") + F.col("_inside") - 1).cast("bigint")).drop("_off", "_inside", "_range"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Even rows over all configured partitions by the hash of ``cols``. For steps whose rows are few bytes but much
    work, which the optimizer would otherwise put together in one task for their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def deal(df: DataFrame, *cols: str) -> DataFrame:
    """The same before a step that works row by row. Rows that lie by ``cols`` already are dealt all the same, where ``spread`` would be
    left out as needless and the partitions put together for their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*cols))
