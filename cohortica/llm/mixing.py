"""Mixing sources to target weights along a time-varying curriculum.

A source's weight over training time (0 to 1) is a schedule of equal phases,
integrated and scaled to the source's target.  The documents of a source stand
in a fixed pseudo-random order (MD5 of the id, the few largest first) and repeat; the end of a copy's
words on the source's demand axis, inverted through the integral, is its
training position.  :func:`mix` range-sorts the copies by position.

The running sum of a source is taken in two levels, (source, bucket) sums and
then a window in each bucket, so a source with a third of all rows is spread
over ``BUCKETS`` windows.

Nulls and edge cases: a null text has size 0; null sources form one source,
ordered last; documents of size 0 are taken whenever their place in the order
is (they add no words); repeated rows are ordered by id, then text hash; an
empty table gives an empty result.  Extra columns pass through :func:`mix`
untouched; the names it adds (``size source_size target positions position``)
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.llm import common

#: A document of over about 1/LARGE of its source stands at the front of each pass, so that the end of the demand meets small ones.
LARGE = 256
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Phase multipliers by rank of the source, repeating: steady, rising, falling.
SCHEDULES = ((1.0, 1.0, 1.0, 1.0), (0.5, 0.8, 1.2, 1.5), (1.5, 1.2, 0.8, 0.5))
#: Sources up to this many are broadcast; a list of more is joined by shuffle.
MOST_BROADCAST = 10_000
_ADDED = ("size", "source_size", "target", "positions")


def targets(sizes: list[int], weights: list[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Shares ``sum(sizes)`` by weight; what exceeds max_repeats * size is shared again among the rest."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole >= max_repeats * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in sorted(full):
            out[i] = float(max_repeats * sizes[i])
        left = max(0.0, left - sum(out[i] for i in full))
        open_ -= full
    return out


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` with size, source_size, target and positions (one per copy taken, rising).

    The driver holds one row per source (the list of sources a mix names weights
    for); documents are never collected.  Up to MOST_BROADCAST sources are broadcast.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in _ADDED]
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        *kept, F.col(source_col).alias("_source"), common.count_space_words(F.col(text_col)).alias("size"), key.alias("_key"),
        F.substring(key, 1, 2).alias("_bucket"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("_hash"),
    ).withColumn("_bits", F.length(F.bin("size")))
    by_bucket = common.materialize(rows.groupBy("_source", "_bucket", "_bits").agg(F.sum("size").alias("words")), "mix-buckets")
    sums = by_bucket.groupBy("_source").agg(F.sum("words").alias("n")).collect()
    sums.sort(key=lambda x: (x._source is None, (x._source or "").encode()))
    goal = targets([x.n for x in sums], [weights[i % len(weights)] for i in range(len(sums))], max_repeats)
    table = []
    for i, (x, t) in enumerate(zip(sums, goal, strict=True)):
        ends = [0.0]
        for p in schedules[i % len(schedules)]:
            ends.append(ends[-1] + p)
        large = next(b for b in range(1, 64) if (1 << (b - 1)) * LARGE > x.n)
        table.append((x._source, x.n, t, large, [e / ends[-1] for e in ends]))
    few = F.broadcast if len(table) <= MOST_BROADCAST else (lambda x: x)
    goals = few(spark.createDataFrame(table, "_s string, source_size long, target double, _large int, _ends array<double>"))
    late = (F.col("_bits") < F.col("_large")).alias("_late")
    before = Window.partitionBy("_source").orderBy("_late", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        by_bucket.join(goals, F.col("_source").eqNullSafe(F.col("_s")))
        .groupBy("_source", late, "_bucket").agg(F.sum("words").alias("words"))
        .select(F.col("_source").alias("_f"), F.col("_late").alias("_l"), F.col("_bucket").alias("_b"),
                F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_source", "_late", "_bucket").orderBy("_key", id_col, "_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.join(goals, F.col("_source").eqNullSafe(F.col("_s")))
        .withColumn("_late", late)
        .withColumn("_upto", F.sum("size").over(inside))
        # Two rows per source and bucket at most: 2 * 256 times the driver's list of sources.
        .join(few(starts), F.col("_source").eqNullSafe(F.col("_f")) & (F.col("_late") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_end", F.col("_start") + F.col("_upto"))
    )
    # A copy is taken when its middle lies within the demand; pass k over the source is shifted by k * source_size.
    middle = F.col("_end") - F.col("size") / 2
    passes = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: middle + k * F.col("source_size") <= F.col("target"))
    demand = F.transform(passes, lambda k: F.least(F.lit(1.0), (F.col("_end") + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1e-9))))

    def invert(u):
        j = F.greatest(F.size(F.filter(F.col("_ends"), lambda e: e < u)), F.lit(1))
        low, high = F.element_at("_ends", j), F.element_at("_ends", j + 1)
        return (j - 1 + (u - low) / (high - low)) / (F.size("_ends") - 1)

    return placed.select(*kept, "size", "source_size", "target", F.transform(demand, invert).alias("positions"))


def mix(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", **how) -> DataFrame:
    """The columns of ``docs`` plus ``position``: a row per copy taken, range-sorted by training position."""
    names = [c for c in docs.columns if c not in (*_ADDED, "position")]
    copies = place(docs, id_col, **how).select(*names, F.explode("positions").alias("position"))
    n = partitions or common.task_count(docs.sparkSession)
    return copies.repartitionByRange(n, "position", id_col).sortWithinPartitions("position", id_col)
