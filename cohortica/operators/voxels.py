"""Grouped statistics over the voxels of volumes, and the agreement of label volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows: volume_id, z, y, x, hu, label.  Grids: volume_id, nx, ny, nz, sx, sy, sz.


def voxel_ml(sx: Column, sy: Column, sz: Column) -> Column:
    """Millilitres of a voxel; an error unless all three spacings are positive."""
    bad = F.raise_error(F.lit("voxel spacing must be positive")).cast("double")
    return F.when((sx > 0) & (sy > 0) & (sz > 0), sx * sy * sz / 1000).otherwise(bad)


def grid_differences(ct: DataFrame, labels: DataFrame) -> DataFrame:
    """Grids of the two volumes that do not have one size."""
    a, b = ct.alias("a"), labels.alias("b")
    same = (F.col("a.nx") == F.col("b.nx")) & (F.col("a.ny") == F.col("b.ny")) & (F.col("a.nz") == F.col("b.nz"))
    return a.join(b, F.col("a.volume_id") == F.col("b.volume_id")).where(~same).select("a.volume_id", "a.nx", "a.ny", "a.nz", F.col("b.nx").alias("nx_b"), F.col("b.ny").alias("ny_b"), F.col("b.nz").alias("nz_b"))


def on_border(z: Column, y: Column, x: Column, nz: Column, ny: Column, nx: Column) -> Column:
    """Whether a voxel lies on one of the six faces of its volume."""
    return (z == 0) | (z == nz - 1) | (y == 0) | (y == ny - 1) | (x == 0) | (x == nx - 1)


def statistics(voxels: DataFrame, grids: DataFrame, background: int = 0) -> DataFrame:
    """A row per volume and label but the background.

    The background is filtered before anything is shuffled; percentiles are
    exact, over a count of distinct values, so their state is as wide as the
    range of CT values, not as the label.
    """
    rows = voxels.where(F.col("label") != background).join(F.broadcast(grids.select("volume_id", "nx", "ny", "nz")), "volume_id")
    border = on_border(*[F.col(c) for c in ("z", "y", "x", "nz", "ny", "nx")])
    p = lambda q: F.percentile("hu", q)
    return rows.groupBy("volume_id", "label").agg(
        F.count("*").alias("voxel_count"), F.avg("hu").alias("hu_mean"), F.stddev_samp("hu").alias("hu_sd"), p(0.5).alias("hu_median"), p(0.05).alias("hu_p05"),
        p(0.95).alias("hu_p95"), F.min("hu").alias("hu_min"), F.max("hu").alias("hu_max"), F.bool_or(border).alias("touches_border"),
    )


def label_metrics(voxels: DataFrame, grids: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics of every asked label (pos, label) of every volume, in the order asked; an absent label has count and volume 0, all else null.

    ``labels`` is what a caller asks for, a few hundred rows at most.
    """
    asked = grids.crossJoin(F.broadcast(labels))
    rows = asked.join(statistics(voxels, grids), ["volume_id", "label"], "left")
    count = F.coalesce("voxel_count", F.lit(0))
    border = F.coalesce("touches_border", F.lit(False))
    flags = F.array_compact(F.array(F.when(count == 0, "empty_label"), F.when(border, "truncated")))
    return rows.orderBy("volume_id", "pos").select(
        "volume_id", "pos", "label", count.alias("voxel_count"), (count * voxel_ml(F.col("sx"), F.col("sy"), F.col("sz"))).alias("volume_ml"),
        "hu_mean", "hu_sd", "hu_median", "hu_p05", "hu_p95", "hu_min", "hu_max", border.alias("touches_border"), flags.alias("flags"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Per volume: labels asked for and labels present."""
    return metrics.groupBy("volume_id").agg(F.count("*").alias("labels"), F.count_if(F.col("voxel_count") > 0).alias("present"))


def agreement(pairs: DataFrame, group: str = "volume_id") -> DataFrame:
    """Dice and difference in size of two labellings (columns a and b of one voxel), per label but 0.

    One pass: a voxel counts for a's label and for b's, so no label multiplies the rows.
    """
    one = lambda label, a, b: F.struct(F.col(label).alias("label"), F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col("a") == F.col("b")).cast("int").alias("both"))
    sides = F.when(F.col("a") == F.col("b"), F.array(one("a", 1, 1))).otherwise(F.array(one("a", 1, 0), one("b", 0, 1)))
    counts = pairs.select(group, F.explode(sides).alias("s")).where("s.label <> 0").groupBy(group, F.col("s.label").alias("label")).agg(
        F.sum("s.a").alias("a"), F.sum("s.b").alias("b"), F.sum(F.when(F.col("s.a") + F.col("s.b") == 2, 1).otherwise(0)).alias("both")
    )
    return counts.select(group, "label", "a", "b", dice(F.col("both"), F.col("a"), F.col("b")).alias("dice"), volume_difference(F.col("a"), F.col("b")).alias("difference_pct"))


def dice(both: Column, a: Column, b: Column) -> Column:
    """1 when both are empty."""
    return F.coalesce(F.try_divide(2.0 * both, (a + b).cast("double")), F.lit(1.0))


def volume_difference(a: Column, b: Column) -> Column:
    """Per cent of b; 0 when b is empty."""
    return F.coalesce(F.try_divide(100.0 * (a - b), b.cast("double")), F.lit(0.0))


def below_threshold(agreed: DataFrame, least_dice: float = 0.99, most_pct: float = 1.0, group: str = "volume_id") -> DataFrame:
    """Per volume the labels that differ too much, in order, and whether all voxels agree."""
    bad = (F.col("dice") < least_dice) | (F.abs("difference_pct") > most_pct)
    return agreed.groupBy(group).agg(F.array_sort(F.collect_list(F.when(bad, F.col("label")))).alias("below"), F.bool_and(F.col("dice") == 1.0).alias("identical"))
