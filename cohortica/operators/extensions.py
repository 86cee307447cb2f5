"""Operators that the reference's plan specifies without code: marked as extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outliers(rows: DataFrame, group: str, value: str, most: float = 3.5, least_rows: int = 20) -> DataFrame:
    """Rows whose distance from their group's median exceeds ``most`` times the median distance, in groups of ``least_rows`` or more.

    Medians are aggregates joined back, so a large group is not one task's window.
    """
    center = rows.groupBy(group).agg(F.percentile(value, 0.5).alias("_med"), F.count("*").alias("_n")).where(F.col("_n") >= least_rows)
    near = rows.join(F.broadcast(center), group).withColumn("_d", F.abs(F.col(value) - F.col("_med")))
    spread = near.groupBy(group).agg(F.percentile("_d", 0.5).alias("_mad")).where("_mad > 0")
    return near.join(F.broadcast(spread), group).where(F.col("_d") / F.col("_mad") > most).withColumn("robust_z", F.col("_d") / F.col("_mad")).drop("_med", "_n", "_d", "_mad")


def select_series(rows: DataFrame, study: str, modality: str = "CT", least_images: int = 50) -> DataFrame:
    """The primary series of each study: of the modality, with enough images, the widest cover, then thinnest, then by kernel and key."""
    order = Window.partitionBy(study).orderBy(F.col("z_cover").desc(), "thickness", "kernel", "series_key")
    fit = rows.where((F.col("modality") == modality) & (F.col("image_count") >= least_images))
    return fit.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def first_by_uid(rows: DataFrame, uid: str, order: str) -> DataFrame:
    """The first row of each identifier and how many later ones it stands for."""
    return rows.groupBy(uid).agg(F.min_by(F.struct(*[c for c in rows.columns if c != uid]), order).alias("_r"), (F.count("*") - 1).alias("dropped")).select(uid, "_r.*", "dropped")


def cache_key(fingerprint: Column, model_sha: Column, version: Column, device_class: Column) -> Column:
    return F.sha2(F.concat_ws("|", fingerprint, model_sha, version, device_class), 256)


def sides(rows: DataFrame, group: str, x: str, middle: float, margin: float = 15.0) -> DataFrame:
    """Centroid of each group and its side of the midline."""
    out = rows.groupBy(group).agg(F.avg(x).alias("x"))
    return out.withColumn("side", F.when(F.col("x") > middle + margin, "left").when(F.col("x") < middle - margin, "right").otherwise("middle"))


def spacing_irregular(slices: DataFrame, series: str, position: str, tolerance: float = 0.01) -> DataFrame:
    """Series whose slice distances differ by more than the tolerance."""
    step = F.col(position) - F.lag(position).over(Window.partitionBy(series).orderBy(position))
    gaps = slices.withColumn("_gap", step).groupBy(series).agg(F.min("_gap").alias("least"), F.max("_gap").alias("most"))
    return gaps.where(F.col("most") - F.col("least") > tolerance)


def filter_series(rows: DataFrame, modality: str | None = None, least_images: int = 0, most_thickness: float | None = None, pattern: str | None = None,
                  since=None, until=None, not_in: DataFrame | None = None) -> DataFrame:
    """Series of a modality, with enough images, thin enough, whose description matches, of a range of dates, without a result yet."""
    out = rows.where(F.col("image_count") >= least_images)
    if modality is not None:
        out = out.where(F.col("modality") == modality)
    if most_thickness is not None:
        out = out.where(F.col("thickness") <= most_thickness)
    if pattern is not None:
        out = out.where(F.col("description").rlike(pattern))
    if since is not None:
        out = out.where(F.col("study_date") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("study_date") <= F.lit(until))
    return out if not_in is None else out.join(not_in.select("series_key").distinct(), "series_key", "left_anti")


def plausibility(metrics: DataFrame, low: float = -1024.0, high: float = 3071.0, thick_mm: float = 5.0, tiny_ml: float = 0.1) -> DataFrame:
    """Rows with an array of flags: values beyond the CT range, thick slices, tiny structures, another device than asked for."""
    flags = F.array_compact(F.array(
        F.when((F.col("hu_min") < low) | (F.col("hu_max") > high), "hu_range"), F.when(F.col("thickness") > thick_mm, "thick_slices"),
        F.when((F.col("volume_ml") > 0) & (F.col("volume_ml") < tiny_ml), "tiny"), F.when(~F.col("device").eqNullSafe(F.col("requested_device")), "device_fallback"),
    ))
    return metrics.withColumn("flags", flags)


def rescan(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are new or changed by (path, size, mtime) since the last scan."""
    return files.join(seen.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def first_seen_stream(headers: DataFrame, uid: str, ts: str, late: str = "1 day") -> DataFrame:
    """Streaming form of :func:`first_by_uid`: the first header of each identifier, with state bounded by the watermark."""
    return headers.withWatermark(ts, late).dropDuplicatesWithinWatermark([uid])
