"""The review log resolved into current decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(qc: DataFrame) -> DataFrame:
    """The last decision, by (at as text, id), for each exact (series_key, model, label_id); nulls in the key are values."""
    entry = F.struct("status", "reviewer", "at", "comment")
    order = F.struct(F.coalesce("at", F.lit("")), F.coalesce("id", F.lit(-1)))
    return qc.groupBy("series_key", "model", "label_id").agg(F.max_by(entry, order).alias("e")).select("series_key", "model", "label_id", "e.*")


def series_facts(decisions: DataFrame) -> DataFrame:
    """A row per reviewed series: its own decision, its rejected models and excluded (model, label_id) pairs.

    Decisions do not inherit: each level is looked up under its own key.
    """
    whole = F.col("model").isNull() & F.col("label_id").isNull()
    model = F.col("model").isNotNull() & F.col("label_id").isNull()
    label = F.col("model").isNotNull() & F.col("label_id").isNotNull()
    own = F.max(F.when(whole, F.struct("status", "reviewer", "at", "comment")))
    return (
        decisions.groupBy("series_key")
        .agg(
            own.alias("own"),
            F.collect_set(F.when(model & (F.col("status") == "rejected"), F.col("model"))).alias("rejected_models"),
            F.collect_set(F.when(label & (F.col("status") == "label_excluded"), F.struct("model", "label_id"))).alias("excluded_labels"),
        )
        .select(
            "series_key", F.col("own.status").alias("qc_status"), F.col("own.reviewer").alias("qc_reviewer"), F.col("own.at").alias("qc_at"),
            F.col("own.comment").alias("qc_comment"), "rejected_models", "excluded_labels", F.lit(True).alias("reviewed"),
        )
    )
