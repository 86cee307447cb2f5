"""What is known of each series and model: device, failures, run time, review, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.functions.scalars import seconds_between
from cohortica.operators import qc as review


def devices(results: DataFrame) -> DataFrame:
    """Device of a series' first result by (model, label_id), over all models, and the models that have one."""
    return results.groupBy("series_key").agg(
        F.min_by("device", F.struct("model", F.coalesce("label_id", F.lit(-1)))).alias("device"), F.collect_set("model").alias("models_done")
    )


def job_facts(jobs: DataFrame) -> DataFrame:
    """Code of the last failed job by (queued_at, job_id), which a later success does not clear, and seconds of finished jobs."""
    code = F.coalesce(F.nullif(F.col("error_code"), F.lit("")), F.lit("failed"))
    failed = F.col("status") == "failed"
    order = F.when(failed, F.struct(F.coalesce("queued_at", F.lit("")), "job_id"))
    seconds = F.when(F.col("status") == "done", seconds_between(F.col("started_at"), F.col("ended_at")))
    return jobs.where(F.col("series_key").isNotNull()).groupBy("series_key").agg(
        F.max_by(F.when(failed, code), order).alias("failed_code"), F.sum(seconds).alias("runtime_s")
    )


def with_facts(slots: DataFrame, project) -> DataFrame:
    """Slots with everything known of their series; all sides are one row a series, so the joins share one distribution."""
    out = slots
    for facts in (devices(project.results), job_facts(project.jobs), review.series_facts(review.latest(project.qc))):
        out = out.join(facts, "series_key", "left")
    none = F.array().cast("array<string>")
    pairs = F.array().cast("array<struct<model:string,label_id:int>>")
    return out.withColumns({
        "qc_status": F.coalesce("qc_status", F.lit("unreviewed")), "reviewed": F.coalesce("reviewed", F.lit(False)),
        "models_done": F.coalesce("models_done", none), "rejected_models": F.coalesce("rejected_models", none),
        "excluded_labels": F.coalesce("excluded_labels", pairs),
    })


def model_status(model, exclude: bool):
    """excluded, ok, failed or not_run of a model, by precedence, over the columns of :func:`with_facts`."""
    hidden = (F.col("qc_status") == "rejected") | F.array_contains("rejected_models", model)
    rest = F.when(F.array_contains("models_done", model), "ok").when(F.col("failed_code").isNotNull(), "failed").otherwise("not_run")
    return F.when(hidden, "excluded").otherwise(rest) if exclude else rest


def label_excluded(model, label_id):
    return F.exists("excluded_labels", lambda p: (p["model"] == model) & (p["label_id"] == label_id))


def counts(slots: DataFrame, models: list[str], exclude_unused: bool = True) -> DataFrame:
    """One row: series whose own status is rejected, segmented and reviewed ones, and the models any slot has a result of."""
    names = F.array(*map(F.lit, models)).cast("array<string>")
    done = F.arrays_overlap("models_done", names)
    return slots.agg(
        F.count_if(F.col("qc_status") == "rejected").alias("excluded_series"),
        F.count_distinct(F.when(done, F.col("series_key"))).alias("segmented"),
        F.count_distinct(F.when(done & F.col("reviewed"), F.col("series_key"))).alias("reviewed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_intersect("models_done", names))))).alias("models"),
    )
