"""The spine of an export: one row per series with its place in time and in its study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortica.functions.scalars import lenient_date
from cohortica.options import Options


def patients(patients: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Patients with their clear-text id, null where none is stored."""
    return patients.join(identifiers.select("patient_key", "patient_id"), "patient_key", "left")


def eligible(series: DataFrame, results: DataFrame) -> DataFrame:
    """Series that are selected or have a result of any model in the run."""
    hit = results.select("series_key").distinct().withColumn("_hit", F.lit(True))
    return series.join(hit, "series_key", "left").where(F.coalesce("selected", F.lit(False)) | F.col("_hit").isNotNull()).drop("_hit")


def slots(project, options: Options) -> DataFrame:
    """Slots of the project under the options.

    Timepoints number a patient's studies that have an eligible series by date
    (undated last), then key; ``n_studies`` counts them before first or last is
    picked.  All windows share one distribution by patient.
    """
    people = patients(project.patients, project.identifiers)
    if options.patients is not None:
        people = people.where(F.col("pseudonym").isin(*options.patients))
    studies = project.studies.select("study_key", "patient_key", lenient_date(F.col("study_date")).alias("study_date"))
    rows = eligible(project.series, project.results).join(studies, "study_key").join(people, "patient_key")
    by_patient = Window.partitionBy("patient_key")
    by_time = by_patient.orderBy(F.col("study_date").asc_nulls_last(), "study_key")
    in_study = Window.partitionBy("patient_key", "study_key").orderBy(F.coalesce("is_primary", F.lit(False)).desc(), "series_key")
    rows = (
        rows.withColumn("timepoint", F.dense_rank().over(by_time))
        .withColumn("n_studies", F.max("timepoint").over(by_patient))
        .withColumn("day", F.date_diff("study_date", F.min("study_date").over(by_patient)))
        .withColumn("series_index", F.row_number().over(in_study))
    )
    if options.row_level == "patient" and options.multiple_studies == "first":
        rows = rows.where("timepoint = 1")
    if options.row_level == "patient" and options.multiple_studies == "last":
        rows = rows.where("timepoint = n_studies")
    if options.multiple_series == "primary":
        rows = rows.where("series_index = 1")
    return rows


def date_value(options: Options):
    """(name, column, type, unit, description) of the date under the options."""
    return {
        "days_since_first": ("day", F.col("day"), "integer", "days", "days since the patient's first study"),
        "year": ("year", F.year("study_date"), "integer", "", "year of the study"),
        "iso": ("study_date", F.date_format("study_date", "yyyy-MM-dd"), "text", "ISO 8601", "date of the study"),
    }[options.dates]
