"""The ten tables of a project, their keys, and the checks on them as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

METRICS = ("voxel_count", "volume_ml", "hu_mean", "hu_sd", "hu_median", "hu_p05", "hu_p95", "hu_min", "hu_max", "touches_border")

TABLES = {
    "sources": "id long, bookmark binary, display_path string, added_at string",
    "patients": "patient_key string, pseudonym string, sex string, age_at_first_study double",
    "identifiers": "patient_key string, patient_id string, accession_numbers string",
    "studies": "study_key string, patient_key string, study_uid string, study_date string, description string",
    "series": (
        "series_key string, study_key string, series_uid string, part int, modality string, description string, image_count long, "
        "slice_thickness_mm double, pixel_spacing_mm double, kernel string, manufacturer string, kvp double, contrast_agent string, "
        "image_type string, frame_of_reference_uid string, fingerprint string, selected boolean, is_primary boolean, selection_reason string"
    ),
    "runs": "run_id string, created_at string, versions_json string, device string, models_json string, settings_json string, locked boolean",
    "jobs": (
        "job_id string, run_id string, series_key string, kind string, status string, queued_at string, started_at string, ended_at string, "
        "device string, error_code string, log_path string"
    ),
    "results": (
        "run_id string, series_key string, model string, label_id int, label_name string, voxel_count long, volume_ml double, hu_mean double, "
        "hu_sd double, hu_median double, hu_p05 double, hu_p95 double, hu_min double, hu_max double, touches_border boolean, device string, flags string"
    ),
    "qc": "id long, run_id string, series_key string, model string, label_id int, status string, reviewer string, at string, comment string",
    "audit_log": "id long, at string, actor string, action string, object string, details_json string",
}
UNIQUE = {
    "sources": [("id",)], "patients": [("patient_key",), ("pseudonym",)], "identifiers": [("patient_key",)],
    "studies": [("study_key",), ("study_uid",)], "series": [("series_key",), ("series_uid", "part")], "runs": [("run_id",)],
    "jobs": [("job_id",)], "results": [("run_id", "series_key", "model", "label_id")], "qc": [("id",)], "audit_log": [("id",)],
}
PARENTS = {
    ("identifiers", "patient_key"): "patients", ("studies", "patient_key"): "patients", ("series", "study_key"): "studies",
    ("jobs", "run_id"): "runs", ("jobs", "series_key"): "series", ("results", "run_id"): "runs", ("results", "series_key"): "series",
    ("qc", "run_id"): "runs", ("qc", "series_key"): "series",
}
VALUES = {
    ("patients", "sex"): ("F", "M", "O"),
    ("jobs", "status"): ("queued", "running", "done", "failed", "cancelled", "interrupted"),
    ("qc", "status"): ("unreviewed", "accepted", "accepted_with_comment", "rejected", "label_excluded"),
}


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct(table))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rule, key, n: every broken key, reference and enumeration of the tables given."""
    out = []

    def add(df: DataFrame, table: str, rule: str, key, n) -> None:
        out.append(df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), n.cast("long").alias("n")))

    for table, df in tables.items():
        for cols in UNIQUE[table]:
            twice = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])).groupBy(*cols).count().where("count > 1")
            add(twice, table, f"unique {', '.join(cols)}", F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols]), F.col("count"))
        for (child, col), parent in PARENTS.items():
            if child == table and parent in tables:
                key = {"patients": "patient_key", "studies": "study_key", "series": "series_key", "runs": "run_id"}[parent]
                lost = df.where(F.col(col).isNotNull()).join(tables[parent].select(F.col(key).alias(col)), col, "left_anti").groupBy(col).count()
                add(lost, table, f"{col} in {parent}", F.col(col), F.col("count"))
        for (owner, col), allowed in VALUES.items():
            if owner == table:
                odd = df.where(F.col(col).isNotNull() & ~F.col(col).isin(*allowed)).groupBy(col).count()
                add(odd, table, f"{col} values", F.col(col), F.col("count"))
    return reduce(DataFrame.unionByName, out)


def private_columns(tables: dict[str, DataFrame]) -> list[str]:
    """Columns that could hold a birth date or a person's name; must be empty."""
    return sorted(
        f"{t}.{c}" for t, df in tables.items() for c in df.columns if "birth" in c.lower() or ("name" in c.lower() and c != "label_name")
    )
