"""A project's run as lazy frames, from Parquet tables or any source of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica import schema


class UnknownRun(LookupError):
    """The run is not in the project."""


@dataclass(frozen=True)
class Model:
    name: str
    sha256: str | None
    labels: dict[int, str]
    colors: dict[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Run:
    run_id: str
    created_at: str
    device: str
    versions: dict[str, str]
    models: tuple[Model, ...]
    settings: object


@dataclass(frozen=True)
class Project:
    """The rows of one run; frames are never collected, the run's own JSON is on the driver."""

    run: Run
    patients: DataFrame
    identifiers: DataFrame
    studies: DataFrame
    series: DataFrame
    results: DataFrame
    qc: DataFrame
    jobs: DataFrame


def decode_models(raw: str) -> tuple[Model, ...]:
    """Models in the order of the list, which is the order of export columns."""
    ids = lambda m: {int(k): v for k, v in (m or {}).items()}
    return tuple(Model(m["name"], m.get("zip_sha256"), ids(m.get("labels")), ids(m.get("colors"))) for m in json.loads(raw))


def models_frame(runs: DataFrame) -> DataFrame:
    """run_id, model_pos, model, zip_sha256, label_id, label, color of the runs' models_json, in the engine."""
    kind = "array<struct<name:string,zip_sha256:string,labels:map<string,string>,colors:map<string,string>>>"
    models = runs.select("run_id", F.posexplode(F.from_json("models_json", kind)).alias("model_pos", "m"))
    return models.select("run_id", "model_pos", F.col("m.name").alias("model"), "m.zip_sha256", F.col("m.colors").alias("colors"), F.explode("m.labels").alias("id", "label")).select(
        "run_id", "model_pos", "model", "zip_sha256", F.col("id").cast("int").alias("label_id"), "label", F.try_element_at("colors", F.col("id")).alias("color")
    )


def versions_frame(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.explode(F.from_json("versions_json", "map<string,string>")).alias("component", "version"))


def project(tables: dict[str, DataFrame], run_id: str) -> Project:
    """One run of a project.  The run filter reaches the scans of results, qc and jobs."""
    row = tables["runs"].where(F.col("run_id") == run_id).head(1)
    if not row:
        raise UnknownRun(f"no run {run_id}")
    r = row[0]
    run = Run(r.run_id, r.created_at, r.device, json.loads(r.versions_json or "{}"), decode_models(r.models_json or "[]"), json.loads(r.settings_json or "null"))
    own = lambda t: tables[t].where(F.col("run_id") == run_id)
    return Project(run, tables["patients"], tables["identifiers"], tables["studies"], tables["series"], own("results"), own("qc"), own("jobs"))


def read_parquet(spark: SparkSession, folder: str, names=tuple(schema.TABLES)) -> dict[str, DataFrame]:
    return {t: spark.read.schema(schema.struct(t)).parquet(f"{folder}/{t}") for t in names}


def write_parquet(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables; those that are read by run are partitioned by it, so its filter prunes files."""
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("run_id") if name in ("results", "qc", "jobs") else out).parquet(f"{folder}/{name}")
