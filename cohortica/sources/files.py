"""Readers of event lines, checksum manifests, job files, plain files and NIfTI volumes."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.streaming.events import JOB_KINDS, decode

PROTOCOL = 1


def event_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Decoded events of files named events_<model>[__<run>].jsonl, with model_tag and run_tag from the name, in no order but ``line``."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("line"))
    name = F.regexp_extract("file", r"^events_(.*)\.jsonl$", 1)
    tags = F.split(name, "__", 2)
    return decode(lines.drop("_block")).withColumns({"model_tag": F.get(tags, F.lit(0)), "run_tag": F.get(tags, F.lit(1))})


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return decode(spark.readStream.text(folder))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, path, sha256 of every file of a checksum manifest."""
    kind = "models array<struct<name:string,url:string,files:map<string,string>>>"
    models = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("models").alias("m"))
    return models.select("m.name", F.explode("m.files").alias("path", "sha256"))


def files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """path below the folder, size, sha256 and (if asked) content of every file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.lit(f"/{folder.removeprefix('file:').strip('/')}/")
    at = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), root, -1)
    out = rows.select(at.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    return out if content else out.drop("content")


class JobError(ValueError):
    """A job file that does not follow the protocol."""


def job(text: str) -> dict:
    """A job from its file's text; paths must stay inside the project."""
    try:
        raw = json.loads(text)
    except ValueError as broken:
        raise JobError("the job file is no JSON") from broken
    for key in ("protocol_version", "job_id", "kind", "project_dir"):
        if key not in raw:
            raise JobError(f"the job has no {key}")
    if raw["protocol_version"] != PROTOCOL:
        raise JobError(f"protocol version {raw['protocol_version']} is not {PROTOCOL}")
    if raw["kind"] not in JOB_KINDS:
        raise JobError(f"unknown job kind {raw['kind']!r}")
    return raw


def inside(project: str, path: str) -> str:
    """The path below the project's folder; an error if it leaves it."""
    out: list[str] = []
    for part in PurePosixPath(project, path).parts:
        out = [*out, part] if part != ".." else out[:-1] if len(out) > 1 else out
    whole = PurePosixPath(*out)
    if not whole.is_relative_to(PurePosixPath(project)):
        raise JobError("the path leaves the project")
    return str(whole)


def jobs(lines: DataFrame, line: str = "value") -> DataFrame:
    """job_id, kind, project_dir, problem (null for a job that :func:`job` takes) of one job's text a row, with the other columns.  A null key counts as missing."""
    e = lambda c: F.col(f"_job.{c}")
    rows = lines.withColumn("_job", F.from_json(line, "protocol_version int, job_id string, kind string, project_dir string"))
    missing = [F.when(e(c).isNull(), F.lit(f"no {c}")) for c in ("protocol_version", "job_id", "kind", "project_dir")]
    wrong = [F.when(e("protocol_version") != PROTOCOL, "other protocol version"), F.when(~e("kind").isin(*JOB_KINDS), "unknown kind")]
    problem = F.coalesce(F.when(F.try_parse_json(line).isNull(), "no JSON"), *missing, *wrong)
    return rows.select(*[c for c in lines.columns if c != line], e("job_id").alias("job_id"), e("kind").alias("kind"), e("project_dir").alias("project_dir"), problem.alias("problem"))


def inside_column(project: str, path: Column) -> Column:
    """:func:`inside` for a column of paths: null where a path is null or leaves the folder ``project`` (an absolute path)."""
    root = str(PurePosixPath(project))
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"{root}/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    step = lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    got = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when((got == root) | got.startswith(root.rstrip("/") + "/"), got)


# NIfTI-1 datatype codes -> numpy types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def decode_nifti(content: bytes) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Array (z, y, x) with slope and intercept applied, and spacing (x, y, z) of a NIfTI-1 file, compressed or not."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    dim = struct.unpack_from(f"{order}8h", raw, 40)
    code, = struct.unpack_from(f"{order}h", raw, 70)
    pixdim = struct.unpack_from(f"{order}8f", raw, 76)
    offset, slope, intercept = struct.unpack_from(f"{order}3f", raw, 108)
    if code not in NIFTI_TYPES:
        raise ValueError(f"NIfTI datatype {code} is not supported")
    nx, ny, nz = (max(1, n) for n in dim[1:4])
    flat = np.frombuffer(raw, np.dtype(order + NIFTI_TYPES[code]), nx * ny * nz, int(offset))
    array = flat.reshape(nz, ny, nx)
    return (array * slope + intercept if slope not in (0.0, 1.0) or intercept else array), tuple(float(p) for p in pixdim[1:4])


def volumes(spark: SparkSession, pattern: str, value: str = "hu") -> DataFrame:
    """volume_id (file name), z, row of voxels as y and an array: one row per image row, which explodes to voxels where asked."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                array, spacing = decode_nifti(content)
                nz, ny, nx = array.shape
                for z in range(nz):
                    yield pd.DataFrame({
                        "volume_id": path.rsplit("/", 1)[-1], "z": z, "y": range(ny), value: list(array[z].astype(float)), "nx": nx, "ny": ny, "nz": nz,
                        "sx": spacing[0], "sy": spacing[1], "sz": spacing[2],
                    })

    kind = f"volume_id string, z int, y int, {value} array<double>, nx int, ny int, nz int, sx double, sy double, sz double"
    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(rows, kind)


def voxels(rows: DataFrame, value: str = "hu") -> DataFrame:
    """A row per voxel of :func:`volumes`."""
    return rows.select("volume_id", "z", "y", F.posexplode(value).alias("x", value))


def grids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("volume_id").agg(*[F.first(c).alias(c) for c in ("nx", "ny", "nz", "sx", "sy", "sz")])
