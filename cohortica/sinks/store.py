"""Writes to a project's tables: sources, removal of identifiers with its audit entry, manifests."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cohortica import schema


def add_source(spark: SparkSession, folder: str, source_id: int, bookmark: bytes, name: str, at: str) -> None:
    """Appends a source; of its path only the folder's name is kept."""
    spark.createDataFrame([(source_id, bookmark, Path(name).name, at)], schema.struct("sources")).write.mode("append").parquet(f"{folder}/sources")


def source_bookmarks(sources: DataFrame) -> DataFrame:
    """Bookmarks by id, without those that are missing."""
    return sources.where("bookmark is not null").orderBy("id").select("bookmark")


def remove_identifiers(spark: SparkSession, folder: str, audit_id: int, actor: str, at: str) -> int:
    """Empties identifiers and appends how many rows went to the audit log; that number."""
    rows = spark.read.schema(schema.struct("identifiers")).parquet(f"{folder}/identifiers").count()
    entry = (audit_id, at, actor, "remove_identifiers", "identifiers", json.dumps({"rows": rows}, separators=(",", ":")))
    spark.createDataFrame([entry], schema.struct("audit_log")).write.mode("append").parquet(f"{folder}/audit_log")
    schema.empty(spark, "identifiers").write.mode("overwrite").parquet(f"{folder}/identifiers")
    return rows


def write_json(path: str | Path, value) -> None:
    """JSON with sorted keys, published by a rename."""
    partial = Path(path).with_name(f".{Path(path).name}.partial")
    partial.write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(partial, path)
