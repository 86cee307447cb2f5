"""A project database of SQLite as a Spark data source, one partition per table read."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, StructType

from cohortica import schema as store

NAME = "project_sqlite"


class _Reader(DataSourceReader):
    def __init__(self, kind: StructType, options: dict):
        self.kind, self.path, self.table, self.run = kind, options["path"], options["table"], options.get("run_id")
        if self.table not in store.TABLES:
            raise ValueError(f"no table {self.table}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.table)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [f.name for f in self.kind.fields]
        flags = [isinstance(f.dataType, BooleanType) for f in self.kind.fields]
        where, args = (" WHERE run_id = ?", (self.run,)) if self.run and "run_id" in names else ("", ())
        db = sqlite3.connect(f"{Path(self.path).resolve().as_uri()}?mode=ro", uri=True)
        try:
            db.execute("PRAGMA query_only = 1")
            db.execute("BEGIN")
            for row in db.execute(f"SELECT {', '.join(names)} FROM {self.table}{where}", args):
                yield tuple(bool(v) if flag and v is not None else v for v, flag in zip(row, flags, strict=True))
        finally:
            db.close()


class ProjectSqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return store.TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read(spark: SparkSession, path: str, run_id: str | None = None, names=tuple(store.TABLES)) -> dict[str, DataFrame]:
    """Tables of a database file that every executor can open; a run id is filtered in SQLite.

    Ids such as 00012345 stay text.  A table is one read transaction; for one
    snapshot of all of them, copy a file that is being written before reading.
    """
    spark.dataSource.register(ProjectSqlite)
    source = lambda t: spark.read.format(NAME).option("path", path).option("table", t)
    return {t: (source(t).option("run_id", run_id) if run_id and t != "runs" else source(t)).load() for t in names}
