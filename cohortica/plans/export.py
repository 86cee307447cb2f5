"""An export: options and a project in, seven sheets out, lazily."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortica.operators import layouts, sheets, spine, status
from cohortica.options import Options


@dataclass(frozen=True)
class Export:
    sheets: dict[str, DataFrame]
    warnings: list[str]
    masks: DataFrame
    methods_text: str
    excluded_series: int


def slots(project, options: Options) -> DataFrame:
    """The spine with all facts of its series."""
    return status.with_facts(spine.slots(project, options), project)


def build(project, options: Options, *, created: str, words: sheets.Wording | None = None) -> Export:
    """All sheets in order.  Before anything is written the driver runs one count, the distinct positions and a warning's check."""
    words = words or sheets.Wording()
    spark = project.patients.sparkSession
    rows = slots(project, options)
    names = [m.name for m in layouts.selected_models(project.run, options)]
    counted = status.counts(rows, names).first()
    methods = sheets.methods_text(counted, project.run, words)
    got = {
        "results": layouts.results(rows, project, options), "series": sheets.series_sheet(rows, options), "qc": sheets.qc_sheet(rows, project, options),
        "labels": sheets.labels_sheet(spark, project.run, options),
    }
    provenance = sheets.provenance_sheet(spark, project.run, options, created, methods, words)
    skipped = sheets.skipped_sheet(rows, project.run, options)
    got["data_dictionary"] = sheets.dictionary(spark, got | {"provenance": provenance, "skipped": skipped})
    got |= {"provenance": provenance, "skipped": skipped}
    return Export({n: got[n] for n in sheets.SHEET_ORDER}, sheets.warnings(project, options), sheets.masks(rows, project.run, options), methods, counted.excluded_series)
