"""Options of an export, validated on the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any

from cohortica.functions.scalars import sanitize_name
from cohortica.schema import METRICS


class OptionError(ValueError):
    """An option that no dialog could have produced."""


# What each choice may be; the first is the default.
CHOICES = {
    "format": ("xlsx", "csv", "csv_excel"),
    "layout": ("wide", "long"),
    "row_level": ("patient", "study", "series"),
    "multiple_studies": ("suffix", "first", "last", "per_study"),
    "multiple_series": ("primary", "all"),
    "qc": ("exclude", "include"),
    "identifiers": ("pseudonym", "patient_id", "both"),
    "dates": ("days_since_first", "year", "iso"),
}
SUBSETS = ("patients", "models", "labels", "metrics")
SWITCHES = ("methods_text", "masks", "reproducibility_package")


@dataclass(frozen=True)
class Options:
    format: str = "xlsx"
    layout: str = "wide"
    row_level: str = "patient"
    multiple_studies: str = "suffix"
    multiple_series: str = "primary"
    qc: str = "exclude"
    identifiers: str = "pseudonym"
    dates: str = "days_since_first"
    patients: tuple[str, ...] | None = None
    models: tuple[str, ...] | None = None
    labels: tuple[str, ...] | None = None
    metrics: tuple[str, ...] = METRICS
    methods_text: bool = True
    masks: bool = False
    reproducibility_package: bool = False

    @property
    def per_study(self) -> bool:
        return self.row_level == "study" or (self.row_level == "patient" and self.multiple_studies == "per_study")

    @property
    def per_series(self) -> bool:
        return self.row_level == "series"

    @property
    def by_timepoint(self) -> bool:
        """Whether every timepoint has columns of its own."""
        return self.row_level == "patient" and self.multiple_studies == "suffix"

    @property
    def by_series(self) -> bool:
        return self.multiple_series == "all" and not self.per_series

    def json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def parse(raw: Mapping[str, Any]) -> Options:
    """Options from a job's payload.  Switches must be true booleans; a text such as "false" is refused."""
    known = {f.name for f in fields(Options)}
    if unknown := sorted(set(raw) - known):
        raise OptionError(f"unknown export options: {', '.join(unknown)}")
    got: dict[str, Any] = {}
    for key, allowed in CHOICES.items():
        got[key] = raw.get(key, allowed[0])
        if got[key] not in allowed:
            raise OptionError(f"{key} must be one of {', '.join(allowed)}, not {got[key]!r}")
    for key in SUBSETS:
        value = raw.get(key)
        if value is None:
            continue
        if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
            raise OptionError(f"{key} must be a list of names")
        if not value:
            raise OptionError(f"{key} is empty; leave it out to export everything")
        got[key] = tuple(value)
    if wrong := [m for m in got.get("metrics", ()) if m not in METRICS]:
        raise OptionError(f"unknown metrics: {', '.join(wrong)}")
    got["metrics"] = tuple(m for m in METRICS if m in got.get("metrics", METRICS))
    if "labels" in got:
        got["labels"] = tuple(map(sanitize_name, got["labels"]))
    for key in SWITCHES:
        if key in raw:
            if not isinstance(raw[key], bool):
                raise OptionError(f"{key} must be true or false")
            got[key] = raw[key]
    if got.get("reproducibility_package"):
        raise OptionError("the reproducibility package is not available")
    return Options(**got)
