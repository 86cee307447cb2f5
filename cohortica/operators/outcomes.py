"""How a worker's job ends: its status, the error it reports and the exit code of the process."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.sources.files import JobError, job

# Exit codes and error codes of the protocol.
EXIT_OK, EXIT_FAILED, EXIT_UNUSABLE, EXIT_CANCELLED = 0, 1, 2, 130
UNSUPPORTED, INTERNAL = "unsupported_job", "internal_error"


class Cancelled(Exception):
    """The job was asked to stop."""


class JobFailure(Exception):
    """A failure that a handler foresees, under a code of its own."""

    def __init__(self, code: str, message: str, recoverable: bool = False):
        super().__init__(message)
        self.code, self.recoverable = code, recoverable


@dataclass(frozen=True)
class Outcome:
    status: str | None
    exit_code: int
    code: str | None = None
    message: str | None = None
    recoverable: bool | None = None


def unexpected(name: str) -> str:
    """What is said of an exception nobody foresaw: its type, since its text may quote paths with names of people."""
    return f"{name} was not expected; the log has more"


def run(raw: Mapping, handlers: Mapping[str, Callable[[Mapping], None]]) -> Outcome:
    """Runs one job and says how it ended."""
    if raw["kind"] not in handlers:
        return Outcome("failed", EXIT_FAILED, UNSUPPORTED, f"no handler for {raw['kind']}", False)
    try:
        handlers[raw["kind"]](raw)
    except Cancelled:
        return Outcome("cancelled", EXIT_CANCELLED)
    except JobFailure as known:
        return Outcome("failed", EXIT_FAILED, known.code, str(known), known.recoverable)
    except Exception as unknown:  # noqa: BLE001
        return Outcome("failed", EXIT_FAILED, INTERNAL, unexpected(type(unknown).__name__), False)
    return Outcome("ok", EXIT_OK)


def main(argv: list[str], handlers: Mapping[str, Callable[[Mapping], None]]) -> int:
    """``run --job FILE``: the exit code; a file that is no job ends before a handler is asked."""
    asked = argparse.ArgumentParser(prog="cohortica")
    asked.add_argument("command", choices=["run"])
    asked.add_argument("--job", required=True)
    try:
        raw = job(Path(asked.parse_args(argv).job).read_text(encoding="utf-8"))
    except (JobError, OSError, UnicodeDecodeError):
        return EXIT_UNUSABLE
    return run(raw, handlers).exit_code


def judge(ends: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """:func:`run` over many ends of jobs: kind, cancelled, failure (a foreseen code), message, recoverable, exception (a type's name).

    Adds status and exit_code, and code, message and recoverable as reported: null where
    there was no error.  An unknown kind comes before all else, as nothing was run; null
    in ``cancelled`` means no.
    """
    unknown, cancelled = ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), F.coalesce("cancelled", F.lit(False))
    known, broken = F.col("failure").isNotNull(), F.col("exception").isNotNull()
    failed = unknown | (~cancelled & (known | broken))
    own = ~unknown & ~cancelled & known
    said = F.when(unknown, F.concat(F.lit("no handler for "), F.coalesce("kind", F.lit("no kind")))).when(own, F.col("message"))
    said = said.when(failed, F.concat("exception", F.lit(unexpected(""))))
    return ends.select(
        *[c for c in ends.columns if c not in ("message", "recoverable")],
        F.when(failed, "failed").when(cancelled, "cancelled").otherwise("ok").alias("status"),
        F.when(failed, EXIT_FAILED).when(cancelled, EXIT_CANCELLED).otherwise(EXIT_OK).alias("exit_code"),
        F.when(unknown, UNSUPPORTED).when(own, F.col("failure")).when(failed, INTERNAL).alias("code"),
        said.alias("message"), F.when(failed, own & F.coalesce("recoverable", F.lit(False))).alias("recoverable"),
    )
