"""Worker events: decoding, job states folded from them, time-outs, admission; batch and streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values of the event protocol.
TYPES = ("hello", "progress", "heartbeat", "log", "artifact", "result", "error", "done")
STAGES = ("index", "convert", "check", "segment", "metrics", "viewer_cache", "export", "selftest")
JOB_KINDS = ("index", "convert", "segment", "metrics", "viewer_cache", "export", "selftest", "spike_s2")
GPU_KINDS = ("segment", "selftest")
WATCHDOG_SECONDS = 300
HEARTBEAT_SECONDS = 10
LIGHT_JOBS = 2

EVENT = (
    "type string, protocol_version int, versions map<string,string>, job_id string, stage string, fraction double, message string, model string, "
    "ts string, level string, kind string, path string, sha256 string, payload string, code string, recoverable boolean, status string"
)


def decode(lines: DataFrame, line: str = "value") -> DataFrame:
    """Event columns, ``problem`` (null for a valid event) and the other columns of ``lines``; the text of a bad line is not repeated.

    Blank lines are dropped.
    """
    raw = F.col(line)
    rows = lines.where(F.trim(raw) != "").withColumn("_e", F.from_json(raw, EVENT)).withColumn("_fraction_key", F.try_variant_get(F.try_parse_json(raw), "$.fraction", "string").isNotNull() | raw.rlike(r'"fraction"\s*:\s*null'))
    e = lambda c: F.col(f"_e.{c}")
    problem = (
        F.when(e("type").isNull(), "no event").when(~e("type").isin(*TYPES), "unknown type")
        .when((e("type") == "progress") & ~F.coalesce(e("stage").isin(*STAGES), F.lit(False)), "unknown stage")
        .when((e("type") == "progress") & ~F.col("_fraction_key"), "no fraction")
        .when((e("type") == "progress") & ~F.coalesce(e("fraction").between(0, 1), F.lit(True)), "fraction out of range")
    )
    rest = [c for c in lines.columns if c != line]
    return rows.select(*rest, "_e.*", problem.alias("problem"))


def encode(events: DataFrame) -> Column:
    """One JSON text per event: unset fields are left out but a progress event's fraction, whose null has a meaning."""
    fields = [c for c in events.columns if c in {f.split()[0] for f in EVENT.split(", ")}]
    plain = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    lost = (F.col("type") == "progress") & F.col("fraction").isNull()
    return F.when(lost, F.regexp_replace(plain, r"\}$", ',"fraction":null}')).otherwise(plain)


def final_status(done: Column, exit_status: Column, timed_out: Column | None = None) -> Column:
    """Status of an ended job: a time-out overrides, then the done event, then the exit code."""
    own = F.when(done == "ok", "done").when(done == "cancelled", "cancelled").when(done == "failed", "failed").when(exit_status == 130, "cancelled").otherwise("failed")
    return own if timed_out is None else F.when(timed_out, "failed").otherwise(own)


def fold(events: DataFrame, order: Column) -> DataFrame:
    """State of each job after its events: progress sets stage, fraction, message; an error its code; done decides."""
    kind = F.col("type")
    last = lambda what, when: F.max_by(F.when(when, what), F.when(when, order))
    alive = kind.isin("progress", "heartbeat")
    progress = last(F.struct("stage", "fraction", "message"), kind == "progress")
    failure = last(F.struct("code", "message"), kind == "error")
    return events.groupBy("job_id").agg(
        progress.alias("p"), failure.alias("e"), last(F.col("status"), kind == "done").alias("done"), F.max(F.when(alive, F.col("ts"))).alias("last_sign"),
        F.count("*").alias("n_events"),
    ).select("job_id", "p.stage", "p.fraction", F.coalesce("e.message", "p.message").alias("message"), F.col("e.code").alias("code"), "done", "last_sign", "n_events")


def silences(events: DataFrame, key: str, ts: str = "ts", limit: int = WATCHDOG_SECONDS) -> DataFrame:
    """Gaps of more than ``limit`` seconds between an event of a key and the next."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    gap = (F.unix_micros(F.col("after").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return events.select(key, ts, after.alias("after")).withColumn("gap_s", gap).where(F.col("gap_s") > limit)


def cadence(events: DataFrame, key: str, ts: str = "ts", seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Events of a key in each window of ``seconds``."""
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def admitted(jobs: DataFrame, paused: bool = False, queue: str | None = None) -> DataFrame:
    """Queued jobs to start now (job_id, kind, status, pos): one GPU job and LIGHT_JOBS others may run at once, in queue order."""
    lane = [queue] if queue else []
    gpu = F.col("kind").isin(*GPU_KINDS)
    same = Window.partitionBy(*lane, "gpu")
    free = F.when(F.col("gpu"), 1).otherwise(LIGHT_JOBS) - F.count_if(F.col("status") == "running").over(same)
    turn = F.row_number().over(Window.partitionBy(*lane, "gpu", F.col("status") == "queued").orderBy("pos", "job_id"))
    rows = jobs.withColumn("gpu", gpu).withColumn("free", free).withColumn("turn", turn)
    return rows.where((F.col("status") == "queued") & (F.col("turn") <= F.col("free")) & F.lit(not paused)).drop("gpu", "free", "turn")


def recovered(jobs: DataFrame) -> DataFrame:
    """Interrupted jobs queue again."""
    return jobs.withColumn("status", F.when(F.col("status") == "interrupted", "queued").otherwise(F.col("status")))


def retried(jobs: DataFrame) -> DataFrame:
    """Failed jobs queue again without their code and message."""
    failed = F.col("status") == "failed"
    clear = {c: F.when(~failed, F.col(c)) for c in ("error_code", "message") if c in jobs.columns}
    return jobs.withColumns({**clear, "status": F.when(failed, "queued").otherwise(F.col("status"))})


def cancelled(jobs: DataFrame, ids: list[str]) -> DataFrame:
    """Queued and interrupted jobs of the list are cancelled at once; running ones are asked to stop."""
    asked = F.col("job_id").isin(*ids)
    waiting = F.col("status").isin("queued", "interrupted")
    return jobs.withColumns({"stop": asked & (F.col("status") == "running"), "status": F.when(asked & waiting, "cancelled").otherwise(F.col("status"))})


def device_fallback(requested: Column, actual: Column) -> Column:
    return ~requested.eqNullSafe(actual)


def latest_results(events: DataFrame, key: str, order: str) -> DataFrame:
    """Payload of the last result event and status of the last done event of each run."""
    kind = F.col("type")
    last = lambda what, name: F.max_by(F.when(kind == name, F.col(what)), F.when(kind == name, F.col(order)))
    return events.groupBy(key).agg(last("payload", "result").alias("payload"), last("status", "done").alias("status"))


# -- streaming -----------------------------------------------------------------------------------------------------------

STATE = "job_id string, stage string, fraction double, code string, status string, n_events long"
#: transformWithState needs this provider.
STREAM_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class JobFold(StatefulProcessor):
    """Keeps a job's state; a timer that no sign of life renews fails the job with watchdog_timeout."""

    def __init__(self, limit_s: int = WATCHDOG_SECONDS):
        self.limit_ms = limit_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "stage string, fraction double, code string, status string, n long, at double")

    def _get(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, None, None, "running", 0, -1.0]

    def _row(self, job: str, s: list) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [job], "stage": [s[0]], "fraction": [s[1]], "code": [s[2]], "status": [s[3]], "n_events": [s[4]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self._get()
        for part in rows:
            for x in part.sort_values("order").itertuples():
                s[4] += 1
                if s[3] != "running":
                    continue
                if x.type == "progress":
                    s[0], s[1] = x.stage, None if pd.isna(x.fraction) else float(x.fraction)
                elif x.type == "error":
                    s[2] = x.code
                elif x.type == "done":
                    s[3] = {"ok": "done", "cancelled": "cancelled"}.get(x.status, "failed")
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s[3] == "running":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        self.state.update(tuple(s))
        yield self._row(key[0], s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._get()
        if s[3] == "running":
            s[2], s[3] = "watchdog_timeout", "failed"
            self.state.update(tuple(s))
            yield self._row(key[0], s)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, limit_s: int = WATCHDOG_SECONDS) -> DataFrame:
    """Streaming form of :func:`fold`, in update mode; ``events`` has job_id, type, stage, fraction, code, status and order."""
    return events.groupBy("job_id").transformWithStateInPandas(JobFold(limit_s), STATE, outputMode="Update", timeMode="ProcessingTime")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: int = WATCHDOG_SECONDS, late: str = "1 hour") -> DataFrame:
    """Runs of events without a silence over ``gap`` (extension: a watermark bounds the state of a stream)."""
    at = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    at = at.withWatermark("_ts", late) if events.isStreaming else at
    return at.groupBy(key, F.session_window("_ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
