"""Queries over events and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortica.plans.driver_tables import table
from cohortica.streaming import events as E

QUERIES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


# Events of the driver as worker events: the user is the job.
def _events(spark, sf):
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "progress", "view", "heartbeat", "error", "error", "signup", "log", "purchase", "done")]), F.col("event_type"))
    rows = table(spark, sf, "events").withColumn("type", kind)
    on = lambda t, c: F.when(F.col("type") == t, c)
    k = F.col("event_id")
    return rows.select(
        k.alias("order"), F.col("ts"), "type", F.col("user_id").cast("string").alias("job_id"), on("progress", F.element_at(F.array(*map(F.lit, E.STAGES)), (k % 8 + 1).cast("int"))).alias("stage"),
        on("progress", F.when(k % 5 > 0, (k % 100) / 100)).alias("fraction"), on("progress", F.concat(F.lit("m"), k)).alias("message"), on("error", F.concat(F.lit("c"), k % 9)).alias("code"),
        on("done", F.when(k % 3 == 0, "ok").when(k % 3 == 1, "failed").otherwise("cancelled")).alias("status"),
    )


EVENTS = """ev AS (SELECT event_id AS o, ts, CASE event_type WHEN 'click' THEN 'progress' WHEN 'view' THEN 'heartbeat' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'log' ELSE 'done' END AS type, CAST(user_id AS STRING) AS job_id,
 ['index','convert','check','segment','metrics','viewer_cache','export','selftest'][event_id % 8 + 1] AS stage, CASE WHEN event_id % 5 > 0 THEN (event_id % 100) / 100.0 END AS fraction, 'm' || event_id AS message, 'c' || (event_id % 9) AS code,
 CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'cancelled' END AS status FROM events)"""


@_query("q_j3_job_state", f"""WITH {EVENTS} SELECT job_id, arg_max(stage, o) FILTER (type = 'progress') AS stage, round(arg_max_null(fraction, o) FILTER (type = 'progress'), 6)::DOUBLE AS fraction, arg_max(message, o) FILTER (type = 'progress') AS message,
  arg_max(code, o) FILTER (type = 'error') AS code, arg_max(status, o) FILTER (type = 'done') AS done, count(*) AS n_events FROM ev GROUP BY job_id""")
def _(spark, sf):
    return E.fold(_events(spark, sf), F.col("order")).select("job_id", "stage", F.round("fraction", 6).alias("fraction"), "message", "code", "done", "n_events")


@_query("q_j4_final_status", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 4 = 0 THEN 'done' WHEN event_id % 4 = 1 THEN 'cancelled' WHEN event_id % 4 = 2 THEN 'failed' WHEN event_id % 8 = 3 THEN 'cancelled' ELSE 'failed' END AS status FROM events""")
def _(spark, sf):
    k = F.col("event_id")
    done = F.when(k % 4 == 0, "ok").when(k % 4 == 1, "cancelled").when(k % 4 == 2, "failed")
    return table(spark, sf, "events").select("event_id", E.final_status(done, F.when(k % 8 == 3, 130).otherwise(1), k % 11 == 0).alias("status"))


def _stamp(*cols):
    return {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in cols}


@_query("q_j5_watchdog", """SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, strftime(after, '%Y-%m-%d %H:%M:%S.%f') AS after, (epoch_us(after) - epoch_us(ts)) / 1e6 AS gap_s
 FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events) WHERE epoch_us(after) - epoch_us(ts) > 300000000""")
def _(spark, sf):
    return E.silences(table(spark, sf, "events"), "user_id").withColumns(_stamp("ts", "after"))


@_query("q_j6_cadence", "SELECT user_id, strftime(time_bucket(INTERVAL '10 seconds', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return E.cadence(table(spark, sf, "events"), "user_id").withColumns(_stamp("window_start"))


def _jobs(spark, sf):
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("segment", "index", "export", "selftest", "convert"))), (k % 5 + 1).cast("int"))
    status = F.when(k % 17 == 0, "running").when(k % 3 == 0, "done").when(k % 7 == 0, "interrupted").when(k % 13 == 0, "failed").otherwise("queued")
    return table(spark, sf, "events").select(F.col("user_id").alias("queue"), k.alias("job_id"), k.alias("pos"), kind.alias("kind"), status.alias("status"), F.concat(F.lit("c"), k % 9).alias("error_code"))


JOBS = """jobs AS (SELECT user_id AS queue, event_id AS job_id, ['segment','index','export','selftest','convert'][event_id % 5 + 1] AS kind,
 CASE WHEN event_id % 17 = 0 THEN 'running' WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 7 = 0 THEN 'interrupted' WHEN event_id % 13 = 0 THEN 'failed' ELSE 'queued' END AS status, 'c' || event_id % 9 AS error_code FROM events)"""


@_query("q_j7_admission", f"""WITH {JOBS}, r AS (SELECT *, kind IN ('segment', 'selftest') AS gpu FROM jobs),
 f AS (SELECT *, (CASE WHEN gpu THEN 1 ELSE 2 END) - count(*) FILTER (status = 'running') OVER (PARTITION BY queue, gpu) AS free, row_number() OVER (PARTITION BY queue, gpu, status = 'queued' ORDER BY job_id) AS turn FROM r)
 SELECT queue, job_id, kind FROM f WHERE status = 'queued' AND turn <= free""")
def _(spark, sf):
    return E.admitted(_jobs(spark, sf), queue="queue").select("queue", "job_id", "kind")


@_query("q_j8_j9_transitions", f"""WITH {JOBS} SELECT job_id, CASE WHEN status IN ('interrupted', 'failed') THEN 'queued' ELSE status END AS retried, CASE WHEN status <> 'failed' THEN error_code END AS error_code,
 CASE WHEN job_id IN (1, 7, 14, 17) AND status IN ('queued', 'interrupted') THEN 'cancelled' ELSE status END AS cancelled, job_id IN (1, 7, 14, 17) AND status = 'running' AS stop FROM jobs""")
def _(spark, sf):
    jobs = _jobs(spark, sf)
    again = E.retried(E.recovered(jobs)).select("job_id", F.col("status").alias("retried"), "error_code")
    gone = E.cancelled(jobs.withColumn("job_id", F.col("job_id").cast("string")), ["1", "7", "14", "17"]).select(F.col("job_id").cast("long").alias("job_id"), F.col("status").alias("cancelled"), "stop")
    return again.join(gone, "job_id")


@_query("q_j12_device_fallback", "SELECT event_id, event_type <> 'view' AS fell_back FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", E.device_fallback(F.lit("view"), F.col("event_type")).alias("fell_back"))


@_query("q_j1_a10_event_decode", """SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'unknown type' WHEN 2 THEN 'unknown stage' WHEN 3 THEN 'fraction out of range' WHEN 4 THEN 'no fraction' WHEN 5 THEN 'no event' END AS problem,
  CASE event_id % 6 WHEN 0 THEN 'progress' WHEN 1 THEN 'other' WHEN 5 THEN NULL ELSE 'progress' END AS type FROM events""")
def _(spark, sf):
    k = F.col("event_id") % 6
    line = (
        F.when(k == 0, '{"type":"progress","job_id":"a","stage":"segment","fraction":null,"message":"x"}').when(k == 1, '{"type":"other"}')
        .when(k == 2, '{"type":"progress","job_id":"a","stage":"nowhere","fraction":0.5,"message":"x"}').when(k == 3, '{"type":"progress","job_id":"a","stage":"check","fraction":1.5,"message":"x"}')
        .when(k == 4, '{"type":"progress","job_id":"a","stage":"check","message":"x"}').otherwise("{broken")
    )
    return E.decode(table(spark, sf, "events").select("event_id", line.alias("value"))).select("event_id", "problem", "type")


@_query("q_b11_event_json", """SELECT event_id, CASE WHEN event_type = 'click' THEN '{"type":"progress","job_id":"' || user_id || '","stage":"check"' || CASE WHEN event_id % 5 > 0 THEN ',"fraction":0.5}' ELSE ',"fraction":null}' END ELSE '{"type":"heartbeat","job_id":"' || user_id || '"}' END AS line FROM events""")
def _(spark, sf):
    progress = F.col("event_type") == "click"
    rows = table(spark, sf, "events").select("event_id", F.when(progress, "progress").otherwise("heartbeat").alias("type"), F.col("user_id").cast("string").alias("job_id"), F.when(progress, "check").alias("stage"),
                                             F.when(progress & (F.col("event_id") % 5 > 0), 0.5).alias("fraction"))
    return rows.select("event_id", E.encode(rows).alias("line"))


@_query("q_a18_latest_result", f"""WITH {EVENTS} SELECT job_id, arg_max(message, o) FILTER (type = 'log') AS payload, arg_max(status, o) FILTER (type = 'done') AS status FROM ev GROUP BY job_id""")
def _(spark, sf):
    rows = _events(spark, sf).withColumn("payload", F.concat(F.lit("m"), "order")).withColumn("type", F.when(F.col("type") == "log", "result").otherwise(F.col("type")))
    return E.latest_results(rows, "job_id", "order")


def _sessions(spark, sf):
    return E.sessions(table(spark, sf, "events"), "user_id")


@_query("q_x_sessions", """WITH g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL '300 seconds' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events))
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL '300 seconds', '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def _(spark, sf):
    return _sessions(spark, sf).withColumns(_stamp("start", "end"))
