"""Queries over the store and the cohort export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortica import schema
from cohortica.operators import layouts, qc, sheets, spine, status
from cohortica.options import Options, parse
from cohortica.plans import export
from cohortica.plans.driver_tables import oracle, project, view
from cohortica.sources.project import models_frame, versions_frame

QUERIES: dict = {}
_ALL = parse({"multiple_series": "all", "row_level": "series"})


def _query(name: str, *views: str, sql: str | None = None, cte: str = ""):
    def add(run):
        text = oracle(f"WITH {cte},\n{sql.strip()[5:]}" if cte and sql.strip()[:5] == "WITH " else f"WITH {cte}\n{sql}" if cte else sql, *views) if sql else None
        QUERIES[name] = (run, text)
        return run

    return add


def _text(df, *cols):
    """Nullable whole numbers as text, so that no reader turns them into floats."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


_STORE = ("patients", "identifiers", "studies", "series", "results")
_FULL = (*_STORE, "qc", "jobs")
DATE = r"CASE WHEN regexp_matches(study_date, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(study_date AS DATE) WHEN regexp_matches(study_date, '^\d{8}$') THEN CAST(try_strptime(study_date, '%Y%m%d') AS DATE) END"
SLOTS = f"""
elig AS (SELECT s.* FROM series s WHERE selected OR EXISTS (SELECT 1 FROM results r WHERE r.series_key = s.series_key)),
good AS (SELECT study_key, patient_key, {DATE} AS d FROM studies WHERE study_key IN (SELECT study_key FROM elig)),
tp AS (SELECT *, row_number() OVER (PARTITION BY patient_key ORDER BY d NULLS LAST, study_key) AS timepoint, count(*) OVER (PARTITION BY patient_key) AS n_studies,
         min(d) OVER (PARTITION BY patient_key) AS d0 FROM good),
slots AS (SELECT p.pseudonym, i.patient_id, p.sex, p.age_at_first_study, tp.timepoint, tp.n_studies, tp.d, date_diff('day', tp.d0, tp.d) AS day, e.*,
            row_number() OVER (PARTITION BY e.study_key ORDER BY e.is_primary DESC, e.series_key) AS series_index
          FROM elig e JOIN tp USING (study_key) JOIN patients p USING (patient_key) LEFT JOIN identifiers i USING (patient_key))"""
FACTS = SLOTS + """,
last_qc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_key, model, label_id ORDER BY "at" DESC, id DESC) AS rn FROM qc) WHERE rn = 1),
own_qc AS (SELECT * FROM last_qc WHERE model IS NULL AND label_id IS NULL),
model_qc AS (SELECT * FROM last_qc WHERE model IS NOT NULL AND label_id IS NULL AND status = 'rejected'),
label_qc AS (SELECT * FROM last_qc WHERE model IS NOT NULL AND label_id IS NOT NULL AND status = 'label_excluded'),
dev AS (SELECT series_key, device FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY model, label_id) AS rn FROM results) WHERE rn = 1),
failed AS (SELECT series_key, coalesce(nullif(error_code, ''), 'failed') AS code FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY queued_at DESC, job_id DESC) AS rn FROM jobs WHERE status = 'failed') WHERE rn = 1),
runtime AS (SELECT series_key, sum(epoch(CAST(ended_at AS TIMESTAMP)) - epoch(CAST(started_at AS TIMESTAMP))) AS s FROM jobs WHERE status = 'done' GROUP BY series_key),
models AS (SELECT * FROM (VALUES (0, 'clin_ct_organs', 'organs'), (1, 'clin_ct_body_composition', 'body_composition')) t(pos, model, key)),
labels_dim AS (SELECT * FROM (VALUES (0, 1, 'liver'), (0, 2, 'spleen'), (0, 3, 'kidney_left'), (1, 1, 'skeletal_muscle'), (1, 2, 'subcutaneous_fat'), (1, 3, 'visceral_fat')) t(pos, label_id, label)),
facts AS (SELECT slots.*, coalesce(own_qc.status, 'unreviewed') AS qc_status, own_qc.reviewer, own_qc."at", own_qc.comment, dev.device, failed.code, runtime.s AS runtime_s
          FROM slots LEFT JOIN own_qc USING (series_key) LEFT JOIN dev USING (series_key) LEFT JOIN failed USING (series_key) LEFT JOIN runtime USING (series_key)),
states AS (SELECT f.*, m.pos, m.model, m.key, EXISTS (SELECT 1 FROM model_qc q WHERE q.series_key = f.series_key AND q.model = m.model) AS model_rejected,
             CASE WHEN f.qc_status = 'rejected' OR EXISTS (SELECT 1 FROM model_qc q WHERE q.series_key = f.series_key AND q.model = m.model) THEN 'excluded'
                  WHEN EXISTS (SELECT 1 FROM results r WHERE r.series_key = f.series_key AND r.model = m.model) THEN 'ok' WHEN f.code IS NOT NULL THEN 'failed' ELSE 'not_run' END AS status,
             CASE WHEN EXISTS (SELECT 1 FROM results r WHERE r.series_key = f.series_key AND r.model = m.model) THEN 'ok' WHEN f.code IS NOT NULL THEN 'failed' ELSE 'not_run' END AS open_status
           FROM facts f, models m)"""


# -- scans ---------------------------------------------------------------------------------------------------------------


@_query("q_a2_run_lookup", "runs", sql="SELECT run_id, created_at, device FROM runs WHERE run_id = 'R1'")
def _(spark, sf):
    return view(spark, sf, "runs").where("run_id = 'R1'").select("run_id", "created_at", "device")


@_query("q_a3_d1_patients_identifiers", "patients", "identifiers", sql="SELECT pseudonym, sex, patient_id FROM patients LEFT JOIN identifiers USING (patient_key)")
def _(spark, sf):
    return spine.patients(view(spark, sf, "patients"), view(spark, sf, "identifiers")).orderBy("pseudonym").select("pseudonym", "sex", "patient_id")


@_query("q_a4_studies_series", "studies", "series", sql="SELECT study_key, patient_key, series_key, part, is_primary FROM studies JOIN series USING (study_key)")
def _(spark, sf):
    return view(spark, sf, "studies").join(view(spark, sf, "series"), "study_key").select("study_key", "patient_key", "series_key", "part", "is_primary")


@_query("q_a5_results_scan", "results", sql="SELECT series_key, model, label_id, voxel_count, round(volume_ml, 6) AS volume_ml FROM results WHERE run_id = 'R1'")
def _(spark, sf):
    return view(spark, sf, "results").where("run_id = 'R1'").orderBy("series_key", "model", "label_id").select("series_key", "model", "label_id", "voxel_count", F.round("volume_ml", 6).alias("volume_ml"))


@_query("q_a6_qc_scan", "qc", sql='SELECT id, series_key, model, CAST(label_id AS STRING) AS label_id, status, "at" FROM qc')
def _(spark, sf):
    return _text(view(spark, sf, "qc").where("run_id = 'R1'").orderBy("at", "id").select("id", "series_key", "model", "label_id", "status", "at"), "label_id")


@_query("q_a7_jobs_scan", "jobs", sql="SELECT job_id, series_key, status, queued_at FROM jobs WHERE run_id = 'R1' AND series_key IS NOT NULL")
def _(spark, sf):
    return view(spark, sf, "jobs").where("run_id = 'R1' AND series_key IS NOT NULL").orderBy("queued_at", "job_id").select("job_id", "series_key", "status", "queued_at")


@_query("q_a8_models_decode", "runs", sql="""
SELECT CAST(mp AS INT) - 1 AS model_pos, json_extract_string(m, '$.name') AS model, CAST(k AS INT) AS label_id, json_extract_string(m, '$.labels.' || k) AS label, json_extract_string(m, '$.colors.' || k) AS color
FROM (SELECT m, mp, unnest(json_keys(m, '$.labels')) AS k FROM (SELECT unnest(CAST(models_json AS JSON[])) AS m, generate_subscripts(CAST(models_json AS JSON[]), 1) AS mp FROM runs))""")
def _(spark, sf):
    return models_frame(view(spark, sf, "runs")).select("model_pos", "model", "label_id", "label", "color")


@_query("q_a9_versions_decode", "runs", sql="SELECT k AS component, json_extract_string(versions_json, '$.' || k) AS version FROM (SELECT versions_json, unnest(json_keys(versions_json)) AS k FROM runs)")
def _(spark, sf):
    return versions_frame(view(spark, sf, "runs")).select("component", "version")


# -- joins, review, status -----------------------------------------------------------------------------------------------


@_query("q_d2_patients_studies_series", *_STORE, sql="SELECT pseudonym, study_key, series_key FROM patients JOIN studies USING (patient_key) JOIN series USING (study_key)")
def _(spark, sf):
    p = project(spark, sf)
    return p.patients.join(p.studies, "patient_key").join(p.series, "study_key").select("pseudonym", "study_key", "series_key")


@_query("q_d3_eligible_series", *_STORE, cte=SLOTS, sql="SELECT series_key, study_key, selected FROM elig")
def _(spark, sf):
    p = project(spark, sf)
    return spine.eligible(p.series, p.results).select("series_key", "study_key", "selected")


@_query("q_d4_studies_with_series", *_STORE, cte=SLOTS, sql="SELECT study_key, patient_key FROM good")
def _(spark, sf):
    p = project(spark, sf)
    return p.studies.join(spine.eligible(p.series, p.results), "study_key", "left_semi").select("study_key", "patient_key")


@_query("q_d10_results_presence", *_STORE, sql="SELECT DISTINCT series_key, model FROM results")
def _(spark, sf):
    return project(spark, sf).results.select("series_key", "model").distinct()


@_query("q_d12_not_rejected", *_FULL, cte=FACTS, sql="SELECT series_key, model FROM (SELECT DISTINCT series_key, model FROM results) r WHERE NOT EXISTS (SELECT 1 FROM model_qc q WHERE q.series_key = r.series_key AND q.model = r.model)")
def _(spark, sf):
    p = project(spark, sf)
    gone = qc.latest(p.qc).where("model IS NOT NULL AND label_id IS NULL AND status = 'rejected'").select("series_key", "model")
    return p.results.select("series_key", "model").distinct().join(gone, ["series_key", "model"], "left_anti")


@_query("q_e1_latest_decision", "qc", cte='last_qc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_key, model, label_id ORDER BY "at" DESC, id DESC) AS rn FROM qc) WHERE rn = 1)',
        sql='SELECT series_key, model, CAST(label_id AS STRING) AS label_id, status, reviewer, "at", comment FROM last_qc')
def _(spark, sf):
    return _text(qc.latest(view(spark, sf, "qc")), "label_id")


@_query("q_e2_e4_series_review", *_FULL, cte=FACTS, sql="""
SELECT series_key, coalesce(max(status) FILTER (model IS NULL AND label_id IS NULL), 'unreviewed') AS qc_status,
  array_to_string(list_sort(list_distinct(coalesce(list(model) FILTER (model IS NOT NULL AND label_id IS NULL AND status = 'rejected'), []))), ',') AS rejected,
  count(*) FILTER (model IS NOT NULL AND label_id IS NOT NULL AND status = 'label_excluded') AS n_excluded FROM last_qc GROUP BY series_key""")
def _(spark, sf):
    facts = qc.series_facts(qc.latest(view(spark, sf, "qc")))
    return facts.select("series_key", F.coalesce("qc_status", F.lit("unreviewed")).alias("qc_status"), F.array_join(F.array_sort("rejected_models"), ",").alias("rejected"), F.size("excluded_labels").cast("long").alias("n_excluded"))


@_query("q_e5_first_device", *_STORE, sql="SELECT series_key, device FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY model, label_id) AS rn FROM results) WHERE rn = 1")
def _(spark, sf):
    return status.devices(view(spark, sf, "results")).select("series_key", "device")


@_query("q_e6_e7_job_facts", *_FULL, cte=FACTS, sql="SELECT series_key, code AS failed_code, round(s, 3) AS runtime_s FROM (SELECT DISTINCT series_key FROM jobs) LEFT JOIN failed USING (series_key) LEFT JOIN runtime USING (series_key)")
def _(spark, sf):
    return status.job_facts(view(spark, sf, "jobs")).select("series_key", "failed_code", F.round("runtime_s", 3).alias("runtime_s"))


@_query("q_e8_model_status", *_FULL, cte=FACTS, sql="SELECT series_key, model, status, open_status FROM states")
def _(spark, sf):
    slots = export.slots(project(spark, sf), _ALL_SERIES)
    both = [F.struct(F.lit(m).alias("model"), status.model_status(F.lit(m), True).alias("status"), status.model_status(F.lit(m), False).alias("open_status")) for m in _NAMES]
    return slots.select("series_key", F.inline(F.array(*both)))


_ALL_SERIES = parse({"multiple_series": "all", "row_level": "series"})
_NAMES = ["clin_ct_organs", "clin_ct_body_composition"]


@_query("q_e11_e12_counts", *_FULL, cte=FACTS, sql="""
SELECT (SELECT count(*) FROM facts WHERE qc_status = 'rejected') AS excluded_series, count(DISTINCT series_key) FILTER (has) AS segmented,
  count(DISTINCT series_key) FILTER (has AND rev) AS reviewed, (SELECT string_agg(DISTINCT r.model, ',' ORDER BY r.model) FROM results r JOIN slots USING (series_key)) AS models
FROM (SELECT series_key, EXISTS (SELECT 1 FROM results r WHERE r.series_key = f.series_key) AS has, EXISTS (SELECT 1 FROM qc q WHERE q.series_key = f.series_key) AS rev FROM facts f)""")
def _(spark, sf):
    return status.counts(export.slots(project(spark, sf), _ALL_SERIES), _NAMES).withColumn("models", F.array_join("models", ","))


# -- spine and layouts ---------------------------------------------------------------------------------------------------

_SLOT = ["pseudonym", "study_key", "series_key", "timepoint", "n_studies", "day", "series_index"]


@_query("q_g1_slots", *_STORE, cte=SLOTS, sql="SELECT pseudonym, study_key, series_key, timepoint::INT AS timepoint, n_studies::INT AS n_studies, CAST(day AS STRING) AS day, series_index::INT AS series_index FROM slots")
def _(spark, sf):
    return _text(spine.slots(project(spark, sf), _ALL_SERIES).select(*_SLOT), "day")


@_query("q_f1_f5_last_study_primary", *_STORE, cte=SLOTS, sql="SELECT pseudonym, study_key, series_key, timepoint::INT AS timepoint, n_studies::INT AS n_studies, CAST(day AS STRING) AS day, series_index::INT AS series_index FROM slots WHERE timepoint = n_studies AND series_index = 1")
def _(spark, sf):
    return _text(spine.slots(project(spark, sf), parse({"multiple_studies": "last"})).select(*_SLOT), "day")


@_query("q_f3_first_study_subset", *_STORE, cte=SLOTS, sql="SELECT pseudonym, study_key, timepoint::INT AS timepoint FROM slots WHERE timepoint = 1 AND series_index = 1 AND pseudonym IN ('P0001', 'P0007', 'P0100')")
def _(spark, sf):
    return spine.slots(project(spark, sf), parse({"multiple_studies": "first", "patients": ["P0001", "P0007", "P0100", "nobody"]})).select("pseudonym", "study_key", "timepoint")


_LONG = """
SELECT st.pseudonym, st.timepoint::INT AS timepoint, CAST(st.day AS STRING) AS day, st.series_index::INT AS series, st.description AS series_description, st.key AS model, l.label_id, l.label,
  CAST(r.voxel_count AS STRING) AS voxel_count, round(r.volume_ml, 6) AS volume_ml, round(r.hu_mean, 6) AS hu_mean, CAST(r.touches_border AS STRING) AS touches_border, coalesce(r.flags, '') AS flags,
  CASE WHEN q.status IS NOT NULL THEN 'label_excluded' WHEN st.model_rejected THEN 'rejected' ELSE st.qc_status END AS qc_status, st.device, 'R1' AS run_id
FROM states st JOIN labels_dim l USING (pos) LEFT JOIN results r ON r.series_key = st.series_key AND r.model = st.model AND r.label_id = l.label_id
LEFT JOIN label_qc q ON q.series_key = st.series_key AND q.model = st.model AND q.label_id = l.label_id WHERE """


def _long(options):
    def run(spark, sf):
        p = project(spark, sf)
        rows = layouts.long(export.slots(p, options), p, options)
        return _text(rows, "day", "voxel_count", "touches_border").withColumns({c: F.round(c, 6) for c in ("volume_ml", "hu_mean")})

    return run


_METRIC = ["voxel_count", "volume_ml", "hu_mean", "touches_border"]
_query("q_g2_long", *_FULL, cte=FACTS, sql=_LONG + "st.status = 'ok' AND q.status IS NULL")(_long(parse({"layout": "long", "multiple_series": "all", "row_level": "series", "metrics": _METRIC})))
_query("q_g2_long_include", *_FULL, cte=FACTS, sql=_LONG + "st.open_status = 'ok'")(_long(parse({"layout": "long", "multiple_series": "all", "row_level": "series", "metrics": _METRIC, "qc": "include"})))
_query("q_d7_long_subset", *_FULL, cte=FACTS, sql=_LONG + "st.status = 'ok' AND q.status IS NULL AND l.label IN ('liver', 'visceral_fat') AND st.series_index = 1 AND st.timepoint = 1")(
    _long(parse({"layout": "long", "multiple_studies": "first", "labels": ["Liver", "visceral-fat", "unknown"], "metrics": _METRIC})))


def _wide_sql(keys: str, where: str) -> str:
    cells = []
    for key, labels in (("organs", ("liver", "spleen", "kidney_left")), ("body_composition", ("skeletal_muscle", "subcutaneous_fat", "visceral_fat"))):
        pos = 0 if key == "organs" else 1
        cells.append(f"max(st.status) FILTER (st.pos = {pos}) AS {key}__status")
        for i, label in enumerate(labels, 1):
            ok = f"st.pos = {pos} AND st.status = 'ok' AND r.label_id = {i} AND q.status IS NULL"
            cells += [f"CAST(max(r.voxel_count) FILTER ({ok}) AS STRING) AS {key}__{label}__voxel_count", f"round(max(r.hu_mean) FILTER ({ok}), 6) AS {key}__{label}__hu_mean"]
    return f"""
SELECT st.pseudonym, CAST(any_value(st.n_studies) AS INT) AS n_studies, any_value(st.sex) AS sex, round(any_value(st.age_at_first_study), 6) AS age_first_study, {keys}
  CAST(any_value(st.day) AS STRING) AS day, any_value(st.description) AS series_description, round(any_value(st.slice_thickness_mm), 6) AS slice_thickness_mm, any_value(st.kernel) AS kernel, any_value(st.device) AS device,
  any_value(st.qc_status) AS qc_status, 'R1' AS run_id, {', '.join(cells)}
FROM states st LEFT JOIN results r ON r.series_key = st.series_key AND r.model = st.model LEFT JOIN label_qc q ON q.series_key = st.series_key AND q.model = st.model AND q.label_id = r.label_id
WHERE {where} GROUP BY st.pseudonym, st.timepoint, st.series_index, st.series_key"""


def _wide(options):
    def run(spark, sf):
        p = project(spark, sf)
        rows = layouts.wide(export.slots(p, options), p, options)
        doubles = [c for c, k in rows.dtypes if k == "double"]
        return _text(rows, *[c for c in rows.columns if c.split("__")[0] == "day" or "voxel_count" in c]).withColumns({c: F.round(c, 6) for c in doubles})

    return run


_TWO = ["voxel_count", "hu_mean"]
_query("q_g3_g7_wide_last", *_FULL, cte=FACTS, sql=_wide_sql("", "st.timepoint = st.n_studies AND st.series_index = 1"))(_wide(parse({"multiple_studies": "last", "metrics": _TWO})))
_query("q_g3_g7_wide_study", *_FULL, cte=FACTS, sql=_wide_sql("CAST(st.timepoint AS INT) AS timepoint,", "st.series_index = 1"))(_wide(parse({"row_level": "study", "metrics": _TWO})))
_query("q_g3_g7_wide_series", *_FULL, cte=FACTS, sql=_wide_sql("CAST(st.timepoint AS INT) AS timepoint, CAST(st.series_index AS INT) AS series,", "true"))(_wide(parse({"row_level": "series", "multiple_series": "all", "metrics": _TWO})))


@_query("q_g4_g5_wide_suffix", *_FULL, cte=FACTS, sql="""
WITH own AS (SELECT * FROM states WHERE series_index = 1 AND pos = 0), spots AS (SELECT p.pseudonym, t.timepoint FROM (SELECT DISTINCT pseudonym FROM own) p, (SELECT DISTINCT timepoint FROM own) t),
got AS (SELECT own.pseudonym, own.timepoint, r.voxel_count FROM own JOIN results r ON r.series_key = own.series_key AND r.model = own.model AND r.label_id = 1
  LEFT JOIN label_qc q ON q.series_key = own.series_key AND q.model = own.model AND q.label_id = 1 WHERE own.status = 'ok' AND q.status IS NULL)
SELECT spots.pseudonym, 'organs__liver__voxel_count__t' || spots.timepoint AS "column", CAST(got.voxel_count AS STRING) AS value FROM spots LEFT JOIN got USING (pseudonym, timepoint)
UNION ALL SELECT spots.pseudonym, 'organs__status__t' || spots.timepoint, own.status FROM spots LEFT JOIN own USING (pseudonym, timepoint)""")
def _(spark, sf):
    """Cells and statuses of a block of columns per timepoint, a row a cell, since the columns are as many as the data has timepoints."""
    p, o = project(spark, sf), parse({"metrics": ["voxel_count"], "models": ["clin_ct_organs"], "labels": ["liver"]})
    rows = layouts.wide(export.slots(p, o), p, o)
    cells = [c for c in rows.columns if c.startswith("organs__")]
    return _text(rows, *cells).unpivot(["pseudonym"], cells, "column", "value")


@_query("q_e14_positions", *_STORE, cte=SLOTS, sql="SELECT CAST(row_number() OVER (ORDER BY timepoint, series_index) AS INT) AS n, CAST(timepoint AS INT) AS timepoint, CAST(series_index AS INT) AS series FROM (SELECT DISTINCT timepoint, series_index FROM slots)")
def _(spark, sf):
    o = parse({"multiple_series": "all"})
    places = layouts.positions(spine.slots(project(spark, sf), o), o)
    return spark.createDataFrame([(n, t, s) for n, (t, s) in enumerate(places, 1)], "n int, timepoint int, series int")


@_query("q_i1_f6_row_order", *_FULL, cte=FACTS, sql="""
SELECT st.pseudonym, CAST(st.timepoint AS INT) AS timepoint, CAST(st.series_index AS INT) AS series, st.key AS model, l.label_id, CAST(row_number() OVER (PARTITION BY st.pseudonym ORDER BY st.timepoint, st.series_index, st.pos, l.label_id) AS INT) AS row,
  CAST(dense_rank() OVER (PARTITION BY st.pseudonym[1:4] ORDER BY st.pseudonym) AS INT) AS person FROM states st JOIN labels_dim l USING (pos) WHERE st.open_status = 'ok'""")
def _(spark, sf):
    """Place of each row of the long layout as it comes: among the person's rows, and of the person among those whose names begin alike."""
    p, o = project(spark, sf), parse({"layout": "long", "multiple_series": "all", "row_level": "series", "metrics": ["voxel_count"], "qc": "include"})
    rows = layouts.long(export.slots(p, o), p, o).select("pseudonym", "timepoint", "series", "model", "label_id", F.monotonically_increasing_id().alias("_at"))
    own = Window.partitionBy("pseudonym")
    rows = rows.withColumns({"row": F.row_number().over(own.orderBy("_at")), "_first": F.min("_at").over(own)})
    return rows.withColumn("person", F.dense_rank().over(Window.partitionBy(F.substring("pseudonym", 1, 4)).orderBy("_first"))).drop("_at", "_first")


@_query("q_d8_d9_skeleton", *_FULL, cte=FACTS, sql="""
SELECT st.series_key, st.model, l.label_id, l.label, r.series_key IS NOT NULL AS found FROM states st JOIN labels_dim l USING (pos) LEFT JOIN results r ON r.series_key = st.series_key AND r.model = st.model AND r.label_id = l.label_id
LEFT JOIN label_qc q ON q.series_key = st.series_key AND q.model = st.model AND q.label_id = l.label_id WHERE st.status = 'ok' AND q.status IS NULL""")
def _(spark, sf):
    p = project(spark, sf)
    rows = layouts.values(export.slots(p, _ALL_SERIES), p, _ALL_SERIES, layouts.selected_labels(p.run, _ALL_SERIES))
    return rows.select("series_key", "model", "label_id", "label", F.col("voxel_count").isNotNull().alias("found"))


@_query("q_d5_patient_subset", *_STORE, cte=SLOTS, sql="SELECT pseudonym, series_key FROM slots WHERE pseudonym IN ('P0002', 'P0050', 'P0101')")
def _(spark, sf):
    return spine.slots(project(spark, sf), parse({"patients": ["P0101", "nobody", "P0002", "P0050"], "multiple_series": "all", "row_level": "series"})).select("pseudonym", "series_key")


_query("q_d6_model_subset", *_FULL, cte=FACTS, sql=_LONG + "st.open_status = 'ok' AND st.pos = 1")(
    _long(parse({"layout": "long", "multiple_series": "all", "row_level": "series", "metrics": _METRIC, "qc": "include", "models": ["clin_ct_body_composition"]})))


@_query("q_e9_e10_first_study", *_STORE, cte=SLOTS, sql="SELECT pseudonym, strftime(d, '%Y-%m-%d') AS first_study, CAST(n_studies AS INT) AS n_studies FROM slots WHERE timepoint = 1 AND series_index = 1")
def _(spark, sf):
    rows = spine.slots(project(spark, sf), parse({"multiple_studies": "first"}))
    return rows.select("pseudonym", F.date_format("study_date", "yyyy-MM-dd").alias("first_study"), "n_studies")


@_query("q_d11_d13_series_lookups", *_FULL, cte=FACTS, sql='SELECT series_key, qc_status, reviewer, "at", comment, device, code AS failed_code, round(runtime_s, 3) AS runtime_s FROM facts')
def _(spark, sf):
    rows = export.slots(project(spark, sf), _ALL_SERIES)
    return rows.select("series_key", "qc_status", F.col("qc_reviewer").alias("reviewer"), F.col("qc_at").alias("at"), F.col("qc_comment").alias("comment"), "device", "failed_code", F.round("runtime_s", 3).alias("runtime_s"))


@_query("q_e13_pivot_cells", *_FULL, cte=FACTS, sql="""
SELECT st.pseudonym, CAST(st.timepoint AS INT) AS timepoint, CAST(st.series_index AS INT) AS series, st.key || '__' || l.label || '__voxel_count' AS "column", CAST(r.voxel_count AS DOUBLE) AS value FROM states st JOIN labels_dim l USING (pos)
JOIN results r ON r.series_key = st.series_key AND r.model = st.model AND r.label_id = l.label_id LEFT JOIN label_qc q ON q.series_key = st.series_key AND q.model = st.model AND q.label_id = l.label_id WHERE st.status = 'ok' AND q.status IS NULL""")
def _(spark, sf):
    """Filled cells of the wide layout, turned back to a row each."""
    p, o = project(spark, sf), parse({"row_level": "series", "multiple_series": "all", "metrics": ["voxel_count"]})
    rows = layouts.wide(export.slots(p, o), p, o)
    return layouts.unpivot(rows, [c for c in rows.columns if c.endswith("__voxel_count")], ["pseudonym", "timepoint", "series"]).where("value IS NOT NULL")


@_query("q_g17_warnings", "patients", "identifiers", sql="""
SELECT CAST(1 AS INT) AS n, 'This export contains DICOM PatientIDs. Treat the file as identifying data.' AS warning
UNION ALL SELECT 2, 'Some patients have no stored PatientID (identifiers were removed); their cells are empty.' WHERE EXISTS (SELECT 1 FROM patients WHERE patient_key NOT IN (SELECT patient_key FROM identifiers WHERE patient_id IS NOT NULL))""")
def _(spark, sf):
    got = sheets.warnings(project(spark, sf), parse({"identifiers": "both"}))
    return spark.createDataFrame(list(enumerate(got, 1)), "n int, warning string")


@_query("q_g8_g9_identity_dates", *_STORE, cte=SLOTS, sql="SELECT pseudonym, patient_id, strftime(d, '%Y-%m-%d') AS study_date, CAST(year(d) AS STRING) AS year FROM slots WHERE series_index = 1")
def _(spark, sf):
    slots = spine.slots(project(spark, sf), parse({"row_level": "study"}))
    own, date = parse({"identifiers": "both", "dates": "iso"}), parse({"dates": "year"})
    return slots.select(*layouts.identity(own), layouts.date_column(own), layouts.date_column(date).cast("string").alias("year"))


# -- companion sheets ----------------------------------------------------------------------------------------------------


@_query("q_g10_series_sheet", *_FULL, cte=FACTS, sql="""
SELECT pseudonym, timepoint::INT AS timepoint, CAST(day AS STRING) AS day, series_index::INT AS series, is_primary AS primary, modality, description AS series_description, manufacturer, kernel, round(slice_thickness_mm, 6) AS slice_thickness_mm,
  CAST(pixel_spacing_mm AS DOUBLE) AS pixel_spacing_mm, kvp, contrast_agent, CAST(image_count AS STRING) AS image_count, qc_status, device, round(runtime_s, 3) AS runtime_s FROM facts""".replace("AS primary", 'AS "primary"'))
def _(spark, sf):
    rows = sheets.series_sheet(export.slots(project(spark, sf), _ALL_SERIES), _ALL_SERIES)
    return _text(rows, "day", "image_count").withColumns({"slice_thickness_mm": F.round("slice_thickness_mm", 6), "pixel_spacing_mm": F.col("pixel_spacing_mm").cast("double"), "runtime_s": F.round("runtime_s", 3)})


@_query("q_g11_qc_sheet", *_FULL, cte=FACTS, sql="""
SELECT pseudonym, timepoint::INT AS timepoint, series_index::INT AS series, NULL::STRING AS model, NULL::STRING AS label_id, NULL::STRING AS label, qc_status AS status, NULL::STRING AS flags, reviewer, "at", comment FROM facts
UNION ALL SELECT f.pseudonym, f.timepoint::INT, f.series_index::INT, m.key, CAST(q.label_id AS STRING), l.label, q.status, NULL, q.reviewer, q."at", q.comment FROM facts f JOIN last_qc q USING (series_key) JOIN models m USING (model) LEFT JOIN labels_dim l ON l.pos = m.pos AND l.label_id = q.label_id
UNION ALL SELECT f.pseudonym, f.timepoint::INT, f.series_index::INT, m.key, CAST(r.label_id AS STRING), l.label, NULL, r.flags, NULL, NULL, NULL FROM facts f JOIN results r USING (series_key) JOIN models m USING (model) JOIN labels_dim l ON l.pos = m.pos AND l.label_id = r.label_id WHERE r.flags <> ''""")
def _(spark, sf):
    p = project(spark, sf)
    return _text(sheets.qc_sheet(export.slots(p, _ALL_SERIES), p, _ALL_SERIES), "label_id")


@_query("q_g12_labels_sheet", *_FULL, cte=FACTS, sql="""
SELECT model, key AS model_key, label_id, label, upper(label[1]) || replace(label[2:], '_', ' ') AS display_name, CASE pos WHEN 1 THEN 'z-range of the L3 vertebra only (MOOSE workflow)' ELSE 'whole field of view' END AS region,
  CASE WHEN pos = 0 AND label_id = 1 THEN '#aa0000' END AS color, repeat(CASE pos WHEN 0 THEN 'a' ELSE 'b' END, 64) AS model_sha256 FROM models JOIN labels_dim USING (pos)""")
def _(spark, sf):
    return sheets.labels_sheet(spark, project(spark, sf).run, Options())


@_query("q_g13_e15_skipped_sheet", *_FULL, cte=FACTS, sql="""
WITH per AS (SELECT *, count(*) FILTER (status <> 'ok') OVER w AS bad, count(*) OVER w AS n, min(status) OVER w AS lo, max(status) OVER w AS hi FROM states WINDOW w AS (PARTITION BY series_key)),
why AS (SELECT *, bad = n AND lo = hi AS whole, CASE status WHEN 'failed' THEN 'failed: ' || code WHEN 'excluded' THEN 'excluded by QC' ELSE 'not run' END AS reason FROM per WHERE status <> 'ok')
SELECT pseudonym, timepoint::INT AS timepoint, series_index::INT AS series, description AS series_description, modality, CASE WHEN NOT whole THEN key END AS model, reason FROM why WHERE NOT whole OR pos = 0""")
def _(spark, sf):
    p = project(spark, sf)
    return sheets.skipped_sheet(export.slots(p, _ALL_SERIES), p.run, _ALL_SERIES)


def _dictionary(spark, sf):
    p = project(spark, sf)
    rows = export.slots(p, _ALL_SERIES)
    got = {"series": sheets.series_sheet(rows, _ALL_SERIES), "skipped": sheets.skipped_sheet(rows, p.run, _ALL_SERIES)}
    return sheets.dictionary(spark, got)


QUERIES["q_g14_dictionary"] = (_dictionary, None)


def _provenance(spark, sf):
    p = project(spark, sf)
    counted = status.counts(export.slots(p, _ALL_SERIES), _NAMES).first()
    words = sheets.Wording()
    return sheets.provenance_sheet(spark, p.run, _ALL_SERIES, "2026-01-02T00:00:00Z", sheets.methods_text(counted, p.run, words), words)


QUERIES["q_g15_g16_provenance"] = (_provenance, None)


@_query("q_b8_mask_list", *_FULL, cte=FACTS, sql="SELECT series_key, model, pseudonym || '_t' || timepoint || '_s' || series_index || '_' || key AS stem FROM states WHERE status = 'ok'")
def _(spark, sf):
    p = project(spark, sf)
    return sheets.masks(export.slots(p, _ALL_SERIES), p.run, _ALL_SERIES)


@_query("q_b10_export_summary", *_FULL, cte=FACTS, sql="SELECT count(*) AS rows, 17::BIGINT AS columns, (SELECT count(*) FROM facts WHERE qc_status = 'rejected') AS excluded_series FROM facts")
def _(spark, sf):
    rows = export.slots(project(spark, sf), _ALL_SERIES)
    n = len(sheets.series_sheet(rows, _ALL_SERIES).columns)
    return rows.agg(F.count("*").alias("rows"), F.lit(n).cast("long").alias("columns"), F.count_if(F.col("qc_status") == "rejected").alias("excluded_series"))


@_query("q_m1_constraints", "patients", "studies", "series", "qc", sql="""
SELECT 'patients' AS "table", 'unique patient_key' AS rule, patient_key AS key, count(*) AS n FROM patients GROUP BY patient_key HAVING count(*) > 1
UNION ALL SELECT 'patients', 'unique pseudonym', pseudonym, count(*) FROM patients GROUP BY pseudonym HAVING count(*) > 1
UNION ALL SELECT 'studies', 'unique study_key', study_key, count(*) FROM studies GROUP BY study_key HAVING count(*) > 1
UNION ALL SELECT 'studies', 'unique study_uid', study_uid, count(*) FROM studies GROUP BY study_uid HAVING count(*) > 1
UNION ALL SELECT 'studies', 'patient_key in patients', patient_key, count(*) FROM studies WHERE patient_key NOT IN (SELECT patient_key FROM patients) GROUP BY patient_key
UNION ALL SELECT 'series', 'unique series_key', series_key, count(*) FROM series GROUP BY series_key HAVING count(*) > 1
UNION ALL SELECT 'series', 'unique series_uid, part', series_uid || ' | ' || part, count(*) FROM series GROUP BY series_uid, part HAVING count(*) > 1
UNION ALL SELECT 'series', 'study_key in studies', study_key, count(*) FROM series WHERE study_key NOT IN (SELECT study_key FROM studies) GROUP BY study_key""")
def _(spark, sf):
    return schema.violations({t: view(spark, sf, t) for t in ("patients", "studies", "series")})
