import hashlib
import hmac
import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixture_project as fx
from cohortica import schema
from cohortica.functions import scalars as S
from cohortica.operators import audit, extensions, geometry, voxels
from cohortica.sinks import store
from cohortica.sinks import tables as sinks
from cohortica.sources import files, project, sqlite
from cohortica.streaming import events as E


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_names(spark):
    assert one(spark, S.sanitize(F.lit("Vertebra L3")), S.sanitize(F.lit("  heart--left atrium "))) == ("vertebra_l3", "heart_left_atrium")
    with pytest.raises(Exception, match="nothing remains"):
        one(spark, S.sanitize(F.lit("---")))
    with pytest.raises(ValueError):
        S.sanitize_name("---")
    assert one(spark, S.model_key(F.lit("preclin_ct_legs")), S.model_key(F.lit("clin_pt_fdg_brain_v1")), S.model_key(F.lit("clin_ct_ribs"))) == ("preclin_ct_legs", "clin_pt_fdg_brain_v1", "ribs")
    assert one(spark, S.display_name(F.lit("kidney_left")), S.display_name(F.lit("vertebra_L3")), S.display_name(F.lit("__"))) == ("Kidney left", "Vertebra L3", "__")
    assert one(spark, S.pseudonym(F.lit(1)), S.pseudonym(F.lit(12345))) == ("P0001", "P12345")
    with pytest.raises(ValueError):
        S.wide_column("a", "b", "c", 0)


def test_dates_and_ages(spark):
    d = lambda t: F.date_format(S.lenient_date(F.lit(t)), "yyyy-MM-dd")
    assert one(spark, *map(d, ("2020-01-10", "20210305", "2020", "2020-1-5", "not a date", "2021-02-30", "20211340"))) == ("2020-01-10", "2021-03-05", None, None, None, None, None)
    age = lambda b, x: S.age_in_years(F.lit(b).cast("date"), F.lit(x).cast("date"))
    assert one(spark, age("1960-06-15", "2024-06-14"), age("1960-06-15", "2024-06-15"), age("2000-02-29", "2023-02-28")) == (63, 64, 22)
    assert one(spark, S.dicom_age(F.lit("045Y")), S.dicom_age(F.lit(" 006m")), S.dicom_age(F.lit("45"))) == (45.0, 0.5, None)


def test_numbers_and_keys(spark):
    assert one(spark, S.finite(F.lit(float("nan"))), S.finite(F.lit(float("inf"))), S.finite(F.lit(1.5))) == (None, None, 1.5)
    level = lambda hu: S.window_level(F.lit(float(hu)), F.lit(40.0), F.lit(400.0))
    assert one(spark, level(-160), level(240), level(-999), level(40)) == (0, 255, 0, 128)
    key = bytes(range(32))
    assert one(spark, S.hashed_uid(F.lit(" 1.2 "), key))[0] == hmac.new(key, b"1.2", hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        S.hashed_uid(F.lit("x"), b"short")
    assert sinks.csv_value(1e7) == "10000000.0" and sinks.csv_value(0.0001) == "0.0001" and sinks.csv_value(float("nan")) == "" and sinks.csv_value("=1", True) == "'=1"


def test_licences(spark):
    def case(expression, classifiers, text):
        licence = S.classify_licence(F.lit(expression).cast("string"), F.array(*map(F.lit, classifiers)).cast("array<string>"), F.lit(text).cast("string"))
        return one(spark, licence, S.licence_verdict(licence, F.lit(False)))

    assert case("MIT", [], None) == ("MIT", "ok")
    assert case(None, ["License :: OSI Approved :: BSD License"], None) == ("BSD", "ok")
    assert case(None, [], "Apache License\n Version 2.0, January 2004\n more") == ("Apache-2.0", "ok")
    assert case("GPL-3.0", [], None)[1] == "not allowed" and case("LGPL-3.0", [], None)[1] == "needs approval"
    assert case("MIT OR GPL-3.0", [], None)[1] == "ok" and case("Apache-2.0 WITH LLVM-exception", [], None)[1] == "ok"
    assert case(None, [], None) == ("UNKNOWN", "not recognised")
    for expression, want in (
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", "ok"), ("Apache-2.0 OR BSD-3-Clause", "ok"), ("MIT AND GPL-3.0", "not allowed"), ("GPL-2.0 OR AGPL-3.0", "not allowed"),
        ("LGPL-2.1 OR GPL-2.0", "not allowed"), ("LGPL-2.1 AND MIT", "needs approval"), ("Dual GPL/MIT", "not allowed"), ("Own-1.0 OR MIT", "not recognised"), ("MPL-2.0", "ok"),
    ):
        assert case(expression, [], None)[1] == want, expression


Z, Y, X = 20, 30, 40


def volume(spark, label, hu=None, spacing=(1.0, 1.0, 2.0)):
    hu = np.full((Z, Y, X), -1000.0) if hu is None else hu
    z, y, x = np.nonzero(label)
    rows = [("v", int(a), int(b), int(c), float(hu[a, b, c]), int(label[a, b, c])) for a, b, c in zip(z, y, x, strict=True)]
    voxels_ = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, hu double, label int")
    return voxels_, spark.createDataFrame([("v", X, Y, Z, *spacing)], "volume_id string, nx int, ny int, nz int, sx double, sy double, sz double")


def test_metrics(spark):
    label = np.zeros((Z, Y, X), int)
    label[5:15, 5:15, 5:15] = 1
    label[3, 0:10, 0:10] = 2
    label[18, 20, 20:25] = 3
    label[10, 25, 25] = 4
    hu = np.random.default_rng(1).normal(40, 10, (Z, Y, X)).round()
    asked = spark.createDataFrame([(1, 9), (2, 1), (3, 3), (4, 4), (5, 2)], "pos int, label int")
    got = voxels.label_metrics(*volume(spark, label, hu), asked).collect()
    assert [r.label for r in got] == [9, 1, 3, 4, 2]
    absent, first, third, single, edge = got
    assert (absent.voxel_count, absent.volume_ml, absent.hu_mean, absent.touches_border, absent.flags) == (0, 0.0, None, False, ["empty_label"])
    assert (first.voxel_count, first.volume_ml, first.flags) == (1000, 2.0, [])
    values = hu[label == 1]
    assert np.allclose([first.hu_mean, first.hu_sd, first.hu_median, first.hu_p05, first.hu_p95], [values.mean(), values.std(ddof=1), *np.percentile(values, [50, 5, 95])])
    assert (single.voxel_count, single.hu_sd) == (1, None) and edge.touches_border and edge.flags == ["truncated"] and not third.touches_border
    with pytest.raises(Exception, match="spacing"):
        voxels.label_metrics(*volume(spark, label, hu, (0.0, 1.0, 1.0)), asked).collect()
    assert voxels.summary(voxels.label_metrics(*volume(spark, label, hu), asked)).first().present == 4


def test_agreement(spark):
    pairs = spark.createDataFrame([("v", 1, 1)] * 99 + [("v", 1, 2), ("v", 2, 2), ("v", 0, 0)], "volume_id string, a int, b int")
    got = {r.label: (round(r.dice, 6), round(r.difference_pct, 6)) for r in voxels.agreement(pairs).collect()}
    assert got == {1: (round(198 / 199, 6), round(100 / 99, 6)), 2: (round(2 / 3, 6), -50.0)}
    low = voxels.below_threshold(voxels.agreement(pairs)).first()
    assert low.below == [1, 2] and not low.identical


def test_planes_are_inverse(spark):
    grid = [(p, n, c, r, s) for p in geometry.PLANES for n in (True, False) for c in range(3) for r in range(3) for s in range(3)]
    df = spark.createDataFrame(grid, "plane string, neuro boolean, c int, r int, s int")
    n = (F.lit(3), F.lit(3), F.lit(3))
    df = df.withColumn("v", geometry.voxel_of(F.col("plane"), F.col("neuro"), F.col("c"), F.col("r"), F.col("s"), *n))
    df = df.withColumn("p", geometry.pixel_of(F.col("plane"), F.col("neuro"), F.col("v.i"), F.col("v.j"), F.col("v.k"), *n))
    assert df.where("p.column <> c or p.row <> r or p.slice <> s").count() == 0
    with pytest.raises(ValueError):
        geometry.extract_slice(df, df, "oblique", 0)


def test_audits(spark):
    manifest = spark.createDataFrame([("m", "a", "1"), ("m", "b", "2"), ("m", "c", "3")], "name string, path string, sha256 string")
    found = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, sha256 string")
    assert [tuple(r) for r in audit.manifest_mismatches(manifest, found).collect()] == [("m", "b", "differs"), ("m", "c", "missing")]
    inverted = one(spark, audit.invert_labels(F.create_map(F.lit("background"), F.lit("0"), F.lit("liver"), F.lit("1"))))[0]
    assert inverted == {1: "liver"}
    slices = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 3.0), ("b", 0.0), ("b", 1.0)], "s string, z double")
    assert [r.s for r in extensions.spacing_irregular(slices, "s", "z").collect()] == ["a"]


def test_schema_checks(spark):
    tables = fx.tables(spark)
    assert schema.private_columns(tables) == []
    assert schema.violations(tables).count() == 0
    tables["patients"] = tables["patients"].union(spark.createDataFrame([("px", "A-11", "X", None)], schema.struct("patients")))
    assert {(r["table"], r.rule) for r in schema.violations(tables).collect()} == {("patients", "unique pseudonym"), ("patients", "sex values")}


def test_sqlite_and_parquet_read_the_same(spark, tmp_path):
    path = tmp_path / "project.sqlite"
    db = sqlite3.connect(path)
    for name, data in fx.rows().items():
        fields = schema.struct(name).fields
        db.execute(f"CREATE TABLE {name} ({', '.join(f.name for f in fields)})")
        db.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(fields))})", data)
    db.commit()
    db.close()
    got = sqlite.read(spark, str(path), fx.RUN)
    assert [r.patient_id for r in got["identifiers"].orderBy("patient_key").collect()] == ["0077", "2E3", "9"]
    project.write_parquet({k: v for k, v in fx.tables(spark).items()}, str(tmp_path / "p"))
    again = project.read_parquet(spark, str(tmp_path / "p"))
    for name in ("series", "results", "qc", "jobs", "patients"):
        cols = got[name].columns
        assert sorted(map(str, got[name].select(cols).collect())) == sorted(map(str, again[name].select(cols).collect()))
    plan = project.project(again, fx.RUN).results._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "run_id" in plan


def test_store_writes(spark, tmp_path):
    folder = str(tmp_path / "p")
    project.write_parquet(fx.tables(spark), folder)
    assert store.remove_identifiers(spark, folder, 1, "me", "2026-01-01T00:00:00Z") == 3
    again = project.read_parquet(spark, folder)
    assert again["identifiers"].count() == 0 and json.loads(again["audit_log"].first().details_json) == {"rows": 3}
    store.add_source(spark, folder, 2, None, "/secret/path/name", "2026-01-01T00:00:00Z")
    got = project.read_parquet(spark, folder)["sources"]
    assert {r.display_path for r in got.collect()} == {"share", "name"} and store.source_bookmarks(got).count() == 1


LINES = [
    '{"type":"hello","protocol_version":1,"versions":{"a":"1"}}', '{"type":"progress","job_id":"j","stage":"segment","fraction":0.5,"message":"m"}',
    '{"type":"progress","job_id":"j","stage":"segment","fraction":null,"message":"m"}', '{"type":"heartbeat","job_id":"j","ts":"2026-01-01T00:00:00Z"}', "",
    '{"type":"nope"}', '{"type":"progress","job_id":"j","stage":"x","fraction":0.5,"message":"m"}', '{"type":"progress","job_id":"j","stage":"check","fraction":1.5,"message":"m"}',
    '{"type":"progress","job_id":"j","stage":"check","message":"m"}', "broken",
]


def test_event_lines(spark, tmp_path):
    (tmp_path / "events_organs__r2.jsonl").write_text("\n".join(LINES))
    got = files.event_files(spark, str(tmp_path / "events_*.jsonl")).orderBy("line").collect()
    assert [r.problem for r in got] == [None, None, None, None, "unknown type", "unknown stage", "fraction out of range", "no fraction", "no event"]
    assert {(r.model_tag, r.run_tag) for r in got} == {("organs", "r2")}


def test_jobs_and_admission(spark):
    jobs = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, job_id string, kind string, status string")
    start = lambda rows, **how: [r.job_id for r in E.admitted(jobs(rows), **how).collect()]
    assert start([("a", "segment", "running"), ("b", "segment", "queued"), ("c", "index", "queued")]) == ["c"]
    assert start([("a", "index", "running"), ("b", "export", "queued"), ("c", "index", "queued")]) == ["b"]
    assert start([("b", "export", "queued")], paused=True) == []
    assert files.job('{"protocol_version":1,"job_id":"a","kind":"export","project_dir":"/p"}')["kind"] == "export"
    for bad in ("{", "{}", '{"protocol_version":2,"job_id":"a","kind":"export","project_dir":"/p"}', '{"protocol_version":1,"job_id":"a","kind":"x","project_dir":"/p"}'):
        with pytest.raises(files.JobError):
            files.job(bad)
    assert files.inside("/p", "a/../b") == "/p/b"
    with pytest.raises(files.JobError):
        files.inside("/p", "../q")


def test_stream_equals_batch(spark, tmp_path):
    rows = [("j1", "progress", "check", 0.1, None, None), ("j2", "heartbeat", None, None, None, None), ("j1", "error", None, None, "bad", None), ("j1", "done", None, None, None, "failed"), ("j2", "done", None, None, None, "ok")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "order long, job_id string, type string, stage string, fraction double, code string, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.fold_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("jobs_fold").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.job_id: (r.stage, r.code, r.status, r.n_events) for r in spark.table("jobs_fold").collect()}
    batch = E.fold(df.withColumn("ts", F.lit(None).cast("string")).withColumn("message", F.lit("")), F.col("order"))
    same = {r.job_id: (r.stage, r.code, one(spark, E.final_status(F.lit(r.done), F.lit(1)))[0], r.n_events) for r in batch.collect()}
    assert got == same == {"j1": ("check", "bad", "failed", 3), "j2": (None, None, "done", 2)}


def test_nifti(spark, tmp_path):
    array = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 4, 3, 2, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 4, 16)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.5, 2, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    (tmp_path / "a.nii").write_bytes(bytes(head) + array.tobytes())
    rows = files.volumes(spark, str(tmp_path / "*.nii"))
    assert rows.count() == 6 and files.voxels(rows).count() == 24
    assert [r.hu for r in files.voxels(rows).orderBy("z", "y", "x").collect()] == list(map(float, range(24)))
    grid = files.grids(rows).first()
    assert (grid.nx, grid.ny, grid.nz, grid.sx, grid.sz) == (4, 3, 2, 0.5, 2.0)
