import csv
import zipfile

import pytest
from pyspark.sql import functions as F

import fixture_project as fx
from cohortica.operators import layouts, sheets
from cohortica.options import OptionError, Options, parse
from cohortica.plans import export
from cohortica.sinks import tables as sinks
from cohortica.sources.project import UnknownRun, models_frame, project


@pytest.fixture(scope="module")
def cohort(spark):
    return project({k: v.cache() for k, v in fx.tables(spark).items()}, fx.RUN)


def wide(cohort, **raw):
    options = parse(raw)
    return layouts.wide(export.slots(cohort, options), cohort, options)


def by_patient(df):
    return {r["pseudonym"]: r.asDict() for r in df.collect()}


def test_unknown_run(spark):
    with pytest.raises(UnknownRun):
        project(fx.tables(spark), "nope")


def test_wide_default(cohort):
    df = wide(cohort)
    assert len(df.columns) == 4 + 2 * (7 + 2 * (1 + 3 * 10)) == 142
    rows = by_patient(df)
    assert list(rows) == ["A-11", "A-12", "A-13", "A-14"]
    one = rows["A-11"]
    assert (one["n_studies"], one["day__t1"], one["day__t2"]) == (2, 0, 89)
    assert (one["organs__heart__voxel_count__t1"], one["organs__heart__voxel_count__t2"], one["organs__heart__volume_ml__t2"]) == (fx.count(1, 1), fx.count(3, 1), fx.count(3, 1) / 64)
    assert all(v is None for k, v in rows["A-14"].items() if k.endswith("__t2"))
    two = rows["A-12"]
    assert (two["qc_status__t1"], two["organs__status__t1"], two["organs__heart__voxel_count__t1"]) == ("rejected", "excluded", None)
    assert (rows["A-13"]["organs__status__t1"], rows["A-14"]["organs__status__t1"], rows["A-14"]["body_composition__status__t1"]) == ("failed", "ok", "not_run")
    four = rows["A-14"]
    assert (four["organs__aorta__voxel_count__t1"], four["organs__heart__volume_ml__t1"], four["organs__heart__touches_border__t1"]) == (None, fx.count(9, 1) / 64, True)


def test_wide_include_first_last(cohort):
    two = by_patient(wide(cohort, qc="include"))["A-12"]
    assert (two["organs__status__t1"], two["organs__heart__voxel_count__t1"]) == ("ok", fx.count(7, 1))
    for pick, count in (("last", fx.count(3, 1)), ("first", fx.count(1, 1))):
        df = wide(cohort, multiple_studies=pick)
        one = by_patient(df)["A-11"]
        assert not [c for c in df.columns if "__t1" in c or "__t2" in c] and (one["organs__heart__voxel_count"], one["n_studies"]) == (count, 2)


def test_wide_all_series_and_row_levels(cohort):
    df = wide(cohort, multiple_series="all")
    one = by_patient(df)["A-11"]
    assert (one["organs__heart__voxel_count__t2__s1"], one["organs__heart__voxel_count__t2__s2"]) == (fx.count(3, 1), fx.count(5, 1))
    assert "organs__heart__voxel_count__t1__s2" not in df.columns
    assert wide(cohort, row_level="study").count() == 5
    assert wide(cohort, row_level="series", multiple_series="all").count() == 6


def test_subsets_dates_identifiers(cohort):
    df = wide(cohort, patients=["A-11", "A-14", "nobody"], models=[fx.ORGANS], labels=["heart"], metrics=["volume_ml"], multiple_studies="last")
    assert list(by_patient(df)) == ["A-11", "A-14"] and df.columns[-2:] == ["organs__status", "organs__heart__volume_ml"]
    assert by_patient(wide(cohort, dates="year"))["A-11"]["year__t2"] == 2018
    assert by_patient(wide(cohort, dates="iso"))["A-11"]["study_date__t2"] == "2018-06-01"
    both = wide(cohort, identifiers="both")
    assert [r["patient_id"] for r in both.collect()] == ["0077", "2E3", None, "9"]
    assert len(sheets.warnings(cohort, parse({"identifiers": "both"}))) == 2
    with pytest.raises(ValueError, match="unknown"):
        wide(cohort, models=["unknown"])


@pytest.fixture(scope="module")
def built(cohort):
    return export.build(cohort, parse({"layout": "long", "multiple_series": "all"}), created="2026-10-03T00:00:00Z")


def test_long(cohort, tmp_path):
    options = parse({"layout": "long"})
    df = layouts.long(export.slots(cohort, options), cohort, options)
    sinks.write_csv(df, tmp_path / "long.csv")
    lines = (tmp_path / "long.csv").read_bytes().split(b"\r\n")
    assert lines[1] == b"A-11,1,0,1,Chest thin,organs,1,heart,507,7.921875,2.5,4.0,1.5,-8.0,16.0,-50.0,75.0,FALSE,,accepted,cpu,night-7"
    assert df.count() == 14
    include = parse({"layout": "long", "qc": "include"})
    assert layouts.long(export.slots(cohort, include), cohort, include).count() == 21
    sinks.write_csv(df, tmp_path / "excel.csv", excel=True)
    text = (tmp_path / "excel.csv").read_bytes().decode("utf-8-sig")
    rows = list(csv.reader(text.splitlines(), delimiter=";"))
    assert rows[1][9] == "7,921875" and any(r[4].startswith("'=1+1") for r in rows[1:])


def test_companion_sheets(built, cohort):
    skipped = [(r["pseudonym"], r["model"], r["reason"]) for r in built.sheets["skipped"].collect()]
    assert skipped == [("A-12", None, "excluded by QC"), ("A-13", None, "failed: no_pixels"), ("A-14", "body_composition", "not run")]
    qc = [(r["pseudonym"], r["model"], r["label"], r["status"], r["flags"]) for r in built.sheets["qc"].collect()]
    assert [x for x in qc if x[0] == "A-12"] == [("A-12", None, None, "rejected", None)]
    assert [x[2:] for x in qc if x[0] == "A-14" and x[1]] == [("aorta", "label_excluded", None), ("heart", None, "truncated")]
    series = [(r["timepoint"], r["series"], r["primary"], r["runtime_s"]) for r in built.sheets["series"].collect() if r["pseudonym"] == "A-11"]
    assert series == [(1, 1, True, 75.0), (2, 1, True, 75.0), (2, 2, False, 135.0)]
    regions = {r["model_key"]: r["region"] for r in built.sheets["labels"].collect()}
    assert regions["organs"] == "whole field of view" and "L3" in regions["body_composition"]
    assert list(built.sheets) == list(sheets.SHEET_ORDER)
    words = built.sheets["data_dictionary"].collect()
    assert {r["sheet"] for r in words} == {"results", "series", "qc", "labels", "provenance", "skipped"} and all(r["description"] for r in words)
    keys = [r["key"] for r in built.sheets["provenance"].collect()]
    assert keys.index("version.app") < keys.index("version.torch") < keys.index(f"model.{fx.ORGANS}.sha256")
    assert built.masks.count() == 7  # both models of three series and one of the formula's; the moved one is rejected


def test_methods_sentence(cohort):
    text = export.build(cohort, parse({}), created="x").methods_text
    assert text.endswith("3 of 4 series underwent visual quality control; 1 series were excluded.")
    assert sheets.qc_sentence(2, 2, 0) == "Results underwent visual quality control; 0 series were excluded."
    assert sheets.qc_sentence(2, 0, 0).startswith("No visual")


def test_files_are_reproducible(built, tmp_path):
    for n in "ab":
        (tmp_path / n).mkdir()
        got = sinks.write_export(built, parse({"layout": "long"}), tmp_path / n, "run")
        assert got["rows"] == built.sheets["results"].count() and got["excluded_series"] == 1
    assert (tmp_path / "a/run.xlsx").read_bytes() == (tmp_path / "b/run.xlsx").read_bytes()
    with zipfile.ZipFile(tmp_path / "a/run.xlsx") as z:
        assert "=1+1" in z.read("xl/worksheets/sheet1.xml").decode() and "<f>" not in z.read("xl/worksheets/sheet1.xml").decode()
    sinks.write_export(built, parse({"format": "csv", "layout": "long"}), tmp_path / "a", "run")
    assert (tmp_path / "a/run.csv").exists() and (tmp_path / "a/run.qc.csv").exists()


def test_pivot_round_trip(cohort):
    options = parse({"row_level": "study", "metrics": ["voxel_count"]})
    rows = wide(cohort, row_level="study", metrics=["voxel_count"])
    cells = layouts.unpivot(rows, [c for c in rows.columns if "voxel_count" in c], ["pseudonym", "timepoint"]).where("value is not null")
    long_rows = layouts.long(export.slots(cohort, options), cohort, options)
    back = long_rows.select("pseudonym", "timepoint", F.concat_ws("__", "model", "label", F.lit("voxel_count")).alias("column"), F.col("voxel_count").cast("double").alias("value"))
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, back.collect())) != []


def test_duplicate_labels_and_options(cohort, spark):
    from dataclasses import replace

    twice = replace(cohort.run.models[0], labels={1: "Heart", 2: "heart"})
    with pytest.raises(ValueError, match="same name"):
        layouts.selected_labels(replace(cohort.run, models=(twice,)), Options())
    for bad in ({"x": 1}, {"layout": "tall"}, {"models": []}, {"metrics": ["no"]}, {"masks": "false"}, {"reproducibility_package": True}):
        with pytest.raises(OptionError):
            parse(bad)
    assert parse({"metrics": ["hu_mean", "voxel_count"]}).metrics == ("voxel_count", "hu_mean")


def test_models_frame(spark):
    got = models_frame(fx.tables(spark)["runs"]).orderBy("model_pos", "label_id").collect()
    assert [(r.model_pos, r.label_id, r.label, r.color) for r in got][:2] == [(0, 1, "heart", "#00aa33"), (0, 2, "aorta", None)] and len(got) == 6
