import pytest

from cohortica.operators import outcomes
from cohortica.sources import files

JOB = '{"protocol_version": 1, "job_id": "j", "kind": "export", "project_dir": "/p"}'


def ends(error):
    def handler(raw):
        if error:
            raise error

    return {"export": handler}


@pytest.mark.parametrize(("error", "code", "status"), [
    (None, 0, "ok"), (outcomes.Cancelled(), 130, "cancelled"), (outcomes.JobFailure("disk_full", "no room", True), 1, "failed"), (ValueError("/data/DOE^JANE"), 1, "failed"),
])
def test_run_and_exit_code(tmp_path, error, code, status):
    path = tmp_path / "job.json"
    path.write_text(JOB)
    assert outcomes.main(["run", "--job", str(path)], ends(error)) == code
    got = outcomes.run({"kind": "export"}, ends(error))
    assert got.status == status and "DOE" not in str(got.message)


def test_unusable_files_and_kinds(tmp_path):
    path = tmp_path / "job.json"
    assert outcomes.main(["run", "--job", str(path)], {}) == 2
    path.write_text("{")
    assert outcomes.main(["run", "--job", str(path)], {}) == 2
    path.write_text(JOB)
    assert outcomes.main(["run", "--job", str(path)], {}) == 1
    assert outcomes.run({"kind": "export"}, {}).code == "unsupported_job"


def test_judge_agrees_with_run(spark):
    rows = [
        ("ok", "export", False, None, None, None, None), ("cancelled", "export", True, None, None, None, "KeyError"), ("known", "export", None, "disk_full", "no room", True, None),
        ("broken", "export", False, None, None, None, "ValueError"), ("unknown", "paint", True, None, None, None, None), ("none", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "name string, kind string, cancelled boolean, failure string, message string, recoverable boolean, exception string")
    got = {r["name"]: (r["status"], r["exit_code"], r["code"], r["message"], r["recoverable"]) for r in outcomes.judge(df, ["export"]).collect()}
    known = outcomes.run({"kind": "export"}, ends(outcomes.JobFailure("disk_full", "no room", True)))
    broken = outcomes.run({"kind": "export"}, ends(ValueError("x")))
    unknown = outcomes.run({"kind": "paint"}, {})
    assert got["ok"] == ("ok", 0, None, None, None) and got["cancelled"] == ("cancelled", 130, None, None, None)
    for name, want in (("known", known), ("broken", broken), ("unknown", unknown)):
        assert got[name] == (want.status, want.exit_code, want.code, want.message, want.recoverable)
    assert got["none"][:3] == ("failed", 1, "unsupported_job")
    assert outcomes.judge(df.limit(0), ["export"]).count() == 0


def test_job_column_and_paths_agree_with_the_driver_forms(spark):
    texts = [JOB, "{", "", None, "{}", JOB.replace("1", "9", 1), JOB.replace("export", "paint"), '{"protocol_version": 1, "job_id": "j", "kind": "export"}']
    got = [r["problem"] for r in files.jobs(spark.createDataFrame([(t,) for t in texts], "value string")).collect()]
    for text, problem in zip(texts, got, strict=True):
        if problem is None:
            files.job(text)
        else:
            with pytest.raises((files.JobError, TypeError)):
                files.job(text)
    paths = ["a/b", "../x", "", ".", "a/../../p/c", "/p/q", "/pq", "/", "../..", "a//b/./c", "/../p"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.inside_column("/p", files.F.col("p")).alias("at")).collect()
    for r in rows:
        try:
            want = files.inside("/p", r["p"])
        except files.JobError:
            want = None
        assert r["at"] == want, r
