import datetime as dt
import decimal
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tableprobe import analyze
from tableprobe.operators.jobs import run_jobs
from tableprobe.operators.profile import PROFILE_SCHEMA, describe
from tableprobe.sources.datasets import check_dataset, is_allowed, read_dataset
from tableprobe.plans import analysis, reading
from tableprobe.sources import reports
from tableprobe.sources.reports import make_run_id, published_runs, read_report, write_report, write_run
from tableprobe.sources.scratch import own_folder, scratch_directory


def file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types(spark, tmp_path):
    path = file(tmp_path, "typed.csv", """i,l,big,d,b,dt,ts,s,x
1,10000000000,12345678901234567890,1.5,true,2024-01-02,2024-01-02 03:04:05,a,
2,20000000000,22345678901234567890,2.5,false,2024-01-03,2024-01-03 03:04:05,b,
""")
    df = read_dataset(spark, path, "csv")
    assert [t for _, t in df.dtypes] == [
        "int", "bigint", "decimal(20,0)", "double", "boolean", "date", "timestamp", "string", "string"]
    row = df.first()
    assert row["big"] == decimal.Decimal("12345678901234567890") and row["x"] is None
    assert row["dt"] == dt.date(2024, 1, 2)
    assert describe(df).where("column = 'big'").first()["mean"] > 1e19


def test_csv_shapes(spark, tmp_path):
    ragged = read_dataset(spark, file(tmp_path, "ragged.csv", "a,b\n1\n2,x,extra\n"), "csv")
    assert sorted(map(tuple, ragged.collect())) == [(1, None), (2, "x")]
    dotted = read_dataset(spark, file(tmp_path, "dotted.csv", "a,b.c\n1,2\n3,2\n"), "csv")
    assert [(r["column"], r["distinct_count"]) for r in describe(dotted).collect()] == [("a", 2), ("b.c", 1)]
    header = read_dataset(spark, file(tmp_path, "header.csv", "a,b\n"), "csv")
    assert header.count() == 0 and describe(header).count() == 2
    given = read_dataset(spark, file(tmp_path, "given.csv", "a\n1\n"), "csv", schema="a string")
    assert given.dtypes == [("a", "string")]
    other = read_dataset(spark, file(tmp_path, "semi.csv", "a;b\n1;2\n"), "csv", sep=";")
    assert other.columns == ["a", "b"]


def test_directory_glob_and_list(spark, tmp_path):
    for n in range(3):
        file(tmp_path, f"part{n}.csv", f"a\n{n}\n")
    for path in (str(tmp_path), f"{tmp_path}/part*.csv", [f"{tmp_path}/part{n}.csv" for n in range(3)]):
        assert read_dataset(spark, path, "csv").count() == 3


def test_json(spark, tmp_path):
    lines = [{"t": "2024-01-01T00:00:00", "a": 1, "b": {"c": 1.5}, "e": [1, 2], "f": True}, {"a": 2}]
    df = read_dataset(spark, file(tmp_path, "x.json", "\n".join(map(json.dumps, lines))), "json")
    assert df.dtypes == [("a", "bigint"), ("b", "struct<c:double>"), ("e", "array<bigint>"), ("f", "boolean"), ("t", "string")]
    assert {r["column"]: r["distinct_count"] for r in describe(df, "json").collect()} == dict.fromkeys("abeft", 2)
    pretty = file(tmp_path, "pretty.json", json.dumps(lines, indent=1))
    assert read_dataset(spark, pretty, "json", multiLine=True).count() == 2


def test_text(spark, tmp_path):
    df = read_dataset(spark, file(tmp_path, "x.txt", "one\n\none\n"), " Text ")
    assert df.columns == ["value"] and df.count() == 3
    assert describe(df, "text").first()["distinct_count"] == 2


def test_unknown_format(spark):
    for wrong in ("parquet", "", None):
        with pytest.raises(ValueError):
            read_dataset(spark, "x", wrong)


@pytest.mark.parametrize("name, file_type, allowed", [
    ("a.csv", "csv", True), ("A.CSV", " Csv ", True), ("a.b.json", "json", True), ("a.txt", "text", True),
    ("a.csv", "json", False), ("a.text", "text", False), ("csv", "csv", False), ("", "csv", False),
    (None, "csv", False), ("a.csv", "xml", False), ("a.csv", None, False),
])
def test_is_allowed(name, file_type, allowed):
    assert is_allowed(name, file_type) is allowed


def test_empty_files_are_refused(spark, tmp_path):
    for name, file_type in (("e.csv", "csv"), ("e.json", "json"), ("e.txt", "text")):
        path = file(tmp_path, name, "")
        with pytest.raises(ValueError):
            check_dataset(read_dataset(spark, path, file_type), path, file_type)
    header = file(tmp_path, "h.csv", "a,b\n")
    check_dataset(read_dataset(spark, header, "csv"), header, "csv")
    with pytest.raises(ValueError):
        check_dataset(read_dataset(spark, header, "csv"), header, "json")
    empty = file(tmp_path, "g.csv", "")
    with pytest.raises(ValueError):
        check_dataset(read_dataset(spark, empty, "csv", schema="a int"), empty, "csv")


def test_the_files_are_checked_not_their_folders(spark, tmp_path):
    folder = tmp_path / "2024.01.05"
    folder.mkdir()
    one, two = file(folder, "a.csv", "a\n1\n"), file(folder, "B.CSV", "a\n2\n")
    for path in (str(folder), [one, two], f"{folder}/*"):
        check_dataset(read_dataset(spark, path, "csv"), path, "csv")
    run_id, profile, _ = analyze(spark, [one, two], "csv", str(tmp_path / "r"))
    assert run_id.endswith("_a.csv") and profile.first()["rows"] == 2
    file(folder, "c.json", "{}")
    with pytest.raises(ValueError, match="c.json"):
        check_dataset(read_dataset(spark, str(folder), "csv"), str(folder), "csv")


def test_run_id():
    now = dt.datetime(2024, 5, 6, 7, 8, 9)
    assert make_run_id("my file.csv", now) == "20240506_070809_my_file.csv"
    assert "/" not in make_run_id("../../etc/passwd", now)


def test_report_round_trip(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([(float("nan"), "é"), (1.0, None)], "v double, `s.t` string")
    profile, jobs = describe(df), run_jobs(df)
    write_report(profile, base, "run1", "descriptive")
    write_report(jobs, base, "run1", " ML ")
    back = read_report(spark, base, "run1", "descriptive").orderBy("pos").collect()
    assert [r["column"] for r in back] == ["v", "s.t"] and back[0]["mean"] is None and back[0]["run_id"] == "run1"
    assert back[0]["min"] == 1.0 and back[0]["max"] is None
    assert read_report(spark, base, "run1", "ml").drop("run_id").orderBy("job_order").collect() == jobs.collect()
    for part in os.listdir(f"{base}/kind=descriptive/run_id=run1"):
        if part.endswith(".json"):
            for line in open(f"{base}/kind=descriptive/run_id=run1/{part}", encoding="utf-8"):
                assert "NaN" not in line


def test_reports_are_kept_apart(spark, tmp_path):
    base = str(tmp_path)
    report = spark.createDataFrame([], PROFILE_SCHEMA)
    write_report(report, base, "run1", "descriptive")
    write_report(report, base, "run2", "descriptive")
    with pytest.raises(Exception, match="already exists"):
        write_report(report, base, "run1", "descriptive")
    assert read_report(spark, base, "run2", "descriptive").count() == 0
    assert read_report(spark, base, "run3", "descriptive") is None
    for call in (lambda: write_report(report, base, "r", "other"), lambda: read_report(spark, base, "r", "other")):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("run_id", ["*", "r[3]", "a/b", "..", "", None, "x y"])
def test_run_ids_are_plain_names(spark, tmp_path, run_id):
    with pytest.raises(ValueError):
        write_report(spark.createDataFrame([], PROFILE_SCHEMA), str(tmp_path), run_id, "descriptive")
    with pytest.raises(ValueError):
        read_report(spark, str(tmp_path), run_id, "descriptive")


def test_no_report_holds_nan(spark, tmp_path):
    days = "date'2024-01-01' AS day, 1L AS count, double('NaN') AS mean_value, 1D AS min_value, " \
           "double('Infinity') AS max_value, 2D AS sum_value"
    report = run_jobs(spark.range(2), "text").withColumn("sample", F.expr(f"array(named_struct({_named(days)}))"))
    report = report.withColumn("centers", F.expr("array(array(double('NaN'), 1D))")).withColumn(
        "metrics", F.expr("map('a', double('-Infinity'))"))
    row = read_report(spark, str(tmp_path), write_and_name(report, str(tmp_path)), "ml").first()
    assert row["sample"][0]["mean_value"] is None and row["sample"][0]["max_value"] is None
    assert row["sample"][0]["min_value"] == 1.0 and row["centers"] == [[None, 1.0]] and row["metrics"] == {"a": None}


def _named(items):
    pairs = [item.rsplit(" AS ", 1) for item in items.split(", ")]
    return ", ".join(f"'{name}', {value}" for value, name in pairs)


def write_and_name(report, base):
    write_report(report, base, "nan", "ml")
    return "nan"


@pytest.mark.parametrize("staged", [False, True])
def test_analyze(spark, tmp_path, staged):
    lines = ["id,name of,signup_date,score"] + [f"{n},{'ab'[n % 2]},2024-01-{n % 28 + 1:02d},{n * 2}" for n in range(60)]
    path = file(tmp_path, "people.csv", "\n".join(lines) + "\n")
    staging = str(tmp_path / "staged") if staged else None
    run_id, profile, jobs = analyze(spark, path, "csv", str(tmp_path / "reports"), staging=staging, hold=not staged)
    assert run_id.endswith("_people.csv")
    assert profile.where(F.col("column") == "name of").first()["distinct_count"] == 2
    assert jobs.where("skipped").count() == 0 and jobs.count() == 4
    with pytest.raises(ValueError):
        analyze(spark, path, "json", str(tmp_path / "reports"))


@pytest.mark.parametrize("staged", [False, True])
def test_bad_lines_are_a_column(spark, tmp_path, staged):
    path = file(tmp_path, "mixed.json", '{"a":1}\nnot json\n{"a":2}\n')
    staging = str(tmp_path / "s") if staged else None
    profile = analyze(spark, path, "json", str(tmp_path / "r"), staging=staging)[1]
    assert {r["column"]: (r["null_count"], r["distinct_count"]) for r in profile.collect()} == {
        "_corrupt_record": (2, 2), "a": (1, 3)}
    assert read_dataset(spark, path, "json", mode="DROPMALFORMED", schema="a bigint").count() == 2


def test_analyze_directory(spark, tmp_path):
    parts = tmp_path / "parts"
    parts.mkdir()
    for n in range(3):
        file(parts, f"part{n}.csv", f"a,day\n{n},2024-01-0{n + 1}\n")
    for path in (f"{parts}/", f"{parts}/part*.csv"):
        run_id, profile, jobs = analyze(spark, path, "csv", str(tmp_path / "r"), run_id=f"r{len(path)}")
        assert profile.first()["rows"] == 3
        assert len(jobs.where("job = 'timeSeries'").first()["sample"]) == 3


def test_analyze_text(spark, tmp_path):
    path = file(tmp_path, "lines.txt", "one\ntwo\none\n")
    run_id, profile, jobs = analyze(spark, path, "text", str(tmp_path / "r"), run_id="r1")
    assert run_id == "r1" and profile.select("file_type", "rows", "distinct_count").first() == ("text", 3, 2)
    assert {r["reason_code"] for r in jobs.collect()} == {"TEXT_INPUT"}


def test_a_run_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path, base = file(tmp_path, "t.csv", "a,b\n1,x\n2,y\n"), str(tmp_path / "r")
    whole, written = reports._finite_only, []

    def dies(report):
        written.append(report)
        if len(written) == 2:
            raise RuntimeError("lost")
        return whole(report)

    monkeypatch.setattr(reports, "_finite_only", dies)
    with pytest.raises(RuntimeError):
        analyze(spark, path, "csv", base, run_id="r1")
    assert os.path.isdir(f"{base}/kind=descriptive/run_id=r1")
    assert read_report(spark, base, "r1", "descriptive") is None and read_report(spark, base, "r1", "ml") is None
    assert published_runs(spark, base).count() == 0
    monkeypatch.setattr(reports, "_finite_only", whole)
    _, profile, jobs = analyze(spark, path, "csv", base, run_id="r1")
    assert profile.count() == 2 and jobs.count() == 4
    assert {tuple(r) for r in published_runs(spark, base).collect()} == {("r1", "descriptive"), ("r1", "ml")}
    with pytest.raises(ValueError, match="already exists"):
        write_run({"ml": jobs.drop("run_id")}, base, "r1")
    assert write_run({}, base, "r2") == [] and read_report(spark, base, "r2", "ml") is None


def test_reading_is_chosen_by_size_scans_and_memory():
    assert reading.choose(1000, 1, 10 ** 6) == "reread"
    assert reading.choose(1000, 12, 10 ** 6) == "hold"
    assert reading.choose(10 ** 6, 12, 10 ** 6) == "stage"
    assert reading.choose(10 ** 6, 12, 10 ** 6, may_stage=False) == "reread"
    assert reading.choose(10 ** 6, 2, 10 ** 6) == "reread"


@pytest.mark.parametrize("memory, name, text, way", [
    (10 ** 9, "a.csv", "a,b\n1,x\n2,y\n", "hold"), (10, "a.csv", "a,b\n1,x\n2,y\n", "stage"),
    (10, "a.json", '{"s": "x"}\n', "reread"), (1, "a.txt", "x\n", "reread")])
def test_analyze_chooses(spark, tmp_path, monkeypatch, memory, name, text, way):
    taken = []
    choose = reading.choose
    monkeypatch.setattr(reading, "storage_memory", lambda spark: memory)
    monkeypatch.setattr(reading, "choose", lambda *a: taken.append(choose(*a)) or taken[-1])
    kind = {"txt": "text"}.get(name.split(".")[1], name.split(".")[1])
    _, profile, jobs = analyze(spark, file(tmp_path, name, text), kind, str(tmp_path / "r"))
    assert taken == [way] and profile.first()["rows"] > 0 and jobs.count() == 4
    assert analysis._way(spark, str(tmp_path / name), kind, True, None, {})[0] == "hold"
    assert analysis._way(spark, str(tmp_path / name), kind, False, "/x", {})[0] == "stage"
    assert reading.storage_memory(spark) == memory


def test_storage_memory_is_measured(spark):
    assert reading.storage_memory(spark) > 10 ** 8


def test_scratch_follows_the_session(spark):
    assert scratch_directory(spark) != scratch_directory(spark)

    def session(master, folder=None, **settings):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
        return SimpleNamespace(conf=settings, sparkContext=context)

    shared = {"spark.checkpoint.dir": "hdfs:///shared/"}
    assert scratch_directory(session("yarn", **shared)).startswith("hdfs:///shared/")
    assert scratch_directory(session("local[2]", **shared)).startswith("hdfs:///shared/")
    assert scratch_directory(session("yarn", "hdfs:///set")).startswith("hdfs:///set/")
    for master in ("yarn", "local[2]"):
        with pytest.raises(ValueError):
            scratch_directory(session(master))
    with pytest.raises(ValueError):
        own_folder(session("yarn"))
