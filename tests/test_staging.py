import pytest

from tableprobe.sources import staging
from tableprobe.sources.datasets import read_dataset
from tableprobe.sources.staging import stage_dataset

COLUMNS = {
    "int": ["1", "-5", "+7", None], "long": ["1", "3000000000"], "dec": ["12345678901234567890", "1"],
    "dbl": ["1", "2.5", "1e5"], "dbl2": ["1E5", "5"], "dbl3": [".5", "5.", "1d", "2f"], "dot": ["1", "5."],
    "nan": ["NaN", "1"], "inf": ["Inf", "-Inf", "1"], "inf2": ["Infinity", "-Infinity", "1"], "low": ["nan", "1"],
    "sp": [" 1", "2"], "sp2": ["1.5 ", "2"], "d1": ["2024-01-02", None, "2024-02-03"], "d2": ["2024-1-2", "2024-01-03"],
    "d3": ["2024", "2025"], "d4": ["2024-01", "2024-02"], "d5": ["2024-01-02", "2024-01-02 10:00:00"],
    "ts1": ["2024-01-02 03:04", "2024-01-02T03:04:05Z"], "ts3": ["2024-01-02T03", "x"],
    "b1": ["true", "FALSE"], "b2": ["true", "1"], "b3": ["true", "yes"], "mix": ["1", "2024-01-01"],
    "mix2": ["2.5", "2024-01-01"], "none": [None, None], "declong": ["12345678901234567890", "3000000000"],
    "decdbl": ["12345678901234567890", "1.5"], "big": ["1" * 39, "1"], "big38": ["1" * 38, "1"], "dash": ["-", "1"],
    "zero": ["-0", "0"], "hex": ["0x10", "1"], "hexf": ["0x1p3", "1"], "line": ["1_000", "1"], "lead": ["007", "08"],
    "now": ["now", "today"], "zone": ["2024-01-02 03:04:05+01:00", "2024-01-02"], "plus": ["+2024-01-02", "2024-01-02"],
    "trail": ["2024-01-02 ", "2024-01-03"], "packed": ["20240102", "20240103"], "dec2": ["123456789012345678901", "5"],
    "zeros": ["0" * 30 + "12345678901234567890", "5"], "bad": ["2024-13-02", "2024-01-02"], "comma": ["1,5", "1"],
    "exp": ["1e400", "1"], "late": ["2024-01-02 25:00:00", "2024-01-02 03:00:00"], "decz": ["12345678901234567890.0", "1"],
    "empty": ["", "a"], "quoted": ['say ""x""', "a"], "lines": ["a\nb", "c"],
}


def write_csv(path, columns):
    path.mkdir()
    height = max(map(len, columns.values()))
    lines = [",".join(columns)]
    for i in range(height):
        cells = [v[i] if i < len(v) else None for v in columns.values()]
        lines.append(",".join("" if c is None else f'"{c}"' for c in cells))
    (path / "a.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_types_and_values_are_those_that_spark_infers(spark, tmp_path):
    path = write_csv(tmp_path / "in", COLUMNS)
    options = {"multiLine": True, "escape": '"'}
    expected = read_dataset(spark, path, "csv", **options)
    staged = stage_dataset(spark, path, "CSV ", str(tmp_path / "copy"), **options)
    kinds = {f.name: f.dataType.simpleString() for f in expected.schema.fields}
    assert {f.name: f.dataType.simpleString() for f in staged.schema.fields} == kinds
    assert {"int", "bigint", "decimal(20,0)", "double", "date", "timestamp", "boolean", "string"} <= set(kinds.values())
    assert repr(staged.collect()) == repr(expected.collect())


@pytest.mark.parametrize("name", [c for c in COLUMNS if c != "lines"])
def test_every_kind_by_itself(spark, tmp_path, name):
    types = staging.type_of
    df = spark.createDataFrame([(v,) for v in COLUMNS[name] if v], "c string")
    path = write_csv(tmp_path / "in", {"c": COLUMNS[name], "other": ["x"] * len(COLUMNS[name])})
    found = df.select(staging.kind_of(df.c).alias("k"), staging._digits(df.c).alias("n")).collect()
    kinds = 0
    for r in found:
        kinds |= r["k"]
    digits = max((r["n"] for r in found if r["k"] == staging.DECIMAL), default=0)
    expected = read_dataset(spark, path, "csv", escape='"').schema["c"].dataType
    assert types(kinds, digits) == expected


def test_the_text_is_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = "".join(f"{i},{i / 4},name {i},2024-01-{i % 28 + 1:02d}\n" for i in range(60_000))
    (tmp_path / "in" / "a.csv").write_text("id,x,name,day\n" + lines)
    size = (tmp_path / "in" / "a.csv").stat().st_size

    def bytes_read():
        found = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
        return sum(s.getBytesRead() for s in found if s.getScheme() == "file")

    before = bytes_read()
    staged = stage_dataset(spark, str(tmp_path / "in"), "csv", str(tmp_path / "copy"))
    once = bytes_read() - before
    before = bytes_read()
    inferred = read_dataset(spark, str(tmp_path / "in"), "csv")
    inferred.write.parquet(str(tmp_path / "twice"))
    twice = bytes_read() - before
    assert staged.schema == inferred.schema and staged.count() == 60_000
    assert size <= once < 1.5 * size < twice


def test_other_datasets_and_options(spark, tmp_path):
    path = write_csv(tmp_path / "in", {"a": ["1", "2"], "a.b": ["x", "y"]})
    given = stage_dataset(spark, path, "csv", str(tmp_path / "c1"), schema="a string, `a.b` string")
    assert [f.dataType.simpleString() for f in given.schema.fields] == ["string", "string"]
    assert stage_dataset(spark, path, "csv", str(tmp_path / "c2")).columns == ["a", "a.b"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"x": 1}\n{"x": 2}\n')
    assert stage_dataset(spark, str(tmp_path / "j"), "json", str(tmp_path / "c3")).count() == 2
    (tmp_path / "e.csv").write_text("")
    assert stage_dataset(spark, str(tmp_path / "e.csv"), "csv", str(tmp_path / "c4")).columns == []
    (tmp_path / "h.csv").write_text("a,b\n")
    only = stage_dataset(spark, str(tmp_path / "h.csv"), "csv", str(tmp_path / "c5"))
    assert only.dtypes == [("a", "string"), ("b", "string")] and only.count() == 0
    with pytest.raises(Exception, match="already exists"):
        stage_dataset(spark, path, "csv", str(tmp_path / "c2"))
    assert not staging.reads_in_one_pass(spark, "csv", {"dateFormat": "yyyy"})
