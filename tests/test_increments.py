import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tableprobe.operators import increments, profile

SCHEMA = T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("b", T.LongType()), T.StructField("d", T.DoubleType()),
    T.StructField("m", T.DecimalType(12, 3)), T.StructField("s", T.StringType()), T.StructField("day", T.DateType()),
    T.StructField("ts", T.TimestampType()), T.StructField("y", T.BooleanType()), T.StructField("raw", T.BinaryType()),
    T.StructField("arr", T.ArrayType(T.IntegerType())), T.StructField("map", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("a.b", T.FloatType())])


def rows(n):
    for k in range(n):
        full = (k % 7 - 3, (k * k) << 40, [0.25, -0.0, 0.0, float("nan")][k % 4] + (k % 5), Decimal(k % 9) / 8,
                "x" * (k % 40), dt.date(1969, 12, 30) + dt.timedelta(k % 90), dt.datetime(2024, 1, 1, k % 24), k % 2 == 0,
                bytes([k % 3]) * (k % 50), [k % 4, None], {"k": k}, float(k % 6))
        yield tuple(None if (k + j) % 11 == 0 else v for j, v in enumerate(full))


def same(a, b):
    key = [repr(r) for r in sorted(a.collect(), key=lambda r: r["pos"])]
    assert key == [repr(r) for r in sorted(b.collect(), key=lambda r: r["pos"])]


@pytest.mark.parametrize("scale", [None, 2])
def test_merged_parts_are_the_whole(spark, scale):
    data = list(rows(200))
    whole = spark.createDataFrame(data, SCHEMA)
    parts = [spark.createDataFrame(data[a:b], SCHEMA) for a, b in ((0, 20), (20, 20), (20, 150), (150, 200))]
    merged = increments.merge_states([increments.profile_state(p, scale) for p in parts])
    same(increments.state_profile(merged), profile.describe(whole, exact_scale=scale))
    same(increments.state_profile(increments.profile_state(whole, scale)), profile.describe(whole, exact_scale=scale))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    same(increments.state_profile(increments.profile_state(empty)), profile.describe(empty))
    none = spark.createDataFrame([], T.StructType([]))
    assert increments.state_profile(increments.profile_state(none)).count() == 0


def test_added_files_cost_their_own_scan(spark, tmp_path):
    data = list(rows(90))
    base = str(tmp_path / "state")
    for name, (a, b) in {"p1": (0, 40), "p2": (40, 90)}.items():
        spark.createDataFrame(data[a:b], SCHEMA).write.parquet(str(tmp_path / name))
    first = increments.profile_increment(spark, base, "p1", spark.read.parquet(str(tmp_path / "p1")))
    assert first.first()["rows"] == 40
    both = increments.profile_increment(spark, base, "p2", spark.read.parquet(str(tmp_path / "p2")))
    same(both, profile.describe(spark.createDataFrame(data, SCHEMA)))
    assert not any("/p1" in f or "/p2/" in f for f in both.inputFiles())


def test_parts_count_once_they_are_whole(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(ValueError):
        increments.read_state(spark, base)
    increments.add_state(base, "a", increments.profile_state(spark.createDataFrame(list(rows(30)), SCHEMA)))
    state = increments.profile_state(spark.createDataFrame(list(rows(60)), SCHEMA))
    state.members.write.parquet(f"{base}/members/part=b")  # a run that was lost before its ranges were written
    found = increments.state_profile(increments.read_state(spark, base))
    same(found, profile.describe(spark.createDataFrame(list(rows(30)), SCHEMA)))
    increments.add_state(base, "b", state)
    assert increments.state_profile(increments.read_state(spark, base)).first()["rows"] == 90
    with pytest.raises(Exception, match="already exists"):
        increments.add_state(base, "b", state)


def test_different_columns_are_refused(spark, tmp_path):
    increments.add_state(str(tmp_path), "a", increments.profile_state(spark.range(5).toDF("x")))
    increments.add_state(str(tmp_path), "b", increments.profile_state(spark.range(5).toDF("y")))
    with pytest.raises(ValueError):
        increments.read_state(spark, str(tmp_path))
