"""Hand-made edge rows for names and cleaning."""

import math

import pytest
from pyspark.sql import functions as F

from casework.operators import clean, names, profile


def test_names_normalise_unique_sanitise(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(" Age Days", "age_days", "x (y)")
    out = names.sanitize_columns(names.normalize_columns(df))
    assert out.columns == ["age_days", "age_days.1", "x__y_"]


def test_dedupe_keeps_first_and_null_equal(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, None), (2, 2, "a")], "row_id long, k int, v string")
    rows = sorted(tuple(r) for r in clean.dedupe_keep_first(df).collect())
    assert rows == [(0, 1, None), (2, 2, "a")]


def test_parse_dates(spark):
    df = spark.createDataFrame([("2024-01-05",), ("bad",), (None,)], "date_of_surgery string")
    out = [r[0] for r in clean.parse_dates(df).collect()]
    assert str(out[0]) == "2024-01-05 00:00:00" and out[1] is None and out[2] is None


def test_null_tokens(spark):
    vals = ["-99", "-99.0", " Null ", "#NULL!", "N/A", "", "ok "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    out = [r["v"] for r in clean.normalize_nulls(df, keep=["i"]).orderBy("i").collect()]
    assert out == [None, "-99.0", None, None, None, None, "ok"]


def test_blank_rows(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("cefazolin",)], "ped_sap_name1 string")
    assert [r[0] for r in clean.drop_blank_rows(df, ["ped_sap_name1", "absent"]).collect()] == ["cefazolin"]


def test_low_variance(spark):
    df = spark.createDataFrame([("a", "a", 0.001, 0.0), ("a", None, 0.002, 1.0)], "k string, m string, t double, v double")
    dropped = {r["column_name"] for r in profile.low_variance_report(df).filter("dropped").collect()}
    assert dropped == {"k", "t"}
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    assert {r["column_name"] for r in profile.low_variance_report(one).filter("dropped").collect()} == {"a", "b"}


def test_clip_float32(spark):
    df = spark.createDataFrame([(1e300,), (float("-inf"),), (None,), (1.5,)], "x double")
    out = [r[0] for r in clean.clip_float32(df).collect()]
    assert out == [3.4028234663852886e38, -3.4028234663852886e38, None, 1.5]


def test_composite_target(spark):
    vals = ["No Complication", "-99", "-99.0", "Deep SSI", None]
    df = spark.createDataFrame([(v, "null") for v in vals], "dsupinfec string, wndinfd string")
    out = clean.composite_target(df, "any_ssi").collect()
    assert [r["dsupinfec"] for r in out] == [0, 0, 1, 1, 0]
    assert [r["any_ssi"] for r in out] == [0, 0, 1, 1, 0]
    df2 = spark.createDataFrame([("null", "Deep"), ("x", None)], "dsupinfec string, orgspcssi string")
    assert [r["any_ssi"] for r in clean.composite_target(df2, "any_ssi").collect()] == [1, 1]
    assert clean.composite_target(df2, "unknown_target").columns == []


def test_threshold_label(spark):
    df = spark.createDataFrame([(5.0,), (6.0,), (None,), (float("nan"),)], "t double")
    assert [r["y"] for r in clean.label_by_threshold(df, "t", "x > 5", out="y").collect()] == [0, 1, 0, 0]
    with pytest.raises(ValueError):
        clean.label_by_threshold(df, "t", "x >>> 5")
    with pytest.raises(ValueError):
        clean.label_by_threshold(df, "t", "nosuchcol > 5")


def test_binary_target_cast(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "t double")
    assert dict(clean.binary_target_cast(df, "t").dtypes)["t"] == "int"
    df3 = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "t double")
    assert dict(clean.binary_target_cast(df3, "t").dtypes)["t"] == "double"


def test_leak_drop_requires_numeric_target(spark):
    for bad in (spark.createDataFrame([("1", "x"), ("soon", "y")], "t string, dehis string"),
                spark.createDataFrame([(True, "x")], "t boolean, dehis string"), spark.createDataFrame([("x",)], "dehis string")):
        with pytest.raises(ValueError):
            clean.drop_leak_columns(bad, "t")
    text = spark.createDataFrame([("1", "x"), (" 2.5", "y"), ("-99", "y"), (None, "y")], "t string, dehis string")
    assert clean.drop_leak_columns(text, "t").columns == ["t"]
    df2 = spark.createDataFrame([(1, "x", 2)], "t int, dehis string, keep int")
    assert clean.drop_leak_columns(df2, "t").columns == ["t", "keep"]


def test_correlated_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, math.sin(i), float(i)) for i in range(20)], "a double, b double, c double, t double")
    got = {r["column_name"]: r["dropped"] for r in clean.correlated_columns(df, "t", 0.95).collect()}
    assert got == {"a": True, "b": True, "c": False}


def _jobs(spark, fn):
    sc = spark.sparkContext
    import uuid
    g = uuid.uuid4().hex
    sc.setJobGroup(g, "count jobs")
    try:
        fn()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(g))


def test_profiles_use_constant_job_count(spark):
    """A1 and P10 cost the same number of jobs for 4 or 40 columns."""
    base = spark.range(200).select(*[(F.col("id") % (i + 2)).cast("string").alias(f"c{i}") for i in range(40)])
    narrow = base.select(*[f"c{i}" for i in range(4)]).checkpoint()
    wide = base.checkpoint()
    a = _jobs(spark, lambda: profile.profile_text_columns(narrow))
    b = _jobs(spark, lambda: profile.profile_text_columns(wide))
    c = _jobs(spark, lambda: profile.low_variance_report(narrow).collect())
    d = _jobs(spark, lambda: profile.low_variance_report(wide).collect())
    assert a == b and c == d and b <= 4 and d <= 2
