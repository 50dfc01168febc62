import pytest

from casework.operators.encoders import regimen_name
from casework.plans import training
from casework.session import COMPILED_BYTES, HUGE_METHOD, wide_plans


def test_builder_plans_methods_that_the_jvm_compiles(spark, monkeypatch):
    """The fitted passes run with generated methods small enough to be compiled; the session keeps its own setting."""
    before, seen = spark.conf.get(HUGE_METHOD), []
    real = training.profile.low_variance_stats
    monkeypatch.setattr(training.profile, "low_variance_stats", lambda *a, **k: seen.append(spark.conf.get(HUGE_METHOD)) or real(*a, **k))
    raw = spark.createDataFrame([(i, i % 4, "a" if i % 2 else "b") for i in range(40)], "row_id long, tothlos int, race string")
    training.build_training_table(raw, training.BuildConfig(target="tothlos"))
    assert [int(s) for s in seen] == [COMPILED_BYTES]
    assert spark.conf.get(HUGE_METHOD) == before


def test_setting_comes_back_with_the_last_holder(spark):
    before = spark.conf.get(HUGE_METHOD)
    first, second = wide_plans(spark), wide_plans(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert int(spark.conf.get(HUGE_METHOD)) == COMPILED_BYTES
    second.__exit__(None, None, None)
    assert spark.conf.get(HUGE_METHOD) == before
    with pytest.raises(KeyError), wide_plans(spark):
        raise KeyError
    assert spark.conf.get(HUGE_METHOD) == before


def test_regimen_names_follow_sorted_drugs_without_sorting_rows(spark):
    df = spark.createDataFrame([(1, True, "yes", 0), (2, None, "x", 1), (3, False, "0", 0)], "i int, used_b boolean, used_a string, `used_é` int")
    cols = ["used_b", "used_a", "used_é"]
    x = df.select("i", regimen_name(cols).alias("r"), regimen_name([]).alias("none"))
    assert "array_sort" not in x._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in x.orderBy("i").collect()] == [
        (1, "combo_abx_regimen_a_b", "single_abx_regimen_"), (2, "combo_abx_regimen_é", "single_abx_regimen_"),
        (3, "single_abx_regimen_", "single_abx_regimen_")]
