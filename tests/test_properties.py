"""Randomised properties of the two-level ordered operators (Hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from casework.operators import ordered

rows = st.lists(st.tuples(st.integers(0, 3) | st.none(), st.floats(-5, 5, allow_nan=False) | st.none()),
                min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, rpb=st.integers(1, 20), sparse=st.booleans())
def test_two_level_equals_single_window(spark, data, rpb, sparse):
    step = 7919 if sparse else 1
    df = spark.createDataFrame([(i * step, g, v) for i, (g, v) in enumerate(data)], "k long, g int, v double")
    w = Window.partitionBy("g").orderBy("k")
    ref = df.withColumn("v", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = ordered.forward_fill(df, ["v"], "k", ["g"], rows_per_bucket=rpb)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)
    ref_r = df.withColumn("rank", F.row_number().over(w) - 1)
    got_r = ordered.rank_within(df, "k", ["g"], rows_per_bucket=rpb)
    assert sorted(map(tuple, got_r.collect()), key=str) == sorted(map(tuple, ref_r.collect()), key=str)


scored = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=80)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=scored)
def test_auc_equals_pairwise_count(spark, data):
    from casework.operators import metrics
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    df = spark.createDataFrame([(y, float(s)) for y, s in data], "label int, score double")
    got = metrics.roc_auc(df).first()["auc"]
    if not pos or not neg:
        assert got is None
        return
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert abs(got - wins / (len(pos) * len(neg))) < 1e-12
