"""Frequent values by counter summaries: exact, or handed to the grouping of all values."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from casework.operators import encoders, profile


def brute(rows, k):
    c = Counter(v for v in rows if v is not None)
    return sorted(c.items(), key=lambda r: (-r[1], r[0]))[:k]


@pytest.mark.parametrize("counters", [64, 1024, 16384])
def test_frequent_values_are_exact_or_not_claimed(spark, counters):
    n = 60_000
    df = spark.range(n).select(F.floor(F.sqrt("id")).alias("rising"), (F.xxhash64("id") % 50_000).alias("flat"),
                               F.when(F.rand(3) < 0.6, F.concat(F.lit("hot"), (F.col("id") % 8).cast("string"))).otherwise(F.xxhash64("id").cast("string")).alias("hot"),
                               F.when(F.col("id") % 3 == 0, F.lit(-0.0)).when(F.col("id") % 3 == 1, F.lit(0.0)).otherwise(F.lit(float("nan"))).alias("zero"),
                               F.lit(None).cast("string").alias("none"), (F.col("id") % 5).cast("string").alias("a.b"))
    df = df.repartition(5).cache()
    got = profile.frequent_values(df, df.columns, 5, counters)
    values = {c: [r[0] for r in df.select(F.col(f"`{c}`")).collect()] for c in df.columns}
    for c in ("rising", "flat", "hot", "a.b"):
        assert got[c] is None or got[c] == brute(values[c], 5), c
    assert got["a.b"] == brute(values["a.b"], 5) and got["none"] == []
    assert [x for _, x in got["zero"]] == [40_000, 20_000]  # both zeros are one value
    assert counters < 1024 or got["hot"] is not None  # eight values hold 7.5 % each
    assert counters > 1024 or got["flat"] is None  # no value stands out
    df.unpersist()


def test_top_values_falls_back_where_nothing_stands_out(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 2500).alias("v"))
    want = [(v, 2) for v in range(7)]
    assert [tuple(r) for r in profile.top_values(df, "v", 7).collect()] == want
    monkeypatch.setattr(profile, "frequent_values", lambda *a, **k: {"v": None})
    assert [tuple(r) for r in profile.top_values(df, "v", 7).collect()] == want
    assert profile.top_values(df.limit(0), "v", 3).count() == 0


def test_long_tails_of_several_columns(spark, monkeypatch):
    df = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.lit("x")).otherwise(F.col("id").cast("string")).alias("a"),
                                    F.xxhash64("id").cast("string").alias("b"))
    want_b = sorted(r["b"] for r in df.collect())[:3]
    for counters in (profile.COUNTERS, 64):
        monkeypatch.setattr(profile.frequent_values, "__defaults__", (counters,))
        top = encoders._top_k_per_column(df, ["a", "b"], 3)
        assert top["a"][0] == "x" and top["a"][1:] == ["1", "10001"] and top["b"] == want_b
