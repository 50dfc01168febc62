from pyspark.sql import functions as F

from casework.operators.ordered import in_one_partition


def test_single_file_is_not_sorted_in_its_own_task(spark):
    """The writer of one file streams ranges that were sorted before: its one partition has no sort of the whole table."""
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.repeat(F.lit("v"), 20).alias("v")).repartition(6)
    one = in_one_partition(df, "k")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert one.rdd.getNumPartitions() == 1
    assert [r["k"] for r in one.collect()] == list(range(5000))


def test_single_file_of_nulls_ties_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (2, "b")], "k int, v string").repartition(3)
    assert [r["k"] for r in in_one_partition(df, "k").collect()] == [None, 1, 2, 2]
    path = str(tmp_path / "none")
    in_one_partition(df.filter("k > 9"), "k").write.option("header", True).csv(path)
    assert spark.read.option("header", True).csv(path).columns == ["k", "v"]
