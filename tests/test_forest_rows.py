"""the rows that a forest is fitted on lie evenly over the partitions, and the training table is worked out once."""

from pyspark.sql import functions as F

from casework.operators import metrics, search, treeshap
from casework.plans import modelling
from casework.session import COMPILED_BYTES, HUGE_METHOD


def _parts(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_class_weights_do_not_gather_rows_by_label(spark):
    rows = spark.range(0, 4000, numPartitions=4).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("double").alias("label"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the planner does not know how small the class table is
    try:
        got = metrics.with_class_weight(rows)
        assert sorted(_parts(got)) == [1000] * 4
        assert {(r.label, r.weight) for r in got.distinct().select("label", "weight").distinct().collect()} == {(0.0, 4000 / (2 * 3600)), (1.0, 5.0)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


def test_many_classes_and_none(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i // 2),) for i in range(12)] + [(None,)], "label double")
    monkeypatch.setattr(metrics, "MAX_CLASSES", 3)
    assert sorted(r.weight or 0 for r in metrics.with_class_weight(rows).collect()) == [0] + [1.0] * 12
    assert metrics.with_class_weight(rows.filter("false")).count() == 0
    assert [r.weight for r in metrics.with_class_weight(rows.filter("label is null")).collect()] == [None]


def test_rows_are_spread_by_id_in_order(spark, monkeypatch):
    rows = spark.range(0, 3000, numPartitions=1).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("label"))
    monkeypatch.setattr(search, "TRAIN_PARTITION_BYTES", 8 * 10 * 200)
    got, other = search.spread_rows(rows, 10), search.spread_rows(rows.orderBy(F.desc("row_id")).repartition(5), 10)
    assert len(_parts(got)) == 15 and max(_parts(got)) < 300

    def placed(df):
        return df.rdd.glom().map(lambda p: [r.row_id for r in p]).collect()
    assert placed(got) == placed(other) and all(p == sorted(p) for p in placed(got))


def test_table_is_worked_out_once(spark, monkeypatch):
    """The labelled table is written before the class weights, the fit and the attribution read it, by plans that the JVM compiles."""
    seen = []
    table = spark.createDataFrame([(i, i % 9, float(i % 5)) for i in range(60)], "row_id long, tothlos int, x double")
    monkeypatch.setattr(modelling, "training_table", lambda spark, d: seen.append(spark.conf.get(HUGE_METHOD)) or table)
    got, feats = modelling._labelled(spark, "")
    assert [int(s) for s in seen] == [COMPILED_BYTES]
    assert got.columns == ["row_id", "label", "x"] and feats == ["x"] and got.inputFiles() and "labelled" in got.inputFiles()[0]
    assert got.select("row_id", F.col("label").cast("int")).orderBy("row_id").collect() == [(i, int(i % 9 > 5)) for i in range(60)]


def test_bins_compare_edges_without_lambdas(spark):
    rows = [([0.1 * i, -1.0 * (i % 3)], [float(i % 4), float("nan") if i % 5 == 0 else None if i % 5 == 1 else float(i)]) for i in range(50)]
    sh = spark.createDataFrame([(i, p, x) for i, (p, x) in enumerate(rows)], "row_id long, shap array<double>, x array<double>")
    got = treeshap.attribution_bins(sh, None, ["a", "b"], top_k=2, n_bins=5)
    assert "lambda" not in got._jdf.queryExecution().analyzed().toString()
    long = sh.select(F.posexplode("shap").alias("k", "phi"), "x").selectExpr("if(k = 0, 'a', 'b') AS feature", "phi", "x[k] AS value")
    edges = long.groupBy("feature").agg(*[F.percentile_approx(c, [0.2, 0.4, 0.6, 0.8], 1000).alias(e) for c, e in (("phi", "pe"), ("value", "ve"))])
    want = long.join(edges, "feature").selectExpr("feature", "size(filter(pe, e -> e < phi)) AS phi_bin", "size(filter(ve, e -> e < value)) AS value_bin") \
        .groupBy("feature", "phi_bin", "value_bin").count()
    assert sorted(got.collect()) == sorted(want.collect()) and dict(got.dtypes) == dict(want.dtypes)


def test_bins_of_a_feature_without_values(spark):
    sh = spark.createDataFrame([(i, [0.5 * i], [None]) for i in range(4)], "row_id long, shap array<double>, x array<double>")
    assert {r.value_bin for r in treeshap.attribution_bins(sh, None, ["a"], top_k=1, n_bins=3).collect()} == {None}
