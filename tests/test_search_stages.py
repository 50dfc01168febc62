"""Stage-wise scoring of boosting, row weights as a grid axis, speculative selection rounds: equal to the plain forms."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from casework.operators import boruta, search
from casework.operators.metrics import roc_auc
from casework.operators.split import train_test_split
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def rows(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").filter("l_orderkey <= 1200")
    d = li.select(F.xxhash64("l_orderkey", "l_linenumber").alias("row_id"), "l_quantity", "l_tax", "l_discount",
                  (F.col("l_quantity") * (1 + F.col("l_tax")) > 27).cast("double").alias("label"))
    d = search.assemble(d, ["l_quantity", "l_tax", "l_discount"]).withColumn("fold", F.pmod(F.col("row_id"), F.lit(3)).cast("int"))
    return d.repartition(1).cache()


def test_first_stages_are_the_shorter_fit(rows):
    est = GBTClassifier(maxDepth=2, stepSize=0.3, seed=3)
    whole, short = est.copy({est.maxIter: 5}).fit(rows), est.copy({est.maxIter: 2}).fit(rows)
    cut = search.first_stages(whole, 2)
    assert cut.getNumTrees == 2 and search.first_stages(whole, 5) is whole
    a = [r[0] for r in cut.transform(rows).orderBy("row_id").select("rawPrediction").collect()]
    b = [r[0] for r in short.transform(rows).orderBy("row_id").select("rawPrediction").collect()]
    assert a == b and cut.treeWeights == short.treeWeights


def test_points_with_stages_share_a_fit_and_score_alike(rows, monkeypatch):
    est = GBTClassifier(seed=3)
    spec = search.ModelSpec("g", est, {"maxIter": [1, 4], "maxDepth": [1, 2], "stepSize": [0.1]}, staged="maxIter")
    maps = spec.param_maps()
    assert sorted(len(m) for _, m in search.fit_groups(maps, "maxIter")) == [2, 2] and len(search.fit_groups(maps, None)) == 4
    ev = BinaryClassificationEvaluator(numBins=0)
    got = search.cross_validate(est, maps, rows, ev, 3, 2, staged="maxIter")
    plain = search.cross_validate(est, maps, rows, ev, 3, 2)
    assert got[0] == plain[0] and got[1] == pytest.approx(plain[1], abs=1e-12) and [m.getNumTrees for m in got[2]] == [m.getNumTrees for m in plain[2]]


def test_the_catalogue_needs_six_boosting_fits_a_fold():
    forest, boosting = search.default_specs()
    assert len(search.fit_groups(boosting.param_maps(), boosting.staged)) == 6 and len(boosting.param_maps()) == 12
    assert len(search.fit_groups(forest.param_maps(), forest.staged)) == 48


def test_grid_points_carry_their_row_weights(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    df = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") > 250000).cast("int").alias("x"),
                  (F.col("o_totalprice") + 10000 * (F.col("o_custkey") % 20) > 340000).cast("double").alias("label"))
    tree = RandomForestClassifier(numTrees=1, maxDepth=1, featureSubsetStrategy="all", bootstrap=False, seed=1)
    spec = search.ModelSpec("t", tree, {"maxDepth": [1]}, positive_weights=(1.0, 5.0, 10.0))
    assert len(spec.param_maps()) == 3
    best, _ = search.grid_search(df, ["x"], [spec])
    assert best.best_params == {"maxDepth": 1, "positive_weight": 1.0}  # one split: the AUC is the same, the first point stays
    train = search.with_positive_weights(df, [spec])
    for w in (1.0, 5.0, 10.0):
        point = {tree.getParam("weightCol"): search.weight_column(w), tree.getParam("maxDepth"): 1}
        model = tree.copy().setLabelCol("label").fit(search.assemble(train, ["x"]), point)
        p = {r["x"]: r["p"] for r in model.transform(search.assemble(df.withColumn("x2", F.col("x")), ["x"]).withColumn("x", F.col("x2")))
             .select("x", search._prob1().alias("p")).distinct().collect()}
        rate = F.sum(F.col("label") * w) / F.sum(F.when(F.col("label") == 1, w).otherwise(1.0))
        want = {r["x"]: r["p"] for r in df.groupBy("x").agg(rate.alias("p")).collect()}
        if len({v > 0.5 for v in want.values()}) == 1:  # MLlib joins leaves that predict the same class
            want = dict.fromkeys(want, df.agg(rate).first()[0])
        assert p == pytest.approx(want)


def serial(n, max_iter, alpha, two_step, one):
    """One round after the other."""
    hits, dec, it = np.zeros(n, dtype=int), np.zeros(n, dtype=int), 0
    while it < max_iter and (dec == 0).any():
        it += 1
        active = np.where(dec >= 0)[0]
        hits[active] += one(active, it)
        boruta.decide(hits, dec, it, alpha, two_step)
    return hits.tolist(), dec.tolist(), it


@pytest.mark.parametrize("two_step", [True, False])
def test_speculative_rounds_decide_like_serial_ones(two_step):
    for seed in range(40):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 12))
        strength = rng.choice([0.05, 0.5, 0.95], n)

        def one(active, it):  # depends on the set and the round, as a fit does
            r = np.random.default_rng([seed, it, len(active), int(active.sum())])
            return (r.random(len(active)) < strength[active]).astype(int)
        want = serial(n, 60, 0.1, two_step, one)
        for width in (1, 3, 8, 100):
            hits, dec, it = boruta.replay(n, 60, 0.1, two_step, lambda active, its: [one(active, i) for i in its], width)
            assert (hits.tolist(), dec.tolist(), it) == want


def test_speculative_boruta_is_the_serial_one(spark, rows):
    df = rows.withColumn("noise", F.pmod(F.xxhash64("row_id"), F.lit(97))).withColumn("more", F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(97)))
    feats = ["l_quantity", "noise", "more"]
    df = df.withColumn("l_quantity", F.element_at(search.vector_to_array("features"), 1)).drop("features")
    a = boruta.boruta(df, feats, max_iter=7, num_trees=5, speculate=1)
    b = boruta.boruta(df, feats, max_iter=7, num_trees=5, speculate=4)
    assert a == b and a.decision[0] == "confirmed"
    assert roc_auc(df.select("label", F.col("l_quantity").alias("score"))).first()["auc"] > 0.9


def test_regression_passes_hold_few_statistics(spark):
    """a pass of the regression forest fills few MB of statistics, and the trees do not depend on the passes."""
    rng = np.random.default_rng(5)
    rows = [(i, *(float(v) for v in rng.random(4)), float(rng.integers(1, 8))) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, target double")
    model, _, _ = search.rf_regression(df, ["a", "b", "c", "d"], "target", num_trees=20, max_depth=6)
    assert model.getOrDefault("maxMemoryInMB") == search.GROUP_MB
    train, _ = train_test_split(search.assemble(df.withColumnRenamed("target", "label"), ["a", "b", "c", "d"]), "row_id", 0.2, 42)
    fit = {mb: RandomForestRegressor(numTrees=20, seed=42, maxDepth=6, featureSubsetStrategy="all", maxMemoryInMB=mb).fit(train).toDebugString
           for mb in (0, 256)}  # 0: one node a pass
    shape = [s.split("\n", 1)[1] for s in (model.toDebugString, *fit.values())]
    assert shape[0] == shape[1] == shape[2]
    assert search.group_memory(31, 100, 8) == 4 and 4 < search.group_memory(200, 100, 8) < search.group_memory(5000, 500, 12) == 256


def test_points_with_levels_share_a_fit_and_score_alike(rows):
    """forests that differ in depth only come from one fit; the cut forests are those that a fit of their depth gives."""
    est = RandomForestClassifier(seed=3)
    spec = search.ModelSpec("f", est, {"numTrees": [12], "maxDepth": [1, 3, 6], "minInstancesPerNode": [1, 2],
                                       "featureSubsetStrategy": ["sqrt"]}, levels="maxDepth")
    maps = spec.param_maps()
    assert len(search.fit_groups(maps, spec.levels)) == 2
    whole = est.copy().fit(rows, {est.numTrees: 12, est.maxDepth: 6})
    tops = search.top_levels(rows.sparkSession, whole, [1, 3])
    shape = [tree.toDebugString.split("\n", 1)[1] for tree in whole.trees]
    assert len(shape) == 12
    for depth, cut in tops.items():
        plain = est.copy().fit(rows, {est.numTrees: 12, est.maxDepth: depth})
        assert [t.toDebugString.split("\n", 1)[1] for t in cut.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]
        assert cut.getMaxDepth() == depth
        a, b = ([r[0] for r in m.transform(rows).orderBy("row_id").select("rawPrediction").collect()] for m in (cut, plain))
        assert a == b
    ev = BinaryClassificationEvaluator(numBins=0)
    got = search.cross_validate(est, maps, rows, ev, 3, 4, levels="maxDepth")
    want = search.cross_validate(est, maps, rows, ev, 3, 4)
    assert got[:2] == want[:2] and [m.toDebugString.split("\n", 1)[1] for m in got[2]] == [m.toDebugString.split("\n", 1)[1] for m in want[2]]


def test_forests_whose_levels_outgrow_a_pass_are_fitted_each(rows, monkeypatch):
    """features are drawn in the order of passes, so a level in several passes is no base for a shared fit."""
    est = RandomForestClassifier(seed=3, numTrees=4)
    assert search.split_by_level(est, {est.maxDepth: 7}, 31) and not search.split_by_level(est, {est.maxDepth: 20, est.numTrees: 150}, 31)
    small = est.copy({est.maxMemoryInMB: 0})
    maps = search.ModelSpec("f", small, {"maxDepth": [1, 2]}).param_maps()
    monkeypatch.setattr(search, "top_levels", None)  # not to be called
    ev = BinaryClassificationEvaluator(numBins=0)
    got = search.cross_validate(small, maps, rows, ev, 3, 2, levels="maxDepth")
    want = search.cross_validate(small, maps, rows, ev, 3, 2)
    assert got[:2] == want[:2]


def test_the_catalogue_needs_twelve_forest_fits_a_fold(spark):
    forest, _ = search.default_specs()
    groups = search.fit_groups(forest.param_maps(), forest.levels)
    assert len(groups) == 12 and all(search.split_by_level(forest.estimator, p, 31) for p, _ in groups)
    assert sum(len(m) for _, m in groups) == len(forest.param_maps()) == 48
