"""forests and boosting over packed columns give MLlib's trees; a search and a selection round use them where the table fits a task."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from casework.operators import boruta, local_trees, search
from casework.operators.split import stratified_folds

FEATS = ["a", "b", "c", "d", "same", "g"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        a, b, c, d = float(rng.normal()), int(rng.integers(0, 9)), bool(rng.random() < 0.3), float(round(rng.random(), 1) - 0.4)
        y = float(a + 0.3 * b + c + rng.normal() > 1.6)
        rows.append((i, y, a, b, c, d, bool(c), int(rng.integers(0, 3))))
    return spark.createDataFrame(rows, "row_id long, label double, a double, b int, c boolean, d double, same boolean, g int").repartition(1).cache()


def columns(df, feats=FEATS):
    return search.packed(df.orderBy("row_id"), feats, "label")[0]


def shapes(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.trees]


def margins(model, df, at=1):
    return np.array([r[0][at] for r in model.transform(df).orderBy("row_id").select("rawPrediction").collect()])


def test_packed_columns_hold_the_table(table):
    got = columns(table)
    for f, v, c in zip(FEATS, got.values, got.codes):
        assert v[c].tolist() == [float(r[0]) for r in table.orderBy("row_id").select(F.col(f).cast("double")).collect()]
    assert local_trees.pack([np.array([1.0, np.nan])], np.array([0.0, 1.0])) is None  # MLlib is to tell what is wrong
    assert local_trees.pack([np.array([1.0, 2.0])], np.array([0.0, 2.0])) is None
    assert search.packed(table.withColumn("a", F.when(F.col("row_id") > 3, F.col("a"))), FEATS, "label")[0] is None


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_boosting_is_mllibs(spark, table, depth):
    data = search.assemble(table, FEATS)
    est = GBTClassifier(maxIter=8, maxDepth=depth, stepSize=0.3, seed=1, minInstancesPerNode=2)
    whole = est.fit(data)
    got = columns(table)
    fit = search.local_fit(est, {}, None, (), (1.0, 1.0))
    model = search.local_model(spark, est, {}, len(FEATS), fit.nodes(got, np.zeros(len(got))))
    assert margins(model, data) == pytest.approx(margins(whole, data), abs=1e-9)
    assert model.getNumTrees == 8 and model.treeWeights == whole.treeWeights and model.getMaxDepth() == depth and model.getMaxIter() == 8
    if depth < 5:  # below, splits of two features part a few rows alike, and rounding chooses for MLlib
        assert model.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray(), abs=1e-9)


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.7, 1.9)])
def test_a_forest_without_draws_is_mllibs(spark, table, weights):
    data = search.assemble(table, FEATS).withColumn("_class_weight", F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]))
    est = RandomForestClassifier(numTrees=2, maxDepth=4, minInstancesPerNode=3, featureSubsetStrategy="all", bootstrap=False, seed=1, weightCol="_class_weight")
    whole = est.fit(data)
    got = columns(table)
    fit = search.local_fit(est, {}, None, (), weights)
    model = search.local_model(spark, est, {}, len(FEATS), fit.nodes(got, np.zeros(len(got))))
    assert shapes(model) == shapes(whole) and margins(model, data) == pytest.approx(margins(whole, data), abs=1e-9)
    assert model.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray(), abs=1e-9)


def test_draws_and_subsets_are_those_of_a_forest():
    times = local_trees.drawn(np.random.default_rng(1), 400_000)
    share = np.bincount(times, minlength=6)[:6] / len(times)
    assert share == pytest.approx([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)], abs=3e-3) and abs(times.mean() - 1) < 0.01
    assert [local_trees.tried(s, 31, 9) for s in ("sqrt", "log2", "all", "auto", "onethird")] == [6, 5, 31, 6, 11] and local_trees.tried("auto", 31, 1) == 31


def test_deep_forests_hold_the_shallow_ones(table):
    """A fit scored at smaller depths gives what fits of those depths give; trees do not depend on the range they are grown in."""
    got = columns(table)
    fold = np.arange(len(got)) % 3
    est = RandomForestClassifier(numTrees=7, maxDepth=6, seed=5)
    deep = search.local_fit(est, {}, 1, (1, 4, 6), (1.0, 1.5)).scores(got, fold)
    for d in (1, 4):
        assert search.local_fit(est, {est.maxDepth: d}, 1, (d,), (1.0, 1.5)).scores(got, fold)[d] == deep[d]
    whole = search.local_fit(est, {}, None, (), (1.0, 1.0))
    parts = [search.replace(whole, trees=r).nodes(got, fold) for r in (range(0, 3), range(3, 7))]
    assert parts[0] + parts[1] == whole.nodes(got, fold)


def test_scores_are_the_evaluators(spark, table):
    data = search.assemble(table, FEATS)
    est = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.2, seed=1)
    got, fold = columns(table), np.array([i % 3 for i in range(900)])
    ev = BinaryClassificationEvaluator(numBins=0)
    for rounds, (auc, (tn, fp, fn, tp)) in search.local_fit(est, {}, 2, (2, 6), (1.0, 1.0)).scores(got, fold).items():
        model = est.copy({est.maxIter: rounds}).fit(data.filter("row_id % 3 <> 2"))
        pred = model.transform(data.filter("row_id % 3 = 2"))
        assert auc == pytest.approx(ev.evaluate(pred), abs=1e-9)
        said = {(r[0], r[1]): r[2] for r in pred.groupBy("label", "prediction").count().collect()}
        assert (tn, fp, fn, tp) == tuple(said.get(k, 0) for k in ((0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)))


def test_the_search_is_the_one_of_mllib(spark, table, monkeypatch):
    """All points and folds are scored in tasks, none by MLlib; where MLlib fits instead, results are the same."""
    specs = [search.ModelSpec("g", GBTClassifier(seed=3), {"maxIter": [2, 5], "maxDepth": [2, 3], "stepSize": [0.1, 0.4]}, staged="maxIter"),
             search.ModelSpec("f", RandomForestClassifier(numTrees=2, featureSubsetStrategy="all", bootstrap=False, seed=3),
                              {"maxDepth": [1, 4], "minInstancesPerNode": [1, 5]}, balanced=True, levels="maxDepth")]
    assert all(search.fits_locally(s) for s in search.default_specs() + specs) and not any(search.fits_locally(s) for s in search.optional_specs())
    want = []
    monkeypatch.setattr(local_trees, "LOCAL_BYTES", 0)
    want = search.grid_search(table, FEATS, specs)[1]
    monkeypatch.setattr(local_trees, "LOCAL_BYTES", 1 << 20)
    monkeypatch.setattr(search, "cross_validate", None)  # not to be called
    got = search.grid_search(table, FEATS, specs)[1]
    for a, b in zip(got, want):
        x, y = a.metrics.first().asDict(recursive=True), b.metrics.first().asDict(recursive=True)
        assert a.best_params == b.best_params and a.cv_auc == pytest.approx(b.cv_auc, abs=1e-9)
        assert x.pop("cv_metrics") == pytest.approx(y.pop("cv_metrics"))
        assert [i["importance"] for i in x.pop("feature_importances")] == pytest.approx([i["importance"] for i in y.pop("feature_importances")], abs=1e-9)
        assert x == pytest.approx(y) if isinstance(x, float) else {k: v for k, v in x.items() if not isinstance(v, float)} == {k: v for k, v in y.items() if not isinstance(v, float)}
        assert [x[k] for k in ("auc", "accuracy", "f1")] == pytest.approx([y[k] for k in ("auc", "accuracy", "f1")])


def test_other_specs_and_odd_labels_stay_with_mllib(spark, table):
    rf = RandomForestClassifier(seed=1)
    for spec in (search.ModelSpec("l", LogisticRegression(), {"maxIter": [2]}), search.ModelSpec("e", RandomForestClassifier(impurity="entropy"), {}),
                 search.ModelSpec("s", rf, {"subsamplingRate": [0.5]}), search.ModelSpec("q", rf, {"featureSubsetStrategy": ["0.4"]}),
                 search.ModelSpec("w", rf, {"maxDepth": [1]}, positive_weights=(2.0,))):
        assert not search.fits_locally(spec)
    folded = stratified_folds(table.filter("label = 1 or row_id < 20"), "label", "row_id", 50)
    assert search.search_locally([search.ModelSpec("f", rf, {"maxDepth": [1]})], folded, FEATS, "row_id", 50, True) is None  # folds without a class


def test_local_shadows_are_those_of_the_rows():
    """Each column is permuted within the hash-spread partitions, drawn as ``_shadow_rows`` draws partition 0."""
    import pandas as pd
    x = np.arange(60, dtype=np.uint8).reshape(3, 20)
    got = local_trees.shadowed(list(x), np.array([0, 12, 12, 20]), 7, 2)
    rows = next(boruta._shadow_rows(3, 7)(iter([pd.DataFrame({"label": np.zeros(12), "_x": list(x[:, :12].T.astype(float))})])))
    assert len(got) == 6 and np.array_equal(np.stack(rows["_x"].to_numpy())[:, 3:], np.stack([g[:12] for g in got], axis=1))
    for j, g in enumerate(got):
        assert sorted(g[:12]) == sorted(x[j % 3][:12]) and sorted(g[12:]) == sorted(x[j % 3][12:]) and not np.array_equal(g, x[j % 3])


def test_importances_are_mllibs(spark, table):
    """A drawn forest's importances come near MLlib's; of two equal columns each has its share."""
    data, got = search.assemble(table, FEATS), columns(table)
    bins = got.binned(got.thresholds(np.arange(len(got))))
    want = RandomForestClassifier(numTrees=120, seed=9).fit(data).featureImportances.toArray()
    grown = local_trees.grow_forest(bins, got.label, (1.0, 1.0), range(120), 5, 1, local_trees.tried("auto", len(FEATS), 120), [9])
    mean = np.mean([t.importance(len(FEATS)) for t in grown], axis=0)
    assert mean == pytest.approx(want, abs=0.03)


def test_rounds_of_a_small_table_are_fitted_in_tasks(spark, table, monkeypatch):
    """no round is fitted by MLlib; decisions are those of MLlib's rounds and do not depend on how many are fitted ahead."""
    df = table.withColumn("n1", F.pmod(F.xxhash64("row_id"), F.lit(97))).withColumn("n2", F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(7)))
    feats = ["a", "b", "c", "n1", "n2"]
    monkeypatch.setattr(local_trees, "LOCAL_BYTES", 0)
    want = boruta.boruta(df, feats, max_iter=9, num_trees=10, rows_per_partition=300)
    monkeypatch.setattr(local_trees, "LOCAL_BYTES", 1 << 20)
    monkeypatch.setattr(boruta, "RandomForestClassifier", None)  # not to be called
    got = [boruta.boruta(df, feats, max_iter=9, num_trees=10, rows_per_partition=300, speculate=w) for w in (None, 1, 5)]
    assert got[0] == got[1] == got[2]
    assert got[0].decision[:3] == want.decision[:3] == ["confirmed"] * 3 and "confirmed" not in got[0].decision[3:] + want.decision[3:]
