"""Model search (M1-M11): MLlib estimators under stratified k-fold cross-validation.

The search is a driver loop over model specifications; the fits of all folds and grid points of a
specification run concurrently (``parallelism``) on the persisted training vectors. Test metrics use the
exact aggregations of ``operators.metrics``.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.functions.text import col
from casework.operators import local_trees, metrics
from casework.operators.local_trees import cut_tree
from casework.operators.split import is_test_row, stratified_folds, train_test_split
from casework.session import materialize, scratch_path, ship_package

log = logging.getLogger(__name__)


@dataclass
class ModelSpec:
    """An estimator and its grid: {param name: values}."""

    name: str
    estimator: object
    grid: dict[str, list] = field(default_factory=dict)
    balanced: bool = False
    #: parameters whose grid values hold for a loss summed over the rows; MLlib's loss is their mean
    per_row: tuple[str, ...] = ()
    #: a parameter that counts stages (boosting rounds): the model of a smaller value is the first stages of that of a larger one
    staged: str | None = None
    #: weights of the rows of class 1 (class 0 weighs 1), one more axis of the grid
    positive_weights: tuple[float, ...] = ()
    #: a parameter that counts levels (depth of a forest): the model of a smaller value is the top of that of a larger one
    levels: str | None = None

    def param_maps(self, n_rows: int = 1):
        b = ParamGridBuilder()
        for k, vs in self.grid.items():
            b = b.addGrid(self.estimator.getParam(k), [v / max(1, n_rows) for v in vs] if k in self.per_row else vs)
        if self.positive_weights:
            b = b.addGrid(self.estimator.getParam("weightCol"), [weight_column(w) for w in self.positive_weights])
        return b.build()


_WEIGHT = "_positive_weight_"


def weight_column(weight: float) -> str:
    return _WEIGHT + str(float(weight)).replace(".", "_")


def with_positive_weights(df: DataFrame, specs: list[ModelSpec], label: str = "label") -> DataFrame:
    """One column per weight of any spec's grid, so that a grid point carries its own row weights."""
    weights = sorted({float(w) for s in specs for w in s.positive_weights})
    return df.select("*", *[F.when(F.col(label) == 1, w).otherwise(1.0).alias(weight_column(w)) for w in weights])


def shown_params(point: dict) -> dict:
    """A grid point as {name: value}; a weight column counts as its weight."""
    out = {p.name: v for p, v in point.items()}
    if str(out.get("weightCol", "")).startswith(_WEIGHT):
        out["positive_weight"] = float(out.pop("weightCol")[len(_WEIGHT):].replace("_", "."))
    return out


def first_stages(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted classifier of the first ``n`` trees of ``model``. Boosting without subsampling fits each tree to the
    trees before it, so this is the model that ``n`` rounds fit."""
    java, sc = model._java_obj, SparkContext._active_spark_context
    trees, weights = java.trees(), java.treeWeights()
    if n >= len(trees):
        return model
    some = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    part = sc._gateway.new_array(sc._gateway.jvm.double, n)
    for i in range(n):
        some[i], part[i] = trees[i], float(weights[i])
    cut = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{java.uid()}_{n}", some, part, java.numFeatures(), java.numClasses())
    java.copyValues(cut, java.extractParamMap())
    return GBTClassificationModel(cut)


def split_by_level(est, point: dict, n_features: int) -> bool:
    """Whether each pass of this two-class forest splits a whole level of all its trees. The features of a node are drawn in the order
    of the passes, so only then do forests that differ in depth draw alike: statistics of the widest level must fit a pass."""
    got = est.copy(point)
    per_node = {"sqrt": math.ceil(math.sqrt(n_features)), "log2": max(1, math.ceil(math.log2(n_features)))} \
        .get(got.getFeatureSubsetStrategy(), n_features)
    nodes = got.getNumTrees() * 2 ** max(0, got.getMaxDepth() - 1)
    return nodes * per_node * got.getMaxBins() * 3 * 8 <= got.getMaxMemoryInMB() << 20


def top_levels(spark, model: RandomForestClassificationModel, depths: list[int]) -> dict[int, RandomForestClassificationModel]:
    """The forests of the first levels of ``model``, by depth, through its saved form. Where passes split whole levels
    (``split_by_level``), these are the forests that a fit of that depth gives."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    trees: dict[int, list] = {}
    for r in nodes.select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.prediction").collect():
        trees.setdefault(r[0], []).append(r[1:])  # one row per node: bounded by the model
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    out = {}
    for depth in depths:
        kept = []
        for t, rows in trees.items():
            _, left, right, prediction = zip(*sorted(rows))
            kept += [(t, i, new, a, b) for new, (i, a, b) in enumerate(cut_tree(left, right, prediction, depth))]
        kept = spark.createDataFrame(kept, "treeID int, _id int, _new int, _left int, _right int")
        cut = nodes.withColumn("_id", F.col("nodeData.id")).join(F.broadcast(kept), ["treeID", "_id"]).select("treeID", F.col("nodeData").withField(
            "id", F.col("_new")).withField("leftChild", F.col("_left")).withField("rightChild", F.col("_right")).alias("nodeData"))
        about["paramMap"]["maxDepth"] = depth
        top = f"{path}-{depth}"
        cut.write.parquet(f"{top}/data")
        spark.read.parquet(f"{path}/treesMetadata").write.parquet(f"{top}/treesMetadata")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{top}/metadata")
        out[depth] = RandomForestClassificationModel.load(top)
    return out


def default_specs(seed: int = 42) -> list[ModelSpec]:
    """The reference catalogue: a balanced random forest (min-split has no MLlib parameter, so the
    grid has 2×4×3×2 = 48 points) and gradient-boosted trees (2×3×2 = 12 points)."""
    rf = RandomForestClassifier(seed=seed)
    gbt = GBTClassifier(seed=seed)
    return [
        ModelSpec("RandomForestClassifier", rf, {
            "numTrees": [50, 150], "maxDepth": [1, 3, 5, 7], "minInstancesPerNode": [1, 2, 3],
            "featureSubsetStrategy": ["sqrt", "log2"]}, balanced=True, levels="maxDepth"),
        ModelSpec("GBTClassifier", gbt, {"maxIter": [100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1]}, staged="maxIter"),
    ]


def optional_specs(seed: int = 42) -> list[ModelSpec]:
    """Specs present but switched off in the reference catalogue (M7)."""
    return [
        ModelSpec("LogisticRegression", LogisticRegression(maxIter=1000), {
            "regParam": [100.0, 10.0, 1.0, 0.1], "elasticNetParam": [1.0, 0.0]}, balanced=True, per_row=("regParam",)),
        ModelSpec("GBTClassifierWeighted", GBTClassifier(seed=seed), {
            "maxIter": [100, 200], "maxDepth": [3, 6], "stepSize": [0.01, 0.1]}, staged="maxIter", positive_weights=(1.0, 5.0, 10.0)),
    ]


def assemble(df: DataFrame, feature_cols: list[str], out: str = "features") -> DataFrame:
    """One vector column of ``feature_cols`` in order; booleans enter as 0/1.

    The assembler resolves names as paths (``a.b`` would mean a struct field), so columns are fed
    under positional aliases; the real names stay with the caller, in the same order.
    """
    feats = set(feature_cols)
    tmp = [f"_f{i}" for i in range(len(feature_cols))]
    cast = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in feats],
                     *[F.col(f"`{c}`").cast("double").alias(t) for c, t in zip(feature_cols, tmp)])
    return VectorAssembler(inputCols=tmp, outputCol=out, handleInvalid="error").transform(cast).drop(*tmp)


@dataclass
class SearchResult:
    name: str
    model: object
    metrics: DataFrame
    test: DataFrame
    cv_auc: float
    best_params: dict
    feature_names: list[str]


def _prob1(col: str = "probability"):
    return vector_to_array(F.col(col)).getItem(1)


def mean_metrics(counts: list[tuple[int, int, int, int]], folds: int | None = None) -> dict[str, float]:
    """Mean accuracy, precision, recall and F1 over folds, each given as tn, fp, fn, tp."""
    out = {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for tn, fp, fn, tp in counts:
        got = {"accuracy": (tp + tn) / max(tp + tn + fp + fn, 1), "precision": tp / (tp + fp) if tp else 0.0,
               "recall": tp / (tp + fn) if tp else 0.0, "f1": 2 * tp / (2 * tp + fp + fn) if tp else 0.0}
        out = {k: v + got[k] / (folds or len(counts)) for k, v in out.items()}
    return out


def fold_metrics(models: list, train: DataFrame, fold_col: str = "fold") -> dict[str, float]:
    """M3: mean accuracy, precision, recall and F1 over the folds, from one grid point's fold models and their
    validation rows."""
    from functools import reduce
    parts = [m.transform(train.filter(F.col(fold_col) == i).select("features", "label"))
             .select("label", "prediction", F.lit(i).alias("fold")) for i, m in enumerate(models)]
    y, p = F.col("label") == 1, F.col("prediction") == 1
    per = reduce(lambda a, b: a.unionByName(b), parts).groupBy("fold") \
        .agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    return mean_metrics([(r.tn, r.fp, r.fn, r.tp) for r in per.collect()], len(models))


def fit_groups(maps: list[dict], staged: str | None) -> list[tuple[dict, list[tuple[int, int | None]]]]:
    """Grid points that one fit serves: (the point to fit, [(index, stages or None)]). Points that differ only in the number of
    stages share the fit of the largest."""
    groups: dict[tuple, list[int]] = {}
    for i, m in enumerate(maps):
        groups.setdefault(tuple(sorted((p.name, str(v)) for p, v in m.items() if p.name != staged)), []).append(i)
    out = []
    for index in groups.values():
        stages = {i: v for i in index for p, v in maps[i].items() if p.name == staged}
        top = max(index, key=lambda i: stages.get(i, 0))
        out.append((maps[top], [(i, stages.get(i)) for i in index]))
    return out


def cross_validate(est, maps: list[dict], train: DataFrame, evaluator, folds: int, parallelism: int,
                   fold_col: str = "fold", staged: str | None = None, pool=None,
                   levels: str | None = None) -> tuple[int, float, list]:
    """M3: index and mean AUC of the best grid point (the first of equal ones), and its fold models. Fits of all folds and
    points are submitted from ``parallelism`` driver threads (or to ``pool``); a point's models are dropped as soon as
    another is better. Points that differ in ``staged`` only are scored from one fit per fold, as are those that differ in
    ``levels`` only, where passes split whole levels."""
    from concurrent.futures import ThreadPoolExecutor
    sides = [(train.filter(F.col(fold_col) != i), train.filter(F.col(fold_col) == i)) for i in range(folds)]

    levels = None if staged else levels
    groups = fit_groups(maps, staged or levels)
    if levels:
        n_features = len(train.select("features").first()[0])
        if not all(split_by_level(est, point, n_features) for point, _ in groups):
            groups = fit_groups(maps, None)

    def fit(point: dict, members: list, fold: int):
        whole, out = est.copy().fit(sides[fold][0], point), {}
        deepest = max((n for _, n in members if n is not None), default=None)
        tops = top_levels(train.sparkSession, whole, sorted({n for _, n in members} - {deepest})) if levels and len(members) > 1 else {}
        for i, stages in members:
            model = whole if stages is None else tops.get(stages, whole) if levels else first_stages(whole, stages)
            out[i] = (model, evaluator.evaluate(model.transform(sides[fold][1])))
        return out

    best = (-1, float("-inf"), [])
    own = pool or ThreadPoolExecutor(max_workers=max(1, parallelism))
    try:
        run = inheritable_thread_target(train.sparkSession)(fit)  # the caller's scheduler pool holds in the fits' threads too
        running = [[own.submit(run, point, members, i) for i in range(folds)] for point, members in groups]
        for j in range(len(running)):
            done = [f.result() for f in running[j]]
            running[j] = []
            for i in done[0]:
                auc = sum(d[i][1] for d in done) / folds
                if auc > best[1] or (auc == best[1] and i < best[0]):
                    best = (i, auc, [d[i][0] for d in done])
    finally:
        if pool is None:
            own.shutdown(cancel_futures=True)
    return best


def fitted_estimator(spec: ModelSpec):
    """A copy of the spec's estimator that reads the search's columns."""
    est = spec.estimator.copy()
    est.setFeaturesCol("features").setLabelCol("label")
    if spec.balanced and est.hasParam("weightCol"):
        est.set(est.getParam("weightCol"), "_class_weight")
    return est


#: Parameters that ``local_trees`` knows, or that change no tree.
_FOREST = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "bootstrap", "maxBins", "seed"}
_BOOSTING = {"maxIter", "maxDepth", "minInstancesPerNode", "stepSize", "maxBins", "seed"}
_NO_MATTER = {"maxMemoryInMB", "cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol"}


def fits_locally(spec: ModelSpec) -> bool:
    """Whether ``local_trees`` fits every point of the spec: a forest or boosting classifier without other parameters than it knows."""
    known = {RandomForestClassifier: _FOREST, GBTClassifier: _BOOSTING}.get(type(spec.estimator))
    if known is None or spec.positive_weights or spec.per_row or (spec.balanced and known is _BOOSTING):
        return False
    est = spec.estimator
    given = {p.name for p in est.params if est.isSet(p) and not (est.hasDefault(p) and est.getOrDefault(p) == est._defaultParamMap[p])}
    points = [{p.name: v for p, v in m.items()} for m in spec.param_maps()]
    strategies = {m.get("featureSubsetStrategy", est.getOrDefault("featureSubsetStrategy")) for m in points}
    bins = {m.get("maxBins", est.getOrDefault("maxBins")) for m in points}
    return (given | {n for m in points for n in m}) <= known | _NO_MATTER and max(bins) <= 256 and \
        strategies <= ({"auto", "all", "sqrt", "log2", "onethird"} if known is _FOREST else {"all"})


def local_fit(est, point: dict, fold: int | None, marks: tuple[int, ...], weight: tuple[float, float]) -> local_trees.Fit:
    got = est.copy(point)
    common = dict(fold=fold, depth=got.getMaxDepth(), marks=marks, least=got.getMinInstancesPerNode(), max_bins=got.getMaxBins(),
                  seed=got.getSeed() & (1 << 64) - 1)
    if isinstance(est, GBTClassifier):
        return local_trees.Fit(True, trees=range(got.getMaxIter()), step=got.getStepSize(), **common)
    return local_trees.Fit(False, trees=range(got.getNumTrees()), of=got.getNumTrees(), strategy=got.getFeatureSubsetStrategy(),
                           bootstrap=got.getBootstrap(), weight=weight, **common)


def local_model(spark, est, point: dict, n_features: int, trees: list[tuple[int, float, list[tuple]]]):
    """MLlib's model of these trees, through its saved form: that of a fit of one tree to two rows, with other nodes and parameters."""
    some = [f"x{i}" for i in range(n_features)]
    few = assemble(spark.range(2).select(F.col("id").cast("double").alias("label"), F.lit(1.0).alias("_class_weight"),
                                         *[F.col("id").alias(c) for c in some]), some)
    count = "maxIter" if isinstance(est, GBTClassifier) else "numTrees"
    stub = est.copy(point)
    model = stub.copy({stub.getParam(count): 1, stub.getParam("maxDepth"): 1}).fit(few)
    path = scratch_path(spark, "local-model")
    model.write().save(path)
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    about["paramMap"] |= {n: stub.getOrDefault(n) for n in (count, "maxDepth")}
    about["numTrees"] = len(trees)
    out = f"{path}-whole"
    shape = spark.read.parquet(f"{path}/data").schema
    spark.createDataFrame([(t, n) for t, _, nodes in trees for n in nodes], shape).coalesce(1).write.parquet(f"{out}/data")
    one = spark.read.parquet(f"{path}/treesMetadata")
    told = json.loads(one.first()[1])
    told["paramMap"] |= {"maxDepth": stub.getMaxDepth()}
    spark.createDataFrame([(t, json.dumps(told | {"uid": f"{told['uid']}_{t}"}), w) for t, w, _ in trees], one.schema) \
        .coalesce(1).write.parquet(f"{out}/treesMetadata")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{out}/metadata")
    return type(model).load(out)


def packed(df: DataFrame, names: list[str], label: str, *others: str):
    """The table's features and labels (``local_trees.Columns``, None where MLlib is to tell what is wrong) and its other columns."""
    plain = [F.col(n) if isinstance(df.schema[n].dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType))
             else F.col(n).cast("double").alias(n) for n in names]
    got = df.select(F.col(label).cast("double").alias("_label"), *others, *plain).toArrow()
    if any(got[c].null_count for c in ["_label", *names]):
        return None, None
    return local_trees.pack([got[n].to_numpy() for n in names], got["_label"].to_numpy()), [got[c].to_numpy() for c in others]


def search_locally(specs: list[ModelSpec], train: DataFrame, names: list[str], row_id: str, folds: int, cv_metrics: bool) -> list[tuple] | None:
    """M3, M4 on a table whose packed columns fit a task: they are broadcast, every fit of a fold and the points that share it is one task, and
    tasks send back scores. The best point of each spec is fitted to all rows and becomes MLlib's model. Gives per spec the point, its
    AUC, its other scores and the model; None where MLlib is to fit after all."""
    spark = train.sparkSession
    columns, others = packed(train.orderBy(row_id, "label", "fold", *names), names, "label", "fold")
    sides = np.bincount(others[0] * 2 + columns.label, minlength=2 * folds) if columns else np.zeros(1)
    if not (sides > 0).all():  # no class may be missing in a fold
        return None
    sc, fold = spark.sparkContext, others[0].astype(np.int16)
    ship_package(spark)
    kept = sc.broadcast((columns, fold))
    weight = tuple(len(columns) / (2 * n) for n in np.bincount(columns.label).tolist())

    def run(tasks: list, do):
        """Each task's result, the longest begun first."""
        order = sorted(range(len(tasks)), key=lambda i: -tasks[i].cost())
        done = sc.parallelize([(i, tasks[i]) for i in order], len(tasks)).map(lambda t: (t[0], do(t[1], *kept.value))).collect()
        return [r for _, r in sorted(done, key=lambda r: r[0])]

    fits, of = [], []  # of: (spec, {mark: point}) by fit
    for s, spec in enumerate(specs):
        est, maps = fitted_estimator(spec), spec.param_maps()
        axis = "maxIter" if isinstance(est, GBTClassifier) else "maxDepth"
        for point, members in fit_groups(maps, axis):
            marks = {est.copy(maps[i]).getOrDefault(axis): i for i, _ in members}
            fits += [local_fit(est, point, k, tuple(marks), weight if spec.balanced else (1.0, 1.0)) for k in range(folds)]
            of += [(s, marks)] * folds
    scores: dict[tuple[int, int], list] = {}
    for (s, marks), got in zip(of, run(fits, lambda fit, c, f: fit.scores(c, f))):
        for mark, i in marks.items():
            scores.setdefault((s, i), []).append(got[mark])
    out, refits = [], []
    for s, spec in enumerate(specs):
        est, maps = fitted_estimator(spec), spec.param_maps()
        auc = [sum(a for a, _ in scores[s, i]) / folds for i in range(len(maps))]
        best = max(range(len(maps)), key=lambda i: (auc[i], -i))
        other = mean_metrics([cm for _, cm in scores[s, best]]) if cv_metrics else None
        out.append((maps[best], auc[best], other, est))
        whole = local_fit(est, maps[best], None, (), weight if spec.balanced else (1.0, 1.0))
        parts = 1 if whole.boosted else min(len(whole.trees), sc.defaultParallelism)
        refits += [(s, replace(whole, trees=whole.trees[k * len(whole.trees) // parts:(k + 1) * len(whole.trees) // parts])) for k in range(parts)]
    trees: dict[int, list] = {}
    for (s, _), got in zip(refits, run([f for _, f in refits], lambda fit, c, f: fit.nodes(c, f))):
        trees.setdefault(s, []).extend(got)
    kept.destroy()
    return [(point, auc, other, local_model(spark, est, point, len(names), trees[s])) for s, (point, auc, other, est) in enumerate(out)]


def evaluate(model, test: DataFrame, feature_names: list[str], best_params: dict, name: str,
             cv_auc: float, cv_other: dict | None = None) -> DataFrame:
    """M8/M9 + A9-A11: one metrics row for a fitted classifier on the test rows.

    Predictions are persisted for the two metric jobs, then released; the result is a one-row
    DataFrame of literals (no lineage back to the test rows).
    """
    spark = test.sparkSession
    pred = model.transform(test).select("label", "prediction", _prob1().alias("score"))
    pred = pred.persist(StorageLevel.MEMORY_AND_DISK)
    cm = metrics.confusion_metrics(pred).first()
    auc_v = metrics.roc_auc(pred).first()["auc"]
    pred.unpersist()
    imp = getattr(model, "featureImportances", None)
    imps = [(n, float(v)) for n, v in zip(feature_names, imp.toArray())] if imp is not None else None
    schema = ("model string, auc double, accuracy double, precision double, recall double, f1 double, "
              "confusion_matrix struct<tn:bigint,fp:bigint,fn:bigint,tp:bigint>, best_params map<string,string>, "
              "feature_importances array<struct<feature:string,importance:double>>, cv_auc double, "
              "cv_metrics map<string,double>")
    row = (name, float(auc_v) if auc_v is not None else None, cm["accuracy"], cm["precision"], cm["recall"], cm["f1"],
           (cm["tn"], cm["fp"], cm["fn"], cm["tp"]), {k: str(v) for k, v in best_params.items()}, imps,
           float(cv_auc), {k: float(v) for k, v in (cv_other or {}).items()})
    return spark.createDataFrame([row], schema)


#: Bytes of dense feature vectors per partition of the training rows: a search runs many fits at once, so few, full partitions.
TRAIN_PARTITION_BYTES = 64 << 20


def spread_rows(train: DataFrame, n_features: int, row_id: str = "row_id") -> DataFrame:
    """The training rows spread by id over equal partitions of at most about ``TRAIN_PARTITION_BYTES`` of vectors, at least one per core.
    A forest draws its samples by partition and place in it, so rows are put in the order of their ids."""
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() * 8 * max(1, n_features) // TRAIN_PARTITION_BYTES))
    return train.repartition(parts, F.xxhash64(row_id)).sortWithinPartitions(row_id)


def grid_search(df: DataFrame, feature_cols: list[str], specs: list[ModelSpec] | None = None, row_id: str = "row_id",
                test_size: float = 0.2, seed: int = 42, folds: int = 5, parallelism: int | None = None,
                select_by: str = "test", use_boruta: bool = False,
                boruta_iter: int = 100, cv_metrics: bool = True) -> tuple[SearchResult, list[SearchResult]]:
    """M1-M4: split by id hash, stratified folds, CV per spec (AUC, exact), winner by test AUC
    (``select_by='test'``, the compatible choice) or by CV AUC (``'cv'``). ``cv_metrics`` also
    scores accuracy, precision, recall and F1 per grid point over the folds (M3).

    Forests and boosting over a table of up to ``local_trees.LOCAL_BYTES`` are fitted in one task a fit (``search_locally``); all other
    specs' fits go through one pool of ``parallelism`` driver threads (by default one per core of the session). Their training
    rows are kept once, in partitions of about ``TRAIN_PARTITION_BYTES`` of vectors: a fit reads them many times, and on
    a small table a fit that stays in one task leaves the other cores to the other fits.

    M12: ``use_boruta`` selects features on the training rows only (two-step, alpha 0.1, a forest sized to its features) and
    applies the selection to both sides; if nothing is confirmed all features stay."""
    from concurrent.futures import ThreadPoolExecutor
    if specs is not None and not specs:
        raise ValueError("You must provide at least one model specification.")
    specs = specs or default_specs(seed)
    if use_boruta:
        from casework.operators.boruta import boruta
        train_rows = df.filter(~is_test_row(row_id, test_size, seed))
        sel = boruta(train_rows, feature_cols, "label", row_id, max_iter=boruta_iter, num_trees=None, seed=seed).selected
        feature_cols = sel or feature_cols
    spark = df.sparkSession
    parallelism = parallelism or spark.sparkContext.defaultParallelism
    names = [f"_f{i}" for i in range(len(feature_cols))]
    data = df.select(row_id, "label", *[col(c).alias(n) for c, n in zip(feature_cols, names)])
    train, test = train_test_split(data, row_id, test_size, seed)
    train = metrics.with_class_weight(train, "label", "_class_weight")
    train = materialize(stratified_folds(train, "label", row_id, folds, seed), "search-train")
    n_train = train.count()
    test = materialize(assemble(test, names).select(row_id, "features", "label"), "search-test")  # stays readable for the caller
    here = [i for i, s in enumerate(specs) if fits_locally(s)] if 0 < n_train * 8 * len(names) <= local_trees.LOCAL_BYTES else []
    fitted = search_locally([specs[i] for i in here], train, names, row_id, folds, cv_metrics) if here else None
    fitted = dict(zip(here, fitted or []))
    rest = [i for i in range(len(specs)) if i not in fitted]
    if rest:
        train = assemble(train, names)
        train = with_positive_weights(train, specs).select(row_id, "features", "label", "_class_weight", "fold", *[
            weight_column(w) for w in sorted({float(w) for s in specs for w in s.positive_weights})])
        parts = max(1, -(-n_train * 8 * max(1, len(feature_cols)) // TRAIN_PARTITION_BYTES))
        train = train.repartition(parts, F.xxhash64(row_id)).persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC", rawPredictionCol="rawPrediction",
                                              numBins=0)

    def fit_spec(spec: ModelSpec, pool):
        est = fitted_estimator(spec)
        maps = spec.param_maps(n_train)
        best_i, auc, models = cross_validate(est, maps, train, evaluator, folds, parallelism, staged=spec.staged, pool=pool,
                                              levels=spec.levels)
        other = fold_metrics(models, train) if cv_metrics else None
        return maps[best_i], auc, other, est.copy().fit(train, maps[best_i])

    # long fits first: the specs with stages are submitted ahead of the others
    order = sorted(rest, key=lambda i: specs[i].staged is None)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as fits, ThreadPoolExecutor(max_workers=len(specs)) as searches:
        run = inheritable_thread_target(spark)(fit_spec)
        jobs = {i: searches.submit(run, specs[i], fits) for i in order}
        fitted |= {i: jobs[i].result() for i in rest}
    results = []
    for spec, (point, auc, other, model) in zip(specs, [fitted[i] for i in range(len(specs))]):
        best_params = shown_params(point)
        m = evaluate(model, test, feature_cols, best_params, spec.name, auc, other)
        results.append(SearchResult(spec.name, model, m, test, auc, best_params, feature_cols))
        log.info("%s: cv auc %.4f params %s", spec.name, auc, best_params)
    train.unpersist()
    key = (lambda r: r.metrics.first()["auc"]) if select_by == "test" else (lambda r: r.cv_auc)
    best = max(results, key=key)
    return best, results


#: MB of split statistics that a pass of the regression forest fills, and the most passes that may cost.
GROUP_MB = 4
MAX_GROUPS = 160


def group_memory(n_features: int, num_trees: int, max_depth: int, bins: int = 32) -> int:
    """MB of statistics for the nodes that one pass over the rows splits. Every row updates statistics of every tree in the pass;
    once these outgrow the processor's cache, the update waits for memory. Smaller groups take more passes, so many
    features or deep trees get larger ones, up to MLlib's default of 256. Only for forests that try all features at each split: those draw nothing
    per node, so their trees do not depend on the groups."""
    whole = num_trees * (2 ** max_depth - 1) * n_features * bins * 24  # weight, sum and sum of squares per bin
    return min(256, max(GROUP_MB, -(-whole // (MAX_GROUPS << 20))))


def rf_regression(df: DataFrame, feature_cols: list[str], target: str, row_id: str = "row_id",
                  test_size: float = 0.2, seed: int = 42, num_trees: int = 100, max_depth: int = 8,
                  bootstrap: bool = True):
    """F5 binary cast, split, random-forest regression over all features at each split; returns
    (model, metrics, test). ``max_depth`` bounds the trees (MLlib allows up to 30; deeper trees fit closer and
    make attribution dearer)."""
    from casework.operators.clean import binary_target_cast
    df = binary_target_cast(df, target)
    data = assemble(df.select(row_id, col(target).cast("double").alias("label"), *[col(c) for c in feature_cols]), feature_cols)
    train, test = train_test_split(data, row_id, test_size, seed)
    train = train.persist(StorageLevel.DISK_ONLY)  # read a few times before the passes; memory is left to the fit's own points
    model = RandomForestRegressor(numTrees=num_trees, seed=seed, maxDepth=max_depth, featureSubsetStrategy="all", bootstrap=bootstrap,
                                  maxMemoryInMB=group_memory(len(feature_cols), num_trees, max_depth)).fit(train)
    train.unpersist()
    pred = model.transform(test)
    return model, metrics.regression_metrics(pred), test
