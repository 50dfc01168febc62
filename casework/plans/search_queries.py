"""Queries of the model search whose results SQL can work out: stages of boosting (M6) and row weights as a grid axis (M7)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from casework.operators import search
from casework.plans.catalogue import query, r6
from casework.plans.modelling import _TREE_ROWS, _tree_rows

STAGES = (1, 5, 10, 20)


@query("boosting_stages", f"""WITH RECURSIVE p AS (SELECT x, avg(y)::DOUBLE AS p FROM ({_TREE_ROWS}) GROUP BY x),
-- each stage adds a tenth of the mean residual of its leaf; the first fits the labels as -1 and 1
f AS (SELECT x, p, 1 AS stages, 2 * p - 1 AS margin FROM p
      UNION ALL SELECT x, p, stages + 1, margin + 0.1::DOUBLE * (p * 4 / (1 + exp(2 * margin)) - (1 - p) * 4 / (1 + exp(-2 * margin))) FROM f WHERE stages < 20)
SELECT stages, x, round(margin, 6) AS margin, round(1 / (1 + exp(-2 * margin)), 6) AS probability FROM f WHERE stages IN {STAGES}""")
def q_boosting_stages(spark, d):
    """M6: the margins of 1, 5, 10 and 20 boosting rounds, all from one fit of 20 rounds."""
    rows = _tree_rows(spark, d)
    data = search.assemble(rows.select("x", F.col("x").alias("x1"), "z", "label"), ["x1", "z"])
    model = GBTClassifier(maxIter=max(STAGES), maxDepth=1, stepSize=0.1, seed=1).fit(data)
    leaves = data.select("x", "features").distinct()
    out = None
    for n in STAGES:
        part = search.first_stages(model, n).transform(leaves).select(
            F.lit(n).alias("stages"), "x", r6(search.vector_to_array("rawPrediction")[1]).alias("margin"), r6(search._prob1()).alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


WEIGHTS = (1.0, 5.0, 10.0)


@query("positive_weights", f"""WITH w AS (SELECT unnest({list(WEIGHTS)})::DOUBLE AS weight),
c AS (SELECT x, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM ({_TREE_ROWS}) GROUP BY x),
r AS (SELECT weight, x, weight * pos / (weight * pos + neg) AS p, sum(weight * pos) OVER u / sum(weight * pos + neg) OVER u AS all_p
      FROM c, w WINDOW u AS (PARTITION BY weight)),
-- two leaves that predict the same class are one leaf
s AS (SELECT *, min(p > 0.5) OVER (PARTITION BY weight) = max(p > 0.5) OVER (PARTITION BY weight) AS joined FROM r)
SELECT weight AS positive_weight, x, round(CASE WHEN joined THEN all_p ELSE p END, 6) AS probability FROM s""")
def q_positive_weights(spark, d):
    """M7: grid points that weigh the rows of class 1 by 1, 5 and 10: one tree's class shares under each."""
    tree = RandomForestClassifier(numTrees=1, maxDepth=1, featureSubsetStrategy="all", bootstrap=False, seed=1)
    spec = search.ModelSpec("tree", tree, {"maxDepth": [1]}, positive_weights=WEIGHTS)
    rows = _tree_rows(spark, d)
    data = search.with_positive_weights(search.assemble(rows.select("x", F.col("x").alias("x1"), "label"), ["x1"]), [spec])
    leaves = data.select("x", "features").distinct()
    out = None
    for point in spec.param_maps():
        part = tree.fit(data, point).transform(leaves).select(F.lit(search.shown_params(point)["positive_weight"]).alias("positive_weight"), "x",
                                                              r6(search._prob1()).alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out
