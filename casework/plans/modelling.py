"""Modelling queries: training table (X4), search (M1-M9), regression (M10-M11), attribution
(X1-X2, S6) and selection (M12-M13). They read the case table derived from the driver's tables.
Most are checked by row count plus property tests; ``stump_shap`` also has a closed-form oracle."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.config import BuildConfig
from casework.functions.text import col, to_number
from casework.operators import search, treeshap
from casework.operators.metrics import with_class_weight
from casework.plans.catalogue import _HASH, query, r6
from casework.plans.training import build_training_table, feature_columns, with_label
from casework.session import materialize, scratch_path, wide_plans
from casework.sources.fixtures import build_cases
from casework.sources.tables import read_cases, table

TARGET = "tothlos"
BIN = "x > 5"


def training_table(spark: SparkSession, sf_dir: str, cfg: BuildConfig | None = None) -> DataFrame:
    """X4 on the case table (row order = case id); target ``tothlos``."""
    raw = build_cases(spark, sf_dir).withColumn("row_id", F.col("caseid"))
    cfg = cfg or BuildConfig(target=TARGET)
    df, _ = build_training_table(raw, cfg)
    return df


query("training_table")(training_table)


def _labelled(spark, d):
    """The labelled training table, written once (fits and attributions read it many times), and its features."""
    with wide_plans(spark):
        t = with_label(training_table(spark, d), TARGET, BIN)
        feats = feature_columns(t, TARGET, exclude=("row_id", "label"))
        return materialize(t.select("row_id", "label", *[col(c) for c in feats]), "labelled"), feats


@query("grid_search")
def q_grid_search(spark, d):
    t, feats = _labelled(spark, d)
    best, results = search.grid_search(t, feats, search.default_specs())
    rows = None
    for r in results:
        m = r.metrics.withColumn("selected", F.lit(r.name == best.name))
        rows = m if rows is None else rows.unionByName(m)
    return rows


def _fit_forest(spark, d, num_trees=50, depth=5):
    t, feats = _labelled(spark, d)
    from casework.operators.split import train_test_split
    train, test = train_test_split(t, "row_id")
    train = search.spread_rows(with_class_weight(train, "label", "_w"), len(feats))
    train = search.assemble(train, feats).select("features", "label", "_w").persist(StorageLevel.DISK_ONLY)  # the fit reads it several times
    model = RandomForestClassifier(numTrees=num_trees, maxDepth=depth, seed=42, weightCol="_w").fit(train)
    train.unpersist()
    return model, search.assemble(test, feats), feats


@query("tree_shap")
def q_tree_shap(spark, d):
    model, test, feats = _fit_forest(spark, d)
    return treeshap.explain_summary(test, model, feats)


@query("attribution_bins")
def q_attr_bins(spark, d):
    model, test, feats = _fit_forest(spark, d)
    sh = materialize(treeshap.explain(test, model, keep_values=True), "shap")  # read by the summary, the edges and the bins
    return treeshap.attribution_bins(sh, None, feats, top_k=25)


@query("rf_regression")
def q_rf_regression(spark, d):
    t = training_table(spark, d)
    feats = feature_columns(t, TARGET)
    _, m, _ = search.rf_regression(t, feats, TARGET, num_trees=100)
    return m


# X1 on a depth-1 tree whose split and leaves come from aggregates: phi(split feature) =
# leaf value - cover-weighted mean of the leaves; phi(other feature) = 0.
_STUMP_T = 25.0


@query("stump_shap",
       "WITH s AS (SELECT avg(l_discount) FILTER (WHERE l_quantity <= 25.0) AS vl, avg(l_discount) FILTER (WHERE l_quantity > 25.0) AS vr, "
       "count(*) FILTER (WHERE l_quantity <= 25.0) AS nl, count(*) AS n FROM lineitem) "
       "SELECT l_orderkey, l_linenumber, round((CASE WHEN l_quantity <= 25.0 THEN vl ELSE vr END) - (nl * vl + (n - nl) * vr) / n + 1e-9, 6) + 0.0 AS phi_quantity, "
       "0.0 AS phi_tax FROM lineitem, s")
def q_stump(spark, d):
    li = table(spark, d, "lineitem")
    left = F.col("l_quantity") <= _STUMP_T
    agg = li.agg(F.avg(F.when(left, F.col("l_discount"))).alias("vl"), F.avg(F.when(~left, F.col("l_discount"))).alias("vr"),
                 F.count_if(left).alias("nl"), F.count(F.lit(1)).alias("n")).first()
    tree = treeshap.Tree(feature=np.array([0, 0, 0]), threshold=np.array([_STUMP_T, 0.0, 0.0]),
                         left=np.array([1, -1, -1]), right=np.array([2, -1, -1]),
                         value=np.array([0.0, agg["vl"], agg["vr"]]),
                         cover=np.array([float(agg["n"]), float(agg["nl"]), float(agg["n"] - agg["nl"])]), categories={})
    x = li.select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity"), F.col("l_tax")).alias("x"))
    sh = treeshap.explain_trees(x, [tree], "x", ("l_orderkey", "l_linenumber"))
    return sh.select("l_orderkey", "l_linenumber", r6(F.col("shap")[0] + 1e-9).alias("phi_quantity"),
                     r6(F.col("shap")[1]).alias("phi_tax"))


@query("boruta")
def q_boruta(spark, d):
    from casework.operators.boruta import boruta
    t, feats = _labelled(spark, d)
    res = boruta(t, feats, "label", max_iter=100, num_trees=None)
    return res.to_frame(spark)


@query("training_table_lexical")
def q_training_lexical(spark, d):
    """X4 in the compatible mode: numeric-looking text (the target too) becomes label codes of
    the sorted strings, as in the reference."""
    return training_table(spark, d, BuildConfig(target=TARGET, numeric_mode="lexical"))


@query("rf_regression_shap")
def q_rf_regression_shap(spark, d):
    """M10 attribution: Tree SHAP of the random-forest regressor on the test rows, top 40 features."""
    t = training_table(spark, d)
    feats = feature_columns(t, TARGET)
    model, _, test = search.rf_regression(t, feats, TARGET, num_trees=100)
    return treeshap.explain_summary(test, model, feats).limit(40)


@query("csv_cases",
       "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, "
       "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_custkey || ', \"' || o_orderpriority || '\"' AS note "
       "FROM orders")
def q_csv_cases(spark, d):
    """The orders as a CSV case file in the shared folder, with missing tokens and quoted fields, read back."""
    o = table(spark, d, "orders")
    path = scratch_path(spark, "csv cases")
    o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
             F.when(F.col("o_orderkey") % 5 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
             F.concat(F.col("o_custkey").cast("string"), F.lit(', "'), "o_orderpriority", F.lit('"')).alias("note")) \
        .write.option("header", True).option("escape", '"').csv(path)
    c = read_cases(spark, path)
    return c.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", to_number("o_totalprice").alias("o_totalprice"), "note")


@query("name_collisions",
       "WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity AS flag_r, "
       "CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS flag FROM lineitem) "
       "SELECT l_orderkey, l_linenumber, flag_r, flag = 'N' AS \"flag_N\", flag = 'R' AS \"flag_R.1\", flag = 'a' AS flag_a, "
       "flag = 'n' AS \"flag_n.1\", flag = 'r' AS \"flag_r.2\" FROM f")
def q_name_collisions(spark, d):
    """Dummies of values that differ in case only, next to a column that has one of their names."""
    from casework.operators.encoders import CategoricalEncoder
    li = table(spark, d, "lineitem")
    f = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("flag_r"),
                  F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("flag"))
    return CategoricalEncoder(columns=["flag"]).fit(f).transform(f)


# One tree without bootstrap on one 0/1 feature: its leaves are the classes' shares (or the targets' means) by
# feature value, which SQL can work out for every fold. This holds the search, the metrics, the regression path and
# the exported trees to exact figures.
_TREE_ROWS = ("SELECT o_orderkey AS row_id, CAST(o_totalprice > 250000 AS INT) AS x, "
              "CAST(o_totalprice + 10000 * (o_custkey % 20) > 340000 AS INT) AS y, o_totalprice / 1000 + 10 * (o_custkey % 20) AS target FROM orders")
_TREE_SPLIT = (f"WITH s AS (SELECT *, {_HASH.format(k='row_id')} AS h FROM ({_TREE_ROWS})), "
               "t AS (SELECT *, (h % 10000) < 2000 AS is_test FROM s)")


def _tree_rows(spark, d):
    o, more = table(spark, d, "orders"), F.col("o_custkey") % 20
    return o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") > 250000).cast("int").alias("x"),
                    (F.col("o_totalprice") + 10000 * more > 340000).cast("double").alias("label"),
                    (F.col("o_totalprice") / 1000 + 10 * more).alias("target"), F.lit(0).alias("z"))


@query("search_one_tree", _TREE_SPLIT + """,
f AS (SELECT x, y, 5 AS part FROM t WHERE is_test
      UNION ALL SELECT x, y, (row_number() OVER (PARTITION BY y ORDER BY h, row_id) - 1) % 5 FROM t WHERE NOT is_test),
c AS (SELECT part, x, y, count(*) AS n FROM f GROUP BY ALL), k AS (SELECT unnest(range(0, 6)) AS k),
m AS (SELECT k, x, CAST(sum(n) FILTER (y = 1) AS DOUBLE) / sum(n) AS p FROM c, k WHERE part <> 5 AND part <> k GROUP BY k, x),
v AS (SELECT k.k, c.x, m.p, coalesce(sum(n) FILTER (y = 1), 0) AS pos, coalesce(sum(n) FILTER (y = 0), 0) AS neg
      FROM c JOIN k ON c.part = k.k JOIN m ON m.k = k.k AND m.x = c.x GROUP BY k.k, c.x, m.p),
a AS (SELECT v.k, sum(v.pos * w.neg * CASE WHEN v.p > w.p THEN 1.0::DOUBLE WHEN v.p = w.p THEN 0.5 ELSE 0 END) / sum(v.pos * w.neg) AS auc
      FROM v JOIN v AS w ON v.k = w.k GROUP BY v.k),
q AS (SELECT k, coalesce(sum(pos) FILTER (p > 0.5), 0)::DOUBLE AS tp, coalesce(sum(neg) FILTER (p > 0.5), 0)::DOUBLE AS fp,
             coalesce(sum(pos) FILTER (p <= 0.5), 0)::DOUBLE AS fn, coalesce(sum(neg) FILTER (p <= 0.5), 0)::DOUBLE AS tn FROM v GROUP BY k),
r AS (SELECT k, auc, tn, fp, fn, tp, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
             coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM a JOIN q USING (k))
SELECT round(max(auc) FILTER (k = 5), 6) AS auc, round(max(accuracy) FILTER (k = 5), 6) AS accuracy, round(max(precision) FILTER (k = 5), 6) AS precision,
       round(max(recall) FILTER (k = 5), 6) AS recall, round(max(f1) FILTER (k = 5), 6) AS f1, max(tn) FILTER (k = 5)::BIGINT AS tn,
       max(fp) FILTER (k = 5)::BIGINT AS fp, max(fn) FILTER (k = 5)::BIGINT AS fn, max(tp) FILTER (k = 5)::BIGINT AS tp,
       round(avg(auc) FILTER (k < 5), 6) AS cv_auc, round(avg(accuracy) FILTER (k < 5), 6) AS cv_accuracy, round(avg(precision) FILTER (k < 5), 6) AS cv_precision,
       round(avg(recall) FILTER (k < 5), 6) AS cv_recall, round(avg(f1) FILTER (k < 5), 6) AS cv_f1, 1.0::DOUBLE AS importance FROM r""")
def q_search_one_tree(spark, d):
    """M3, M8, M9 with A9-A11: the search over one point, its fold averages, test metrics and importance."""
    spec = search.ModelSpec("tree", RandomForestClassifier(numTrees=1, maxDepth=1, featureSubsetStrategy="all", bootstrap=False, seed=1), {"maxDepth": [1]})
    best, _ = search.grid_search(_tree_rows(spark, d).drop("target", "z"), ["x"], [spec])
    cm, cv = F.col("confusion_matrix"), F.col("cv_metrics")
    return best.metrics.select(*[r6(c).alias(c) for c in ("auc", "accuracy", "precision", "recall", "f1", "cv_auc")],
                               *[cm[c].alias(c) for c in ("tn", "fp", "fn", "tp")],
                               *[r6(cv[c]).alias(f"cv_{c}") for c in ("accuracy", "precision", "recall", "f1")],
                               r6(F.col("feature_importances")[0]["importance"]).alias("importance"))


_LEAVES = _TREE_SPLIT + ", m AS (SELECT x, avg(target) AS leaf, count(*) AS n FROM t WHERE NOT is_test GROUP BY x)"


@query("regression_one_tree", _LEAVES + """,
e AS (SELECT target, leaf FROM t JOIN m USING (x) WHERE is_test)
SELECT round(avg(abs(target - leaf)), 6) AS mae, round(avg((target - leaf) * (target - leaf)), 6) AS mse,
       round(1 - sum((target - leaf) * (target - leaf)) / (var_pop(target) * count(*)), 6) AS r2 FROM e""")
def q_regression_one_tree(spark, d):
    """Regression metrics of one tree on the test rows."""
    _, m, _ = search.rf_regression(_tree_rows(spark, d).drop("label"), ["x", "z"], "target", num_trees=1, max_depth=1, bootstrap=False)
    return m.select(*[r6(c).alias(c) for c in ("mae", "mse", "r2")])


@query("shap_one_tree", _LEAVES + """,
b AS (SELECT sum(leaf * n) / sum(n) AS base FROM m)
SELECT 'x' AS feature, round(avg(abs(leaf - base)), 6) AS mean_abs_shap FROM t JOIN m USING (x), b WHERE is_test
UNION ALL SELECT 'z', 0.0""")
def q_shap_one_tree(spark, d):
    """X1, X2 through the exported trees of a fitted model: mean absolute attribution on the test rows."""
    model, _, test = search.rf_regression(_tree_rows(spark, d).drop("label"), ["x", "z"], "target", num_trees=1, max_depth=1, bootstrap=False)
    return treeshap.explain_summary(test, model, ["x", "z"]).select("feature", r6("mean_abs_shap").alias("mean_abs_shap"))


@query("binary_target_cast", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS INT) AS two, "
       "CAST(o_orderkey % 3 AS DOUBLE) AS three FROM orders")
def q_binary_target(spark, d):
    """a target of two values becomes int, one of three stays."""
    from casework.operators.clean import binary_target_cast
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 1.0).otherwise(2.0).alias("two"),
                                         (F.col("o_orderkey") % 3).cast("double").alias("three"))
    return binary_target_cast(binary_target_cast(o, "two"), "three")


# X4 against SQL: a small case table of the orders (every tenth twice, as P4 must drop copies), as rows of
# (caseid, feature, value). Vocabularies are known, so SQL can spell the features out.
_SMALL = """WITH o AS (SELECT o_orderkey AS caseid, CAST(1 + o_custkey % 12 AS VARCHAR) AS tothlos,
       CASE WHEN o_custkey % 3 = 0 THEN 'Male' ELSE ' female' END AS sex,
       CASE WHEN o_orderkey % 9 <> 4 THEN CASE o_custkey % 3 WHEN 0 THEN 'white' WHEN 1 THEN 'black' ELSE 'asian' END END AS race,
       CASE WHEN o_orderkey % 7 = 3 THEN '-99' WHEN o_orderkey % 7 <> 5 THEN CAST(o_custkey % 50 AS VARCHAR) END AS lab,
       CASE o_custkey % 5 WHEN 0 THEN 'CeFAZoLin (Kefzol)' WHEN 1 THEN 'Vancomycin HCl' WHEN 2 THEN ' ' ELSE 'other' END AS drug FROM orders),
f AS (SELECT caseid, tothlos, CASE WHEN trim(sex) = 'Male' THEN 1.0 ELSE 0.0 END AS sex, drug,
       last_value(race IGNORE NULLS) OVER w AS race, nullif(last_value(lab IGNORE NULLS) OVER w, '-99') AS lab FROM o
       WINDOW w AS (ORDER BY caseid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT * FROM f WHERE trim(drug) <> '') """
_SMALL_DUMMIES = """SELECT caseid, unnest([{'f': 'sex', 'v': sex}, {'f': 'race_black', 'v': CAST(race = 'black' AS DOUBLE)},
       {'f': 'race_white', 'v': CAST(race = 'white' AS DOUBLE)}, {'f': 'ped_sap_name1_Vancomycin HCl', 'v': CAST(drug LIKE 'Vanc%' AS DOUBLE)},
       {'f': 'ped_sap_name1_other', 'v': CAST(drug = 'other' AS DOUBLE)}, {'f': 'used_vancomycin', 'v': CAST(drug LIKE 'Vanc%' AS DOUBLE)},
       {'f': 'combo_abx_regimen_vancomycin', 'v': CAST(drug LIKE 'Vanc%' AS DOUBLE)}, """


def _small_cases(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    cust = F.col("o_custkey")
    race = F.when(cust % 3 == 0, "white").when(cust % 3 == 1, "black").otherwise("asian")
    drug = F.when(cust % 5 == 0, "CeFAZoLin (Kefzol)").when(cust % 5 == 1, "Vancomycin HCl").when(cust % 5 == 2, " ").otherwise("other")
    copies = F.explode(F.when(key % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return o.select(key.alias("CaseID"), (1 + cust % 12).cast("string").alias("TotHLOS"),
                    F.when(cust % 3 == 0, "Male").otherwise(" female").alias("Sex"), F.when(key % 9 != 4, race).alias("Race"),
                    F.when(key % 7 == 3, "-99").when(key % 7 != 5, (cust % 50).cast("string")).alias("Lab"),
                    drug.alias("ped_sap_name1"), copies.alias("c")) \
        .select("*", (F.col("CaseID") * 2 + F.col("c")).alias("row_id")).drop("c")


def _long(df: DataFrame, key: str = "row_id") -> DataFrame:
    feats = [c for c in df.columns if c != key]
    wide = df.select(F.floor(col(key) / 2).cast("long").alias("_case"), *[r6(col(c)).alias(c) for c in feats])
    return wide.unpivot(["_case"], [col(c) for c in feats], "feature", "value").withColumnRenamed("_case", "caseid")


@query("training_features", _SMALL + ", l AS (SELECT avg(CAST(lab AS DOUBLE)) AS m FROM k), x AS (" + _SMALL_DUMMIES +
       """{'f': 'used_cefazolin', 'v': CAST(drug LIKE 'CeF%' AS DOUBLE)}, {'f': 'combo_abx_regimen_cefazolin', 'v': CAST(drug LIKE 'CeF%' AS DOUBLE)},
       {'f': 'single_abx_regimen_', 'v': CAST(drug = 'other' AS DOUBLE)}, {'f': 'caseid', 'v': CAST(caseid AS DOUBLE)},
       {'f': 'tothlos', 'v': CAST(tothlos AS DOUBLE)}, {'f': 'lab', 'v': coalesce(CAST(lab AS DOUBLE), m)}]) AS u FROM k, l)
SELECT caseid, u.f AS feature, round(u.v, 6) + 0.0 AS value FROM x""")
def q_training_features(spark, d):
    """X4, numbers as numbers."""
    return _long(build_training_table(_small_cases(spark, d), BuildConfig(target=TARGET))[0])


@query("training_features_compatible", _SMALL + """, c AS (SELECT *, dense_rank() OVER (ORDER BY CAST(caseid AS VARCHAR)) - 1 AS case_code,
       dense_rank() OVER (ORDER BY tothlos) - 1 AS los_code, dense_rank() OVER (ORDER BY coalesce(lab, 'Unknown')) - 1 AS lab_code FROM k), x AS (""" +
       _SMALL_DUMMIES + """{'f': 'single_abx_regimen_', 'v': CAST(drug NOT LIKE 'Vanc%' AS DOUBLE)}, {'f': 'caseid', 'v': CAST(case_code AS DOUBLE)},
       {'f': 'tothlos', 'v': CAST(los_code AS DOUBLE)}, {'f': 'lab', 'v': CAST(lab_code AS DOUBLE)}]) AS u FROM c)
SELECT caseid, u.f AS feature, u.v + 0.0 AS value FROM x""")
def q_training_compatible(spark, d):
    """X4 in the full compatible mode: numbers as codes of sorted text, missing cells as text, drugs read after drop-first."""
    cfg = BuildConfig(target=TARGET, numeric_mode="lexical", missing_as_text="nan", drugs_after_drop_first=True)
    return _long(build_training_table(_small_cases(spark, d), cfg)[0])
