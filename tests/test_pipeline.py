"""End to end: entry, training table, sinks, a CSV case file, streaming scoring."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from casework.operators import search
from casework.plans.training import build_training_table
from casework.sources import materialize
from casework.sources.tables import read_cases
from casework.streaming.apply import apply_stages, stream_cases, write_scored
from tests.conftest import SF_SMALL


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    types = dict(df.dtypes)
    assert all(t in ("double", "int", "bigint", "boolean", "float") for c, t in types.items()), types


def test_query_registry_complete():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40


def test_csv_cases_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="casework-csv-")
    path = os.path.join(d, "cohort.csv")
    rows = ["caseid,Tot HLOS,sex,height,weight,ped_sap_name1,race,dsupinfec",
            '1,3,Male,60,100,"CeFAZoLin (Kefzol)",white,No Complication',
            '2,7,female,-99,120,Vancomycin,black,',
            '2,7,female,-99,120,Vancomycin,black,',
            '3,,female,65,#NULL!,"Ampicillin, IV",asian,Deep SSI',
            '4,9,male,70,150,  ,white,',
            '5,2,Female,62,110,cefazolin,white,-99']
    with open(path, "w") as f:
        f.write("\n".join(rows) + "\n")
    raw = read_cases(spark, path)
    assert raw.count() == 6
    table, rep = build_training_table(raw)
    # duplicate and blank-slot rows gone; composite target built; binary sex
    assert table.count() == 4 and "any_ssi" in table.columns and "sex" in rep.binary
    assert read_cases(spark, os.path.join(d, "missing.csv")).columns == []


def test_sinks_and_read_or_build(spark):
    d = tempfile.mkdtemp(prefix="casework-res-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "row_id")
    p = materialize.training_table_path(d, "ds", "t")
    assert materialize.read_or_build(spark, p, build).count() == 5
    assert materialize.read_or_build(spark, p, build).count() == 5 and len(calls) == 1
    m = spark.createDataFrame([(0.7, 0.9, 0.5, 0.4, 0.45)], "auc double, accuracy double, precision double, recall double, f1 double")
    s = spark.createDataFrame([("a", 0.1)], "feature string, mean_abs_shap double")
    materialize.save_results(m, s, d, "ds", "RF", "t", run_ts="20250101_000000")
    runs = materialize.compare_runs(spark, d).collect()
    assert len(runs) == 1 and runs[0]["model_name"] == "RF"


def test_streaming_applies_fitted_stages(spark):
    src = tempfile.mkdtemp(prefix="casework-stream-src-")
    out = tempfile.mkdtemp(prefix="casework-stream-out-")
    ck = tempfile.mkdtemp(prefix="casework-stream-ck-")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "event_type", "value")
    ev.write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    from casework.operators.encoders import CategoricalEncoder
    model = CategoricalEncoder(columns=["event_type"]).fit(ev)
    stream = stream_cases(spark, os.path.join(src, "batch1"), ev.schema)
    q = write_scored(apply_stages(stream, [model.transform]), out, ck)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == ev.count() and set(model.dummy_names()) <= set(got.columns)


def test_run_dataset_end_to_end(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from casework.plans.run import run_dataset
    from casework.sources.fixtures import build_cases
    raw = build_cases(spark, SF_SMALL).withColumn("row_id", F.col("caseid"))
    specs = [search.ModelSpec("RandomForestClassifier", RandomForestClassifier(seed=1, numTrees=10),
                              {"maxDepth": [2, 3]}, balanced=True)]
    res = tempfile.mkdtemp(prefix="casework-run-")
    out = run_dataset(spark, raw, "cases", res, specs=specs, exclude=("caseid",))
    m = out.best.metrics.first()
    assert 0.0 <= m["auc"] <= 1.0 and m["confusion_matrix"]["tp"] + m["confusion_matrix"]["fn"] > 0
    assert "caseid" not in out.best.feature_names
    top = out.shap_summary.first()
    assert top["feature"] in out.best.feature_names
    assert out.attribution.count() > 0
    assert materialize.compare_runs(spark, res).count() == 1


def test_cohort_folder_datasets(spark):
    from casework.sources.tables import list_datasets, read_cohort_folder
    d = tempfile.mkdtemp(prefix="casework-folder-")
    os.makedirs(os.path.join(d, "sub"))
    for name, rows in (("alpha.csv", ["a,b", "1,x", "2,y"]), (os.path.join("sub", "beta.csv"), ["a,b", "3,z"])):
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(rows) + "\n")
    df = read_cohort_folder(spark, d)
    assert list_datasets(df) == ["alpha", "beta"]
    got = sorted((r["dataset"], r["a"]) for r in df.select("dataset", "a").collect())
    assert got == [("alpha", "1"), ("alpha", "2"), ("beta", "3")]


def test_search_with_boruta_selection(spark):
    from pyspark.ml.classification import RandomForestClassifier
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    df = li.select(F.monotonically_increasing_id().alias("row_id"), "l_quantity", "l_tax",
                   (F.rand(3) * 10).alias("noise"), (F.col("l_quantity") > 25).cast("double").alias("label"))
    specs = [search.ModelSpec("RF", RandomForestClassifier(seed=1, numTrees=10), {"maxDepth": [3]}, balanced=True)]
    best, _ = search.grid_search(df, ["l_quantity", "l_tax", "noise"], specs, use_boruta=True, boruta_iter=6,
                                 cv_metrics=False)
    assert "l_quantity" in best.feature_names and "noise" not in best.feature_names
    import pytest
    with pytest.raises(ValueError):
        search.grid_search(df, ["l_quantity"], [])


def test_optional_logistic_spec(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    df = li.select(F.monotonically_increasing_id().alias("row_id"), "l_quantity", "l_tax",
                   (F.col("l_quantity") > 25).cast("double").alias("label"))
    lr = search.optional_specs()[0]
    assert len(lr.param_maps()) == 8
    lr.grid = {"regParam": [0.01], "elasticNetParam": [0.0]}
    best, _ = search.grid_search(df, ["l_quantity", "l_tax"], [lr], cv_metrics=True)
    m = best.metrics.first()
    assert m["auc"] > 0.9 and m["feature_importances"] is None and set(m["cv_metrics"]) == {"accuracy", "precision", "recall", "f1"}


def test_csv_quoted_fields(spark):
    d = tempfile.mkdtemp(prefix="casework-quoted-")
    path = os.path.join(d, "q.csv")
    with open(path, "w") as f:
        f.write('caseid,note,drug\n1,"line one\nline two","CeFAZoLin, 1g"\n2,"say ""hi""",x\n')
    rows = read_cases(spark, path).orderBy("caseid").collect()
    assert [r["note"] for r in rows] == ["line one\nline two", 'say "hi"'] and rows[0]["drug"] == "CeFAZoLin, 1g"


def test_training_table_has_no_missing_values(spark):
    from casework.operators.profile import columns_with_nulls
    from casework.plans.modelling import training_table
    t = training_table(spark, SF_SMALL)
    assert columns_with_nulls(t) == []
    bad = spark.createDataFrame([(1.0, None), (float("nan"), "a")], "x double, y string")
    assert columns_with_nulls(bad) == ["x", "y"]


def test_lexical_mode_codes_sorted_strings(spark):
    from casework.config import BuildConfig
    from casework.sources.fixtures import build_cases
    raw = build_cases(spark, SF_SMALL).withColumn("row_id", F.col("caseid"))
    table, rep = build_training_table(raw, BuildConfig(target="tothlos", numeric_mode="lexical"))
    assert rep.to_double == []
    got = {r["row_id"]: r["tothlos"] for r in table.select("row_id", "tothlos").collect()}
    texts = sorted({str(r["tothlos"]) for r in raw.select("tothlos").collect()})
    code = {t: i for i, t in enumerate(texts)}
    exp = {r["row_id"]: code[str(r["tothlos"])] for r in raw.select("row_id", "tothlos").collect()}
    assert got == {k: exp[k] for k in got}


def test_missing_as_text_makes_nan_category(spark):
    from casework.config import BuildConfig
    from casework.sources.fixtures import build_cases
    raw = build_cases(spark, SF_SMALL).withColumn("row_id", F.col("caseid"))
    _, rep = build_training_table(raw, BuildConfig(target="tothlos", missing_as_text="nan", forward_fill=False))
    assert "nan" in rep.one_hot.get("ped_sap_name2", [])


def test_search_with_dotted_and_spaced_names(spark):
    from pyspark.ml.classification import RandomForestClassifier
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    df = li.select(F.monotonically_increasing_id().alias("row_id"), F.col("l_quantity").alias("qty.1"),
                   F.col("l_tax").alias("tax rate"), (F.col("l_quantity") > 25).alias("flag (x)"),
                   (F.col("l_quantity") > 25).cast("double").alias("label"))
    specs = [search.ModelSpec("RF", RandomForestClassifier(seed=1, numTrees=5), {"maxDepth": [2]})]
    best, _ = search.grid_search(df, ["qty.1", "tax rate", "flag (x)"], specs, cv_metrics=False)
    assert best.metrics.first()["auc"] > 0.9


def test_builder_correlation_option(spark):
    from casework.config import BuildConfig
    from casework.sources.fixtures import build_cases
    raw = build_cases(spark, SF_SMALL).withColumn("row_id", F.col("caseid"))
    table, _ = build_training_table(raw, BuildConfig(target="tothlos", correlation_threshold=0.8))
    # optime (sum of quantities) tracks the line count closely and is dropped
    assert "optime" not in table.columns and "tothlos" in table.columns
