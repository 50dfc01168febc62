"""Runs over case files as they come: names with spaces, missing tokens, clashing names, unfinished writes."""

import os

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from casework.config import BuildConfig
from casework.operators import encoders, names, search
from casework.plans.run import run_folder
from casework.plans.training import build_training_table
from casework.session import shared_dir
from casework.sources import materialize
from casework.sources.tables import list_datasets, read_cases, read_cohort_folder


def write_cohort(path, n, shift):
    with open(path, "w") as f:
        f.write("caseid,tothlos,sex,height,weight,ped_sap_name1,race,score,note\n")
        for i in range(n):
            race = ("White", "white", "black", "NA", "asian")[i % 5]
            los = "NaN" if i % 29 == 28 else (i * 7 + shift) % 11
            f.write(f"{i},{los},{'Male' if i % 2 else 'female'},{55 + i % 20},{100 + (i * 13) % 90},"
                    f"{('Cefazolin', 'Vancomycin', '')[i % 3 if i % 17 else 2]},{race},{'NA' if i % 6 == 0 else ((i * 7 + shift) % 11) / 2},x\n")


def test_run_folder_over_csv_files(spark, tmp_path):
    os.makedirs(tmp_path / "raw" / "sub")
    write_cohort(tmp_path / "raw" / "with space.csv", 160, 0)
    write_cohort(tmp_path / "raw" / "sub" / "other.csv", 160, 3)
    folder = str(tmp_path / "raw")
    assert list_datasets(read_cohort_folder(spark, folder)) == ["other", "with space"]
    specs = [search.ModelSpec("RandomForestClassifier", RandomForestClassifier(seed=1, numTrees=5), {"maxDepth": [2]}, balanced=True)]
    out = run_folder(spark, folder, str(tmp_path / "results"), specs=specs, exclude=("caseid",))
    assert sorted(out) == ["other", "with space"] and all(r is not None for r in out.values())
    for r in out.values():
        assert r.best.metrics.first()["auc"] > 0.6 and r.shap_summary.first()["feature"] == "score"
    assert materialize.compare_runs(spark, str(tmp_path / "results")).count() == 2


def test_datasets_run_side_by_side_in_pools_of_their_own(spark, tmp_path, monkeypatch):
    import time

    from casework.plans import run as plan
    os.makedirs(tmp_path / "raw")
    for i, name in enumerate(("one", "two")):
        write_cohort(tmp_path / "raw" / f"{name}.csv", 120, i)
    spans = {}
    whole = plan.build_training_table

    def spy(raw, cfg):
        pool = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        spans[pool] = [time.time()]
        out = whole(raw, cfg)
        out[0].count()
        spans[pool].append(time.time())
        return out
    monkeypatch.setattr(plan, "build_training_table", spy)
    specs = [search.ModelSpec("RandomForestClassifier", RandomForestClassifier(seed=1, numTrees=3), {"maxDepth": [2]}, balanced=True)]
    together = run_folder(spark, str(tmp_path / "raw"), str(tmp_path / "a"), specs=specs, exclude=("caseid",))
    (a, b), (c, d) = spans["dataset-one"], spans["dataset-two"]
    assert max(a, c) < min(b, d)  # they overlap
    alone = run_folder(spark, str(tmp_path / "raw"), str(tmp_path / "b"), specs=specs, exclude=("caseid",), at_once=1)
    for name in ("one", "two"):
        x, y = (o[name].best.metrics.select("auc", "accuracy", "cv_auc").first() for o in (together, alone))
        assert tuple(x) == tuple(y)


def test_missing_tokens_of_the_scan(spark, tmp_path):
    path = str(tmp_path / "a b.csv")
    write_cohort(path, 60, 0)
    raw = read_cases(spark, path)
    assert raw.filter("score IS NULL").count() == 10 and raw.filter("race = 'NA'").count() == 0


def test_unique_names_ignore_case_and_do_not_collide():
    assert names.unique_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]
    assert names.unique_names(["x", "X", "x"]) == ["x", "X.1", "x.2"]
    for given in (["a", "A", "a.1", "A.1", "a"], ["b"] * 5, []):
        got = [n.lower() for n in names.unique_names(given)]
        assert len(set(got)) == len(got)


def test_case_variants_and_taken_names_through_the_builder(spark):
    rows = [(i, ("White", "white", "black")[i % 3], i % 2, f"{i % 7}", ("Cefazolin", "Vancomycin")[i % 2], i % 2) for i in range(40)]
    raw = spark.createDataFrame(rows, "row_id long, race string, race_white int, tothlos string, ped_sap_name1 string, used_tobacco int")
    table, rep = build_training_table(raw, BuildConfig(target="tothlos"))
    low = [c.lower() for c in table.columns]
    assert len(set(low)) == len(low) and "race_white" in low and "used_tobacco" in low and "used_vancomycin" in low
    assert sorted(rep.one_hot["race"]) == ["White", "black", "white"]
    assert table.count() == 40


def test_drug_flags_keep_other_columns(spark):
    df = spark.createDataFrame([("Cefazolin", "yes", 1)], "ped_sap_name1 string, used_tobacco string, used_cefazolin int")
    out = encoders.DrugMultiHot().transform(df)
    assert out.first()["used_tobacco"] == "yes" and out.columns.count("used_cefazolin") == 1


def test_nan_stays_a_missing_number(spark):
    rows = [(i, float("nan") if i % 5 == 0 else float(i % 9), i % 4, "Cefazolin") for i in range(50)]
    raw = spark.createDataFrame(rows, "row_id long, lab double, tothlos int, ped_sap_name1 string")
    table, _ = build_training_table(raw, BuildConfig(target="tothlos", forward_fill=False))
    assert dict(table.dtypes)["lab"] == "double" and table.filter(F.isnan("lab")).count() == 0


def test_unfinished_write_is_built_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    os.makedirs(path + "/_temporary")
    assert materialize.read_or_build(spark, path, lambda: spark.range(3)).count() == 3
    assert materialize.read_or_build(spark, path, lambda: spark.range(9)).count() == 3
    a, b = (materialize.training_table_path("r", "d", "t", BuildConfig(target="t", numeric_mode=m)) for m in ("numeric", "lexical"))
    assert a != b and a == materialize.training_table_path("r", "d", "t", BuildConfig(target="t"))


def test_label_codes_have_one_type(spark):
    df = spark.createDataFrame([(f"v{i % 300}", f"s{i % 3}") for i in range(900)], "many string, few string")
    for limit in (2, 100, 1000):
        out = encoders.CompatibleEncoder(map_limit=limit).fit(df).transform(df)
        assert dict(out.dtypes) == {"many": "bigint", "few": "bigint"}
        assert out.select("many").distinct().count() == 300


def test_shared_dir_reads_the_setting_only(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_logistic_grid_counts_rows():
    lr = search.optional_specs()[0]
    regs = sorted({next(v for p, v in m.items() if p.name == "regParam") for m in lr.param_maps(1000)})
    assert regs == pytest.approx([0.0001, 0.001, 0.01, 0.1])
