"""Hand-made edge rows for encoders and profiles."""

from pyspark.sql import functions as F

from casework import config
from casework.functions.clinical import bmi_flag, drug_canonical
from casework.operators import encoders, profile


def _col(spark, vals, name="c", typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], f"i int, {name} {typ}")


def test_binary_encoder(spark):
    df = _col(spark, ["Yes", "no", None], "sex")
    m = encoders.BinaryEncoder(["sex"]).fit(df)
    assert m.columns == ["sex"]
    assert [r["sex"] for r in m.transform(df).orderBy("i").collect()] == [1.0, 0.0, 0.0]
    m2 = encoders.BinaryEncoder(["sex"], null_as_zero=False).fit(df)
    assert [r["sex"] for r in m2.transform(df).orderBy("i").collect()] == [1.0, 0.0, None]
    df = _col(spark, ["1", "0", "-1"], "dnr")
    assert [r["dnr"] for r in encoders.BinaryEncoder(["dnr"]).fit(df).transform(df).orderBy("i").collect()] == [1.0, 0.0, 0.0]
    for vals in (["yes", "maybe"], ["1d", "0"], ["2", "0"]):
        df = _col(spark, vals, "dnr")
        assert encoders.BinaryEncoder(["dnr"]).fit(df).columns == []


def test_height_weight_range(spark):
    df = _col(spark, ["60", "tall", "11", "99"], "height").withColumn("weight", F.lit("100"))
    e = encoders.bmi_columns()
    out = [r[0] for r in df.orderBy("i").select(e["height_m"]).collect()]
    assert abs(out[0] - 1.524) < 1e-12 and out[1:] == [None, None, None]


def test_bmi_flags(spark):
    vals = [9.0, 12.0, 16.0, 20.0, 31.0, 41.0, 61.0, None, 10.0, 15.0, 18.5, 30.0, 40.0, 60.0]
    df = _col(spark, vals, "b", "double")
    got = [r[0] for r in df.orderBy("i").select(bmi_flag("b")).collect()]
    assert got == ["invalid_extreme", "invalid_clinical", "unusual_clinical", "valid", "unusual_clinical",
                   "invalid_clinical", "invalid_extreme", "valid",
                   "invalid_clinical", "unusual_clinical", "valid", "valid", "unusual_clinical", "invalid_clinical"]


def test_bmi_kept_only_for_valid_or_unusual(spark):
    df = spark.createDataFrame([("70", "150"), ("40", "300")], "height string, weight string")
    out = encoders.add_bmi(df).collect()
    assert out[0]["bmi_quality_flag"] == "valid" and abs(out[0]["bmi"] - 21.5234) < 1e-3
    assert out[1]["bmi"] is None


def test_drug_canonical(spark):
    df = _col(spark, ["Ampicillin WITHOUT sulbactam", "CeFAZoLin (Kefzol)", "Tobramycin"])
    got = [r[0] for r in df.orderBy("i").select(drug_canonical("c")).collect()]
    assert got == ["ampicillin", "cefazolin", None]


def test_multi_hot_and_combinations(spark):
    df = spark.createDataFrame([("Vancomycin", "cefazolin x"), ("vancomycin", None), (None, "tobramycin")],
                               "ped_sap_name1 string, ped_sap_name2 string")
    used = encoders.DrugMultiHot().transform(df)
    assert [c for c in used.columns if c.startswith("used_")] == sorted(f"used_{d}" for d in {d for _, d in config.DRUG_PATTERNS})
    m = encoders.ComboEncoder().fit(used)
    assert m.names == ["combo_abx_regimen_cefazolin_vancomycin", "combo_abx_regimen_vancomycin", "single_abx_regimen_"]
    out = m.transform(used).collect()
    assert [[r[n] for n in m.names] for r in out] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_multi_hot_after_drop_first(spark):
    df = spark.createDataFrame([(True, False)], "ped_sap_name1_Vancomycin boolean, `ped_sap_name2_CeFAZoLin _Kefzol_` boolean")
    out = encoders.DrugMultiHot(after_drop_first=True).transform(df).first()
    assert out["used_vancomycin"] is True and out["used_cefazolin"] is False


def test_label_encoder_order(spark):
    df = _col(spark, ["10", "2", "B", "a", "é"])
    for limit in (10_000, 1):  # literal map and distributed ranks
        out = encoders.CompatibleEncoder(map_limit=limit).fit(df.drop("i")).transform(df.drop("i"))
        assert [r[0] for r in out.collect()] == [0, 1, 2, 3, 4]


def test_one_hot_drop_first(spark):
    df = _col(spark, ["b", "a", "c", None], "x")
    m = encoders.CategoricalEncoder(columns=["x"]).fit(df.drop("i"))
    out = m.transform(df).orderBy("i")
    assert out.columns == ["i", "x_b", "x_c"]
    assert [(r["x_b"], r["x_c"]) for r in out.collect()] == [(True, False), (False, False), (False, True), (False, False)]


def test_rare_values_grouped(spark):
    vals = [f"v{i:03d}" for i in range(60) for _ in range(1 + (i < 50))] + [None]
    df = _col(spark, vals, "x")
    m = encoders.CategoricalEncoder(columns=["x"]).fit(df.drop("i"))
    assert len(m.top["x"]) == 50 and "v055" not in m.top["x"]
    # "Other" sorts before "v000", so drop-first removes it as the baseline
    assert m.vocab["x"][0] == "Other" and "x_v000" in m.dummy_names()
    out = m.transform(df).filter(F.col("x_v000")).count()
    assert out == 2


def test_categorical_finder_rules(spark):
    def cat(vals):
        df = _col(spark, vals)
        return profile.profile_text_columns(df.drop("i"), ["c"]).categorical == ["c"]
    assert cat([f"v{i}" for i in range(49)])
    assert not cat([f"v{i}" for i in range(50)])
    assert not cat([f"v{i}" for i in range(49)] + [None])
    assert not cat(["yes", "no", "-1"])
    assert cat(["yes", "maybe"])


def test_numeric_share_skips_encoding(spark):
    nine = _col(spark, [str(i) for i in range(9)] + ["x"])
    eight = _col(spark, [str(i) for i in range(8)] + ["x", "y"])
    assert encoders.CategoricalEncoder(columns=["c"]).fit(nine.drop("i")).vocab == {}
    assert "c" in encoders.CategoricalEncoder(columns=["c"]).fit(eight.drop("i")).vocab


def test_unparseable_values_report(spark):
    vals = ["60", "tall", "short", "1d", "-99", None] + [f"x{i}" for i in range(10)]
    df = _col(spark, vals, "height")
    got = [r["value"] for r in encoders.unparseable_values(df, ["height", "weight"], n=5).collect()]
    assert len(got) == 5 and "60" not in got and "-99" not in got
