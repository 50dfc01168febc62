"""The query catalogue: each entry is a Spark query over the driver's tables plus, where the
result is SQL-expressible, an oracle SQL text that DuckDB runs on the same parquet files.

Doubles are rounded to 6 places (and -0.0 folded to 0.0) on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework import config
from casework.operators import clean, encoders, metrics, names, ordered, profile, split
from casework.sources.fixtures import build_cases, build_messy_events, cases_cte, messy_cte
from casework.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r6(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x.cast("double"), 6) + F.lit(0.0)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TOKENS_SQL = _sql_list(t.lower() for t in config.MISSING_TOKENS)


def p7_sql(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ({TOKENS_SQL}) THEN NULL ELSE trim({x}) END"


NUM_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def isnum_sql(x: str) -> str:
    return f"regexp_matches(trim({x}), '{NUM_RE}')"


# Fixed test dictionary for the part types used as drug slots (PROMO deliberately unmapped).
FIXTURE_DRUGS = (("standard", "cefazolin"), ("small", "clindamycin"), ("medium", "gentamicin"),
                 ("large", "vancomycin"), ("economy", "ampicillin"))


# ----------------------------------------------------------------- fixtures
@query("case_table", cases_cte("SELECT * FROM cases"))
def q_case_table(spark, d):
    return build_cases(spark, d)


# ------------------------------------------------------------ P1-P3 names
@query("normalize_names", 'SELECT c_custkey AS "cust_key", c_name AS "cust_key.1", '
                          'c_mktsegment AS "segment__mkt_" FROM customer')
def q_normalize_names(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").alias(" Cust Key"), F.col("c_name").alias("cust_key"),
                                            F.col("c_mktsegment").alias("Segment (Mkt)"))
    return names.sanitize_columns(names.normalize_columns(df))


# ------------------------------------------------------------- P4 dedupe
@query("dedupe_rows", "SELECT min(doc_id) AS doc_id, text, lang, source, n_chars FROM documents "
                      "GROUP BY text, lang, source, n_chars")
def q_dedupe(spark, d):
    return clean.dedupe_keep_first(table(spark, d, "documents"), row_id="doc_id")


# ---------------------------------------------------------- W1 forward fill
_FF = ("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) "
       "OVER ({part}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events")


def _purchase_values(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))


@query("forward_fill", _FF.format(part=""))
def q_ffill(spark, d):
    return ordered.forward_fill(_purchase_values(spark, d), ["value"], "event_id")


@query("forward_fill_by_user", _FF.format(part="PARTITION BY user_id "))
def q_ffill_user(spark, d):
    return ordered.forward_fill(_purchase_values(spark, d), ["value"], "event_id", ["user_id"])


# ------------------------------------------------------- P7 null tokens, P6
@query("normalize_nulls", messy_cte(
    f"SELECT event_id, {p7_sql('status')} AS status, {p7_sql('amount_text')} AS amount_text, "
    f"{p7_sql('day_text')} AS day_text FROM messy_events"))
def q_normalize_nulls(spark, d):
    return clean.normalize_nulls(build_messy_events(spark, d), keep=["event_id"])


@query("parse_dates", messy_cte(
    "SELECT event_id, day_text, CAST(try_cast(trim(day_text) AS TIMESTAMP) AS TIMESTAMP) AS day FROM messy_events"))
def q_parse_dates(spark, d):
    m = build_messy_events(spark, d).select("event_id", "day_text", F.col("day_text").alias("day"))
    return clean.parse_dates(m, ["day"])


# ------------------------------------------------------- P8, P9 on cases
@query("blank_row_filter", cases_cte(
    "SELECT * FROM cases WHERE ped_sap_name1 IS NOT NULL AND trim(ped_sap_name1) <> '' "
    "AND ped_sap_name3 IS NOT NULL AND trim(ped_sap_name3) <> ''"))
def q_blank(spark, d):
    return clean.drop_blank_rows(build_cases(spark, d), ["ped_sap_name1", "ped_sap_name3", "not_a_column"])


@query("leak_drop", cases_cte("SELECT * EXCLUDE (dsupinfec, orgspcssi) FROM cases"))
def q_leak(spark, d):
    return clean.drop_leak_columns(build_cases(spark, d), "tothlos")


# ------------------------------------------------------------ F1 binary
def _binary_source(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    df = o.select(
        k.alias("caseid"),
        F.when(k % 2 == 0, F.lit("male")).otherwise(F.lit("Female")).alias("sex"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" Yes")).when(F.col("o_orderstatus") == "O", F.lit("no"))
         .otherwise(F.lit("-99")).alias("transfus"),
        ((k % 3) - 1).cast("string").alias("inout"),
        (k % 4).cast("string").alias("dnr"),
        F.col("o_orderstatus").alias("ventilat"))
    return clean.normalize_nulls(df, keep=["caseid"])


_BIN_COLS = ("sex", "transfus", "inout", "dnr", "ventilat")
_WORDS = _sql_list(config.BINARY_TRUE + config.BINARY_FALSE)


def _bin_oracle() -> str:
    src = ("SELECT o_orderkey AS caseid, "
           "CASE WHEN o_orderkey % 2 = 0 THEN 'male' ELSE 'Female' END AS sex0, "
           "CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'no' ELSE '-99' END AS transfus0, "
           "CAST(o_orderkey % 3 - 1 AS VARCHAR) AS inout0, CAST(o_orderkey % 4 AS VARCHAR) AS dnr0, "
           "o_orderstatus AS ventilat0 FROM orders")
    cols = ", ".join(f"{p7_sql(c + '0')} AS {c}" for c in _BIN_COLS)
    q = ", ".join(
        f"coalesce(bool_and(lower(trim({c})) IN ({_WORDS}) OR coalesce({isnum_sql(c)} AND "
        f"try_cast(trim({c}) AS DOUBLE) IN (0.0, 1.0, -99.0, -1.0), false)) FILTER (WHERE {c} IS NOT NULL), true) AS q_{c}"
        for c in _BIN_COLS)
    parts = []
    for c in _BIN_COLS:
        enc = (f"CASE WHEN {c} IS NULL THEN 0.0 WHEN lower(trim({c})) IN ({_sql_list(config.BINARY_TRUE)}) THEN 1.0 "
               f"WHEN lower(trim({c})) IN ({_sql_list(config.BINARY_FALSE)}) THEN 0.0 "
               f"WHEN {isnum_sql(c)} AND try_cast(trim({c}) AS DOUBLE) = 1.0 THEN 1.0 ELSE 0.0 END")
        parts.append(f"SELECT caseid, '{c}' AS column_name, CASE WHEN q_{c} THEN CAST({enc} AS VARCHAR) ELSE {c} END AS value "
                     f"FROM v, q")
    return f"WITH s AS ({src}), v AS (SELECT caseid, {cols} FROM s), q AS (SELECT {q} FROM v)\n" + " UNION ALL ".join(parts)


@query("binary_encode", _bin_oracle())
def q_binary(spark, d):
    src = _binary_source(spark, d)
    out = encoders.BinaryEncoder(_BIN_COLS).fit(src).transform(src)
    out = out.select("caseid", *[F.col(c).cast("string").alias(c) for c in _BIN_COLS])
    return out.unpivot(["caseid"], list(_BIN_COLS), "column_name", "value")


# ------------------------------------------------------- F2/F3 composite
_FLAG = "CASE WHEN {c} IS NULL OR lower(trim({c})) IN ({v}) THEN 0 ELSE 1 END"


@query("composite_target", cases_cte(
    "SELECT caseid, {a} AS dsupinfec, {b} AS orgspcssi, greatest({a}, {b}) AS any_ssi FROM cases".format(
        a=_FLAG.format(c="dsupinfec", v=_sql_list(config.NO_EVENT_VALUES)),
        b=_FLAG.format(c="orgspcssi", v=_sql_list(config.NO_EVENT_VALUES)))))
def q_composite(spark, d):
    c = build_cases(spark, d).select("caseid", "dsupinfec", "orgspcssi")
    return clean.composite_target(c, "any_ssi")


# --------------------------------------------------------------- F4 label
@query("threshold_label", cases_cte(
    "SELECT caseid, tothlos, CASE WHEN tothlos > 5 THEN 1 ELSE 0 END AS label FROM cases"))
def q_threshold(spark, d):
    return clean.label_by_threshold(build_cases(spark, d).select("caseid", "tothlos"), "tothlos", "x > 5", out="label")


# ------------------------------------------------------------- F6-F9 BMI
def _bmi_sql_parts():
    def num(x, f):
        return f"CASE WHEN {isnum_sql(x)} THEN try_cast(trim({x}) AS DOUBLE) * {f} END"
    h = f"CASE WHEN ({num('hp', config.INCH_TO_M)}) BETWEEN 0.3 AND 2.5 THEN {num('hp', config.INCH_TO_M)} END"
    w = f"CASE WHEN ({num('wp', config.POUND_TO_KG)}) BETWEEN 2.0 AND 300.0 THEN {num('wp', config.POUND_TO_KG)} END"
    return h, w


_BMI_BASE = cases_cte(
    "SELECT * FROM (SELECT caseid, {h} AS h, {w} AS w FROM (SELECT caseid, {hp} AS hp, {wp} AS wp FROM cases) t0) t1".format(
        h=_bmi_sql_parts()[0], w=_bmi_sql_parts()[1], hp=p7_sql("height"), wp=p7_sql("weight")))
_BMI_FLAG = ("CASE WHEN b < 10 OR b > 60 THEN 'invalid_extreme' WHEN b < 15 OR b > 40 THEN 'invalid_clinical' "
             "WHEN b < 18.5 OR b > 30 THEN 'unusual_clinical' ELSE 'valid' END")
_BMI_ROWS = (f"SELECT caseid, h, w, b, {_BMI_FLAG} AS flag FROM (SELECT caseid, h, w, w / (h * h) AS b FROM ({_BMI_BASE}) s) s2")


@query("bmi_features",
       f"SELECT caseid, round(CASE WHEN flag IN ('valid', 'unusual_clinical') THEN b END, 6) + 0.0 AS bmi, "
       f"flag AS bmi_quality_flag FROM ({_BMI_ROWS}) s3")
def q_bmi(spark, d):
    c = clean.normalize_nulls(build_cases(spark, d).select("caseid", "height", "weight"), keep=["caseid"])
    out = encoders.add_bmi(c)
    return out.select("caseid", r6("bmi").alias("bmi"), "bmi_quality_flag")


@query("bmi_report",
       "SELECT count(*) AS n_rows, count(h) AS height_valid, count(w) AS weight_valid, count(b) AS bmi_computed, "
       "round(min(b), 6) + 0.0 AS bmi_min, round(max(b), 6) + 0.0 AS bmi_max, "
       "count(*) FILTER (WHERE NOT (flag IN ('valid', 'unusual_clinical') AND b IS NOT NULL)) AS bmi_null "
       f"FROM ({_BMI_ROWS}) s3")
def q_bmi_report(spark, d):
    c = clean.normalize_nulls(build_cases(spark, d).select("caseid", "height", "weight"), keep=["caseid"])
    r = encoders.bmi_report(c)
    return r.select("n_rows", "height_valid", "weight_valid", "bmi_computed", r6("bmi_min").alias("bmi_min"),
                    r6("bmi_max").alias("bmi_max"), "bmi_null")


@query("bmi_flag_distribution",
       "SELECT flag AS bmi_quality_flag, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) + 0.0 AS pct "
       f"FROM ({_BMI_ROWS}) s3 GROUP BY flag")
def q_bmi_flags(spark, d):
    c = clean.normalize_nulls(build_cases(spark, d).select("caseid", "height", "weight"), keep=["caseid"])
    dist = profile.flag_distribution(encoders.add_bmi(c), "bmi_quality_flag")
    return dist.select("bmi_quality_flag", "n", r6("pct").alias("pct"))


# ---------------------------------------------------------- F10-F12 drugs
_DRUGS = sorted({dname for _, dname in FIXTURE_DRUGS})


def _canon_sql(x: str) -> str:
    s = f"regexp_replace(lower({x}), '^ped_sap_name[0-9]+_', '')"
    whens = " ".join(f"WHEN contains({s}, '{p}') THEN '{dn}'" for p, dn in FIXTURE_DRUGS)
    return f"CASE {whens} END"


_USED_SQL = ", ".join(
    "coalesce(" + " OR ".join(f"({_canon_sql(f'ped_sap_name{i}')} = '{dn}')" for i in (1, 2, 3)) + f", false) AS used_{dn}"
    for dn in _DRUGS)
# coalesce over an OR with NULL operands: use explicit per-slot coalesce for exact 3-valued logic
_USED_SQL = ", ".join(
    "(" + " OR ".join(f"coalesce({_canon_sql(f'ped_sap_name{i}')} = '{dn}', false)" for i in (1, 2, 3)) + f") AS used_{dn}"
    for dn in _DRUGS)


@query("multi_hot", cases_cte(f"SELECT caseid, {_USED_SQL} FROM cases"))
def q_multi_hot(spark, d):
    c = build_cases(spark, d).select("caseid", "ped_sap_name1", "ped_sap_name2", "ped_sap_name3")
    out = encoders.DrugMultiHot(patterns=FIXTURE_DRUGS).transform(c)
    return out.select("caseid", *[f"used_{dn}" for dn in _DRUGS])


_COMBO_KEY = "concat_ws('_', " + ", ".join(f"CASE WHEN used_{dn} THEN '{dn}' END" for dn in _DRUGS) + ")"


@query("combo_encode", cases_cte(
    f"SELECT caseid, CASE WHEN k = '' THEN 'single_abx_regimen_' ELSE 'combo_abx_regimen_' || k END AS regimen "
    f"FROM (SELECT caseid, {_COMBO_KEY} AS k FROM (SELECT caseid, {_USED_SQL} FROM cases) u) t"))
def q_combo(spark, d):
    c = build_cases(spark, d).select("caseid", "ped_sap_name1", "ped_sap_name2", "ped_sap_name3")
    used = encoders.DrugMultiHot(patterns=FIXTURE_DRUGS).transform(c)
    model = encoders.ComboEncoder().fit(used)
    wide = model.transform(used)
    # back to one row per case: the single regimen column that is set
    pick = F.coalesce(*[F.when(F.col(n) == 1, F.lit(n)) for n in model.names])
    return wide.select("caseid", pick.alias("regimen"))


# ------------------------------------------------------------ F15/F16, F13, F14
@query("one_hot",
       "WITH vocab AS (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL), "
       "kept AS (SELECT v FROM vocab WHERE v > (SELECT min(v) FROM vocab)) "
       "SELECT c_custkey, 'c_mktsegment_' || v AS dummy, coalesce(c_mktsegment = v, false) AS flag FROM customer, kept")
def q_one_hot(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    model = encoders.CategoricalEncoder(columns=["c_mktsegment"]).fit(cu)
    out = model.transform(cu)
    dummies = model.dummy_names()
    return out.unpivot(["c_custkey"], dummies, "dummy", "flag")


_RARE = ("WITH s AS (SELECT {key} AS k, 'u' || CAST({val} AS VARCHAR) AS v FROM {tbl}), "
         "top AS (SELECT v FROM (SELECT v, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY v "
         "ORDER BY n DESC, v ASC LIMIT 50) t) "
         "SELECT k AS {key}, CASE WHEN v IN (SELECT v FROM top) THEN v ELSE 'Other' END AS grp FROM s")


def _rare(spark, d, tbl, key, val):
    src = table(spark, d, tbl).select(key, F.concat(F.lit("u"), F.col(val).cast("string")).alias("grp"))
    model = encoders.CategoricalEncoder(columns=["grp"], max_categories=50).fit(src)
    top = model.top.get("grp")
    if top is None:  # at most max_categories values: nothing is grouped
        return src
    return src.select(key, F.when(F.col("grp").isin(top), F.col("grp")).otherwise(F.lit("Other")).alias("grp"))


@query("rare_group", _RARE.format(key="event_id", val="user_id", tbl="events"))
def q_rare(spark, d):
    return _rare(spark, d, "events", "event_id", "user_id")


@query("rare_group_long_tail", "SELECT DISTINCT * FROM (" + _RARE.format(key="l_orderkey", val="l_partkey", tbl="lineitem") + ") x")
def q_rare_long(spark, d):
    return _rare(spark, d, "lineitem", "l_orderkey", "l_partkey").distinct()


@query("label_encode",
       "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type, "
       "CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand, "
       "CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS p_name FROM part")
def q_label_encode(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    model = encoders.CompatibleEncoder(map_limit=100).fit(p)
    return model.transform(p).select("p_partkey", "p_type", "p_brand", "p_name")


@query("impute",
       "WITH s AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS v, "
       "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS etype FROM events) "
       "SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM s)), 6) + 0.0 AS v, "
       "CAST(dense_rank() OVER (ORDER BY coalesce(etype, 'Unknown')) - 1 AS BIGINT) AS etype FROM s")
def q_impute(spark, d):
    ev = table(spark, d, "events")
    s = ev.select("event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"),
                  F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("etype"))
    out = encoders.CompatibleEncoder().fit(s).transform(s)
    return out.select("event_id", r6("v").alias("v"), F.col("etype").cast("bigint").alias("etype"))


# ---------------------------------------------------------------- profiles
# Small-magnitude columns: means of decimal data are rationals that can sit exactly on a rounding
# boundary, so means and variances get a 1e-9 nudge (far above float error) before rounding.
_LI_NUM = ("l_quantity", "l_discount", "l_tax")


@query("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_distinct, "
    f"round(min({c}), 6) + 0.0 AS min, round(max({c}), 6) + 0.0 AS max, round(avg({c}) + 1e-9, 6) + 0.0 AS mean, "
    f"round(var_samp({c}) + 1e-9, 6) + 0.0 AS var_samp FROM lineitem" for c in _LI_NUM))
def q_column_profile(spark, d):
    p = profile.numeric_profile(table(spark, d, "lineitem"), list(_LI_NUM))
    return p.select("column_name", "n", "n_nonnull", "n_distinct", r6("min").alias("min"), r6("max").alias("max"),
                    r6(F.col("mean") + 1e-9).alias("mean"), r6(F.col("var_samp") + 1e-9).alias("var_samp"))


_CASE_COLS = ("caseid", "tothlos", "optime", "pralbum", "height", "weight", "transfus", "dsupinfec", "orgspcssi",
              "asaclas", "race", "ped_sap_name1", "ped_sap_name2", "ped_sap_name3", "date_of_surgery", "htooday")
_CASES_TEXT = cases_cte("SELECT " + ", ".join(f"{p7_sql(f'CAST({c} AS VARCHAR)')} AS {c}" for c in _CASE_COLS)
                        + " FROM cases")


def _cases_text(spark, d):
    return clean.normalize_nulls(build_cases(spark, d))


@query("categorical_finder", f"WITH t AS ({_CASES_TEXT}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique, "
    f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) < 50) AND NOT coalesce(bool_and(lower(trim({c})) IN "
    f"({_sql_list(config.BOOL_LIKE_VALUES)})) FILTER (WHERE {c} IS NOT NULL), true) AS is_categorical FROM t"
    for c in _CASE_COLS))
def q_categorical(spark, d):
    t = _cases_text(spark, d)
    found = profile.profile_text_columns(t, t.columns).categorical  # the builder's own decision
    return profile.categorical_report(t).withColumn("is_categorical", F.col("column_name").isin(found))


@query("numeric_share", f"WITH t AS ({_CASES_TEXT}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {isnum_sql(c)} THEN 1.0 ELSE 0.0 END) FILTER (WHERE {c} IS NOT NULL), 6) + 0.0 AS share FROM t"
    for c in _CASE_COLS))
def q_numeric_share(spark, d):
    t = _cases_text(spark, d)
    stats = profile.text_stats_from_row(t.agg(*profile.text_stats(t.columns)).first(), t.columns)  # as the builder reads them
    s = spark.createDataFrame(list(stats.numeric_share.items()), "column_name string, share double")
    return s.select("column_name", r6("share").alias("share"))


@query("top_categories",
       "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, value ASC LIMIT 10")
def q_top(spark, d):
    return profile.top_values(table(spark, d, "part"), "p_brand", 10)


def _lowvar_src(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_quantity", "l_discount", "l_tax", "l_returnflag", F.lit(1).alias("htooday"),
                     (F.lit(0.0001) * (F.col("l_linenumber") % 2)).alias("tiny"), F.lit("x").alias("const_text"),
                     F.when(F.col("l_linenumber") == 1, F.lit("a")).alias("maybe_null"))


_LV_SRC = ("SELECT l_quantity, l_discount, l_tax, l_returnflag, 1 AS htooday, 0.0001 * (l_linenumber % 2) AS tiny, "
           "'x' AS const_text, CASE WHEN l_linenumber = 1 THEN 'a' END AS maybe_null FROM lineitem")
_LV_NUM = ("l_quantity", "l_discount", "l_tax", "htooday", "tiny")
_LV_ALL = ("l_quantity", "l_discount", "l_tax", "l_returnflag", "htooday", "tiny", "const_text", "maybe_null")


def _lv_row(c: str) -> str:
    const = f"(count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c})))"
    if c in _LV_NUM:
        var, v = f"round(coalesce(var_samp({c}), 0.0), 6) + 0.0", f"coalesce(var_samp({c}), 0.0)"
    else:
        var = v = "CAST(NULL AS DOUBLE)"
    return f"SELECT '{c}' AS column_name, {const} AS is_constant, {var} AS variance, {v} AS v FROM t"


@query("low_variance", f"WITH t AS ({_LV_SRC}), r AS (" + " UNION ALL ".join(_lv_row(c) for c in _LV_ALL)
       + ") SELECT column_name, is_constant, variance, "
         "(is_constant OR coalesce(v < 0.001, false) OR column_name = 'htooday') AS dropped FROM r")
def q_low_variance(spark, d):
    rep = profile.low_variance_report(_lowvar_src(spark, d))
    return rep.select("column_name", "is_constant", r6("variance").alias("variance"), "dropped")


@query("clip_float32",
       "SELECT l_orderkey, l_linenumber, CASE WHEN x > 3.4028234663852886e38 THEN 3.4028234663852886e38 "
       "WHEN x < -3.4028234663852886e38 THEN -3.4028234663852886e38 ELSE x END AS x FROM (SELECT l_orderkey, l_linenumber, "
       "CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice * 1e35 WHEN 1 THEN -l_extendedprice * 1e36 "
       "WHEN 2 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS x FROM lineitem) t")
def q_clip(spark, d):
    li = table(spark, d, "lineitem")
    x = (F.when(F.col("l_linenumber") % 4 == 0, F.col("l_extendedprice") * 1e35)
         .when(F.col("l_linenumber") % 4 == 1, -F.col("l_extendedprice") * 1e36)
         .when(F.col("l_linenumber") % 4 == 2, F.lit(float("inf"))).otherwise(F.col("l_quantity")))
    return clean.clip_float32(li.select("l_orderkey", "l_linenumber", x.alias("x")))


@query("range_validate",
       "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity * 0.06 BETWEEN 0.3 AND 2.5 THEN l_quantity * 0.06 END, 6) + 0.0 AS q_m "
       "FROM lineitem")
def q_range(spark, d):
    from casework.functions.clinical import in_range
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(in_range(F.col("l_quantity") * 0.06, 0.3, 2.5)).alias("q_m"))


@query("correlated_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice), 6) + 0.0 AS corr, "
    f"coalesce(abs(corr({c}, l_extendedprice)) >= 0.5, false) AS dropped FROM lineitem"
    for c in ("l_quantity", "l_discount", "l_tax")))
def q_corr(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    rep = clean.correlated_columns(li, "l_extendedprice", threshold=0.5)
    return rep.select("column_name", r6("corr").alias("corr"), "dropped")


# ------------------------------------------------------------- M1, M2, A13
_HASH = "CAST(('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT)"


@query("train_test_split", f"SELECT o_orderkey, ({_HASH.format(k='o_orderkey')} % 10000) < 2000 AS is_test FROM orders")
def q_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return o.select("o_orderkey", split.is_test_row("o_orderkey").alias("is_test"))


@query("stratified_folds",
       f"SELECT o_orderkey, label, CAST((row_number() OVER (PARTITION BY label ORDER BY h, o_orderkey) - 1) % 5 AS INTEGER) AS fold "
       f"FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, {_HASH.format(k='o_orderkey')} AS h FROM orders) t")
def q_folds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return split.stratified_folds(o, "label", row_id="o_orderkey", k=5)


@query("class_weights",
       "SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) + 0.0 AS weight "
       "FROM labels GROUP BY quality")
def q_weights(spark, d):
    w = metrics.class_weights(table(spark, d, "labels"), "quality")
    return w.select("quality", "n", r6("weight").alias("weight"))


# ------------------------------------------------------------------ A9-A12
_CM_SRC = ("SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, "
           "CASE WHEN value > 200 THEN 1 ELSE 0 END AS prediction FROM events")


@query("confusion_metrics",
       f"WITH t AS ({_CM_SRC}), c AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, "
       "count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, "
       "count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM t) "
       "SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS accuracy, "
       "round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) + 0.0 AS precision, "
       "round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) + 0.0 AS recall, "
       "round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) + 0.0 AS f1 FROM c")
def q_confusion(spark, d):
    ev = table(spark, d, "events")
    t = ev.select(F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
                  F.when(F.col("value") > 200, 1).otherwise(0).alias("prediction"))
    m = metrics.confusion_metrics(t)
    return m.select("tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("roc_auc",
       "WITH t AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, round(value / 50) AS s FROM events), "
       "r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mr FROM t) "
       "SELECT round((sum(mr) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * "
       "(count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * "
       "count(*) FILTER (WHERE label = 0)), 6) + 0.0 AS auc FROM r")
def q_auc(spark, d):
    ev = table(spark, d, "events")
    t = ev.select(F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
                  F.round(F.col("value") / 50).alias("score"))
    return metrics.roc_auc(t).select(r6("auc").alias("auc"))


@query("regression_metrics",
       "SELECT round(avg(abs(y - p)), 6) + 0.0 AS mae, round(avg((y - p) * (y - p)), 6) + 0.0 AS mse, "
       "round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) + 0.0 AS r2 "
       "FROM (SELECT l_quantity AS y, l_discount * 500 AS p FROM lineitem) t")
def q_regression(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("label"), (F.col("l_discount") * 500).alias("prediction"))
    m = metrics.regression_metrics(li)
    return m.select(*[r6(c).alias(c) for c in ("mae", "mse", "r2")])


@query("mean_abs_summary",
       "SELECT 'f' || CAST(pos - 1 AS VARCHAR) AS feature, round(avg(abs(CAST(v AS DOUBLE))), 6) + 0.0 AS mean_abs_shap "
       "FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) t GROUP BY pos")
def q_mean_abs(spark, d):
    s = metrics.mean_abs_by_position(table(spark, d, "embeddings"), "embedding")
    return s.select("feature", r6("mean_abs_shap").alias("mean_abs_shap"))


__all__ = ["QUERIES", "ORACLES", "query"]


# --------------------------------------------------------- F6 report, wide W1, F1 on labels
@query("unparseable_values", cases_cte(
    "SELECT column_name, value FROM (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS r "
    "FROM (SELECT DISTINCT column_name, value FROM (SELECT 'height' AS column_name, height AS value FROM cases "
    "UNION ALL SELECT 'weight', weight FROM cases) u "
    f"WHERE value IS NOT NULL AND NOT coalesce({isnum_sql('value')} AND try_cast(trim(value) AS DOUBLE) IS NOT NULL, false)) d) t "
    "WHERE r <= 5"))
def q_unparseable(spark, d):
    return encoders.unparseable_values(build_cases(spark, d), ["height", "weight"], n=5)


_FF_CASE_COLS = ("pralbum", "dsupinfec", "ped_sap_name2", "ped_sap_name3", "transfus")


@query("forward_fill_cases", cases_cte(
    "SELECT caseid, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (ORDER BY caseid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
        for c in _FF_CASE_COLS) + " FROM cases"))
def q_ffill_cases(spark, d):
    c = build_cases(spark, d).select("caseid", *_FF_CASE_COLS)
    return ordered.forward_fill(c, list(_FF_CASE_COLS), "caseid")


def _bin_labels_oracle() -> str:
    cols = ("quality", "toxic", "flag")
    src = ("SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, "
           "CASE WHEN doc_id % 5 = 0 THEN 'T' WHEN doc_id % 5 = 1 THEN 'f' WHEN doc_id % 5 = 2 THEN NULL "
           "ELSE CAST(quality + toxic AS VARCHAR) END AS flag FROM labels")
    q = ", ".join(
        f"coalesce(bool_and(lower(trim({c})) IN ({_WORDS}) OR coalesce({isnum_sql(c)} AND "
        f"try_cast(trim({c}) AS DOUBLE) IN (0.0, 1.0, -99.0, -1.0), false)) FILTER (WHERE {c} IS NOT NULL), true) AS q_{c}"
        for c in cols)
    parts = []
    for c in cols:
        enc = (f"CASE WHEN {c} IS NULL THEN 0.0 WHEN lower(trim({c})) IN ({_sql_list(config.BINARY_TRUE)}) THEN 1.0 "
               f"WHEN lower(trim({c})) IN ({_sql_list(config.BINARY_FALSE)}) THEN 0.0 "
               f"WHEN {isnum_sql(c)} AND try_cast(trim({c}) AS DOUBLE) = 1.0 THEN 1.0 ELSE 0.0 END")
        parts.append(f"SELECT doc_id, '{c}' AS column_name, CASE WHEN q_{c} THEN CAST({enc} AS VARCHAR) ELSE {c} END AS value FROM v, q")
    return f"WITH v AS ({src}), q AS (SELECT {q} FROM v)\n" + " UNION ALL ".join(parts)


@query("binary_encode_labels", _bin_labels_oracle())
def q_binary_labels(spark, d):
    lb = table(spark, d, "labels")
    k = F.col("doc_id")
    src = lb.select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"),
                    F.when(k % 5 == 0, F.lit("T")).when(k % 5 == 1, F.lit("f")).when(k % 5 == 2, F.lit(None))
                     .otherwise((F.col("quality") + F.col("toxic")).cast("string")).alias("flag"))
    cols = ["quality", "toxic", "flag"]
    out = encoders.BinaryEncoder(cols).fit(src).transform(src)
    out = out.select("doc_id", *[F.col(c).cast("string").alias(c) for c in cols])
    return out.unpivot(["doc_id"], cols, "column_name", "value")
