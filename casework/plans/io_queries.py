"""Queries of the sources and sinks: CSV records with line breaks read by splits (S1), saved runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.functions.text import to_number
from casework.operators import metrics
from casework.operators.ordered import in_one_partition
from casework.plans.catalogue import query, r6
from casework.session import scratch_path
from casework.sources.materialize import compare_runs, save_results
from casework.sources.tables import read_cases, table


@query("csv_line_breaks",
       "SELECT o_orderkey, o_orderpriority || chr(10) || '\"' || o_custkey || '\", ' || chr(10) || chr(10) || 'x' AS note, "
       "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'a' || chr(10) || '\"' END AS short, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def q_csv_line_breaks(spark, d):
    """One CSV file in key order whose fields hold line breaks, quotes and commas, read by splits of 64 KB; row ids follow the file."""
    o = table(spark, d, "orders")
    path = scratch_path(spark, "csv line breaks")
    note = F.concat("o_orderpriority", F.lit('\n"'), F.col("o_custkey").cast("string"), F.lit('", \n\nx'))
    o.select("o_orderkey", note.alias("note"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise('a\n"').alias("short")) \
        .transform(in_one_partition, "o_orderkey").write.option("header", True).option("escape", '"').csv(path)
    c = read_cases(spark, path, split=True, split_bytes=1 << 16)
    return c.select(to_number("o_orderkey").cast("long").alias("o_orderkey"), "note", "short", F.col("row_id").alias("place"))


_RUN_ROWS = ("SELECT 'status_' || l_linestatus AS dataset, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, "
             "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS prediction, round(l_quantity / 10) AS s FROM lineitem")


@query("saved_runs", f"""WITH t AS ({_RUN_ROWS}),
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY s) + (count(*) OVER (PARTITION BY dataset, s) - 1) / 2.0 AS mr FROM t),
c AS (SELECT dataset, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
             (sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS auc FROM r GROUP BY dataset)
SELECT dataset, 'R' AS target, 'run-1' AS run_ts, 'quantity' AS model_name, round(auc, 6) AS auc, round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) + 0.0 AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) + 0.0 AS f1 FROM c""")
def q_saved_runs(spark, d):
    """The runs of two datasets, each saved twice under one stamp as a replayed job would: one copy of each is read back."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("status_"), "l_linestatus").alias("dataset"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
                     F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("prediction"), F.round(F.col("l_quantity") / 10).alias("score"))
    results = scratch_path(spark, "runs")
    for dataset in ("status_F", "status_O"):
        own = rows.filter(F.col("dataset") == dataset)
        m = metrics.confusion_metrics(own).join(metrics.roc_auc(own))  # one row each
        shap = own.agg(F.avg("score").alias("mean_abs_shap")).select(F.lit("l_quantity").alias("feature"), "mean_abs_shap")
        for _ in range(2):
            save_results(m, shap, results, dataset, "quantity", "R", run_ts="run-1")
    runs = compare_runs(spark, results)
    return runs.select("dataset", "target", "run_ts", "model_name", *[r6(c).alias(c) for c in ("auc", "accuracy", "precision", "recall", "f1")])
