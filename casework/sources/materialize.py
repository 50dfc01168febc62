"""Materialisation and result sinks (S4, S5) and the review re-run."""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.config import BuildConfig


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the Parquet table at ``path`` if it was written to the end, else build, write and read back.

    A job that commits leaves ``_SUCCESS``; a folder without it is an unfinished write and is built anew.
    Reading back also cuts the lineage, so later jobs start from the written files.
    """
    if not committed(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its mark in ``path``."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def training_table_path(results: str, dataset: str, target: str, cfg: BuildConfig | None = None) -> str:
    """Where S4 keeps the training table of one dataset and target, built in one way (a digest of ``cfg``)."""
    way = "" if cfg is None else "_" + hashlib.sha256(repr(cfg).encode()).hexdigest()[:10]
    return os.path.join(results, f"training_{dataset}_{target}{way}")


def save_results(metrics: DataFrame, shap_summary: DataFrame, results: str, dataset: str, model_name: str,
                 target: str, run_ts: str | None = None, csv: bool = True) -> str:
    """Write the metrics row and the SHAP summary, partitioned by dataset, target and run stamp. A write replaces just the
    partitions of its own run, so a job that is replayed leaves one copy and other runs stay.

    Flat columns are also exported as CSV next to them (nested metric columns as JSON text).
    Returns the run stamp.
    """
    with _SAVING:
        return _save(metrics, shap_summary, results, dataset, model_name, target, run_ts or _stamp(), csv)


#: Runs of one session are saved one after the other: writes into one folder share its staging place.
_SAVING = threading.Lock()
_LAST = {"stamp": _dt.datetime.min.replace(tzinfo=_dt.timezone.utc)}


def _stamp() -> str:
    """The time in seconds, later than that of any run saved before: file names carry it."""
    now = max(_dt.datetime.now(_dt.timezone.utc).replace(microsecond=0), _LAST["stamp"] + _dt.timedelta(seconds=1))
    _LAST["stamp"] = now
    return now.strftime("%Y%m%d_%H%M%S")


def _save(metrics: DataFrame, shap_summary: DataFrame, results: str, dataset: str, model_name: str, target: str, run_ts: str, csv: bool) -> str:
    tags = [F.lit(dataset).alias("dataset"), F.lit(target).alias("target"), F.lit(run_ts).alias("run_ts"),
            F.lit(model_name).alias("model_name")]
    m = metrics.select("*", *tags)
    s = shap_summary.select("*", *tags)
    m.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "target", "run_ts").parquet(os.path.join(results, "performance"))
    s.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "target", "run_ts").parquet(os.path.join(results, "shap_summary"))
    if csv:
        flat = m.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("struct", "map", "array")
                          else F.col(f.name) for f in m.schema.fields])
        flat.coalesce(1).write.mode("overwrite").option("header", True) \
            .csv(os.path.join(results, f"performance_{dataset}_{model_name}_{target}_{run_ts}"))
        s.coalesce(1).write.mode("overwrite").option("header", True) \
            .csv(os.path.join(results, f"shap_summary_{model_name}_{target}_{run_ts}"))
    return run_ts


def compare_runs(spark: SparkSession, results: str) -> DataFrame:
    """One row per saved run with its headline metrics, newest first."""
    perf = spark.read.parquet(os.path.join(results, "performance"))
    return perf.select("dataset", "target", "run_ts", "model_name", "auc", "accuracy", "precision", "recall", "f1") \
        .orderBy(F.desc("run_ts"))
