"""The end-to-end run over case files (the per-dataset driver loop) and the review re-run.

For each dataset: build or load the training table (S4), label ``x > 5``, search the model
specs under stratified CV (M1-M4), explain the winner on the test rows (X1-X2), save metrics
and the SHAP summary (S5), and the attribution plot data (S6).
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from casework import session
from casework.config import BuildConfig
from casework.operators import search, treeshap
from casework.plans.training import build_training_table, feature_columns, with_label
from casework.sources import materialize
from casework.sources.tables import cohort_files, input_paths, is_empty, read_cases

log = logging.getLogger(__name__)


@dataclass
class RunOutput:
    best: search.SearchResult
    shap_summary: DataFrame
    attribution: DataFrame
    run_ts: str | None


def run_dataset(spark: SparkSession, raw: DataFrame, dataset: str, results: str, target: str = "tothlos",
                statement: str | None = "x > 5", specs: list[search.ModelSpec] | None = None,
                exclude: tuple[str, ...] = (), cfg: BuildConfig | None = None, save: bool = True,
                use_boruta: bool = False, parallelism: int | None = None) -> RunOutput | None:
    """Run one dataset; ``exclude`` drops reviewed columns before modelling."""
    cfg = cfg or BuildConfig(target=target)
    path = materialize.training_table_path(results, dataset, target, cfg)
    table = materialize.read_or_build(spark, path, lambda: build_training_table(raw, cfg)[0])
    if is_empty(table):
        log.warning("dataset %s: empty training table, skipped", dataset)
        return None
    table = with_label(table.drop(*[c for c in exclude if c in table.columns]), target, statement)
    feats = feature_columns(table, target, exclude=("row_id", "label"))
    best, _ = search.grid_search(table, feats, specs, parallelism=parallelism, use_boruta=use_boruta)
    feats = best.feature_names
    sh = session.materialize(treeshap.explain(best.test, best.model, keep_values=True), "shap")
    summary = treeshap.shap_summary(sh, feats)
    attribution = treeshap.attribution_bins(sh, None, feats)
    summary = session.materialize(summary, "shap-summary")
    attribution = session.materialize(attribution, "attribution")
    ts = materialize.save_results(best.metrics, summary, results, dataset, best.name, target) if save else None
    return RunOutput(best, summary, attribution, ts)


def run_folder(spark: SparkSession, folder: str, results: str, at_once: int = 4, **kw) -> dict[str, RunOutput | None]:
    """The driver loop over every file under ``folder`` (S2), in file-name order. Files are listed
    through Spark (any file system); each file is its own dataset, read and fitted on its own.

    ``at_once`` datasets run side by side, each submitting its jobs to a scheduler pool of its own: with
    ``spark.scheduler.mode=FAIR`` the pools share the executors evenly, and a small dataset does not wait for a large one's stages.
    """
    def one(path: str) -> RunOutput | None:
        name = path.rsplit("/", 1)[-1][:-4]
        sc = spark.sparkContext
        before = sc.getLocalProperty("spark.scheduler.pool")
        sc.setLocalProperty("spark.scheduler.pool", f"dataset-{name}")
        try:
            return run_dataset(spark, read_cases(spark, path), name, results, **kw)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", before)

    paths = input_paths(cohort_files(spark, folder))
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(paths)))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(one), p) for p in paths]
        return {p.rsplit("/", 1)[-1][:-4]: j.result() for p, j in zip(paths, jobs)}
