"""The training-table builder, a fixed sequence of stages over one case table.

S1-P4-W1-P1-P6 → F3 → P9 → P8 → P7 → F1 → A1 → F15/F16 → F11 → F12 → F6-F9 → P10 → P11 → F14/F13 → P3

Every stage is one ``select``/``filter``; fitted stages run a bounded number of summary jobs.
The de-duplicated table and the cleaned text table (after P7) are written as Parquet in the
shared folder, so the ordered work (de-duplication, forward fill) runs once, and every later fit
reads only the columns it needs.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.config import BuildConfig
from casework.functions.clinical import clip
from casework.functions.text import col
from casework.operators import clean, encoders, names, ordered, profile
from casework.session import materialize, wide_plans

log = logging.getLogger(__name__)


@dataclass
class BuildReport:
    """What the fitted stages decided (all bounded by the column count)."""

    binary: list[str] = field(default_factory=list)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    to_double: list[str] = field(default_factory=list)
    combos: list[str] = field(default_factory=list)
    dropped_low_variance: list[str] = field(default_factory=list)
    numeric_mode: str = "numeric"


def build_training_table(raw: DataFrame, cfg: BuildConfig | None = None, row_id: str = "row_id",
                         checkpoint: bool = True) -> tuple[DataFrame, BuildReport]:
    """Run X4 on ``raw`` (which must carry a unique ``row_id``); returns (table, report).

    The output keeps ``row_id`` (for splits) next to the numeric / boolean feature columns and
    the target. ``cfg.numeric_mode='lexical'`` reproduces the label codes of sorted strings.
    """
    with wide_plans(raw.sparkSession):
        return _build(raw, cfg or BuildConfig(), row_id, checkpoint)


def _build(raw: DataFrame, cfg: BuildConfig, row_id: str, checkpoint: bool) -> tuple[DataFrame, BuildReport]:
    rep = BuildReport(numeric_mode=cfg.numeric_mode)
    if not raw.columns:
        return raw, rep
    # S1 is the caller's scan; P4 keep-first, W1 forward fill in row order, P1/P2 names, P6 dates.
    df = clean.dedupe_keep_first(clean.nan_as_missing(raw), row_id)
    if cfg.forward_fill:
        if checkpoint:  # the fill reads its input three times (key range, local windows, bucket summary)
            df = materialize(df, "cases")
        df = ordered.forward_fill(df, [c for c in df.columns if c != row_id], row_id)
    df = names.normalize_columns(df)
    df = clean.parse_dates(df)
    # F3 composite target, P9 leak list, P8 blank key rows.
    target = cfg.target
    df = clean.composite_target(df, target)
    if not df.columns:
        return df, rep
    df = clean.drop_leak_columns(df, target, cfg.leak_columns)
    df = clean.drop_blank_rows(df, cfg.blank_check_columns)
    # Everything to trimmed text, missing tokens to NULL.
    df = clean.normalize_nulls(df, cfg.missing_tokens, keep=[row_id], null_text=cfg.missing_as_text)
    if checkpoint:
        df = materialize(df, "clean-cases")
    # Fit pass A (one aggregation over the checkpoint): F1 decisions, text statistics for A1/A2,
    # and the set of drug regimens for F12 (drug flags read the raw slots, so they are known here).
    drugs = encoders.DrugMultiHot(cfg.drug_patterns, after_drop_first=cfg.drugs_after_drop_first)
    staged = df if cfg.drugs_after_drop_first else drugs.transform(df)
    binenc = encoders.BinaryEncoder(cfg.binary_candidates, cfg.binary_null_as_zero)
    text_cols = [c for c in profile.columns_of_type(staged, (T.StringType,)) if c != row_id]
    combo = encoders.ComboEncoder()
    exprs = binenc.stats(staged) + profile.text_stats(text_cols)
    if not cfg.drugs_after_drop_first:
        exprs += combo.stats(staged)
    row = staged.agg(*exprs).first()
    bm = binenc.from_stats(row, staged)
    rep.binary = bm.columns
    df = bm.transform(staged)
    # Fit pass B: value counts of bounded text columns → one-hot vocabularies (A1 + F15/F16).
    cm = encoders.CategoricalEncoder(None, cfg.max_categories, cfg.numeric_threshold, cfg.numeric_mode) \
        .fit(df.drop(row_id), profile=profile.text_stats_from_row(row, text_cols))
    rep.one_hot = {c: v for c, v in cm.vocab.items()}
    rep.to_double = list(cm.to_double)
    df = cm.transform(df)
    if cfg.drugs_after_drop_first:
        df = drugs.transform(df)
        cmodel = combo.fit(df)
    else:
        cmodel = combo.from_stats(row)
    rep.combos = cmodel.names
    df = cmodel.transform(df)
    df = encoders.add_bmi(df)
    # Fit pass C (one aggregation): P10 constants/variances and F14 statistics of the clipped values.
    feat = df.drop(row_id)
    floats = set(clean.columns_of_type(feat, clean.FLOAT_TYPES))
    compat = encoders.CompatibleEncoder()
    row = feat.agg(*profile.low_variance_stats(feat, prefix="lv"),
                   *compat.stats(feat, exprs={c: clip(c) for c in floats})).first()
    drop = [c for c in profile.low_variance_from_row(row, feat, cfg.variance_threshold) if c != target]
    drop += [c for c in cfg.extra_drop if c in df.columns]
    rep.dropped_low_variance = drop
    keep = set(feat.columns) - set(drop)
    # Pass D (inside): vocabularies of the remaining text columns for F13.
    cmodel2 = compat.from_stats(row, feat, only=keep)
    df = clean.clip_float32(df.drop(*drop))
    df = cmodel2.transform(df)
    if cfg.correlation_threshold is not None:
        feat_cols = [c for c in df.columns if c != row_id]
        df = clean.drop_correlated(df.select(row_id, *[col(c) for c in feat_cols]), target, cfg.correlation_threshold)
    df = names.sanitize_columns(df)
    return df, rep


def feature_columns(df: DataFrame, target: str, exclude: tuple[str, ...] = ("row_id",)) -> list[str]:
    """Numeric and boolean columns other than the target and ids, in table order."""
    from pyspark.sql import types as T
    ok = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, ok) and f.name != target and f.name not in exclude]


def with_label(df: DataFrame, target: str, statement: str | None, label: str = "label") -> DataFrame:
    """F4 on the target when ``statement`` is given, else the target itself as a double label."""
    if statement:
        df = clean.label_by_threshold(df, target, statement, out=label)
    else:
        df = df.withColumn(label, col(target))
    return df.withColumn(label, F.col(label).cast("double"))
