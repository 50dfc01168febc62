"""Row and column cleaning operators."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from casework import config
from casework.functions.clinical import clip, complication_flag, threshold_label
from casework.functions.text import col, is_blank, nan_to_null, null_tokens, parse_timestamp, to_number
from casework.session import materialize

log = logging.getLogger(__name__)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def columns_of_type(df: DataFrame, types) -> list[str]:
    """Names of columns whose type is one of ``types``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def row_fingerprint(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row: two seeded 64-bit hashes of the columns and of which of them are NULL."""
    cols = [col(c) for c in columns]
    nulls = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(F.lit(seed), nulls, *cols).alias(name) for seed, name in ((1, "_fp1"), (2, "_fp2"))]


def dedupe_keep_first(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Drop exact duplicate rows (all columns but ``row_id``), keeping the smallest ``row_id``.

    NULLs compare equal. Rows meet by 128-bit fingerprints, never by their full width: a row whose fingerprint is its own
    cannot have a copy and stays where it is. Only rows that share a fingerprint are compared in full, by the least and the
    greatest row of each fingerprint (partial aggregates, so copies collapse inside each map task and a row repeated in a third
    of the table stays cheap); fingerprints whose two differ are grouped by all columns."""
    keys = [c for c in df.columns if c != row_id]
    fp = ["_fp1", "_fp2"]
    base = materialize(df.select("*", *row_fingerprint(keys)), "dedupe-rows")  # read several times below
    shared = base.groupBy(*fp).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*fp)
    alone = base.join(shared, fp, "left_anti").select(*[col(c) for c in df.columns])
    row = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    groups = base.join(shared, fp, "left_semi").groupBy(*fp).agg(F.min(col(row_id)).alias("_id"), F.min(row).alias("_least"), F.max(row).alias("_greatest"))
    groups = materialize(groups, "dedupe-copies")
    back = {k: F.col("_least")[f"k{i}"] for i, k in enumerate(keys)} | {row_id: F.col("_id")}
    equal = F.col("_least") == F.col("_greatest")
    copies = groups.filter(equal).select(*[back[c].alias(c) for c in df.columns])
    out, collided = alone.unionByName(copies), groups.filter(~equal).select(*fp)
    if collided.isEmpty():
        return out
    mixed = base.join(collided, fp, "left_semi").groupBy(*[col(k) for k in keys]).agg(F.min(col(row_id)).alias(row_id))
    return out.unionByName(mixed.select(*[col(c) for c in df.columns]))


def parse_dates(df: DataFrame, columns: Iterable[str] = config.DATE_COLUMNS) -> DataFrame:
    """Lenient timestamp parse of the listed columns that exist; bad values become NULL."""
    present = set(df.columns)
    return df.select(*[parse_timestamp(c).alias(c) if c in columns and c in present else col(c)
                       for c in df.columns])


def normalize_nulls(df: DataFrame, tokens: Sequence[str] = config.MISSING_TOKENS, keep: Sequence[str] = (),
                    null_text: str | None = None) -> DataFrame:
    """Every column (except ``keep``) becomes trimmed text; missing tokens become NULL."""
    return df.select(*[col(c) if c in keep else null_tokens(c, tokens, null_text).alias(c) for c in df.columns])


def drop_blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose listed (existing) columns are all non-NULL and non-blank."""
    present = [c for c in columns if c in df.columns]
    for c in columns:
        if c not in df.columns:
            log.warning("blank-row filter: no column %r in this table", c)
    if not present:
        return df
    return df.filter(reduce(lambda a, b: a & b, [~is_blank(c) for c in present]))


def drop_leak_columns(df: DataFrame, target: str, leak_columns: Sequence[str] = config.LEAK_COLUMNS) -> DataFrame:
    """The target must be numeric, or text (as a CSV scan gives) whose values, missing tokens aside, all
    read as numbers; drop the fixed leak list (absent names ignored)."""
    if target not in df.columns:
        raise ValueError(f"no column for the target '{target}'")
    if isinstance(df.schema[target].dataType, T.StringType):
        value = null_tokens(target, config.MISSING_TOKENS)
        odd = df.filter(value.isNotNull() & to_number(value).isNull()).select(value.alias("v")).first()
        if odd:
            raise ValueError(f"the target '{target}' holds text that is not a number, such as {odd['v']!r}")
    elif not isinstance(df.schema[target].dataType, NUMERIC_TYPES):
        raise ValueError(f"the target '{target}' is of type {df.schema[target].dataType.simpleString()}, not a number")
    return df.drop(*[c for c in leak_columns if c in df.columns])


def nan_as_missing(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, the only missing value of the later stages."""
    floats = set(columns_of_type(df, FLOAT_TYPES))
    return df.select(*[nan_to_null(c).alias(c) if c in floats else col(c) for c in df.columns]) if floats else df


def correlated_columns(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """One row per numeric column with its Pearson correlation to the target, and whether
    abs(corr) >= threshold. All correlations come from one aggregation job."""
    nums = [c for c in columns_of_type(df, NUMERIC_TYPES) if c != target and c != "row_id"]
    row = df.agg(*[F.corr(col(c).cast("double"), col(target).cast("double")).alias(f"c{i}")
                   for i, c in enumerate(nums)])
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', c{i}" for i, c in enumerate(nums))
    return row.select(F.expr(f"stack({len(nums)}, {stack}) AS (column_name, corr)")) \
        .withColumn("dropped", F.coalesce(F.abs("corr") >= threshold, F.lit(False)))


def drop_correlated(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """Drop numeric columns whose abs correlation with the target reaches ``threshold``."""
    drop = [r["column_name"] for r in correlated_columns(df, target, threshold).filter("dropped").collect()]
    return df.drop(*drop)


def clip_float32(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Clip floating columns to the float32 range; NULL stays NULL, ±inf is clipped."""
    cols = set(columns if columns is not None else columns_of_type(df, FLOAT_TYPES))
    return df.select(*[clip(c).alias(c) if c in cols else col(c) for c in df.columns])


def composite_target(df: DataFrame, target: str, composites=config.KNOWN_COMPOSITES) -> DataFrame:
    """build a known composite target by OR-ing complication flags of its components.

    Each present component is overwritten by its 0/1 flag. If the target is already present
    nothing changes; if it is neither present nor a known composite the result is empty.
    """
    if target in df.columns:
        return df
    if target not in composites:
        log.warning("no target %r and no parts to build it from: empty table", target)
        return df.sparkSession.createDataFrame([], T.StructType([]))
    parts = [c for c in composites[target] if c in df.columns]
    missing = [c for c in composites[target] if c not in df.columns]
    if missing:
        log.warning("%r is built without %s", target, missing)
    flags = {c: complication_flag(c) for c in parts}
    tgt = reduce(lambda a, b: a.bitwiseOR(b), flags.values()) if flags else F.lit(0)
    return df.select(*[flags[c].alias(c) if c in flags else col(c) for c in df.columns], tgt.alias(target))


def label_by_threshold(df: DataFrame, target: str, statement: str, out: str | None = None) -> DataFrame:
    """replace (or add as ``out``) a 0/1 label from a SQL predicate over ``x`` (e.g. ``x > 5``)."""
    out = out or target
    floating = target in df.columns and isinstance(df.schema[target].dataType, FLOAT_TYPES)
    expr = threshold_label(target, statement, floating).alias(out)
    try:
        if out in df.columns:
            res = df.select(*[expr if c == out else col(c) for c in df.columns])
        else:
            res = df.select("*", expr)
        res.schema  # force analysis so a bad predicate fails here
        return res
    except AnalysisException as e:
        raise ValueError(f"not a predicate over x: {statement!r} ({e})") from e


def binary_target_cast(df: DataFrame, target: str) -> DataFrame:
    """a target with exactly two distinct non-NULL values is cast to int (no remapping)."""
    n = df.agg(F.count_distinct(col(target))).first()[0]
    if n == 2:
        return df.withColumn(target, col(target).cast("int"))
    return df
