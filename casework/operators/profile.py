"""Whole-column profiling (A1-A7, P10 fit). Each profile runs a constant number of jobs,
however many columns there are: one wide aggregation, plus at most one unpivot + group-by."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework import config
from casework.functions.text import col, is_number_text, strip
from casework.operators.clean import NUMERIC_TYPES, columns_of_type


def _q(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def _stack(row: DataFrame, names: Sequence[str], fields: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Turn a one-row wide aggregate (columns ``{field}{i}``) into one row per column name."""
    if not names:
        schema = ", ".join(["column_name string"] + [f"{o} double" for o in out])
        return row.sparkSession.createDataFrame([], schema)
    parts = []
    for i, n in enumerate(names):
        parts.append(", ".join([_q(n)] + [f"`{f}{i}`" for f in fields]))
    return row.select(F.expr(f"stack({len(names)}, {', '.join(parts)}) AS (column_name, {', '.join(out)})"))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """A3/A4: per numeric column n, non-NULL count, distinct count, min, max, mean, sample variance.

    ``exact_distinct=False`` takes the distinct count from the aggregation's HyperLogLog
    estimate instead of the unpivot + distinct shuffle (which moves every distinct value)."""
    cols = list(columns) if columns is not None else columns_of_type(df, NUMERIC_TYPES)
    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.count(F.lit(1)).alias(f"n{i}"), F.count(x).alias(f"nn{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"av{i}"), F.var_samp(x).alias(f"vr{i}"), F.approx_count_distinct(x).alias(f"ad{i}")]
    wide = df.agg(*aggs)
    stats = _stack(wide, cols, ["n", "nn", "mn", "mx", "av", "vr", "ad"], ["n", "n_nonnull", "min", "max", "mean", "var_samp", "approx_distinct"])
    if not exact_distinct:
        return stats.select("column_name", F.col("n").cast("bigint").alias("n"), F.col("n_nonnull").cast("bigint").alias("n_nonnull"),
                            F.col("approx_distinct").cast("bigint").alias("n_distinct"), "min", "max", "mean", "var_samp")
    # Exact distinct counts: one unpivot, partial aggregation before the shuffle.
    long = df.select(*[col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], cols, "column_name", "value").filter(F.col("value").isNotNull())
    distinct = long.select("column_name", "value").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return stats.join(distinct, "column_name", "left").select(
        "column_name", F.col("n").cast("bigint").alias("n"), F.col("n_nonnull").cast("bigint").alias("n_nonnull"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min", "max", "mean", "var_samp")


def numeric_share(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A2: per text column, the share of non-NULL values that read as numbers."""
    cols = list(columns) if columns is not None else columns_of_type(df, (T.StringType,))
    aggs = [F.avg(F.when(col(c).isNotNull(), is_number_text(c).cast("double"))).alias(f"s{i}")
            for i, c in enumerate(cols)]
    return _stack(df.agg(*aggs), cols, ["s"], ["share"])


@dataclass
class CategoricalProfile:
    """Fit summary for categorical columns: value frequencies of each bounded text column."""

    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    has_null: dict[str, bool] = field(default_factory=dict)
    approx_distinct: dict[str, int] = field(default_factory=dict)
    numeric_share: dict[str, float] = field(default_factory=dict)
    categorical: list[str] = field(default_factory=list)


def text_stats(columns: Sequence[str], prefix: str = "tx") -> list[F.Column]:
    """Job-1 expressions of the text profile: NULL presence, distinct estimate, numeric share."""
    out = []
    for i, c in enumerate(columns):
        out += [F.max(col(c).isNull().cast("int")).alias(f"{prefix}hn{i}"),
                F.approx_count_distinct(col(c), 0.05).alias(f"{prefix}ad{i}"),
                F.avg(F.when(col(c).isNotNull(), is_number_text(c).cast("double"))).alias(f"{prefix}ns{i}")]
    return out


def text_stats_from_row(row, columns: Sequence[str], prefix: str = "tx") -> CategoricalProfile:
    prof = CategoricalProfile()
    for i, c in enumerate(columns):
        prof.has_null[c] = bool(row[f"{prefix}hn{i}"])
        ns = row[f"{prefix}ns{i}"]
        prof.numeric_share[c] = ns if ns is not None else float("nan")
        prof.approx_distinct[c] = int(row[f"{prefix}ad{i}"])
    return prof


def profile_text_columns(df: DataFrame, columns: Sequence[str] | None = None, max_unique: int = config.MAX_CATEGORIES,
                         bool_like=config.BOOL_LIKE_VALUES, vocab_cap: int | None = None,
                         stats: CategoricalProfile | None = None) -> CategoricalProfile:
    """A1 (+A2, A5 inputs): find categorical text columns and their value counts in two jobs.

    Job 1 (one aggregation, ``text_stats``): NULL presence, HyperLogLog distinct estimate and
    numeric share per column; it may be supplied precomputed as ``stats``. Only columns whose
    estimate is below ``4 * max_unique`` (so the estimate's error cannot decide the result) enter
    job 2: one unpivot + group-by of (column, value) counts, whose result is bounded by that cut
    and is the only thing brought to the driver.
    """
    cols = list(columns) if columns is not None else columns_of_type(df, (T.StringType,))
    if not cols:
        return CategoricalProfile()
    cap = vocab_cap or 4 * max_unique
    if stats is None or any(c not in stats.approx_distinct for c in cols):
        stats = text_stats_from_row(df.agg(*text_stats(cols)).first(), cols)
    prof = CategoricalProfile(has_null={c: stats.has_null[c] for c in cols},
                              numeric_share={c: stats.numeric_share[c] for c in cols},
                              approx_distinct={c: stats.approx_distinct[c] for c in cols})
    bounded = [c for c in cols if prof.approx_distinct[c] <= cap]
    if bounded:
        long = df.select(*[col(c) for c in bounded]).unpivot([], bounded, "column_name", "value") \
            .filter(F.col("value").isNotNull())
        for r in long.groupBy("column_name", "value").count().collect():
            prof.counts.setdefault(r["column_name"], {})[r["value"]] = r["count"]
    bl = set(bool_like)
    for c in bounded:
        vals = prof.counts.get(c, {})
        n_unique = len(vals) + (1 if prof.has_null[c] else 0)
        if n_unique < max_unique and not {v.strip().lower() for v in vals} <= bl:
            prof.categorical.append(c)
    return prof


def categorical_report(df: DataFrame, columns: Sequence[str] | None = None, max_unique: int = config.MAX_CATEGORIES,
                       bool_like=config.BOOL_LIKE_VALUES) -> DataFrame:
    """A1 as a DataFrame: per text column, distinct values counting NULL as one, and the decision."""
    cols = list(columns) if columns is not None else columns_of_type(df, (T.StringType,))
    long = df.select(*[col(c) for c in cols]).unpivot([], cols, "column_name", "value")
    per_value = long.select("column_name", "value").distinct()
    bl = [v for v in bool_like]
    rep = per_value.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.bool_and(F.when(F.col("value").isNotNull(), F.lower(strip("value")).isin(bl))).alias("_all_bool"))
    return rep.select("column_name", "n_unique",
                      ((F.col("n_unique") < max_unique) & ~F.coalesce("_all_bool", F.lit(True))).alias("is_categorical"))


#: Values a counter summary tracks per column; it is all that a task sends in and all that reaches the driver.
COUNTERS = 16384
_COUNTABLE = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, *NUMERIC_TYPES)


def frequent_values(df: DataFrame, columns: Sequence[str], k: int, counters: int = COUNTERS) -> dict[str, list[tuple[object, int]] | None]:
    """The ``k`` most frequent non-NULL values of each column with exact counts (ties by value ascending), without shuffling
    every value; None for a column where that cannot be shown.

    First pass: one aggregation with a mergeable frequent-items summary per column. A value missing from a summary has been
    seen at most ``8 / counters`` times the column's rows (the summary errs by 3.5 / its size, twice over, its size being
    at least the tracked values). Second pass: exact counts of the summaries' values alone. If the k-th exact count lies above the bound, no
    missing value can belong to the top. A summary that never had to forget (its counts add up to the rows) is exact already.
    """
    cols, floats = list(columns), set(columns_of_type(df, (T.FloatType, T.DoubleType)))
    if not cols:
        return {}
    x = df.select(*[(col(c) + F.lit(0.0) if c in floats else col(c)).alias(f"c{i}") for i, c in enumerate(cols)])  # one zero, not two
    row = x.agg(*[e for i in range(len(cols)) for e in (
        F.expr(f"approx_top_k(c{i}, {counters}, {counters}) FILTER (WHERE c{i} IS NOT NULL)").alias(f"t{i}"), F.count(f"c{i}").alias(f"n{i}"))]).first()
    out: dict[str, list[tuple[object, int]] | None] = {}
    again = {}
    for i, c in enumerate(cols):
        items = [(r["item"], r["count"]) for r in row[f"t{i}"] or []]
        if sum(n for _, n in items) == row[f"n{i}"]:
            out[c] = sorted(sorted(items, key=lambda r: r[0]), key=lambda r: -r[1])[:k]
        else:
            again[i] = [v for v, _ in items]
    for i, values in again.items():
        got = []
        if values:
            name = f"c{i}"
            wanted = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", x.schema[name].dataType)]))
            seen = x.select(name).join(F.broadcast(wanted), F.col(name) == F.col("v"), "left_semi")  # at most ``counters`` values
            got = [(r[name], r["count"]) for r in seen.groupBy(name).count().orderBy(F.desc("count"), F.asc(name)).limit(k).collect()]
        out[cols[i]] = got if len(got) == k and got[-1][1] > 8 * row[f"n{i}"] / counters else None
    return out


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """A5: the ``n`` most frequent non-NULL values (ties by value ascending) with counts: by counter summaries where their
    error bound proves the result, else by grouping all values."""
    kind = df.select(col(column).alias("value")).schema["value"]
    if isinstance(kind.dataType, _COUNTABLE) and n <= COUNTERS // 8:
        found = frequent_values(df, [column], n)[column]
        if found is not None:
            schema = T.StructType([kind, T.StructField("count", T.LongType())])
            return df.sparkSession.createDataFrame(found, schema).orderBy(F.desc("count"), F.asc("value"))
    return df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).count() \
        .orderBy(F.desc("count"), F.asc("value")).limit(n)


def flag_distribution(df: DataFrame, flag: str) -> DataFrame:
    """Count and percent of rows per flag value."""
    g = df.groupBy(col(flag).alias(flag)).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def low_variance_stats(df: DataFrame, prefix: str = "lv") -> list[F.Column]:
    """P10 expressions: per column, constant (NULL counted as a value) and, for numeric
    non-boolean columns, the sample variance over non-NULL values."""
    numeric = set(columns_of_type(df, NUMERIC_TYPES))
    out = []
    for i, c in enumerate(df.columns):
        x = col(c)
        nn = F.count(x)
        out.append(((nn == 0) | ((nn == F.count(F.lit(1))) & (F.min(x) == F.max(x)))).alias(f"{prefix}k{i}"))
        if c in numeric:
            out.append(F.coalesce(F.var_samp(x.cast("double")), F.lit(0.0)).alias(f"{prefix}v{i}"))
    return out


def low_variance_from_row(row, df: DataFrame, threshold: float = config.LOW_VARIANCE_THRESHOLD,
                          always_drop: Sequence[str] = config.ALWAYS_DROP, prefix: str = "lv") -> list[str]:
    """Columns P10 removes, from a row holding ``low_variance_stats``."""
    numeric = set(columns_of_type(df, NUMERIC_TYPES))
    drop = []
    for i, c in enumerate(df.columns):
        low = c in numeric and row[f"{prefix}v{i}"] < threshold
        if row[f"{prefix}k{i}"] or low or c in always_drop:
            drop.append(c)
    return drop


def low_variance_report(df: DataFrame, threshold: float = config.LOW_VARIANCE_THRESHOLD,
                        always_drop: Sequence[str] = config.ALWAYS_DROP) -> DataFrame:
    """P10 fit as one aggregation, one row per column: is_constant, variance, dropped."""
    numeric = set(columns_of_type(df, NUMERIC_TYPES))
    wide = df.agg(*low_variance_stats(df))
    parts = ", ".join(f"{_q(c)}, lvk{i}, " + (f"lvv{i}" if c in numeric else "CAST(NULL AS DOUBLE)")
                      for i, c in enumerate(df.columns))
    rep = wide.select(F.expr(f"stack({len(df.columns)}, {parts}) AS (column_name, is_constant, variance)"))
    drop = F.col("is_constant") | F.coalesce(F.col("variance") < threshold, F.lit(False)) \
        | F.col("column_name").isin(list(always_drop))
    return rep.withColumn("dropped", drop)


def drop_low_variance(df: DataFrame, threshold: float = config.LOW_VARIANCE_THRESHOLD,
                      always_drop: Sequence[str] = config.ALWAYS_DROP) -> DataFrame:
    """P10: drop constant and low-variance columns (the decision list is bounded by the column count)."""
    drop = [r["column_name"] for r in low_variance_report(df, threshold, always_drop).filter("dropped").collect()]
    return df.drop(*drop)


def columns_with_nulls(df: DataFrame) -> list[str]:
    """F14 check: columns that still hold NULL (or NaN) values, from one aggregation."""
    if not df.columns:
        return []
    floats = set(columns_of_type(df, (T.FloatType, T.DoubleType)))
    aggs = []
    for i, c in enumerate(df.columns):
        miss = col(c).isNull() | F.isnan(col(c)) if c in floats else col(c).isNull()
        aggs.append(F.max(miss.cast("int")).alias(f"m{i}"))
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns) if row[f"m{i}"]]
