"""Data-dependent encoders as fit/transform pairs.

``fit`` runs a bounded number of jobs and keeps only a small summary (decisions,
vocabularies of bounded size, means); ``transform`` is then a single ``select``
whose fitted constants enter the plan as literals, so it also runs on a stream.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework import config
from casework.functions.clinical import bmi, bmi_flag, drug_canonical, in_range, unit_convert
from casework.functions.text import col, strip, to_number
from casework.operators.clean import NUMERIC_TYPES, columns_of_type
from casework.operators.names import unique_names
from casework.operators.ordered import dense_codes
from casework.operators.profile import CategoricalProfile, frequent_values, profile_text_columns

log = logging.getLogger(__name__)


def _allowed_number(c: str) -> F.Column:
    return to_number(c).isin(list(config.BINARY_ALLOWED_NUMBERS))


# ------------------------------------------------------------------ F1 binary
@dataclass
class BinaryEncoderModel:
    columns: list[str]
    null_as_zero: bool = True

    def expr(self, c: str) -> F.Column:
        s = F.lower(strip(col(c).cast("string")))
        missing = F.lit(0.0) if self.null_as_zero else F.lit(None).cast("double")
        return (F.when(col(c).isNull(), missing)
                .when(s.isin(list(config.BINARY_TRUE)), F.lit(1.0))
                .when(s.isin(list(config.BINARY_FALSE)), F.lit(0.0))
                .when(to_number(col(c).cast("string")) == 1.0, F.lit(1.0))
                .otherwise(F.lit(0.0)))

    def transform(self, df: DataFrame) -> DataFrame:
        enc = set(self.columns)
        return df.select(*[self.expr(c).alias(c) if c in enc else col(c) for c in df.columns])


@dataclass
class BinaryEncoder:
    """encode listed columns to 0/1 when every distinct non-NULL value is a yes/no word or one
    of the numbers 0, 1, -99, -1; other columns stay untouched. The fit is one aggregation, whose
    expressions (``stats``) can also ride along in a larger aggregation (``from_stats``)."""

    columns: Sequence[str] = config.POTENTIAL_BINARY
    null_as_zero: bool = True

    def present(self, df: DataFrame) -> list[str]:
        return [c.lower() for c in self.columns if c.lower() in df.columns]

    def stats(self, df: DataFrame, prefix: str = "bin") -> list[F.Column]:
        words = list(config.BINARY_TRUE + config.BINARY_FALSE)
        out = []
        for i, c in enumerate(self.present(df)):
            s = F.lower(strip(col(c).cast("string")))
            ok = s.isin(words) | _allowed_number(col(c).cast("string"))
            out.append(F.coalesce(F.bool_and(F.when(col(c).isNotNull(), F.coalesce(ok, F.lit(False)))),
                                  F.lit(True)).alias(f"{prefix}{i}"))
        return out

    def from_stats(self, row, df: DataFrame, prefix: str = "bin") -> BinaryEncoderModel:
        present = self.present(df)
        return BinaryEncoderModel([c for i, c in enumerate(present) if row[f"{prefix}{i}"]], self.null_as_zero)

    def fit(self, df: DataFrame) -> BinaryEncoderModel:
        exprs = self.stats(df)
        if not exprs:
            return BinaryEncoderModel([], self.null_as_zero)
        return self.from_stats(df.agg(*exprs).first(), df)


# ------------------------------------------------------- F15/F16 one-hot (+A1/A2)
@dataclass
class CategoricalModel:
    # column -> sorted vocabulary (first value is the dropped baseline)
    vocab: dict[str, list[str]] = field(default_factory=dict)
    # column -> kept values when rare values are grouped into "Other"
    top: dict[str, list[str]] = field(default_factory=dict)
    # numeric-looking text columns converted to double (numeric mode)
    to_double: list[str] = field(default_factory=list)

    def dummy_names(self, others: Sequence[str] = ()) -> list[str]:
        """Names of the dummies, unique next to the ``others`` that the table keeps (values may differ in
        case only, or repeat an existing name)."""
        names = [f"{c}_{v}" for c, vs in self.vocab.items() for v in vs[1:]]
        return unique_names([*others, *names])[len(others):]

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [col(c) if c not in self.to_double else to_number(c).alias(c)
                for c in df.columns if c not in self.vocab]
        dummies = []
        for c, vs in self.vocab.items():
            x = col(c) if c in df.columns else F.lit(None).cast("string")
            if c in self.top:
                x = F.when(x.isin(self.top[c]), x).otherwise(F.lit("Other"))
            dummies += [(c, F.coalesce(x == F.lit(v), F.lit(False))) for v in vs[1:]]
        names = self.dummy_names([c for c in df.columns if c not in self.vocab])
        return df.select(*keep, *[e.alias(n) for n, (c, e) in zip(names, dummies) if c in df.columns])


@dataclass
class CategoricalEncoder:
    """A1 + F15/F16: one-hot (drop first) of categorical text columns.

    ``columns=None`` finds them (A1: < ``max_categories`` distinct values with NULL counted, not
    all bool-like). Columns whose non-NULL values are >= ``numeric_threshold`` numbers are not
    encoded (A2); in ``numeric`` mode they become doubles. A column with more than
    ``max_categories`` values keeps its most frequent ones (ties by value) and maps the rest and
    NULL to "Other". Fit: two jobs for all columns, plus one top-k job for long-tailed columns.
    """

    columns: Sequence[str] | None = None
    max_categories: int = config.MAX_CATEGORIES
    numeric_threshold: float = config.NUMERIC_THRESHOLD
    numeric_mode: str = "numeric"

    def fit(self, df: DataFrame, profile: CategoricalProfile | None = None) -> CategoricalModel:
        """``profile``: text statistics already computed on these values (saves the first job)."""
        text = columns_of_type(df, (T.StringType,))
        prof = profile_text_columns(df, text, self.max_categories, stats=profile)
        model = CategoricalModel()
        if self.numeric_mode == "numeric":
            model.to_double = [c for c in text if prof.numeric_share.get(c, 0.0) >= self.numeric_threshold]
        cats = prof.categorical if self.columns is None else [c.lower() for c in self.columns if c.lower() in df.columns]
        long_tail = []
        for c in cats:
            if prof.numeric_share.get(c, 0.0) >= self.numeric_threshold:
                continue
            if prof.approx_distinct.get(c, 0) > 4 * self.max_categories:  # vocabulary not collected
                long_tail.append(c)
                continue
            counts = prof.counts.get(c, {})
            vocab = sorted(counts)
            if len(vocab) > self.max_categories:
                top = sorted(counts, key=lambda v: (-counts[v], v))[: self.max_categories]
                model.top[c] = top
                vocab = sorted(set(top) | {"Other"})
            model.vocab[c] = vocab
        if long_tail:
            for c, top in _top_k_per_column(df, long_tail, self.max_categories).items():
                model.top[c] = top
                model.vocab[c] = sorted(set(top) | {"Other"})
        return model


def _top_k_per_column(df: DataFrame, columns: list[str], k: int) -> dict[str, list[str]]:
    """Top-k values per column: by counter summaries in two jobs for all columns where their bound proves the result, and
    for the others by one grouping, whose rank filter lets Catalyst limit each group before the shuffle (WindowGroupLimit)."""
    text = df.select(*[col(c).cast("string").alias(c) for c in columns])
    found = frequent_values(text, columns, k)
    out: dict[str, list] = {c: [v for v, _ in vs] for c, vs in found.items() if vs is not None}
    left = [c for c in columns if c not in out]
    if left:
        long = text.select(*[col(c) for c in left]).unpivot([], left, "column_name", "value").filter(F.col("value").isNotNull())
        counts = long.groupBy("column_name", "value").count()
        w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
        ranked: dict[str, list] = {}
        for r in counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).collect():
            ranked.setdefault(r["column_name"], []).append((r["_r"], r["value"]))
        out |= {c: [v for _, v in sorted(vs)] for c, vs in ranked.items()}
    return out


# ------------------------------------------------------------- F10/F11 drugs
@dataclass
class DrugMultiHot:
    """``used_<drug>`` flags, true when any slot column maps to the drug.

    Default reads the raw slot columns (``ped_sap_name1..n``). ``after_drop_first=True`` reads
    the one-hot columns ``ped_sap_name<k>_<value>`` instead, as the compatible pipeline does
    (so a slot's alphabetically first value is lost). Output columns are sorted by drug name.
    """

    patterns: Sequence[tuple[str, str]] = config.DRUG_PATTERNS
    prefix: str = config.DRUG_SLOT_PREFIX
    after_drop_first: bool = False

    def named_drugs(self, df: DataFrame) -> list[F.Column]:
        """Per slot, or per one-hot column of a slot, the canonical name of the drug it holds (NULL: none)."""
        slot = re.compile(rf"{self.prefix}\d+(?:_(?P<value>.*))?", re.IGNORECASE | re.DOTALL)
        held = []
        for c in df.columns:
            m = slot.fullmatch(c)
            if m and self.after_drop_first and m["value"] is not None:
                held.append(F.when(col(c).cast("boolean"), F.lit(m["value"])))
            elif m and not self.after_drop_first and m["value"] is None:
                held.append(col(c))
        return [drug_canonical(h, self.patterns, self.prefix) for h in held]

    def transform(self, df: DataFrame) -> DataFrame:
        drugs = sorted({d for _, d in self.patterns})
        flags = {f"used_{d}": F.coalesce(F.array_contains("_drugs", F.lit(d)), F.lit(False)) for d in drugs}
        # the names of all slots are worked out once per row, in a projection of their own; only columns
        # that the flags replace are left out
        rest = [c for c in df.columns if c.lower() not in flags]
        held = self.named_drugs(df)
        arr = F.array(*held) if held else F.array().cast("array<string>")
        return df.select(*[col(c) for c in rest], arr.alias("_drugs")) \
            .select(*[col(c) for c in rest], *[e.alias(n) for n, e in flags.items()])


# ----------------------------------------------------------- F12 combinations
def regimen_name(used_cols: Sequence[str]) -> F.Column:
    """The combination key of a row: sorted used names joined by '_' (or the empty-regimen name)."""
    in_order = sorted(used_cols, key=lambda c: c[len("used_"):])  # once here rather than in every row; code points sort as UTF-8 bytes do
    key = F.concat_ws("_", *[F.when(col(c).try_cast("boolean"), F.lit(c[len("used_"):])) for c in in_order])
    return F.when(key == "", F.lit("single_abx_regimen_")).otherwise(F.concat(F.lit("combo_abx_regimen_"), key))


@dataclass
class ComboModel:
    names: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        used = [c for c in df.columns if c.startswith("used_")]
        base = df.select("*", regimen_name(used).alias("_regimen"))
        return base.select(*[col(c) for c in df.columns],
                           *[(F.col("_regimen") == F.lit(n)).cast("int").alias(n) for n in self.names])


@dataclass
class ComboEncoder:
    """one 0/1 column per distinct drug combination. The vocabulary has at most
    2^(number of drugs) entries, so collecting it is bounded."""

    def stats(self, df: DataFrame, prefix: str = "combo") -> list[F.Column]:
        used = [c for c in df.columns if c.startswith("used_")]
        return [F.collect_set(regimen_name(used)).alias(prefix)]

    def from_stats(self, row, prefix: str = "combo") -> ComboModel:
        return ComboModel(sorted(row[prefix]))

    def fit(self, df: DataFrame) -> ComboModel:
        return self.from_stats(df.agg(*self.stats(df)).first())


# ---------------------------------------------------------------- F6-F9 BMI
def bmi_columns(height: str = "height", weight: str = "weight") -> dict[str, F.Column]:
    """Intermediate and final BMI columns as expressions."""
    h = in_range(unit_convert(height, config.INCH_TO_M), *config.HEIGHT_M_RANGE)
    w = in_range(unit_convert(weight, config.POUND_TO_KG), *config.WEIGHT_KG_RANGE)
    b = bmi(w, h)
    flag = bmi_flag(b)
    kept = F.when(flag.isin(list(config.BMI_KEEP_FLAGS)), b)
    return {"height_m": h, "weight_kg": w, "bmi_raw": b, "bmi_quality_flag": flag, "bmi": kept}


def add_bmi(df: DataFrame, height: str = "height", weight: str = "weight") -> DataFrame:
    """``bmi`` (kept for valid/unusual flags) and ``bmi_quality_flag``; skipped if an input is absent."""
    if height not in df.columns or weight not in df.columns:
        log.warning("no height or no weight: BMI left out")
        return df
    e = bmi_columns(height, weight)
    return df.select(*[col(c) for c in df.columns if c not in ("bmi", "bmi_quality_flag")],
                     e["bmi"].alias("bmi"), e["bmi_quality_flag"].alias("bmi_quality_flag"))


def unparseable_values(df: DataFrame, columns: Sequence[str] = ("height", "weight"), n: int = 5) -> DataFrame:
    """F6 report: up to ``n`` distinct non-NULL values per column that do not read as numbers.

    One job for all columns; the per-column limit is a rank filter, which Catalyst turns into a
    partial limit before the shuffle, so a column full of bad text costs no more than n rows per task.
    """
    cols = [c for c in columns if c in df.columns]
    long = df.select(*[col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "value") \
        .filter(F.col("value").isNotNull() & to_number("value").isNull()).distinct()
    w = Window.partitionBy("column_name").orderBy("value")
    return long.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def bmi_report(df: DataFrame, height: str = "height", weight: str = "weight") -> DataFrame:
    """One row with valid height/weight/BMI counts, BMI range and the NULL count of the kept BMI."""
    e = bmi_columns(height, weight)
    x = df.select(e["height_m"].alias("h"), e["weight_kg"].alias("w"), e["bmi_raw"].alias("b"), e["bmi"].alias("k"))
    return x.agg(F.count(F.lit(1)).alias("n_rows"), F.count("h").alias("height_valid"),
                 F.count("w").alias("weight_valid"), F.count("b").alias("bmi_computed"),
                 F.round(F.min("b"), 6).alias("bmi_min"), F.round(F.max("b"), 6).alias("bmi_max"),
                 F.count_if(F.col("k").isNull()).alias("bmi_null"))


# ------------------------------------------------------------ F13/F14 numeric
@dataclass
class CompatibleModel:
    means: dict[str, float]
    fill_false: list[str]
    fill_zero: list[str]
    small_vocab: dict[str, list[str]]
    large_codes: dict[str, DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            x = col(c)
            if c in self.means:
                x = F.coalesce(x, F.lit(self.means[c]))
            elif c in self.fill_false:
                x = F.coalesce(x, F.lit(False)).cast("int")
            elif c in self.fill_zero:
                x = F.coalesce(x, F.lit(0))
            elif c in self.small_vocab:
                vs = self.small_vocab[c]
                lookup = F.map_from_arrays(F.array(*[F.lit(v) for v in vs]), F.array(*[F.lit(i).cast("long") for i in range(len(vs))]))
                x = F.element_at(lookup, F.coalesce(x, F.lit("Unknown")))
            out.append(x.alias(c) if c not in self.large_codes else x)
        res = df.select(*out)
        for k, (c, codes) in enumerate(self.large_codes.items()):
            tmp = f"_code_{k}"
            res = res.withColumn(c, F.coalesce(col(c), F.lit("Unknown"))) \
                .join(codes.withColumnRenamed("code", tmp), c, "left") \
                .withColumn(c, F.col(tmp)).drop(tmp)
        return res.select(*[col(c) for c in df.columns])


@dataclass
class CompatibleEncoder:
    """F14 then F13: impute (numeric → mean, boolean → False then int, text → "Unknown") and
    label-encode every text column by its rank among sorted distinct values. Vocabularies up to
    ``map_limit`` values become literal maps; larger ones use the distributed ``dense_codes``
    join, so no vocabulary of unbounded size passes through the driver."""

    map_limit: int = 200

    def stats(self, df: DataFrame, prefix: str = "cmp", exprs: dict[str, F.Column] | None = None) -> list[F.Column]:
        """Per-column NULL flags, means of numeric columns, distinct estimates of text columns.
        ``exprs`` maps a column to the expression whose statistics are wanted (e.g. its clipped form)."""
        exprs = exprs or {}
        num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
        txt = columns_of_type(df, (T.StringType,))
        e = lambda c: exprs.get(c, col(c))
        out = [F.max(e(c).isNull().cast("int")).alias(f"{prefix}n{i}") for i, c in enumerate(df.columns)]
        out += [F.avg(e(c)).alias(f"{prefix}m{i}") for i, c in enumerate(num)]
        out += [F.approx_count_distinct(F.coalesce(e(c), F.lit("Unknown")), 0.05).alias(f"{prefix}d{i}")
                for i, c in enumerate(txt)]
        return out

    def from_stats(self, row, df: DataFrame, prefix: str = "cmp", only: set[str] | None = None) -> CompatibleModel:
        """Model from a row of ``stats(df)``; ``only`` limits the vocabulary jobs to surviving columns."""
        num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
        boo = columns_of_type(df, (T.BooleanType,))
        txt = columns_of_type(df, (T.StringType,))
        other = [c for c in df.columns if c not in set(num) | set(boo) | set(txt)]
        has_null = {c: bool(row[f"{prefix}n{i}"]) for i, c in enumerate(df.columns)}
        means = {c: row[f"{prefix}m{i}"] for i, c in enumerate(num) if has_null.get(c) and row[f"{prefix}m{i}"] is not None}
        small, large, est = [], [], {}
        for i, c in enumerate(txt):
            est[c] = row[f"{prefix}d{i}"]
            if only is not None and c not in only:
                continue
            (small if est[c] <= self.map_limit else large).append(c)
        small_vocab: dict[str, list[str]] = {}
        if small:
            filled = df.select(*[F.coalesce(col(c), F.lit("Unknown")).alias(c) for c in small])
            for r in filled.unpivot([], small, "column_name", "value").distinct().collect():
                small_vocab.setdefault(r["column_name"], []).append(r["value"])
            small_vocab = {c: sorted(v) for c, v in small_vocab.items()}
        large_codes = {}
        for c in large:
            codes = dense_codes(df.select(F.coalesce(col(c), F.lit("Unknown")).alias(c)), c)
            large_codes[c] = codes  # joined without a hint: the planner knows the size of the written codes
        return CompatibleModel(means, [c for c in boo if has_null.get(c)],
                               [c for c in other if has_null.get(c)], small_vocab, large_codes)

    def fit(self, df: DataFrame) -> CompatibleModel:
        if not df.columns:
            return CompatibleModel({}, [], [], {}, {})
        return self.from_stats(df.agg(*self.stats(df)).first(), df)
