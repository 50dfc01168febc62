"""Clinical column expressions: flags, labels, unit conversion, BMI, drug names, clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework import config
from casework.functions.text import col, strip, to_number


def complication_flag(c: str | Column, no_event=config.NO_EVENT_VALUES) -> Column:
    """0 when the value means "no event" (or is missing), else 1."""
    x = col(c)
    return F.when(x.isNull() | F.lower(strip(x)).isin(list(no_event)), F.lit(0)).otherwise(F.lit(1))


def threshold_label(name: str, statement: str, floating: bool = False) -> Column:
    """1 where the SQL predicate over ``x`` holds for column ``name``, else 0 (missing compares false).

    The predicate is SQL text such as ``x > 5`` or ``x BETWEEN 2 AND 4``. ``x`` is bound as
    a lambda variable, so it never clashes with a column of that name. Errors surface as
    ``ValueError`` when the DataFrame is analysed (see ``operators.clean.label_by_threshold``).
    """
    if ";" in statement:
        raise ValueError(f"one predicate over x is wanted, not {statement!r}")
    ref = "`" + name.replace("`", "``") + "`"
    if floating:  # NaN compares false in the reference; in Spark NaN > anything is true
        ref = f"CASE WHEN isnan({ref}) THEN NULL ELSE {ref} END"
    try:
        cond = F.expr(f"element_at(transform(array({ref}), x -> ({statement})), 1)")
    except Exception as e:  # parse errors are raised eagerly
        raise ValueError(f"not a predicate over x: {statement!r} ({e})") from e
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def unit_convert(c: str | Column, factor: float) -> Column:
    """Lenient number parse times a unit factor."""
    return to_number(c) * F.lit(factor)


def in_range(c: str | Column, lo: float, hi: float) -> Column:
    """Value if lo <= value <= hi (inclusive), else NULL."""
    x = col(c)
    return F.when(x.between(F.lit(lo), F.lit(hi)), x)


def bmi(weight_kg: str | Column, height_m: str | Column) -> Column:
    """kg / m²; NULL when an input is NULL or the height is zero."""
    h = col(height_m)
    return F.try_divide(col(weight_kg), h * h)


def bmi_flag(b: str | Column, bands=config.BMI_BANDS) -> Column:
    """First matching band wins; a missing BMI is flagged 'valid' (compatible behaviour)."""
    x = col(b)
    out = None
    for flag, lo, hi in bands:
        cond = (x < F.lit(lo)) | (x > F.lit(hi))
        out = F.when(cond, F.lit(flag)) if out is None else out.when(cond, F.lit(flag))
    return out.otherwise(F.lit("valid"))


def drug_canonical(c: str | Column, patterns: Sequence[tuple[str, str]] = config.DRUG_PATTERNS,
                   prefix: str = config.DRUG_SLOT_PREFIX) -> Column:
    """Canonical drug name: lower-case, strip a slot prefix, first pattern contained wins; else NULL."""
    s = F.regexp_replace(F.lower(col(c)), rf"^{prefix}[0-9]+_", "")
    out = None
    for pat, name in patterns:
        cond = F.contains(s, F.lit(pat.lower()))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def clip(c: str | Column, lo: float = config.FLOAT32_MIN, hi: float = config.FLOAT32_MAX) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (greatest/least would skip NULLs)."""
    x = col(c)
    return F.when(x > F.lit(hi), F.lit(hi)).when(x < F.lit(lo), F.lit(lo)).otherwise(x)

