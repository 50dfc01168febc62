"""Text and number-parsing column expressions (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.config import MISSING_TOKENS

# Characters removed by a Python-style strip() (ASCII whitespace).
_WS = " \t\n\r\x0b\x0c"
# A plain decimal / scientific number. Java-only forms such as "1d" or "0x1" do not match.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def col(c: str | Column) -> Column:
    """Column for a name that may hold dots or spaces."""
    if isinstance(c, Column):
        return c
    return F.col(f"`{c.replace('`', '``')}`")


def strip(c: str | Column) -> Column:
    """Trim leading and trailing whitespace."""
    return F.btrim(col(c).cast("string"), F.lit(_WS))


def is_blank(c: str | Column) -> Column:
    """NULL, or empty after trimming."""
    x = col(c)
    return x.isNull() | (strip(x) == F.lit(""))


_NUMBER_CHARS = "0123456789+-.eE"


def _plain_number(s: Column) -> Column:
    # A string made only of digits, signs, '.', 'e' that the cast accepts is a plain decimal
    # number (same set as NUMBER_PATTERN); Java-only forms such as '1d', '0x1p3', 'NaN' hold other
    # characters. translate() is a per-character map, much cheaper than a regex per cell.
    return (F.translate(s, _NUMBER_CHARS, "") == F.lit("")) & (F.length(s) > 0)


def is_number_text(c: str | Column) -> Column:
    """Trimmed text is a plain decimal number (guards try_cast against '1d', '1f')."""
    s = strip(c)
    return F.coalesce(_plain_number(s) & s.try_cast("double").isNotNull(), F.lit(False))


def to_number(c: str | Column) -> Column:
    """Lenient number parse: numbers pass, everything else becomes NULL."""
    s = strip(col(c))
    return F.when(_plain_number(s), s.try_cast("double"))


def null_tokens(c: str | Column, tokens: Iterable[str] = MISSING_TOKENS, null_text: str | None = None) -> Column:
    """Cast to text, trim, and turn whole-value missing tokens (case-insensitive) into NULL.

    ``null_text``: when given (e.g. "nan"), values that were already missing become
    that literal text instead of staying NULL (the compatible behaviour).
    """
    s = strip(c)
    lowered = [t.lower() for t in tokens]
    out = F.when(F.lower(s).isin(lowered), F.lit(None).cast("string")).otherwise(s)
    if null_text is not None:
        out = F.when(col(c).isNull(), F.lit(null_text)).otherwise(out)
    return out


def nan_to_null(c: str | Column) -> Column:
    """NaN → NULL for floating columns (Spark orders NaN above every number)."""
    x = col(c)
    return F.when(~F.isnan(x), x)


def parse_timestamp(c: str | Column) -> Column:
    """Lenient timestamp parse: bad text becomes NULL. Wall-clock (NTZ) result."""
    x = col(c)
    return F.try_to_timestamp(strip(x)).cast("timestamp_ntz")
