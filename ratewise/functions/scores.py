"""Score coercion and clipping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.constants import NA_TOKENS, NUM_PATTERN


def _null_double() -> Column:
    return F.lit(None).cast("double")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Value -> double; text that is not a plain number -> NULL.

    Strings are guarded by NUM_PATTERN first because Spark's cast accepts
    forms such as '1d', '0.5f' or 'nan' that must count as non-numeric.
    Booleans become 1.0 / 0.0, other numeric types are widened."""
    c = _col(c)
    if dtype is None or isinstance(dtype, T.StringType):
        s = c.cast("string")
        return F.when(s.rlike(NUM_PATTERN), F.trim(s).try_cast("double"))
    return c.cast("double")


def fill_missing(c: str | Column) -> Column:
    """NULL and NaN -> 0.0."""
    return F.coalesce(F.nanvl(_col(c), _null_double()), F.lit(0.0))


def clip01(c: str | Column) -> Column:
    """Clip to [0, 1]; NULL and NaN count as 0 so that NaN never
    reaches a comparison (Spark orders NaN above every number)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), fill_missing(c)))


def clean_score(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """P1 -> P2 -> P3."""
    return clip01(coerce_numeric(c, dtype))


def is_missing(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Value the reader treats as missing (NULL, NaN, NA token)."""
    c = _col(c)
    if dtype is None or isinstance(dtype, T.StringType):
        return c.isNull() | c.cast("string").isin(NA_TOKENS)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_non_numeric(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Present but not coercible to a number."""
    return ~is_missing(c, dtype) & coerce_numeric(c, dtype).isNull()


def is_out_of_range(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """After filling, below 0 or above 1 (infinities included)."""
    filled = fill_missing(coerce_numeric(c, dtype))
    return (filled < 0.0) | (filled > 1.0)
