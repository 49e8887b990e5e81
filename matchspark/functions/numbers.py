"""Numeric column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_double(c: Column) -> Column:
    """Any column as a double; unreadable or missing becomes 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def finite(c: Column) -> Column:
    """Null for NaN and the infinities: NaN counts as more than any number. Short, as dozens of these stand in one row."""
    d = c.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def finite_or_zero(c: Column) -> Column:
    return finite(c).otherwise(F.lit(0.0))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; null stays null (``greatest``/``least`` alone would swallow it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(default))


def flag(cond: Column) -> Column:
    """A condition as 0/1, with null counted as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def percent_text(c: Column) -> Column:
    """``0.834`` as ``83%`` (rounded half to even)."""
    return F.concat(F.bround(c * 100).cast("bigint").cast("string"), F.lit("%"))


def int_or_null(c: Column) -> Column:
    """Text such as ``"3"`` or ``"3.9"`` as a whole number cut towards zero, else null."""
    return finite(c.cast("string").try_cast("double")).try_cast("bigint")


def bit(c: Column) -> Column:
    """``1/true/yes`` as 1, anything else as 0."""
    return flag(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"))


def bool_like(c: Column) -> Column:
    """Boolean vocabulary as 0/1; numbers only when exactly 0 or 1; unexpected values become 0."""
    # fixed values
    true_words = ["1", "t", "true", "yes", "y", "on"]
    text = F.lower(F.trim(c.cast("string")))
    return flag(text.isin(*true_words) | (text.try_cast("double") == 1.0))
