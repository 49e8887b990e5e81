"""Set similarity over sorted id arrays. A missing array counts as the empty set."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_set(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<bigint>"))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(as_set(a), as_set(b)))


def size0(a: Column) -> Column:
    return F.when(a.isNull(), 0).otherwise(F.size(a))


def jaccard_from(overlap: Column, left: Column, right: Column) -> Column:
    """Jaccard from the overlap and both sizes; 0 when either side is empty."""
    return F.when((left > 0) & (right > 0), overlap / (left + right - overlap).cast("double")).otherwise(0.0)


def coverage_from(overlap: Column, left: Column) -> Column:
    """Share of the left set that is covered; 0 when it is empty."""
    return F.when(left > 0, overlap / left.cast("double")).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_from(shared(a, b), size0(a), size0(b))


def coverage(a: Column, b: Column) -> Column:
    return coverage_from(shared(a, b), size0(a))


def covers_all(a: Column, b: Column) -> Column:
    """1 when every element of ``a`` is in ``b`` and neither is empty."""
    return F.when((size0(a) > 0) & (size0(b) > 0) & (shared(a, b) == size0(a)), 1).otherwise(0)


def extra_count(a: Column, b: Column) -> Column:
    """Elements of ``b`` beyond ``a``; 0 when either is empty."""
    return F.when((size0(a) > 0) & (size0(b) > 0), size0(b) - shared(a, b)).otherwise(0)


def match_type(a: Column, b: Column) -> Column:
    """2 when ``b`` is larger, 1 when equally large, 0 when smaller or either is empty."""
    both = (size0(a) > 0) & (size0(b) > 0)
    return F.when(both & (size0(b) > size0(a)), 2).when(both & (size0(b) == size0(a)), 1).otherwise(0)


def parse_set_text(c: Column) -> Column:
    """Text such as ``{1, 2}`` or ``[1, 2]`` back to a sorted id array; unreadable text is empty."""
    inner = F.regexp_replace(F.trim(c), r"^[\[\{\(]\s*|\s*,?\s*[\]\}\)]$", "")
    parts = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.trim(p).try_cast("bigint"))
    listed = F.trim(c).rlike(r"^[\[\{\(].*[\]\}\)]$")
    return F.when(listed & (F.length(inner) > 0), F.array_sort(F.array_distinct(F.array_compact(parts)))) \
        .otherwise(F.array().cast("array<bigint>"))
