"""Table cleaning: text, ids, missing values, duplicates, time cuts, account filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from matchspark.functions import enums
from matchspark.functions.numbers import clip, int_or_null
from matchspark.operators.quantiles import quantile
from matchspark.operators.topk import first_per_key
from matchspark.schemas import MEDIAN_COLUMNS, NULLABLE_KEYS, TABLES


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "id" in c.lower()]


def number_columns(df: DataFrame) -> list[str]:
    ids = set(id_columns(df))
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ids]


def replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """All replacements in one projection."""
    return df.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in df.columns],
                     *[e.alias(c) for c, e in changes.items() if c not in df.columns])


def strip_text(df: DataFrame) -> DataFrame:
    return replace(df, {c: F.trim(F.col(c)) for c in text_columns(df)})


def coerce_ids(df: DataFrame) -> DataFrame:
    """Every id column as a whole number; unreadable ids become null."""
    return replace(df, {c: int_or_null(F.col(c)) for c in id_columns(df)})


def drop_invalid_ids(df: DataFrame, name: str = "") -> DataFrame:
    """Event and bridge tables need all their keys; other tables only must have one id left."""
    spec = TABLES.get(name)
    required = [c for c in (spec.required_ids if spec else ()) if c in df.columns]
    if required:
        return df.dropna(how="any", subset=required)
    ids = [c for c in id_columns(df) if c not in NULLABLE_KEYS]
    return df.dropna(how="all", subset=ids) if ids else df


def blank_to_null(df: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    return replace(df, {c: F.nullif(F.col(c), F.lit("")) for c in text_columns(df) if c not in ignored})


def impute(df: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    """Median for ratings and years, 0 for other numbers, ``unknown`` for text; ids stay null."""
    numbers = number_columns(df)
    changes = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in text_columns(df)
               if c not in ignored and c not in id_columns(df)}
    for c in numbers:
        if c in MEDIAN_COLUMNS:
            median = quantile(df, c, 0.5)
            changes[c] = F.coalesce(F.col(c).cast("double"), median, F.lit(0.0))
        else:
            changes[c] = F.coalesce(F.col(c), F.lit(0))
    return replace(df, changes)


def normalize_experience_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Canonical words plus a ``{column}_num`` code."""
    changes: dict[str, Column] = {}
    for c in [c for c in columns if c in df.columns]:
        changes[c] = enums.normalize_experience(F.col(c))
        changes[f"{c}_num"] = enums.experience_num(enums.normalize_experience(F.col(c)))
    return replace(df, changes) if changes else df


def drop_duplicates(df: DataFrame, name: str) -> DataFrame:
    """One row per business key. The kept row is the first by time, then by the other columns."""
    spec = TABLES.get(name)
    key = list(spec.key) if spec else []
    if not key or not set(key) <= set(df.columns):
        return df
    rest = [c for c in ([spec.time] if spec.time else []) if c in df.columns and c not in key]
    rest += [c for c in df.columns if c not in key and c not in rest]
    return first_per_key(df, key, [F.col(c).asc_nulls_last() for c in rest] or [F.lit(1)])


def filter_by_time(df: DataFrame, column: str, limit: Column) -> DataFrame:
    """Rows up to ``limit``; rows without a time go, a table without the column stays whole."""
    if column not in df.columns:
        return df
    return df.where(F.col(column).cast("timestamp") <= limit.cast("timestamp"))


def clean_table(df: DataFrame, name: str) -> DataFrame:
    """The per-table cleaning steps in their fixed order."""
    spec = TABLES.get(name)
    ignored = spec.keep_null if spec else ()
    out = drop_invalid_ids(coerce_ids(strip_text(df)), name)
    out = blank_to_null(out, ignored)
    out = normalize_experience_columns(out, spec.experience if spec else ())
    return impute(drop_duplicates(out, name), ignored)


def validate_feedback(df: DataFrame) -> DataFrame:
    """Unknown sentiment becomes neutral, unreadable ratings go, ratings are bounded to 1..5."""
    out = df
    if "sentiment" in df.columns:
        label = enums.word(F.col("sentiment"))
        known = label.isin("positive", "neutral", "negative")
        out = out.withColumn("sentiment", F.when(known, label).otherwise(F.lit("neutral")))
    if "rating" in df.columns:
        rating = F.col("rating").try_cast("double")
        out = out.withColumn("rating", clip(rating, 1.0, 5.0)).where(F.col("rating").isNotNull())
    return out


def active_programs(df: DataFrame) -> DataFrame:
    """Open, available and not past the deadline (0/1 program features)."""
    return df.where((F.col("is_open") == 1) & (F.col("is_available") == 1) & (F.col("deadline_passed") == 0))


def without_alerted(applications: DataFrame) -> DataFrame:
    return applications.where(F.coalesce(enums.word(F.col("status")) != "alerted", F.lit(True)))


def safe_accounts(recs: DataFrame, profile: DataFrame, key: str = "mentor_id") -> DataFrame:
    """Drop recommendations of inactive, deleted, banned or suspended accounts.

    Only the flags the profile has are applied; they combine into one semi and one anti join.
    """
    must, never = [], []
    if "is_active" in profile.columns:
        must.append(F.col("is_active") == 1)
    if "account_status" in profile.columns:
        must.append(enums.word(F.col("account_status")) == "active")
    for c in ("is_deleted", "is_banned"):
        if c in profile.columns:
            never.append(F.col(c) == 1)
    ids = F.col("user_id").alias(key)
    out = recs
    if must:
        allowed = must[0]
        for cond in must[1:]:
            allowed = allowed & cond
        out = out.join(profile.where(allowed).select(ids), key, "left_semi")
    if never:
        barred = never[0]
        for cond in never[1:]:
            barred = barred | cond
        out = out.join(profile.where(barred).select(ids), key, "left_anti")
    return out
