"""Identifiers: name-based UUIDs, dense numbers for UUID text, per-source namespaces."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from matchspark.functions.numbers import int_or_null
from matchspark.operators.topk import range_index

USER_COLUMNS = ("user_id", "mentee_id", "mentor_id", "follower_id", "following_id")
CANONICAL = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), nibble % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def _keyed(kind: str, c: Column) -> Column:
    number = int_or_null(c)
    return F.when(number.isNotNull(), uuid5(F.concat(F.lit(f"mentorship.{kind}."), number.cast("string"))))


def user_uuid(c: Column) -> Column:
    return _keyed("user", c)


def session_uuid(c: Column) -> Column:
    return _keyed("session", c)


def feedback_uuid(*parts: Column) -> Column:
    """UUID of the non-empty parts joined by dots; null when every part is empty."""
    texts = [F.trim(p.cast("string")) for p in parts]
    kept = [F.when(~t.isin("", "nan", "NaN", "None"), t) for t in texts]
    key = F.concat_ws(".", *kept)
    return F.when(key != "", uuid5(F.concat(F.lit("mentorship.feedback."), key)))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(CANONICAL), F.lit(False))


def uuid_or_null(c: Column) -> Column:
    return F.when(is_uuid(c), F.lower(c.cast("string")))


def namespaced_int(raw: Column, source_file: Column, step: int = 10_000_000) -> Column:
    """Ids of the second source file are shifted so that both files fit one table."""
    base = int_or_null(raw)
    return F.when(F.lower(F.coalesce(source_file, F.lit(""))).contains("mentorship"), base + step).otherwise(base)


def uuid_numbers(tables: dict[str, DataFrame]) -> DataFrame:
    """Dense numbers 1..n for every non-numeric user id in any table, ordered by the id text.

    The numbering is spread over even ranges of the ids that there are, so it has no single-task sort.
    """
    found = None
    for df in tables.values():
        for c in df.columns:
            if c.lower() in USER_COLUMNS:
                one = df.select(F.trim(F.col(c).cast("string")).alias("uuid"))
                found = one if found is None else found.union(one)
    ids = found.where((F.col("uuid") != "") & F.col("uuid").try_cast("bigint").isNull()).distinct()
    return range_index(ids, ["uuid"], "user_number")


def replace_uuids(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """Every user id column as a number: mapped where the text is a known id, cast otherwise."""
    for c in [c for c in df.columns if c.lower() in USER_COLUMNS]:
        lookup = numbers.select(F.col("uuid").alias("_uuid"), F.col("user_number").alias("_number"))
        text = F.trim(F.col(c).cast("string"))
        df = df.join(lookup, text == F.col("_uuid"), "left").withColumn(
            c, F.coalesce("_number", text.try_cast("bigint"))).drop("_uuid", "_number")
    return df


def restore_uuids(df: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """Numbers back to ids; a number without an id stays as text."""
    lookup = numbers.select(F.col("user_number").alias("_number"), F.col("uuid").alias("_uuid"))
    return df.join(lookup, F.col(column) == F.col("_number"), "left").withColumn(
        column, F.coalesce("_uuid", F.col(column).cast("string"))).drop("_uuid", "_number")
