"""Whole-group statistics next to the rows of the group.

Written as aggregate and join instead of an unordered window: the aggregate combines on the map
side and a skewed join partition can be split by AQE, so no task has to hold a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add one column per aggregate expression, computed over the rows sharing ``keys``."""
    totals = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in stats.items()])
    return df.join(totals, list(keys), "left")


def with_list_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """The same for lists that candidate caps bound, as windows: several in a row need one shuffle and one pass.

    Rows with a null key have no list, as in a join.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    group = Window.partitionBy(*keys)
    return df.select("*", *[F.when(known, expr.over(group)).alias(name) for name, expr in stats.items()])


def with_scalars(df: DataFrame, source: DataFrame, **stats: Column) -> DataFrame:
    """Add whole-table aggregates of ``source`` to every row of ``df`` (one scalar subquery)."""
    row = source.agg(F.struct(*[expr.alias(name) for name, expr in stats.items()])).scalar()
    held = df.select("*", row.alias("_scalars"))
    return held.select(*df.columns, *[F.col(f"_scalars.{name}").alias(name) for name in stats])
