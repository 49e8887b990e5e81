"""Grouped and global top-k, ordered numbering and bounded lists.

``row_number() <= k`` becomes a window group limit in the plan: every task prunes its own rows to k
per group before the shuffle, so one hot group never travels whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchspark.session import materialize


def grouped_topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                 rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group. ``order`` should end in an id so that ties are decided."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def global_topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of the table (a take-ordered plan, no full sort)."""
    return df.orderBy(*order).limit(k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, chosen by ``order``."""
    return grouped_topk(df, keys, order, 1)


def bounded_list(df: DataFrame, column: str, order: Sequence[Column], k: int) -> Column:
    """The first ``k`` values of a table as one array literal (at most ``k`` entries)."""
    top = global_topk(df, order, k).select(column)
    return top.agg(F.collect_list(column)).scalar()


def attach_list(df: DataFrame, values: Column, name: str) -> DataFrame:
    """Every row of ``df`` with every entry of a bounded list."""
    return df.withColumn(name, F.explode(values))


def range_index(df: DataFrame, order: Sequence[str], name: str = "idx", ranges: int | None = None) -> DataFrame:
    """Consecutive numbers 1..n in the order of distinct rows, whatever their values have in common.

    Bounds come from a sample of the rows, so ranges are even also where all ids share a prefix. Rows are written with
    the range they fell into (a repeated task must not draw other bounds), numbered inside it and shifted by the sizes
    of the ranges before it, one row per range.
    """
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_pos", place).join(F.broadcast(shifts), "_range").withColumn(
        name, F.col("_pos") + F.col("_shift")).drop("_range", "_pos", "_shift")


def dense_index(df: DataFrame, bucket: Column, order: Sequence[Column], name: str = "idx",
                groups: Sequence[str] = ()) -> DataFrame:
    """Consecutive numbers 1..n in a total order (per group), without sorting everything in one task.

    ``bucket`` must rise with the order and take a bounded number of values. Rows are numbered inside
    their bucket, then shifted by the size of the buckets before it.
    """
    groups = list(groups)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*groups, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_pos", F.row_number().over(inside))
        .join(shifts, [*groups, "_bucket"])
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_bucket", "_pos", "_shift")
    )
