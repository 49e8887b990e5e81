"""Exact quantiles that never hold a column in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. Here values
are counted first, then spread over ranges that rise with the value (4096 per power of two), and
only the ranges that contain a wanted rank are sorted. Interpolation is linear between ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

STEPS = 4096


def _range(value: Column) -> Column:
    """A whole number that never falls when ``value`` rises; close values share one."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    place = (power + 1100) * STEPS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * place).cast("bigint")


def quantiles_long(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Rows (``name``, ``prob``, ``value``, ``total``); nulls are ignored, ``total`` counts the rest."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    values = (
        df.selectExpr(f"stack({len(columns)}, {pairs}) AS (name, value)")
        .where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
        .select("name", "value", "n", _range(F.col("value")).alias("range"))
    )
    upto = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("upto").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    rank = F.least(F.floor("pos") + F.col("side"), F.col("total") - 1)
    wanted = (
        values.groupBy("name", "range").agg(F.sum("n").alias("size"))
        .select("name", "range", "size", F.sum("size").over(upto).alias("upto"))
        .select("name", "range", "size", "upto", last.alias("total"))
        .select("name", "range", "size", "upto", "total", asked)
        .select("*", (F.col("prob") * (F.col("total") - 1)).alias("pos"),
                F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        .select("name", "range", "prob", "pos", "side", "total", "size", "upto", rank.alias("rank"))
        .where("rank >= upto - size AND rank < upto")
        .select("name", "range", "prob", "total", (F.col("pos") - F.floor("pos")).alias("share"), "side",
                (F.col("rank") - F.col("upto") + F.col("size")).alias("local"))
    )
    inside = Window.partitionBy("name", "range", "prob", "side").orderBy("value")
    hits = (
        values.join(F.broadcast(wanted), ["name", "range"])
        .select("name", "prob", "total", "share", "side", "value", "n", "local", F.sum("n").over(inside).alias("seen"))
        .where("local >= seen - n AND local < seen")
    )
    low = F.max(F.when(F.col("side") == 0, F.col("value")))
    high = F.max(F.when(F.col("side") == 1, F.col("value")))
    return hits.groupBy("name", "prob").agg(
        (low + (high - low) * F.max("share")).alias("value"), F.max("total").alias("total"))


def quantiles_wide(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row: ``{column}_q{percent}`` for every column and probability."""
    out = []
    for c in columns:
        for p in probs:
            cond = (F.col("name") == c) & (F.col("prob") == float(p))
            out.append(F.max(F.when(cond, F.col("value"))).alias(f"{c}_q{p * 100:g}".replace(".", "_")))
    return quantiles_long(df, columns, probs).agg(*out)


def quantile(df: DataFrame, column: str, prob: float) -> Column:
    """One exact quantile as a scalar, usable like a literal."""
    return quantiles_long(df, [column], [prob]).select("value").scalar()
