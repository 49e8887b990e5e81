"""Exact best-k partners by a score that grows with the number of shared tokens.

The full pair table of a popular token is never formed. A pair can be one of the k best of its left
row in three ways, and each way needs a bounded number of candidates:

* it shares nothing: only the score of the right row counts, so the k best of a short list per
  class are enough (``idle``);
* it shares exactly one token: right rows with that token that look alike to the score form one
  posting list; its first k members are enough, because every member ahead of the pair scores at
  least as much (extra shared tokens only help);
* it shares two or more: the candidates of the first two ways give each left row a floor, the value
  of its k-th best so far. A right class tells how many tokens a pair must share to reach it, and
  with that many needed only a few of the rarest tokens have to be looked up (``reaching_pairs``), or rows meet
  in blocks, and then the first two ways need only give a floor.

Right rows that are alike in every respect (copies) are cut to k per kind before the last join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from matchspark.operators.bitmaps import common as bitmaps_share, numbered_tokens, packed, words_of
from matchspark.operators.blockscores import best_in_blocks
from matchspark.operators.topk import attach_list, grouped_topk

#: Values this close to a floor count as reaching it: lists compare scores at nine digits.
SLACK = 1e-8


def bridge(df: DataFrame, key: str, element: str) -> DataFrame:
    """A clean two-column bridge table: no nulls, no repeats."""
    return df.select(key, element).dropna().distinct()


def as_sets(bridge_df: DataFrame, key: str, element: str, name: str) -> DataFrame:
    """Bridge rows to one sorted array per key. Elements come from a taxonomy, which bounds the array."""
    return bridge(bridge_df, key, element).groupBy(key).agg(
        F.array_sort(F.collect_list(element)).alias(name))


def posting_lists(left_tokens: DataFrame, right_tokens: DataFrame, *, token: Sequence[str], left_key: Sequence[str],
                  list_key: Sequence[str], list_order: Sequence[Column], rank: Callable[[DataFrame], Sequence[Column]],
                  k: int) -> DataFrame:
    """The ``k`` best right rows of every (token, left key): lists of ``k`` rows per (token, list key), ranked once per left key."""
    lists = grouped_topk(right_tokens, [*token, *list_key], list_order, k)
    offered = left_tokens.select(*token, *left_key).distinct().join(lists, list(token))
    return grouped_topk(offered, [*token, *left_key], rank(offered), k)


def posting_candidates(left_tokens: DataFrame, right_tokens: DataFrame, *, left_id: str, right_id: str,
                       token: Sequence[str], left_key: Sequence[str], list_key: Sequence[str],
                       list_order: Sequence[Column], rank: Callable[[DataFrame], Sequence[Column]],
                       k: int) -> DataFrame:
    """Pairs sharing one token with what they share, at most ``k`` per (token, left key).

    Posting lists keep ``k`` rows per (token, ``list_key``). They are ranked once per distinct
    (token, ``left_key``) and only then handed to the left rows, so the work per list does not grow
    with the number of left rows that share it.
    """
    token = list(token)
    best = posting_lists(left_tokens, right_tokens, token=token, left_key=left_key, list_key=list_key,
                         list_order=list_order, rank=rank, k=k)
    return left_tokens.select(left_id, *token, *left_key).join(
        best.select(*token, *left_key, right_id, *list_key), [*token, *left_key])


def reaching_pairs(left: DataFrame, left_tokens: DataFrame, right: DataFrame, right_tokens: DataFrame, *, left_id: str,
                   right_id: str, classes: Sequence[str], tops: Sequence[Column], floor: DataFrame,
                   reach: Callable[[Column], Column], part_rows: int = 20_000, exact: dict | None = None) -> DataFrame:
    """Pairs sharing two or more tokens that can still reach the floor of their left row.

    ``reach(o)`` is the best value a left row can get from a right row of a class by sharing ``o``
    tokens; it must not fall with ``o``. It may use the columns of ``left``, the ``classes`` (bounded
    by the taxonomy: levels, domains, set sizes) and the ``tops`` of a class (aggregates of ``right``).
    ``floor`` holds (left_id, _floor), the value of the k-th best pair known; rows without one ask
    for everything.

    Per class the floor gives the least number of tokens to share. A pair sharing that many of n
    tokens shares one of any n - least + 1, so only the rarest so many of the left row are looked up.
    The lookup of a token with more than ``part_rows`` right rows is split by a hash of the right id. Both sides
    carry their tokens as bitmaps, so a pair that meets knows at once how many tokens it shares, and only pairs whose
    own number reaches the floor leave the join.

    Where sets are dense no lookup prunes: with ``exact`` (the arguments of ``best_in_blocks``, with the true score) rows
    meet the classes that can reach their floor in blocks, and the pairs found are the best of each block by that score.
    """
    if exact is not None:
        counted = left.join(left_tokens.groupBy(left_id).agg(F.count("*").alias("_tokens")), left_id).join(floor, left_id, "left")
        if classes:
            kinds = right.groupBy(*classes).agg(*tops)
            entries = kinds.agg(F.collect_list(F.struct(*kinds.columns))).scalar()
            counted = attach_list(counted, entries, "_class").select("*", "_class.*").where(
                F.col("_floor").isNull() | (reach(F.col("_tokens")) >= F.col("_floor") - SLACK))
        return best_in_blocks(counted, right, left_id=left_id, right_id=right_id, classes=classes, **exact)
    places = numbered_tokens(right_tokens.select("token"))
    words = words_of(places)
    left = left.select([f.name for f in left.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))])
    own = [c for c in left.columns if c != left_id]
    common = right_tokens.groupBy("token").agg(F.count("*").alias("_n"))
    rare = left_tokens.select(left_id, "token").join(common, "token").groupBy(left_id).agg(
        F.array_sort(F.collect_set(F.struct("_n", "token"))).alias("_rare")).where(F.size("_rare") > 1)
    kinds = right.groupBy(*classes).agg(*tops)
    entries = kinds.agg(F.collect_list(F.struct(*kinds.columns))).scalar()
    tops_of = [c for c in kinds.columns if c not in classes]
    maps = packed(left_tokens, left_id, places, words).withColumnRenamed("map", "_l_map")
    offered = attach_list(left.join(rare, left_id).join(maps, left_id).join(floor, left_id, "left"), entries, "_class").select("*", "_class.*")
    n = F.size("_rare")
    able = F.filter(F.sequence(F.lit(2), n), lambda o: F.col("_floor").isNull() | (reach(o) >= F.col("_floor") - SLACK))
    asks = offered.withColumn("_least", F.get(able, F.lit(0))).where(F.col("_least").isNotNull())
    parts = F.ceil(F.col("_n") / part_rows).cast("int")
    probes = (
        asks.select(left_id, *own, "_l_map", "_floor", *tops_of, *[F.col(c).alias(f"_l_{c}") for c in classes],
                    F.explode(F.slice("_rare", F.lit(1), n - F.col("_least") + 1)).alias("_p"))
        .select("*", "_p.token", "_p._n")
        .select(left_id, *own, "_l_map", "_floor", *tops_of, *[f"_l_{c}" for c in classes], F.col("token").alias("_l_token"),
                F.explode(F.sequence(F.lit(0), parts - 1)).alias("_l_part"))
    )
    index = right_tokens.select(right_id, "token").join(right.select(right_id, *classes), right_id).join(
        packed(right_tokens, right_id, places, words), right_id).join(common, "token").withColumn("part", F.pmod(F.xxhash64(right_id), parts.cast("long")).cast("int"))
    met = (F.col("token") == F.col("_l_token")) & (F.col("part") == F.col("_l_part"))
    for c in classes:
        met = met & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    shared = bitmaps_share(F.col("_l_map"), F.col("map"), words)
    paired = probes.join(index.drop("_n"), met).withColumn("_shared", shared).where("_shared > 1")
    reaching = paired.where(F.col("_floor").isNull() | (reach(F.col("_shared")) >= F.col("_floor") - SLACK))
    return reaching.select(left_id, right_id).distinct()


def floors(best: DataFrame, left_id: str, value: Column, k: int) -> DataFrame:
    """(left_id, _floor): the least value of a best list that is full."""
    return best.groupBy(left_id).agg(F.count("*").alias("_held"), F.min(value).alias("_floor")).where(
        F.col("_held") >= k).select(left_id, "_floor")


def without_copies(right: DataFrame, kind: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most ``k`` right rows of each kind; alike rows tie, so later ones cannot enter a best-k."""
    return grouped_topk(right, list(kind), order, k)
