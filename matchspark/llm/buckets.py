"""Near pairs among rows that share a bucket, joined to components, without losing any to a leader.

In each of a few rounds every node meets one node only: of the leaders of its buckets, a bucket's leader being its
member with the smallest hash of that round, the one with the smallest hash that is not yet in the node's component
and that ``may`` lets through. So a round verifies no more pairs than there are nodes, and a group of near copies is
settled by its first leaders, however many buckets it shares; rounds go on while they find links. Last, the nodes
whose buckets still hold different components go to ``meet``, which finds every near pair between components without
listing the pairs of a bucket, and those are verified. So the components are those of all near pairs of all buckets. Between
rounds a component found so far joins one neighbour only, the leaders' star in most cases; links are joined to the end
once before the last comparison and once after it. Tables of a finished round are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchspark.llm.common import discard, materialize, release
from matchspark.llm.components import components, nearest

#: Rounds of leaders end after so many, or when one finds less than a tenth of the first one's links.
ROUNDS = 4


def shared(members: DataFrame) -> DataFrame:
    """The (bucket, node) of buckets with two or more nodes, in one shuffle. ``members`` may repeat."""
    w = Window.partitionBy("bucket").orderBy("node")
    met = members.select("bucket", "node", F.lag("node").over(w).alias("before"), F.lead("node").over(w).alias("after"))
    kept = met.where((F.coalesce("before", "node") != F.col("node")) | (F.coalesce("after", "node") != F.col("node")))
    return materialize(kept.select("bucket", "node"), "shared")


def joined(links: DataFrame, roots: DataFrame | None, turn: int | None = None) -> DataFrame:
    """``roots`` (node, root) after ``links`` (a, b): joined to the end, or, given a turn, every root to one neighbour at most."""
    if roots is None:
        return components(links)
    between = (links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left")
               .join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
               .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b"))
    joins = components(between) if turn is None else materialize(nearest(between, turn), "joins")
    fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    every = roots.unionByName(fresh.withColumn("root", F.col("node")))
    out = materialize(every.join(joins.toDF("root", "to"), "root", "left").select(
        "node", F.coalesce("to", "root").alias("root")), "roots")
    discard(joins)
    discard(roots)
    return out


def near_links(members: DataFrame, facts: DataFrame, verify: Callable[[DataFrame], DataFrame],
               may: Callable[[Column, Column], Column], meet: Callable[[DataFrame], DataFrame],
               rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) and the components (node, root) of all near pairs sharing a bucket.

    ``members``: distinct (bucket, node) as of ``shared``; ``facts``: (node, fact), fact a struct that ``may``
    reads of both sides; ``verify``: keeps the near ones of distinct pairs (a, b), a < b; ``meet``: of rows (node,
    root, fact), pairs (node, node2) that hold every near pair of different roots.
    """
    spark = members.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    known = facts.select("node", "fact")
    turn, first, last = 0, None, rounds == 0
    while True:
        held = materialize(members.join(known, "node").join(roots, "node", "left").select(
            "bucket", "node", "fact", F.coalesce("root", "node").alias("root")), "held")
        if not last:
            leader = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root", "fact")
            ends = held.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(leader).alias("o"))
            mixed = ends.where("low < high").select("bucket", "o")
            met = held.join(mixed, "bucket").where((F.col("root") != F.col("o.root")) & may(F.col("fact"), F.col("o.fact")))
            pairs = met.groupBy("node").agg(F.min(F.struct("o.h", F.col("o.node").alias("n")))["n"].alias("node2"))
        else:
            w = Window.partitionBy("bucket")
            open_ = held.select("node", "root", "fact", F.min("root").over(w).alias("low"), F.max("root").over(w).alias("high"))
            rest = materialize(open_.where("low < high").select("node", "root", "fact").dropDuplicates(["node"]), "rest")
            pairs = meet(rest)
        pairs = materialize(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct(), "pairs")
        if last:
            discard(rest)
        discard(held)
        new = materialize(verify(pairs).select("a", "b"), "links")
        discard(pairs)
        found = new.count()
        if found:
            both = materialize(links.unionByName(new).distinct(), "links")
            discard(links)
            links, roots = both, joined(new, roots, None if last else turn)
        discard(new)
        if last:
            release(spark)
            return links, roots
        turn, first = turn + 1, found if first is None else first
        last = turn == rounds or found * 10 <= first
        if last and first:
            roots = joined(links, roots)
        release(spark)
