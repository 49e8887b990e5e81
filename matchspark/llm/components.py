"""Connected components by contraction, for edges too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchspark.llm.common import discard, materialize


def nearest(edges: DataFrame, turn: int) -> DataFrame:
    """(node, to): what each node of the edges (a, b) joins in a turn, the smallest hash among its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("n"))
    return both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.first(order("a")))["n"].alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): nodes with edges, equal roots within a component. ``edges``: (a, b) of longs.

    Every round, each node joins the neighbour (or itself) with the smallest hash of that round and
    the edges are rewritten to the joined nodes; a fresh hash each round makes a chain shrink by a
    constant share, so rounds grow with the logarithm. Minima combine before the shuffle, so a node
    with many neighbours is no hot key; joins on it are splittable. Every round is written to the
    shared folder, so a lost executor repeats one round.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    found = None
    turn = 0
    while not edges.isEmpty():
        joins = materialize(nearest(edges, turn), "joins")
        fewer = materialize(
            edges.join(joins.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(joins.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges")
        if found is None:
            new = joins.select("node", F.col("to").alias("root"))
        else:
            new = found.join(joins.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root"))
        new = materialize(new, "roots")
        for done in (edges, joins, *([found] if found is not None else [])):
            discard(done)
        edges, found = fewer, new
        turn += 1
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
