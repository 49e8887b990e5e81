"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Each vector gets a binary code, cut into 16-bit substrings; every block of the index holds one table
per substring. By the pigeonhole principle a code within Hamming radius r of a query agrees with it
in some substring up to r // m bits, so each table is probed in that ball - by listing the flipped
keys or by scanning the table's distinct keys, whichever are fewer - and all codes within r are
found. Their original vectors are then scored in double precision.

The radius of a query follows from its score against a bounded sample of the index: the k-th best of
the sample is a lower bound of the k-th best of all rows. Rotations, slack and that bound are the only
things a sample decides; every row is indexed. Rows below that bound can't be among the k best and are
not handed on; a query left with fewer than k is asked again without radius and bound.

Blocks: rows are dealt by a hash of their id and content, queries in blocks; each pair of blocks is
one task's work and returns its k best per query, so hot vectors and copies spread over all blocks.
Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do those whose
length differs from the most frequent one. Ties go to the smaller id; rows with the query's own id
are no candidates. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from matchspark.llm.binarycodes import Codes, distances, learn
from matchspark.llm.common import materialize

SAMPLE_ROWS = 4096
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
_BITS = 16


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, with ``v`` an array of doubles."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _balls(radius: int) -> np.ndarray:
    """All flips of a 16-bit key with at most ``radius`` bits."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << _BITS, dtype=np.uint32)) <= radius).astype(np.uint16)


class Tables:
    """One table per substring: distinct keys and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for k in range(codes.shape[1]):
            order = np.argsort(codes[:, k], kind="stable")
            keys, first = np.unique(codes[order, k], return_index=True)
            self.tables.append((keys, np.append(first, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` bits of ``code``: probe every table, then check in full."""
        m = len(self.tables)
        near = radius // m
        hit = np.zeros(len(self.codes), bool)
        for k, (keys, first, order) in enumerate(self.tables):
            ball = self.ball(near)
            if len(ball) < len(keys):
                probes = ball ^ code[k]
                at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
                at = at[keys[at] == probes]
            else:
                at = np.flatnonzero(np.bitwise_count(keys ^ code[k]) <= near)
            if len(at):
                counts = first[at + 1] - first[at]
                ends = np.cumsum(counts)
                hit[order[np.arange(ends[-1]) + np.repeat(first[at] - (ends - counts), counts)]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(code[None, :], self.codes[rows])[0] <= radius]

    _cache: dict[int, np.ndarray] = {}

    def ball(self, near: int) -> np.ndarray:
        if near not in self._cache:
            self._cache[near] = _balls(near)
        return self._cache[near]


def best_of_block(index_ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, radius: np.ndarray,
                  bound: np.ndarray, codes: Codes, k: int) -> pd.DataFrame:
    """The k best of one block of the index for every query of one block, as far as they reach its bound."""
    tables = Tables(codes.of_rows(x))
    q_codes = codes.of_queries(q)
    out = {"query_id": [], "vec_id": [], "score": []}
    for i, qid in enumerate(query_ids):
        rows = tables.within(q_codes[i], int(radius[i]))
        rows = rows[index_ids[rows] != qid]
        if not len(rows):
            continue
        scores = x[rows] @ q[i]
        rows, scores = rows[scores >= bound[i]], scores[scores >= bound[i]]
        best = np.lexsort((index_ids[rows], -scores))[:k]
        out["query_id"].append(np.full(len(best), qid))
        out["vec_id"].append(index_ids[rows[best]])
        out["score"].append(scores[best])
    if not out["query_id"]:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                             "score": pd.Series(dtype="float64")})
    return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id",
           vector_col: str = "embedding", bits: int = 128, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the largest inner product found.

    ``sample_rows`` bounds what the codes and the radii are learned from; ``bits`` is a multiple of 16.
    A query without k found in its radius is asked again with the whole range as radius.
    """
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    asked = materialize(usable(queries, id_col, vector_col).dropDuplicates(["id"]), "queries")
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], empty)
    n_queries = asked.count()
    order = F.xxhash64(F.col("id"), F.col("v"))
    drawn = rows.orderBy(order).limit(sample_rows)
    sample = np.array([r["v"] for r in drawn.select("v").collect()])
    codes = learn(sample, float(np.sqrt(stats["square"])) * (1 + 1e-12), bits)
    index_blocks = max(1, -(-stats["n"] // BLOCK_ROWS))
    query_blocks = max(1, -(-n_queries // BLOCK_QUERIES))

    def radii(batches):
        for pdf in batches:
            q = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, sample.shape[1]))
            scores = q @ sample.T
            kth = min(k, len(sample) - 1)
            bound = -np.partition(-scores, kth, axis=1)[:, kth]  # one more than k: the query may be in the sample
            reach = np.linalg.norm(q, axis=1) * codes.longest
            radius = codes.radius(bound / reach)
            if len(sample) <= k:
                radius, bound = np.full(len(q), codes.bits), np.full(len(q), -np.inf)
            yield pdf.assign(radius=np.asarray(radius, np.int64), bound=bound - 1e-9 * reach)

    def dealt(df, blocks, name):
        return df.withColumn(name, F.pmod(order, F.lit(blocks)).cast("int"))

    def ask(asked_with_radius: DataFrame) -> DataFrame:
        left = dealt(rows, index_blocks, "part").select(
            "part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"), "id", "v")
        right = dealt(asked_with_radius, query_blocks, "block").select(
            F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("part"), "block", "id", "v", "radius", "bound")

        def run(key, a, b):
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return best_of_block(a["id"].to_numpy(), np.stack(a["v"].to_numpy()), b["id"].to_numpy(),
                                 np.stack(b["v"].to_numpy()), b["radius"].to_numpy(), b["bound"].to_numpy(), codes, k)

        found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(
            run, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")

    first = materialize(ask(asked.mapInPandas(radii, "id long, v array<double>, radius long, bound double")), "found")
    reach = min(k, stats["n"] - 1)
    full = first.groupBy("query_id").count().where(F.col("count") >= reach)
    short = asked.join(full, asked["id"] == full["query_id"], "left_anti")
    if short.isEmpty():
        return first
    again = ask(short.withColumn("radius", F.lit(codes.bits).cast("long")).withColumn("bound", F.lit(float("-inf"))))
    return first.join(full.select("query_id"), "query_id", "left_semi").unionByName(again)
