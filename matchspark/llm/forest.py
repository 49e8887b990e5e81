"""Near pairs of fingerprints that share a bucket, found inside tasks and joined to components.

Members of a bucket are cut into blocks of at most ``BLOCK``, and a task holds one block of fingerprints at a time. It
walks the near graph of the block breadth first: each fingerprint is compared with those not yet reached, so a group of
near copies is settled by its first members, and every pair that ends up in two components has been compared. Only the
links of that walk leave the task, at most one for each member.

A bucket of several blocks is settled across them: first one member of each component found so far stands for it, then
the blocks that still hold different components meet two by two, pairs inside a component left out. So no pair of a
bucket is lost, whatever its size, and a bucket of copies costs work in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from matchspark.llm import editwalk
from matchspark.llm.buckets import joined
from matchspark.llm.common import discard, materialize

#: Members of a bucket that one task compares at once.
BLOCK = 8192


def _near(at: int, others: np.ndarray, base: np.ndarray, samples: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``others`` are at least ``threshold`` alike to ``at``, as of ``editwalk.likeness``."""
    scale = np.maximum(base[at], base[others])
    own, their = scale - base[at], scale - base[others]
    fits = (own < editwalk.SCALES) & (their < editwalk.SCALES)
    others, own, their = others[fits], own[fits], their[fits]
    x, y = samples[at, own], samples[others, their]
    some = np.count_nonzero(x | y, axis=1)
    equal = some - np.count_nonzero(x != y, axis=1)
    return others[(some > 0) & (equal / np.maximum(some, 1) >= threshold)]


def walk(prints: list[bytes], labels: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(u, v, start): near pairs of places that join all near labels; ``start`` is where their component began."""
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
    base, samples = raw[:, 0].astype(np.int64), raw[:, 1:].reshape(-1, editwalk.SCALES, editwalk.SAMPLES)
    alone = len(np.unique(labels)) == len(labels)
    open_ = np.ones(len(prints), bool)
    links = []

    def take(place: int) -> list[int]:
        if alone:
            open_[place] = False
            return [place]
        same = np.flatnonzero(labels == labels[place])
        open_[same] = False
        return same.tolist()

    for start in range(len(prints)):
        if not open_[start]:
            continue
        queue = take(start)
        for u in queue:  # grows while it is walked
            rest = np.flatnonzero(open_)
            if not len(rest):
                return links
            for v in _near(u, rest, base, samples, threshold).tolist():
                if open_[v]:
                    links.append((u, v, start))
                    queue += take(v)
    return links


def _found(groups: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) and what they join (x, y) in every group of ``groups`` (bucket, part, node, label)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            bucket, part = held["bucket"].to_numpy(), held["part"].to_numpy()
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            if len(cuts):
                yield links_of(held.slice(0, int(cuts[-1])), cuts)
                held = held.slice(int(cuts[-1])).combine_chunks()
        if held is not None:
            yield links_of(held, np.array([len(held)]))

    def links_of(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        node, label, raw = rows["node"].to_numpy(), rows["label"].to_numpy(), rows["print"].to_pylist()
        out, first = [], 0
        for end in ends.tolist():
            _, at = np.unique(node[first:end], return_index=True)  # a member may repeat
            at = at + first
            if len(at) > 1:
                found = walk([raw[i] for i in at], label[at], threshold)
                out += [(node[at[u]], node[at[v]], label[at[v]], label[at[s]]) for u, v, s in found]
            first = end
        ends_ = np.array(out, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (
            ends_[:, :2].min(axis=1), ends_[:, :2].max(axis=1), ends_[:, 2].copy(), ends_[:, 3].copy())], ["a", "b", "x", "y"])

    dealt = groups.join(prints, "node").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    found = dealt.select("bucket", "part", "node", "label", "print").mapInArrow(run, "a long, b long, x long, y long")
    return materialize(found.distinct(), "links")


def near_links(members: DataFrame, prints: DataFrame, threshold: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that join all near pairs sharing a bucket, and their components (node, root).

    ``members``: (bucket, node), repeats allowed; ``prints``: (node, print) of every node. No members give no rows.
    """
    def parts(order: list[str]):
        return F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1) / block).cast("long")

    w = Window.partitionBy("bucket").orderBy("node")
    met = members.select("bucket", "node", F.lag("node").over(w).alias("before"), F.lead("node").over(w).alias("after"),
                         parts(["node"]).alias("part"))
    kept = met.where((F.coalesce("before", "node") != F.col("node")) | (F.coalesce("after", "node") != F.col("node")))
    shared = materialize(kept.select("bucket", "node", "part"), "shared")
    links = _found(shared.withColumn("label", F.col("node")), prints, threshold)
    roots = joined(links.select(F.col("x").alias("a"), F.col("y").alias("b")), None)
    wide = materialize(shared.join(shared.where("part > 0").select("bucket").distinct(), "bucket").select("bucket", "node"), "wide")
    discard(shared)
    if not wide.isEmpty():
        for across in (_for_components, _for_blocks):
            labelled = materialize(wide.join(roots, "node", "left").select(
                "bucket", "node", F.coalesce("root", "node").alias("label")), "labelled")
            mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
            new = _found(across(labelled.join(mixed.select("bucket"), "bucket"), parts), prints, threshold)
            both = materialize(links.unionByName(new).distinct(), "links")
            roots = joined(new.select(F.col("x").alias("a"), F.col("y").alias("b")), roots)
            for done in (labelled, links, new):
                discard(done)
            links = both
    discard(wide)
    return links.select("a", "b").distinct(), roots


def _for_components(labelled: DataFrame, parts) -> DataFrame:
    """One member of each component of a bucket."""
    each = labelled.groupBy("bucket", "label").agg(F.min("node").alias("node"))
    return each.select("bucket", "node", "label", parts(["node"]).alias("part"))


def _for_blocks(labelled: DataFrame, parts) -> DataFrame:
    """Every two blocks of a bucket, or one, that hold different components."""
    dealt = materialize(labelled.withColumn("block", parts(["label", "node"])), "dealt")
    ends = dealt.groupBy("bucket", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = ends.toDF("bucket", "block2", "low2", "high2")
    two = ends.join(other, "bucket").where("block <= block2 AND least(low, low2) < greatest(high, high2)")
    each = two.select("bucket", F.col("block").alias("i"), F.col("block2").alias("j"),
                      F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return dealt.join(each, ["bucket", "block"]).select(
        "bucket", "node", "label", (F.col("i") * F.lit(1 << 31) + F.col("j")).alias("part"))
