"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2`` bits apart share a point at most one bit from each. So every distinct
fingerprint emits itself and its 64 one-bit variants; the shuffle brings equal variants together,
neighbours within a variant become links, and a bit count verifies them. A variant meets at most 65
distinct fingerprints, whatever the data: copies have been folded into one fingerprint before.
Linked fingerprints are joined to components by contraction.

Null and empty texts have no words and fingerprint zero, linked like any other. Repeated rows and
ties fold into one fingerprint. Null ids are kept; a component's id is its smallest non-null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from matchspark.llm.common import lower_hex, materialize, slices, texts_of
from matchspark.llm.components import components

#: Byte value to eight byte lanes, lane j holding bit j: sums of up to 255 hashes fit a lane.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    pad = -len(lanes) % 255
    if pad:
        lanes = np.concatenate([lanes, np.zeros((pad, 8), np.uint64)])
    sums = lanes.reshape(-1, 255, 8).sum(axis=1)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included.

    Only A-Z are lower-cased; words end at the ASCII white space; fewer words than a shingle form one.
    """
    from xxhash import xxh64_intdigest as xxh

    words = text.encode().lower().split()  # bytes: exactly the ASCII rules
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxh(whole, seed)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    return np.fromiter([xxh(whole[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())],
                       np.uint64, n)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit set if set in over half the shingles' XXH64, repeats included."""
    hashes = shingle_hashes(text, shingle, seed)
    bits = (2 * bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(``id_col``, fp long) of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, shingle) for t in texts_of(part, 1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["id", "fp"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def links(distinct_fps: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect all fingerprints two or fewer bits apart. Input: distinct ``fp``."""
    fp = F.col("fp")
    ball = F.array(fp, *[fp.bitwiseXOR(F.lit(bit).cast("long"))
                         for bit in [1 << k for k in range(63)] + [-(1 << 63)]])
    met = distinct_fps.select("fp", F.explode(ball).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (met.select(before.alias("a"), F.col("fp").alias("b"))
            .where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
            .distinct())


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                           shingle: int = 3) -> DataFrame:
    """(``id_col``, fp, fingerprint, component_id) of every row of ``docs``."""
    fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    label = components(links(nodes.select("fp")))
    first = nodes.join(label, nodes["fp"] == label["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # the smallest id of a root, then handed to its fingerprints and rows
    ids = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = first.join(ids, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(id_col, "fp", lower_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id, all its columns unchanged.

    Rows without id are compared too; a group of such rows only keeps one per distinct text. Repeated
    rows fold into one.
    """
    kept = classes.select(F.col("component_id").alias("__kept")).distinct()
    return (docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")
            .dropDuplicates([id_col, text_col]))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3) -> DataFrame:
    """One document of each group stays, as of ``keep_first``."""
    return keep_first(docs, near_duplicate_classes(docs, id_col=id_col, text_col=text_col, shingle=shingle), id_col, text_col)
