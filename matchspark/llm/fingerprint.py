"""Document fingerprints by randomised edit embedding, with bit-sampled banding and verification.

Null texts are empty; equal texts have equal fingerprints; very long texts cost steps in proportion.
Ties in the order of ids go by a hash of the text; rows without id come last. Empty tables give none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchspark.llm import editwalk, forest
from matchspark.llm.common import discard, materialize, release, slices, texts_of

#: Bytes of text walked at once: long texts cost many steps, which many texts share.
WALK_BYTES = 12 << 20
BANDS, ROWS = 16, 4
_PICKS = np.random.default_rng(3).random((BANDS, ROWS))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_chars, fingerprint) of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, WALK_BYTES):
                texts = texts_of(part, 1)
                prints = editwalk.embed([editwalk.classes(t) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([p.hex() for p in prints])],
                    ["id", "n_chars", "fingerprint"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def with_successor(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and the next text's.

    The next document is the one with the next smaller id (after the last: the first). Documents are
    dealt by ranges of ids in one shuffle; each range also gets the first document of the next one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(source.approxQuantile("id", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges)))
    range_of = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("id")))
        if cuts else F.lit(0)).cast("int")
    tops = sorted(source.groupBy(range_of.alias("range")).agg(F.max("id").alias("top")).collect(), reverse=True)
    if not tops:
        return spark.createDataFrame([], "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double"
                                     ).withColumnRenamed("id", id_col)
    before = {tops[(i + 1) % len(tops)]["top"]: tops[i]["range"] for i in range(len(tops))}
    target = F.lit(None).cast("int")
    for top, place in before.items():  # one entry per range
        target = F.when(F.col("id").eqNullSafe(F.lit(top)), F.lit(place)).otherwise(target)
    is_top = F.col("id").isin([t for t in before if t is not None])
    heads = (source.where(is_top | F.col("id").isNull() if None in before else is_top)
             .groupBy("id").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
             .select(target.alias("range"), F.lit(1).alias("head"), "id", "m.h", "m.text"))
    rows = source.select(range_of.alias("range"), F.lit(0).alias("head"), "id", F.xxhash64("text").alias("h"), "text")
    dealt = (rows.unionByName(heads).repartition(n_ranges, "range")
             .sortWithinPartitions("range", "head", F.col("id").desc_nulls_last(), F.desc("h"), F.desc("text"))
             .select("head", "id", "text"))
    id_type = pa.int64() if source.schema["id"].dataType.simpleString() == "bigint" else None

    def walk(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last; a row marked as head only serves the one before it."""
        texts = [editwalk.classes(t) for _, _, t in rows]
        own = [i for i in range(len(rows) - 1) if not rows[i][0]]
        new = [_edited(rows[i][2], rows[i + 1][2]) for i in own]
        prints = editwalk.embed(texts + [editwalk.classes(t) for t in new])
        edited = prints[len(texts):]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in own], id_type),
            pa.array([len(rows[i][2]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array([prints[i].hex() for i in own], pa.string()),
            pa.array([p.hex() for p in edited], pa.string()),
            pa.array([editwalk.likeness(prints[i], p) for i, p in zip(own, edited)], pa.float64()),
            pa.array([editwalk.likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
        ], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    held.append(row)
                    size += len(row[2])
                    if size > WALK_BYTES and len(held) > 1:
                        yield walk(held)
                        held, size = held[-1:], len(row[2])
        if len(held) > 1:
            yield walk(held)

    kind = source.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double"
                            ).withColumnRenamed("id", id_col)


def _floor(scale: int) -> int:
    """Samples of a scale that every text of that scale, longer than half its characters, fills at least."""
    return int((editwalk.steps_of(scale) <= 1 << scale - 1).sum())


def band_keys(raw: bytes, threshold: float) -> list[bytes]:
    """Keys of a fingerprint; alike ones share most keys of the scale of the longer text.

    At a scale a fingerprint fills its first samples, and the fills of two differ by the threshold at most
    if they are alike. Fills fall into classes of that ratio; each fingerprint emits the keys of its class
    and of the one below, sampled from the bytes that all of a class have filled.
    """
    keys = []
    for s in range(editwalk.SCALES):
        at, scale = 1 + s * editwalk.SAMPLES, raw[0] + s
        fill = editwalk.SAMPLES - raw.count(0, at, at + editwalk.SAMPLES)
        if not fill or s and fill + 1e-9 < threshold * _floor(scale):
            continue  # too short to be near a text of that scale
        own = int(math.log(fill) / -math.log(threshold) + 1e-9)
        for c in range(max(own - 1, 0), own + 1):
            width = min(fill, math.ceil(threshold ** -c - 1e-9))
            for b, rows in enumerate((_PICKS * width).astype(int).tolist()):
                keys.append(bytes([scale, c, b, *[raw[at + r] for r in rows]]))
    return keys


def near_classes(prints: DataFrame, threshold: float = 0.8, block: int = forest.BLOCK) -> DataFrame:
    """(fingerprint, leader, n_links): fingerprints connected by pairs at least ``threshold`` alike.

    Distinct fingerprints are banded by ``band_keys``, near pairs of every band verified and linked
    (``forest``), links joined to components; a class's smallest fingerprint is its leader. ``n_links``
    counts the verified links of a fingerprint that joined the classes inside its bands.
    """
    distinct = materialize(prints.select(F.unhex("fingerprint").alias("print")).distinct().select(
        F.xxhash64("print").alias("node"), "print"), "prints")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh
        for batch in batches:
            nodes, keys = [], []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = band_keys(raw, threshold)
                nodes += [node] * len(found)
                keys += [xxh(k, 42) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64))],
                                             ["node", "bucket"])

    links, roots = forest.near_links(distinct.mapInArrow(band, "node long, bucket long"), distinct, threshold, block)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = materialize(roots.join(ends, "node").join(distinct, "node"), "linked")
    lead = linked.groupBy("root").agg(F.min("print").alias("lead"))
    return distinct.join(linked.join(lead, "root").select("node", "lead", "n_links"), "node", "left").select(
        F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex(F.coalesce("lead", "print"))).alias("leader"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def with_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``with_successor``, and of every row its class (the smallest id of it) and its links."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col).select(
        F.col(id_col).alias("id"), F.unhex("fingerprint").alias("print")), "prints")
    hexed = prints.select("id", F.lower(F.hex("print")).alias("fingerprint"))
    ids = hexed.groupBy("fingerprint").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    of = materialize(near_classes(hexed).where("n_links > 0 OR leader <> fingerprint").select(
        "fingerprint", "n_links", F.xxhash64("leader").alias("class")), "classes")
    of = ids.join(of, "fingerprint", "left").where("n > 1 OR n_links > 0").select(
        F.xxhash64("fingerprint").alias("__node"), "first_id", "n_links", F.coalesce("class", F.xxhash64("fingerprint")).alias("class"))
    of = materialize(of, "known")
    least = of.groupBy("class").agg(F.min("first_id").alias("class_id"))
    of = materialize(of.join(least, "class").select("__node", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "known")
    discard(prints)
    release(docs.sparkSession)
    out = with_successor(docs, id_col=id_col, text_col=text_col)
    names = out.columns
    return out.withColumn("__node", F.xxhash64("fingerprint")).join(of, "__node", "left").select(
        *names, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
