"""Exact removal of byte strings that occur more than once in a corpus (suffix-array deduplication).

Suffixes that share ``length`` bytes are neighbours in the collection's suffix order. Building that
order for whole documents takes as many rounds as the longest one has bytes, so it is built for
short aligned strings instead, with the same result:

1. Anchors. In every stretch of ``length`` bytes the gram with the smallest hash (the leftmost of
   equals) is an anchor. Equal stretches choose the same anchor, so they meet aligned to it.
2. Segments. An anchor's segment holds the stretches that chose it: at most ``2 * length - GRAM``
   bytes. Equal segments fold into one with a count; anchors that occur once in the corpus are dropped.
3. Column-wise construction. The segments of an anchor are the strings of ``columnbwt``: one symbol
   per segment each round, updating the order and the common prefixes; neighbours that share
   ``length`` bytes are repeats. Segments arrive sorted from shuffle files, in blocks of whole groups.
4. Spans. Repeated stretches go back to their documents, are merged, and their bytes removed.

A group with more than ``max_group`` different segments (a passage in very many contexts) never
comes to one task: its stretches are counted by their hash, with partial sums before the shuffle, first
by cores that sixteen neighbouring stretches share, then one by one where that leaves a doubt.

Null texts are empty; texts under ``length`` bytes keep everything; repeated rows repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchspark.llm.columnbwt import NONE, repeated_windows
from matchspark.llm.common import discard, materialize, slices

GRAM = 32
MAX_GROUP = 16_384
#: Bytes of text whose grams are hashed at once, and segments whose order is built at once.
TEXT_BLOCK = 1 << 20
SEGMENT_BLOCK = 8192
#: Neighbouring stretches that are first checked by their common core.
CORE_STEP = 16
_PLACE = 24  # bits of a place inside a block of text

_TABLE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(6).integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram of ``GRAM`` bytes, by doubling."""
    h, size = _TABLE[data], 1
    for k in range(GRAM.bit_length() - 1):
        h = h[:len(h) - size] * _ODD[k] + h[size:]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= _ODD[7]
    return h ^ (h >> np.uint64(32))


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts that stand in a row and end at ``ends``: places, gram hashes, and the bytes around.

    The stretches that chose an anchor start next to each other; the bytes around it are how many lie
    before it in the first of them and from it on to the end of the last.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    keys = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | place
    least = window_minimum(keys, length - GRAM + 1)
    start = np.arange(len(least))
    start = start[start + length <= ends[np.searchsorted(ends, start, side="right")]]
    chosen = (least[start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen)) - 1 if len(first) else first
    at = chosen[first]
    return at, h[at], at - start[first], start[last] + length - at


def text_blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Blocks of about ``TEXT_BLOCK`` bytes: which text each piece is of, its offset there, and the bytes.

    A text longer than a block is cut into pieces that overlap so that no stretch is lost.
    """
    which, offset, parts, size = [], [], [], 0
    limit = max(TEXT_BLOCK, 4 * length)
    for i, text in enumerate(texts):
        for a in range(0, max(len(text) - length + 1, 1), limit - length + 1):
            piece = text[a:a + limit]
            if len(piece) < length:
                continue
            if size + len(piece) > 2 * limit:
                yield which, offset, parts
                which, offset, parts, size = [], [], [], 0
            which.append(i)
            offset.append(a)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield which, offset, parts


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(key, at, gram, segment, before, from_on) of every anchor; ``docs`` holds (key, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        names = ["key", "at", "gram", "segment", "before", "after"]
        for batch in batches:
            for part in slices(batch):
                keys = part.column(0).to_numpy()
                texts = part.column(1).to_pylist()
                for which, offset, parts in text_blocks(texts, length):
                    sizes = np.array([len(p) for p in parts], np.int64)
                    ends = np.cumsum(sizes)
                    row = b"".join(parts)
                    places, grams, before, after = anchors(np.frombuffer(row, np.uint8), ends, length)
                    piece = np.searchsorted(ends, places, side="right")
                    owner = np.array(which, np.int64)[piece]
                    at = places - (ends - sizes)[piece] + np.array(offset, np.int64)[piece]
                    segments = [xxh64_intdigest(row[p - b:p + a], b) for p, b, a in zip(
                        places.tolist(), before.tolist(), after.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[owner]), pa.array(at), pa.array(grams.view(np.int64)),
                         pa.array(np.array(segments, np.uint64).view(np.int64)),
                         pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))], names)

    return docs.mapInArrow(run, "key long, at long, gram long, segment long, before int, after int")


def packed(docs: DataFrame) -> DataFrame:
    """(key, id, packed): whole texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch):
                data = [pack(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())],
                                                 ["key", "id", "packed"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("key", "id", "data").mapInArrow(run, f"key long, id {kind}, packed binary")


def cut_segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, segment, copies, before, bytes, large) of the ``wanted`` segments, from one text that holds each."""
    lists = wanted.groupBy("one.key").agg(F.collect_list(F.struct(
        "one.at", "one.before", "one.after", "gram", "segment", "copies", "large")).alias("wanted"))
    joined = packed(docs).join(lists, "key").select("packed", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        names = ["gram", "segment", "copies", "before", "bytes", "large"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
        for batch in batches:
            for part in slices(batch):
                rows = []
                for data, places in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = unpack(data)
                    for p in places:
                        piece = text[p["at"] - p["before"]:p["at"] + p["after"]]
                        if (xxh64_intdigest(piece, p["before"]) ^ p["segment"]) & (2**64 - 1) == 0:  # the right text
                            rows.append((p["gram"], p["segment"], p["copies"], p["before"], piece, p["large"]))
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return joined.mapInArrow(run, "gram long, segment long, copies long, before int, bytes binary, large boolean")


def _runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of flagged starts as covered bytes, relative to the anchor."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    shift = length - GRAM
    return [(int(a) - shift, int(b) - 1 - shift + length) for a, b in zip(edge[::2], edge[1::2])]


def repeats_of_groups(segments: DataFrame, length: int) -> DataFrame:
    """(gram, segment, lo, hi): repeated bytes relative to the anchor, from whole groups of segments."""
    dealt = segments.repartition("gram").sortWithinPartitions("gram", "segment")
    names = ["gram", "segment", "lo", "hi"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        width = 2 * length - GRAM
        columns = np.full((len(rows), width), NONE, np.int16)
        for i, (_, _, _, before, data, *_) in enumerate(rows):
            a = length - GRAM - before
            columns[i, a:a + len(data)] = np.frombuffer(data, np.uint8)
        gram = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        copies = np.array([r[2] for r in rows], np.int64)
        found = repeated_windows(np.ascontiguousarray(columns.T), group, copies, length)
        out = [(r[0], r[1], lo, hi) for i, r in enumerate(rows) if found[:, i].any()
               for lo, hi in _runs(found[:, i], length)]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    if held and row[:2] == held[-1][:2]:
                        continue  # the same segment, cut from a repeated row
                    if len(held) >= SEGMENT_BLOCK and row[0] != held[-1][0]:
                        yield solve(held)
                        held = []
                    held.append(row)
        if held:
            yield solve(held)

    return dealt.mapInArrow(run, "gram long, segment long, lo long, hi long")


def repeats_by_count(segments: DataFrame, length: int) -> DataFrame:
    """The same as ``repeats_of_groups`` by counting stretches: for groups too large for one task."""
    shift = length - GRAM
    start = F.col("before") - shift  # where a stretch that starts `c` columns after the first one starts
    rows = segments.dropDuplicates(["gram", "segment"])

    def inside(first, size):
        return (start + first >= 0) & (start + first + size <= F.length("bytes"))

    def piece(first, size):
        return F.xxhash64(F.substring("bytes", start + first + 1, size))

    ranges = F.sequence(F.lit(0), F.lit(shift), F.lit(CORE_STEP))
    core_size = length - CORE_STEP + 1
    cores = (rows.withColumn("r", F.explode(ranges))
             .withColumn("core", F.when(inside(F.col("r") + CORE_STEP - 1, F.lit(core_size)),
                                        piece(F.col("r") + CORE_STEP - 1, F.lit(core_size)))))
    # a core cut off by an end of the text, or shared with another segment, leaves a doubt
    shared = (cores.where("core is not null").groupBy("gram", "r", "core").agg(F.sum("copies").alias("n"))
              .where("n > 1").select("gram", "r", "core", F.lit(True).alias("shared")))
    doubt = cores.join(shared, ["gram", "r", "core"], "left").where("shared or core is null")
    stretches = (doubt.withColumn("c", F.explode(F.sequence(F.col("r"), F.least(F.col("r") + CORE_STEP - 1, F.lit(shift)))))
                 .where(inside(F.col("c"), F.lit(length)))
                 .select("gram", "segment", "copies", "c", piece(F.col("c"), F.lit(length)).alias("w")))
    twice = stretches.groupBy("gram", "c", "w").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    return stretches.join(twice, ["gram", "c", "w"], "left_semi").select(
        "gram", "segment", (F.col("c") - shift).cast("long").alias("lo"), (F.col("c") - shift + length).cast("long").alias("hi"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   max_group: int = MAX_GROUP) -> DataFrame:
    """(``id_col``, n_bytes, spans, kept) of every row: the removed runs as byte offsets and the bytes that stay."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).alias("id"), data.alias("data"))
    keyed = keyed.withColumn("key", F.xxhash64("id", "data"))
    everything = materialize(anchor_rows(keyed.select("key", "data"), length), "anchors")
    twice = materialize(everything.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    found = materialize(everything.join(twice, "gram", "left_semi"), "repeated")
    discard(everything)
    distinct = found.groupBy("gram", "segment").agg(
        F.count("*").alias("copies"), F.min(F.struct("key", "at", "before", "after")).alias("one"))
    distinct = materialize(distinct, "segments")
    groups = distinct.groupBy("gram").agg((F.count("*") > max_group).alias("large"))
    cut = materialize(cut_segments(keyed, distinct.join(groups, "gram")), "cut")
    repeats = repeats_of_groups(cut.where("not large"), length)
    if not cut.where("large").isEmpty():
        repeats = repeats.unionByName(repeats_by_count(cut.where("large"), length))
    repeats = materialize(repeats, "repeats")
    discard(cut)
    spans = found.join(repeats, ["gram", "segment"]).groupBy("key").agg(
        F.collect_set(F.struct((F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("hi")).alias("b"))).alias("spans"))
    joined = packed(keyed).join(spans, "key", "left").select("id", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                kept, sizes, cut = [], [], []
                for data, raw in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    text = unpack(data)
                    runs = merged([(s["a"], s["b"]) for s in raw or []])
                    edges = [0, *[x for r in runs for x in r], len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    sizes.append(len(text))
                    cut.append([{"a": a, "b": b} for a, b in runs])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(cut, kind), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "spans", "kept"])

    kind = keyed.schema["id"].dataType.simpleString()
    return joined.mapInArrow(
        run, f"id {kind}, n_bytes long, spans array<struct<a: long, b: long>>, kept binary").withColumnRenamed("id", id_col)
