"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one node. Candidates come from ball hashing: every node has ``CODES`` SimHash codes of ``CODE_BITS``
bits over its shingles, and two codes at most two bits apart share a variant at most one bit from each. Codes that near
agree in one of three blocks of bits, so they are dealt by a block and the balls over the other bits are built
inside tasks; only variants in which nodes meet leave them. One 64-bit code would miss most near copies: at 0.8 a bit
differs with a probability of 0.15, and all ``CODES`` short codes miss such a pair with one of 0.12, a pair at 0.9 with
one of 1e-4. For those that no ball finds, every node also emits ``BANDS`` keys of ``ROWS`` MinHash values each,
which miss a pair right at 0.8 with (1 - 0.8^5)^32 = 3e-6. Nodes that share a variant or a key meet, and every
pair is verified by the exact similarity of the whole sets before it links. Links are joined to components. Nodes whose
buckets still hold different components after the rounds of leaders meet by their rarest shingles (``rare_pairs``), so
texts around a common passage that are not near are never listed pair by pair.

Null and empty texts have no words and are copies of each other. Rows without id are compared too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from matchspark.llm import buckets
from matchspark.llm.common import discard, materialize, release, slices, texts_of
from matchspark.llm.simhash import keep_first, shingle_hashes

SHINGLE = 5
#: The least similarity as a fraction: whole numbers compare exactly.
NEAR, OF = 4, 5
BANDS, ROWS = 32, 5
#: Three blocks of a code: two codes two bits apart agree in one of them.
CODES, CODE_BITS, BLOCK_BITS = 28, 36, 12
#: Rows of whole deals whose balls are built at once.
BALL_ROWS = 1 << 16
_CHUNK = 1 << 12
_draw = np.random.default_rng(11)
_FACTORS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _draw.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _draw.integers(0, 2**63, -(-CODES * CODE_BITS // 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OWN, _BLOCKS = np.uint64((1 << CODE_BITS) - 1), CODE_BITS // BLOCK_BITS
#: Per block: the code itself and every bit outside the block.
_FLIPS = [np.array([0, *[1 << k for k in range(CODE_BITS) if k // BLOCK_BITS != b]], np.uint64) for b in range(_BLOCKS)]


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as ascending hashes."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(found: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set: equal for a band if all its MinHash values are equal."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(found), _CHUNK):
        np.minimum(least, np.multiply.outer(_FACTORS, found[at:at + _CHUNK]).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def ball_codes(found: np.ndarray) -> np.ndarray:
    """``CODES`` SimHash codes of a set: a bit is 1 if set in over half of its hashes."""
    if not len(found):
        return np.zeros(0, np.int64)
    counts, step = np.zeros(64 * len(_SPREAD), np.int64), 255 * (_CHUNK // 255)
    for at in range(0, len(found), step):
        words = _mixed(np.multiply.outer(found[at:at + step], _SPREAD))
        ones = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").view(np.uint64)  # sums of 255 fit a byte
        sums = np.add.reduceat(ones, np.arange(0, len(words), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, len(counts)).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(found))[:CODES * CODE_BITS].reshape(CODES, CODE_BITS)
    return bits @ (np.int64(1) << np.arange(CODE_BITS, dtype=np.int64))


def ball_members(deal: np.ndarray, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, node) of every variant in which nodes of a deal meet; whole deals, a node once in each.

    A deal is a code's place and a block with its bits; a bucket is a code's place and a variant, whatever the block.
    """
    group = (deal >> BLOCK_BITS).astype(np.uint64)  # place of the code and block
    order = np.lexsort((code, group))
    group, code, node = group[order], code[order].astype(np.uint64), node[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (code[1:] != code[:-1]))) if len(code) else order
    sizes = np.diff(np.append(first, len(code)))
    buckets, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def meet(variants: np.ndarray, kinds: np.ndarray) -> None:
        """The nodes of ``kinds`` (places in ``first``) in their variants."""
        many = sizes[kinds]
        at = np.repeat(first[kinds] - np.cumsum(many) + many, many) + np.arange(many.sum())
        buckets.append(np.repeat(variants, many))
        nodes.append(node[at])

    for block, flips in enumerate(_FLIPS):
        kinds = np.flatnonzero(group[first] % np.uint64(_BLOCKS) == block)
        own = (group[first[kinds]] // np.uint64(_BLOCKS) << np.uint64(CODE_BITS)) | code[first[kinds]]
        same = sizes[kinds] > 1
        meet(own[same], kinds[same])
        variants = (own[:, None] ^ flips).ravel()
        order = np.argsort(variants, kind="stable")
        variants, owner = variants[order], kinds[order // len(flips)]
        equal = variants[1:] == variants[:-1]
        shared = np.append(equal, False) | np.append(False, equal) if len(variants) else equal
        meet(variants[shared], owner[shared])
    return _mixed(np.concatenate(buckets) * _SPREAD[0]).view(np.int64), np.concatenate(nodes)


def balls(codes: DataFrame) -> DataFrame:
    """The (bucket, node) of nodes that share a variant of a code; ``codes`` holds (node, codes), a node once."""
    code, place = F.col("code"), F.col("place") * _BLOCKS
    deals = F.array(*[((place + b) * (1 << BLOCK_BITS) + F.shiftright(code, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
                      .cast("int") for b in range(_BLOCKS)])
    dealt = codes.select("node", F.posexplode("codes").alias("place", "code")).select(F.explode(deals).alias("deal"), "node", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solved(parts: list[np.ndarray]) -> pa.RecordBatch:
            bucket, node = ball_members(*parts)
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node)], ["bucket", "node"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(p[0]) for p in held) >= BALL_ROWS:
                rows = [np.concatenate(c) for c in zip(*held)]
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last deal may go on
                held = [[c[whole:].copy() for c in rows]]
                for part in _whole_deals([c[:whole] for c in rows]):
                    yield solved(part)
        if held:
            for part in _whole_deals([np.concatenate(c) for c in zip(*held)]):
                yield solved(part)

    return dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "bucket long, node long").distinct()


def _whole_deals(rows: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Cut rows sorted by deal into parts of about ``BALL_ROWS`` that hold whole deals."""
    at = 0
    while at < len(rows[0]):
        last = rows[0][min(at + BALL_ROWS, len(rows[0])) - 1]
        end = int(np.searchsorted(rows[0], last, side="right"))
        yield [c[at:end] for c in rows]
        at = end


def parity(found: np.ndarray) -> np.ndarray:
    """256 bits, each whether an odd number of the hashes fall on it: two sets differ in as many hashes as bits at least."""
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may(a: Column, b: Column) -> Column:
    """True for every near pair: sizes and parities allow the similarity."""
    differ = sum((F.bit_count(a[f"p{i}"].bitwiseXOR(b[f"p{i}"])) for i in range(4)), F.lit(0))
    return ((F.least(a["size"], b["size"]) * OF >= F.greatest(a["size"], b["size"]) * NEAR)
            & (differ * (OF + NEAR) <= (a["size"] + b["size"]) * (OF - NEAR)))


def rare_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, node2) of different roots, every near pair among them: prefix filtering over whole sets.

    Near sets share NEAR / OF of the larger one, so of two sets in one common order the first
    ``size - ceil(size * NEAR / OF) + 1`` hashes share one. The order puts hashes of a single root first, which need not
    meet at all, then the rarest; from the first shared hash on both sets must have enough hashes left.
    ``rest``: (node, root, fact), a node once; ``sets``: (node, found).
    """
    each = rest.join(sets, "node").select("node", "root", F.explode("found").alias("token"))
    across = each.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    own = each.join(across.where("low < high").select("token", "n"), "token").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
    need = F.floor((F.col("fact.size") * NEAR + (OF - 1)) / OF).cast("int")
    keep = F.greatest(F.size("own") - need + 1, F.lit(0))
    first = materialize(own.join(rest, "node").where(keep > 0).select(
        "node", "root", "fact", F.size("own").alias("many"), F.posexplode(F.slice("own", F.lit(1), keep)).alias("at", "t")).select(
        "node", "root", "fact", (F.col("many") - F.col("at")).alias("left"), F.col("t.token").alias("token")), "prefixes")
    other = first.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "fact", "left")])
    enough = F.least("left", "left2") * (OF + NEAR) >= (F.col("fact.size") + F.col("fact2.size")) * NEAR
    return first.join(other, (first["token"] == other["token"]) & (first["node"] < other["node2"])
                      & (first["root"] != other["root2"]) & enough & _may(first["fact"], other["fact2"])).select("node", "node2")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``id_col``, node, component_id) of every row: near copies and what they connect have one component."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("same"), text.alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, shingle) for t in texts_of(part, 2)]
                bits = np.array([parity(s) for s in sets], np.int64).reshape(-1, 4)
                nodes = np.array([xxh(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()),
                     *[pa.array(bits[:, i]) for i in range(4)], pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                     pa.array([ball_codes(s) for s in sets], pa.list_(pa.int64()))],
                    ["id", "same", "node", "size", "p0", "p1", "p2", "p3", "keys", "codes"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([shingle_set(t, shingle).view(np.int64) for t in texts_of(part, 1)],
                                              pa.list_(pa.int64()))], ["node", "found"])

    kind = source.schema["id"].dataType.simpleString()
    rows = materialize(source.mapInArrow(
        sketch, f"id {kind}, same long, node long, size long, p0 long, p1 long, p2 long, p3 long, keys array<long>, codes array<long>"), "sketches")
    kinds = materialize(rows.groupBy("node").agg(F.min("same").alias("same"), *[
        F.first(c).alias(c) for c in ("size", "p0", "p1", "p2", "p3", "keys", "codes")]), "kinds")
    found = materialize(balls(kinds.select("node", "codes")), "balls")
    release(docs.sparkSession)
    members = buckets.shared(kinds.select(F.explode("keys").alias("bucket"), "node").unionByName(found))
    nodes = kinds.join(members.select("node").distinct(), "node", "left_semi")
    nodes = materialize(nodes.select("node", "same", F.struct("size", "p0", "p1", "p2", "p3").alias("fact")), "nodes")
    for done in (kinds, found):
        discard(done)
    # one text per hash first: the join that follows finds it where it lies
    firsts = source.groupBy("same").agg(F.first("text").alias("text"))
    sets = materialize(firsts.join(nodes.select("node", "same"), "same").select("node", "text")
                       .mapInArrow(hashed, "node long, found array<long>"), "sets")
    release(docs.sparkSession)

    def verify(pairs: DataFrame) -> DataFrame:
        return (pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
                .join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
                .where(F.size(F.array_intersect("x", "y")).cast("long") * (OF + NEAR)
                       >= (F.size("x").cast("long") + F.size("y")) * NEAR).select("a", "b"))

    _, label = buckets.near_links(members, nodes, verify, _may, lambda rest: rare_pairs(rest, sets))
    for done in (members, nodes, sets):
        discard(done)
    first = rows.groupBy("node").agg(F.min("id").alias("first_id")).join(label, "node", "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select(F.col("id").alias(id_col), "node").join(
        first.join(ids, "root").select("node", "component_id"), "node").select(id_col, "node", "component_id")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each group stays, as of ``simhash.keep_first``."""
    return keep_first(docs, classes(docs, id_col=id_col, text_col=text_col, shingle=shingle), id_col, text_col)
