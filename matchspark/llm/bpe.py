"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The words of a slice of documents form a corpus of distinct words. An inverted index leads from each
mergeable pair to its positions in that corpus; merges are replayed in rank order, and each merge
touches only the positions of its own pair and their two neighbours. Words already replayed by a
task are remembered (bounded), so a frequent word is replayed once per task and not once per use.

Documents never leave their partition: no shuffle, and a lost task repeats its own slice only.
Null texts are empty; empty texts give no ids; very long words cost n log n.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from matchspark.llm.common import SLICE_BYTES, slices, texts_of

#: Remembered pieces of a task; beyond that the memory is emptied. Bounds memory, not results.
REMEMBERED_PIECES = 150_000
#: White space next to white space (or at an end): only then does a word depend on its neighbours.
_LOOSE_SPACE = re.compile(r"\s\s").search


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """The ranks of a file: which two tokens join, and the bytes of every token."""

    def __init__(self, path: str):
        ranks = self.ranks = read_ranks(path)
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must count from 0 without a gap")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # every way to put a token together from two others
        joins = np.array([(ranks[t[:i]] * len(ranks) + ranks[t[i:]]) << 20 | rank for t, rank in ranks.items()
                          for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int64)
        joins.sort()
        self.keys = joins >> 20
        self.joined = (joins & ((1 << 20) - 1)).astype(np.int32)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens form, or -1."""
        key = a.astype(np.int64) * len(self.ranks) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], -1)


class Tokens:
    """The bytes of every token, in a row."""

    def __init__(self, path: str):
        ranks = read_ranks.__wrapped__(path)  # not kept: decoding needs the bytes only
        ordered = sorted(ranks, key=ranks.__getitem__)
        self.blob = np.frombuffer(b"".join(ordered), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in ordered])])

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens in a row, and where each token ends."""
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        ends = np.cumsum(size)
        at = np.repeat((start - (ends - size)).astype(np.int32), size)  # a slice holds less than 2 GB
        at += np.arange(len(at), dtype=np.int32)
        return self.blob[at], ends


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def _kept_of_chains(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping places (each other's neighbours), every second from the left: the leftmost goes first."""
    touch = np.concatenate([[False], after[places[:-1]] == places[1:]])
    if not touch.any():
        return places
    at = np.arange(len(places))
    start = np.maximum.accumulate(np.where(touch, 0, at))
    return places[(at - start) % 2 == 0]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each word has.

    All words stand in one row of symbols. ``index`` leads from a rank to the positions whose pair
    has that rank; the lowest rank is replayed at all its positions at once, and only the pairs with
    the neighbours of a merged position are looked up anew. A word in which a merge makes a lower
    rank possible than the one being replayed is done again alone, one merge at a time.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    sym = vocabulary.single[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    n = len(sym)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends - 1] = -1
    before[ends - sizes] = -1
    whole = np.array([vocabulary.ranks.get(w, -1) for w in words], np.int64)
    rank_at = np.full(n, -1, np.int32)
    inner = np.flatnonzero((after >= 0) & (whole[owner] < 0)).astype(np.int32)
    rank_at[inner] = vocabulary.join(sym[inner], sym[inner + 1])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(places: np.ndarray) -> None:
        places = places[rank_at[places] >= 0]
        order = np.argsort(rank_at[places], kind="stable")
        places = places[order]
        ranks = rank_at[places]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        bounds = [*starts.tolist(), len(places)]
        for rank, a, b in zip(ranks[starts].tolist(), bounds, bounds[1:]):
            if rank not in index:
                heappush(heap, rank)
                index[rank] = []
            index[rank].append(places[a:b])

    add(inner)
    again: set[int] = set()
    while heap:
        rank = heappop(heap)
        places = np.concatenate(index.pop(rank))
        places = np.sort(places[rank_at[places] == rank])
        places = _kept_of_chains(places[np.diff(places, prepend=-1) > 0], after)
        if not len(places):
            continue
        gone = after[places]
        right = after[gone]
        sym[places], sym[gone], rank_at[gone] = rank, -1, -1
        after[places] = right
        before[right[right >= 0]] = places[right >= 0]
        left = before[places]
        some = right >= 0
        rank_at[places] = -1
        rank_at[places[some]] = vocabulary.join(sym[places[some]], sym[right[some]])
        some = left >= 0
        rank_at[left[some]] = vocabulary.join(sym[left[some]], sym[places[some]])
        fresh = np.concatenate([places, left[some]])
        lower = fresh[(rank_at[fresh] >= 0) & (rank_at[fresh] < rank)]
        if len(lower):
            again.update(owner[lower].tolist())
        add(fresh)
    alive = sym >= 0
    counts = np.bincount(owner[alive], minlength=len(words))
    is_whole = whole >= 0
    if not again and not is_whole.any():
        return sym[alive], counts
    ids = np.split(sym[alive], np.cumsum(counts)[:-1])
    for w in np.flatnonzero(is_whole).tolist():
        ids[w] = whole[w:w + 1]
    for w in again:
        ids[w] = one_by_one(words[w], vocabulary)
    return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))


def one_by_one(word: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """Ids of one word, merging the leftmost pair of lowest rank until none is left."""
    ids = vocabulary.single[np.frombuffer(word, np.uint8)]
    while len(ids) > 1:
        ranks = vocabulary.join(ids[:-1], ids[1:])
        if ranks.max() < 0:
            break
        k = int(np.where(ranks < 0, len(vocabulary.ranks), ranks).argmin())
        ids = np.concatenate([ids[:k], ranks[k:k + 1], ids[k + 2:]])
    return ids


class Encoder:
    """Texts to ids; remembers the pieces of text it has replayed, as little-endian 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.find = regex.compile(pattern).findall
        self.letters_are_words = r" ?\p{L}+" in pattern
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Stretches of a text that are split alike on their own: at single spaces if all are single."""
        if not text or text[0].isspace() or text[-1].isspace() or "\0" in text or _LOOSE_SPACE(text):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, four bytes each."""
        cut = [self.pieces(t) for t in texts]
        here = set().union(*cut)
        if len(self.known) > REMEMBERED_PIECES:  # what this slice uses is likely to be used again
            self.known = {p: self.known[p] for p in here & self.known.keys()}
        # a run of letters, with one blank before it or none, is one match of the pattern
        plain, found = [], {}
        for p in here - self.known.keys():
            if self.letters_are_words and (p.isalpha() or p[:1] == " " and p[1:].isalpha()):
                plain.append(p)
            else:
                found[p] = self.find(p)
        words = list(set(plain).union(*found.values()))
        ids_of = {}
        if words:
            ids, counts = replay([w.encode() for w in words], self.vocabulary)
            flat, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
            ids_of = {w: flat[a:b] for w, a, b in zip(words, [0, *ends], ends)}
        for p in plain:
            self.known[p] = ids_of[p]
        for p, its_words in found.items():
            self.known[p] = b"".join(map(ids_of.__getitem__, its_words))
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for pieces in cut:  # a whole text that could not be cut is not worth remembering
            if len(pieces) == 1:
                self.known.pop(pieces[0], None)
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    """The encoder of this worker process; the tasks it runs one after the other share its memory."""
    return Encoder(vocabulary_of(path), pattern)


def _encoded(part: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
    """(id, ids) of a slice of (id, text)."""
    ids = encoder.encode(texts_of(part, 1))
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "ids"])


def _decoded(part: pa.RecordBatch, tokens: Tokens) -> pa.RecordBatch:
    """(id, ids, bytes) of a slice of (id, ids)."""
    ids = part.column(1)
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    data, ends = tokens.bytes_of(ids.flatten().to_numpy(zero_copy_only=False))
    last = np.cumsum(sizes)
    ends = np.concatenate([[0], ends])[np.concatenate([[0], last])].astype(np.int32)
    decoded = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([part.column(0), ids, decoded], ["id", "ids", "bytes"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source, source.schema["id"].dataType.simpleString()


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row (``id_col``, ids) per document, in no order. ``vocabulary`` is a path on every executor."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    source, kind = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _encoded(part, encoder_of(vocabulary, pattern))

    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids",
           vocabulary: str | None = None) -> DataFrame:
    """Adds ``bytes``: the ids' tokens in a row. Null ids give no bytes; an unknown id is an error."""
    vocabulary = vocabulary or default_vocabulary()
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES // 2):
                yield _decoded(part, tokens_of(vocabulary))

    kind = source.schema["id"].dataType.simpleString()
    return (source.mapInArrow(run, f"id {kind}, ids array<int>, bytes binary")
            .withColumnsRenamed({"id": id_col, "ids": ids_col}))


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one pass: (``id_col``, ids, bytes) per document, in no order.

    One Python process per task does both halves, so a task holds one slice and the ids never travel
    between two processes. The bytes come from the ids alone.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    source, kind = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for coded in slices(_encoded(part, encoder_of(vocabulary, pattern)), SLICE_BYTES // 2):
                    yield _decoded(coded, tokens_of(vocabulary))

    return source.mapInArrow(run, f"id {kind}, ids array<int>, bytes binary").withColumnRenamed("id", id_col)
