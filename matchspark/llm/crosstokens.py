"""Alignment of two tokenizers over whole texts, by anchors at white space and memoised windows.

Both libraries encode the whole text. Where a token of each ends at the same byte and the next token of each
starts with a space, the text is cut; between two such anchors lies a window, a pair of token-id tuples. How the
tokens of a window overlap depends on its ids alone, so a chunk's distinct id tuples are numbered, each is aligned
once, and all its occurrences look the result up. A text whose tokens do not give back its bytes has no tokens.

How often a pair of ids is linked in the whole corpus: a task handles chunks of a few MB of text and writes, per
chunk, its distinct pairs with their counts and its documents as numbers of the chunk's distinct windows. Pairs
are added up by Spark, their sums joined back to the distinct pairs of each chunk (not to the tokens), and the
chunk's documents are summed over its windows. So no table is broadcast, no row holds more than one chunk, and a
frequent pair gives one row per chunk.

A chunk's distinct words are encoded once: texts are cut before spaces that stand between other characters than white
space, if a tokenizer's file shows that it splits there anyway (byte-level words without normaliser; no piece with a
space after another character); the ids of a text are those of its words in a row. Else whole texts are encoded.

Null and empty texts, and texts that a tokenizer does not give back, have zeros and no groups. Repeated rows and
rows without id are kept one for one; other columns are not read; a very long text is a chunk of its own. An empty
table gives no rows. ``count_sum`` is a long: it holds links times their corpus counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from matchspark.llm.common import materialize, slices, texts_of

#: Bytes of text in a chunk.
CHUNK_BYTES = 2 << 20
#: Words handed to a library at once.
WORDS = 1 << 14
WORDS_IN_A_ROW = 64
_CUT = re.compile(r"(?<=\S)(?= +\S)")
_SPACE = "▁"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _letters_of_bytes() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Words:
    """Texts cut into words: the distinct words, the number of every word, and where each text's words end."""

    def __init__(self, texts: list[str]):
        cut = [_CUT.split(t) for t in texts]
        coded = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        self.number = coded.indices.to_numpy().astype(np.int64)
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.ends = np.cumsum([len(words) for words in cut], dtype=np.int64)


class Tokenizer:
    """The bytes of every token, and whole texts to ids."""

    tokens: list[bytes]
    #: Whether the ids of a text are those of its words in a row.
    by_word: bool

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that carry a leading space."""
        raise NotImplementedError

    def prepare(self) -> None:
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.array([t[:1] == b" " for t in self.tokens])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offset = np.cumsum(self.size) - self.size
        names = [b"%d," % i for i in range(len(self.tokens))]
        self.name_size = np.array([len(n) for n in names], np.int64)
        self.name_offset = np.cumsum(self.name_size) - self.name_size
        self.names = np.frombuffer(b"".join(names), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), WORDS):
            found = self.ids_of(texts[at:at + WORDS])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode_words(self, texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where the ids of each end."""
        if not self.by_word:
            ids, sizes = self.encode(texts)
            return ids, np.cumsum(sizes)
        ids, sizes = self.encode(words.distinct)
        starts = np.cumsum(sizes) - sizes
        ends = np.append(0, np.cumsum(sizes[words.number]))[words.ends]
        return ids[_ranges(starts[words.number], sizes[words.number])], ends


class ByteLevel(Tokenizer):
    """A byte-level vocabulary file; encodes a space and the text, special strings as plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it may use
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        split = said["pre_tokenizer"] or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not said["normalizer"]
        added = {t["id"]: t["content"].encode() for t in said["added_tokens"]}
        letter = _letters_of_bytes()
        entries = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}
        self.tokens = [added.get(i) or bytes(letter[c] for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.prepare()

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As words encode alike in a row, rows of words are handed over, and their tokens dealt out by bytes."""
        if not self.by_word:
            return super().encode(texts)
        rows = [texts[at:at + WORDS_IN_A_ROW] for at in range(0, len(texts), WORDS_IN_A_ROW)]
        # a row must be cut where its words are: none may end in white space
        rows = [r for row in rows for r in ([row] if not any(w[-1].isspace() for w in row) else [[w] for w in row])]
        ids, _ = super().encode(["".join(row) for row in rows])
        token_ends = np.cumsum(self.size[ids])
        word_ends = np.cumsum(np.fromiter((len(w.encode()) for w in texts), np.int64, len(texts)))
        ends = np.searchsorted(token_ends, word_ends) + 1
        if not len(texts) or len(token_ends) and np.array_equal(token_ends[np.minimum(ends, len(ids)) - 1], word_ends):
            return ids, np.diff(ends, prepend=0)
        return super().encode(texts)


class Pieces(Tokenizer):
    """A piece model; it adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = re.compile("<0x([0-9A-F]{2})>")
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any(re.search(f"[^{_SPACE}]{_SPACE}", n) for n in names)
        self.tokens = [bytes([int(raw.fullmatch(n)[1], 16)]) if self.model.is_byte(i) else n.replace(_SPACE, " ").encode()
                       for i, n in enumerate(names)]
        self.prepare()

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


@lru_cache(maxsize=1)
def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, kept by the worker process."""
    return ByteLevel(path_a), Pieces(path_b)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _per(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of stretches that end at ``ends``."""
    return np.diff(np.append(0, np.cumsum(values))[ends], prepend=0)


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of both, values of either) of two rising rows without repeats."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    twice = both[1:] == both[:-1]
    return both[:-1][twice], both[np.append(~twice, np.ones(min(len(both), 1), bool))]


def _gives_back(tok: Tokenizer, ids: np.ndarray, ends: np.ndarray, raw: bytes, raw_ends: np.ndarray) -> np.ndarray:
    """Which texts' tokens join to their bytes."""
    size = tok.size[ids]
    good = _per(size, ends) == np.diff(raw_ends, prepend=0)
    token_good = np.repeat(good, np.diff(ends, prepend=0))
    joined = tok.blob[_ranges(tok.offset[ids[token_good]], size[token_good])]
    whole = np.frombuffer(raw, np.uint8)[np.repeat(good, np.diff(raw_ends, prepend=0))]
    width = np.diff(raw_ends, prepend=0)[good]
    good[np.flatnonzero(good)[_per(joined != whole, np.cumsum(width)) > 0]] = False
    return good


def _kept(ids: np.ndarray, ends: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(ends, prepend=0)
    return ids[np.repeat(good, sizes)], np.cumsum(sizes[good])


class Alignment:
    """Windows laid out in a row and aligned at once: groups between shared ends, links where tokens overlap.

    Every stretch between two neighbouring ends, of either side, is the overlap of one token of each: a link.
    """

    def __init__(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, tok_a: Tokenizer, tok_b: Tokenizer):
        end_a, end_b = np.cumsum(tok_a.size[a]), np.cumsum(tok_b.size[b])
        window_end = end_a[ends_a - 1]
        shared, every = _merged(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, every), np.searchsorted(end_b, every)
        self.pairs = a[at_a].astype(np.int64) << 32 | b[at_b]
        self.link_ends = np.searchsorted(every, window_end) + 1
        group_ends = np.searchsorted(shared, window_end) + 1
        self.groups = np.diff(group_ends, prepend=0)
        self.texts = self._written(a, b, tok_a, tok_b, np.searchsorted(shared, end_a), np.searchsorted(shared, end_b), group_ends)

    @staticmethod
    def _written(a, b, tok_a, tok_b, group_a, group_b, group_ends) -> list[bytes]:
        """Of each window ``a1,a2|b1;a3|b2``: a group's tokens of the first side, then of the second."""
        n = int(group_ends[-1]) if len(group_ends) else 0
        last_a = np.cumsum(np.bincount(group_a, minlength=n))
        last_b = np.cumsum(np.bincount(group_b, minlength=n))
        order = np.empty(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + np.append(0, last_b)[group_a]
        place_b = np.arange(len(b)) + last_a[group_b]
        order[place_a], order[place_b] = np.arange(len(a)), np.arange(len(a), len(a) + len(b))
        size = np.concatenate([tok_a.name_size[a], tok_b.name_size[b]])[order]
        start = np.concatenate([tok_a.name_offset[a], tok_b.name_offset[b] + len(tok_a.names)])[order]
        blob = np.concatenate([tok_a.names, tok_b.names])[_ranges(start, size)]
        ends = np.cumsum(size)
        blob[ends[place_a[last_a - 1]] - 1] = ord("|")
        blob[ends[place_b[last_b - 1]] - 1] = ord(";")
        stops = ends[(last_a + last_b)[group_ends - 1] - 1].tolist()
        written = blob.tobytes()
        return [written[i:j - 1] for i, j in zip([0, *stops], stops)]


def _numbered(*sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of every window, first place of every number): equal numbers for equal id tuples on all sides."""
    code = None
    for ids, cuts in sides:
        offsets = pa.py_buffer((4 * cuts).astype(np.int64))
        tuples = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(ids.astype("<i4"))])
        own = pc.dictionary_encode(tuples).indices.to_numpy().astype(np.int64)
        code = own if code is None else code * len(own) + own
    number = pc.dictionary_encode(pa.array(code)).indices.to_numpy()
    first = np.empty(int(number.max(initial=-1)) + 1, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, first


_LONGS = ("n_a", "n_b", "n_groups", "n_links")
_INTS = ("text_ends", "windows", "link_ends", "pair_at")
#: Of these, the steps are kept: they only rise.
_RISING = ("text_ends", "link_ends")


def _packed(made: dict[str, object]) -> bytes:
    """The whole numbers of a chunk as one value: bytes of equal place in a row, compressed."""
    parts = [np.diff(made[c], prepend=0) if c in _RISING else made[c] for c in _INTS]
    planes = [np.ascontiguousarray(v.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for v in parts]
    head = np.array([len(v) for v in parts], "<i8").tobytes()
    return head + pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    """The numbers that ``_packed`` made one value of."""
    sizes = np.frombuffer(data, "<i8", len(_INTS))
    rest = data[8 * len(_INTS):]
    planes, start, out = np.frombuffer(pa.Codec("zstd").decompress(rest, int(4 * sizes.sum()), asbytes=True), np.uint8), 0, {}
    for c, n in zip(_INTS, sizes.tolist()):
        values = np.ascontiguousarray(planes[start:start + 4 * n].reshape(4, n).T).view("<i4").reshape(n)
        out[c] = np.cumsum(values, dtype=np.int64) if c in _RISING else values
        start += 4 * n
    return out


def _chunk(texts: list[str], tok_a: Tokenizer, tok_b: Tokenizer) -> dict[str, object]:
    """One chunk of texts: its counts, its documents as windows, its distinct windows and its distinct pairs."""
    at = np.array([k for k, t in enumerate(texts) if t], np.int64)
    some = [" " + texts[k] for k in at.tolist()]
    raw = [t.encode() for t in some]
    raw_ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    out: dict[str, object] = {c: np.zeros(len(texts), np.int64) for c in _LONGS}
    sha, text_ends = [""] * len(texts), np.zeros(len(texts), np.int64)
    words = Words(some)
    (a, ends_a), (b, ends_b) = tok_a.encode_words(some, words), tok_b.encode_words(some, words)
    joined = b"".join(raw)
    good = _gives_back(tok_a, a, ends_a, joined, raw_ends) & _gives_back(tok_b, b, ends_b, joined, raw_ends)
    (a, ends_a), (b, ends_b), at = _kept(a, ends_a, good), _kept(b, ends_b, good), at[good]
    windows = link_ends = pairs = pair_at = links = np.zeros(0, np.int64)
    if len(at):
        end_a, end_b = np.cumsum(tok_a.size[a]), np.cumsum(tok_b.size[b])
        # before a token that starts with a space, and after the last one; every text starts with a space
        anchors, _ = _merged(*[end[np.append(tok.starts[ids[1:]], True)] for end, ids, tok in ((end_a, a, tok_a), (end_b, b, tok_b))])
        cut_a, cut_b = (np.append(0, np.searchsorted(end, anchors) + 1) for end in (end_a, end_b))
        windows, first = _numbered((a, cut_a), (b, cut_b))
        size_a, size_b = np.diff(cut_a)[first], np.diff(cut_b)[first]
        known = Alignment(a[_ranges(cut_a[first], size_a)], np.cumsum(size_a), b[_ranges(cut_b[first], size_b)], np.cumsum(size_b), tok_a, tok_b)
        link_ends = known.link_ends
        n_links = np.diff(link_ends, prepend=0)
        coded = pc.dictionary_encode(pa.array(known.pairs))
        pairs, pair_at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        often = np.bincount(windows, minlength=len(first))
        links = np.bincount(pair_at, np.repeat(often, n_links), minlength=len(pairs)).astype(np.int64)
        ends = np.searchsorted(anchors, end_a[ends_a - 1]) + 1
        out["n_a"][at], out["n_b"][at] = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        out["n_groups"][at], out["n_links"][at] = _per(known.groups[windows], ends), _per(n_links[windows], ends)
        numbers, start = windows.tolist(), 0
        for k, end in zip(at.tolist(), ends.tolist()):
            sha[k] = hashlib.sha256(b";".join([known.texts[w] for w in numbers[start:end]])).hexdigest()
            start = end
        text_ends[at] = ends
    return {**out, "groups_sha256": sha, "text_ends": np.maximum.accumulate(text_ends), "windows": windows, "link_ends": link_ends,
            "pair_at": pair_at, "pairs": pa.StructArray.from_arrays(
                [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(links)],
                ["a", "b", "links"])}


def _listed(values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunks(docs: DataFrame, tokenizers: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of documents; numbers of chunks are unique, and the same when a task runs again.

    The numbers of its windows and links are packed: as arrays they are more bytes than the text, in every row that an
    executor holds, sorts, writes and reads.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    types = {**{c: "long" for c in _LONGS}, "groups_sha256": "string", "pairs": "struct<a:int,b:int,links:long>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, CHUNK_BYTES):
                made = _chunk(texts_of(part, 1), *tokenizers_of(*tokenizers))
                columns = {c: pa.array(made[c], pa.int64()) for c in _LONGS} | {"groups_sha256": pa.array(made["groups_sha256"], pa.string())}
                columns |= {"pairs": made["pairs"]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), _listed(part.column(0)), *[_listed(columns[c]) for c in types], pa.array([_packed(made)], pa.binary())],
                    ["chunk", "ids", *types, "packed"])
                number += 1

    return source.mapInArrow(run, f"chunk long, ids array<{kind}>, " + ", ".join(f"{c} array<{t}>" for c, t in types.items()) + ", packed binary")


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, links, best): links of every id pair in all chunks; ``best`` if no other pair of this b has more."""
    summed = made.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.links").alias("links"))
    most = summed.groupBy("b").agg(F.max("links").alias("most"))
    return summed.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``tokenizers``: paths of a byte-level vocabulary and of a piece model that every executor has. ``n_best``:
    links whose pair is the most frequent of its piece, ties included; ``count_sum``: the corpus counts of all links.
    """
    made = materialize(chunks(docs, tokenizers or default_tokenizers(), id_col, text_col), "chunks")
    counts = materialize(pair_counts(made), "pairs")
    pairs = made.select("chunk", F.posexplode("pairs").alias("at", "p")).select("chunk", "at", "p.a", "p.b")
    back = (pairs.join(counts, ["a", "b"]).groupBy("chunk")
            .agg(F.sort_array(F.collect_list(F.struct("at", "links", "best"))).alias("known"))
            .select("chunk", F.transform("known", lambda k: k["links"]).alias("links"),
                    F.transform("known", lambda k: k["best"].cast("int")).alias("best")))
    rows = made.drop("pairs").join(back, "chunk", "left")
    kind = made.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = {c: batch.column(i).slice(k, 1).flatten() for i, c in enumerate(batch.schema.names) if c not in ("chunk", "packed")}
                of = _unpacked(batch.column("packed")[k].as_py()) | {c: held[c].to_numpy(zero_copy_only=False) for c in ("links", "best")}
                sums = []
                for value in (of["best"], of["links"]):
                    by_window = _per(value[of["pair_at"]].astype(np.int64), of["link_ends"])
                    sums.append(pa.array(_per(by_window[of["windows"]], of["text_ends"]).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [held["ids"], *[held[c] for c in _LONGS], *sums, held["groups_sha256"]],
                    ["id", *_LONGS, "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in (*_LONGS, 'n_best', 'count_sum'))}, "
                                "groups_sha256 string").withColumnRenamed("id", id_col)
