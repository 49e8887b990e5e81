"""Language identification: a bidirectional GRU labels every byte of the letters, documents pool them.

The network reads runs of letters (cut every 48 bytes) between two blanks and starts anew with each,
so equal runs get equal labels and a task computes each run once (remembered runs are bounded). A
document's probability of a language is the mean over all its letter positions, whole text.

It learns from a bounded sample: per language the ``SAMPLE_DOCS`` distinct texts with the smallest
hash, of each at most ``SAMPLE_WORDS`` runs drawn from the whole text. Null texts and texts without
letters are ``und`` with score 0; so is everything if there is nothing to learn from. Ties go to the
first label in order. Repeated rows get repeated answers.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from matchspark.llm.bytegru import ByteGru
from matchspark.llm.common import materialize, slices, texts_of

SAMPLE_DOCS = 300
SAMPLE_WORDS = 40
RUN_BYTES = 48
REMEMBERED_RUNS = 100_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+").findall


def runs_of(text: str) -> list[str]:
    """The runs of letters of a whole text, lower case. Fractions, raised digits and Roman number signs are no letters."""
    return [part for run in _LETTERS(text.lower()) for part in (
        (run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def sequences(run: str) -> list[bytes]:
    """A run as byte sequences of bounded length, each between two blanks."""
    data = run.encode()
    return [b" " + data[i:i + RUN_BYTES] + b" " for i in range(0, len(data), RUN_BYTES)]


def by_length(seqs: list[bytes]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, s in enumerate(seqs):
        out.setdefault(len(s), []).append(i)
    return out


def matrix(seqs: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(seqs), np.uint8).reshape(-1, length)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    labels: list[str]
    net: ByteGru | None

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Per word: sum of its positions' probabilities by label, then the number of positions."""
        out = np.zeros((len(words), len(self.labels) + 1))
        seqs, owner = [], []
        for i, w in enumerate(words):
            for s in sequences(w):
                seqs.append(s)
                owner.append(i)
        owner = np.array(owner, np.int64)
        for length, at in by_length(seqs).items():
            for k in range(0, len(at), 1024):
                part = at[k:k + 1024]
                p = self.net.probabilities(matrix([seqs[i] for i in part], length))[1:-1].sum(axis=0)
                np.add.at(out, owner[part], np.concatenate([p, np.full((len(part), 1), length - 2.0)], axis=1))
        return out


def sample(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text",
           max_docs: int = SAMPLE_DOCS, max_words: int = SAMPLE_WORDS) -> DataFrame:
    """(lang, words): the bounded sample that a model learns from."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(text_col).alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = (rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(order))
              .where(F.col("n") <= max_docs).select("lang", "h"))
    chosen = materialize(chosen, "sample")  # at most max_docs rows per language

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                picked = []
                for h, text in zip(part.column(1).to_pylist(), texts_of(part, 2)):
                    words = runs_of(text)
                    picked.append(random.Random(h).sample(words, min(max_words, len(words))))
                    picked[-1] = [w[:RUN_BYTES] for w in picked[-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(picked, pa.list_(pa.string()))], ["lang", "h", "words"])

    return (rows.join(chosen, ["lang", "h"]).select("lang", "h", "text")
            .mapInArrow(draw, "lang string, h long, words array<string>").dropDuplicates(["lang", "h"])
            .select("lang", "h", "words"))


def train(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", epochs: int = 4,
          max_docs: int = SAMPLE_DOCS, max_words: int = SAMPLE_WORDS) -> Model:
    """Learn from the bounded sample of ``docs``, on the driver."""
    rows = sorted(sample(docs, lang_col=lang_col, text_col=text_col, max_docs=max_docs,
                         max_words=max_words).collect(), key=lambda r: (r["lang"], r["h"]))
    labels = sorted({r["lang"] for r in rows if r["words"]})
    if not labels:
        return Model([], None)
    seqs, target = [], []
    for r in rows:
        for w in r["words"]:
            for s in sequences(w):
                seqs.append(s)
                target.append(labels.index(r["lang"]))
    target = np.array(target)
    net = ByteGru(len(labels))
    net.fit([(matrix([seqs[i] for i in at], n), target[at]) for n, at in sorted(by_length(seqs).items())],
            epochs=epochs)
    return Model(labels, net)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as a struct ``__row``, with lang_pred and score."""
    source = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"),
                         F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        sums = np.zeros((0, len(model.labels) + 1))
        for batch in batches:
            for part in slices(batch):
                langs, scores = [], []
                texts = [runs_of(t) for t in texts_of(part, 1)]
                if model.labels:
                    if len(place) > REMEMBERED_RUNS:
                        place, sums = {}, sums[:0]
                    fresh = list({w for ws in texts for w in ws} - place.keys())
                    place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
                    sums = np.concatenate([sums, model.word_sums(fresh)])
                for words in texts:
                    if not words or not model.labels:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = sums[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    pooled = total[:-1] / total[-1]
                    langs.append(model.labels[int(pooled.argmax())])
                    scores.append(float(min(1.0, pooled.max())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["__row", "lang_pred", "score"])

    kind = source.schema["__row"].dataType.simpleString()
    return source.mapInArrow(run, f"__row {kind}, lang_pred string, score double")
