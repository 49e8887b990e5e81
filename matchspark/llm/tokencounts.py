"""Token counts through a digest cache: stored counts are joined, only distinct misses are encoded.

The cache is a folder of Parquet files, one partition ``tokenizer=<digest>`` per tokenizer version:
library, its version and the bytes of the vocabulary file. Its rows are (content, n_tokens), ``content``
the SHA-256 of the normalised text. ``count_tokens`` digests every row in the JVM, joins the digests
to the cache, hands one text per missing digest to the library, appends what it counted and joins
again. Texts move once, and only one per missing digest and task (copies combine before the shuffle);
all other steps move digests. Appending is one Spark write job, so a lost executor repeats a task and
never leaves half a file; two jobs that append the same digest leave equal rows, which fold on reading.

``normalise`` must keep every count as it is; by default it only reads null as the empty text, as a
tokenizer with added tokens may treat any other change as another text. Special strings inside a text are
handled as the library does by default; nothing is added, cut or padded.

Null and empty texts count as the library counts the empty text. Rows without id, repeated rows and
clashing columns are kept one for one; an empty table gives no rows and leaves the cache as it was.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from matchspark.llm.common import materialize, scratch_path, slices, texts_of

#: Digests are stored as 32 bytes.
_CACHE_SCHEMA = "content binary, n_tokens long"
_LIBRARY = {".json": "tokenizers", ".model": "sentencepiece"}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library_of(path: str) -> str:
    kind = os.path.splitext(path)[1]
    if kind not in _LIBRARY:
        raise ValueError(f"no library for {path}: {' or '.join(_LIBRARY)} expected")
    return _LIBRARY[kind]


def tokenizer_digest(path: str) -> str:
    """Hex digest of what decides a count: the library, its version and the vocabulary's bytes."""
    library = library_of(path)
    found = hashlib.sha256(f"{library} {version(library)}\n".encode())
    with open(path, "rb") as file:
        for block in iter(lambda: file.read(1 << 20), b""):
            found.update(block)
    return found.hexdigest()


@lru_cache(maxsize=4)
def counter_of(path: str) -> Callable[[list[str]], list[int]]:
    """Texts to token counts by the file's library; kept by the worker process."""
    if library_of(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it may use
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def cached(df_or_spark, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) stored for this tokenizer version, one row per digest; none if there is no such folder."""
    spark = df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark
    folder = f"{cache}/tokenizer={tokenizer_digest(tokenizer)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHE_SCHEMA)
    return spark.read.schema(_CACHE_SCHEMA).parquet(folder).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(misses: DataFrame, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of distinct (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(tokenizer)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count(texts_of(part, 1)), pa.int64())], ["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, _CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache: str | None = None, *, tokenizer: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", normalise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """(``id_col``, n_bytes, n_tokens, hit) of every row; ``hit`` if the count was stored before this call.

    ``cache`` is a folder all executors reach (None: a new one, so everything is a miss); ``tokenizer`` a
    vocabulary file that every executor has under this path.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    cache = cache or scratch_path(spark, "token-counts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = F.unhex(F.sha2(F.encode(normalise(text), "UTF-8"), 256))
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content")), "digests")
    before = cached(spark, cache, tokenizer)
    known = materialize(rows.select("content").distinct().join(before, "content"), "known")
    misses = (docs.select(content.alias("content"), normalise(text).alias("text"))
              .join(known.select("content"), "content", "left_anti")
              .groupBy("content").agg(F.first("text").alias("text")))
    if not rows.isEmpty():
        encode_misses(misses, tokenizer).write.mode("append").parquet(f"{cache}/tokenizer={tokenizer_digest(tokenizer)}")
    counts = cached(spark, cache, tokenizer).join(known.select("content", F.lit(True).alias("hit")), "content", "left")
    return rows.join(counts, "content").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", F.coalesce("hit", F.lit(False)).alias("hit"))
