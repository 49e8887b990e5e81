"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchspark.session import materialize, scratch_path  # noqa: F401  (re-exported for the operators)

#: A task works on slices of at most this many bytes of text, whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes (one row may hold more)."""
    if batch.num_rows == 0:
        return
    step = max(1, min(batch.num_rows, int(limit * batch.num_rows / max(batch.nbytes, 1))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts of a column; null counts as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def discard(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished stages: it does once the driver has dropped their plans."""
    gc.collect()
    spark._jvm.System.gc()


def lower_hex(value: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def with_row(df: DataFrame, name: str = "__row") -> DataFrame:
    """Pack all columns into one struct, so that helper columns can't clash with theirs."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def unit_hash(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from md5 of the parts: the same on every run, and in plain SQL."""
    digest = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
