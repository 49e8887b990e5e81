"""Written results: tables, manifests, split configuration, models, full-refresh loads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from matchspark.functions.sets import parse_set_text

SET_COLUMNS = ("subdomains_set", "interests_set", "expertise_set")


def save_table(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """A processed or feature table as Parquet, partitioned by split when it has one."""
    by = partition_by or ("time_split" if "time_split" in df.columns else None)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved table; sets stored as text by older exports become arrays again."""
    df = spark.read.parquet(path)
    return restore_sets(df)


def restore_sets(df: DataFrame) -> DataFrame:
    for c in SET_COLUMNS:
        if c in df.columns and isinstance(df.schema[c].dataType, StringType):
            df = df.withColumn(c, parse_set_text(F.col(c)))
        elif c in df.columns and df.schema[c].dataType != ArrayType(LongType()):
            df = df.withColumn(c, F.col(c).cast("array<bigint>"))
    return df


def save_manifest(spark: SparkSession, manifest: dict, path: str) -> str:
    """A JSON manifest as a one-row text table."""
    text = json.dumps(manifest, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_manifest(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).limit(2).collect()
    if not rows:
        raise FileNotFoundError(f"no manifest in {path}")
    return json.loads(rows[0][0])


def save_split_config(config: DataFrame, path: str) -> str:
    """The split boundaries (one row) as CSV."""
    config.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def load_split_config(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c).cast("timestamp").alias(c) for c in ("train_end", "valid_end", "test_start")])


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml.classification import LogisticRegressionModel
    return LogisticRegressionModel.load(path)


def save_scaler(scaler: DataFrame, path: str) -> str:
    """Scaler statistics: one row per column."""
    scaler.write.mode("overwrite").parquet(path)
    return path


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def refresh_table(df: DataFrame, path: str) -> int:
    """Replace a target table once every row has arrived beside it; a load that fails leaves the old table as it was.

    The rows are written to a staged folder and counted on their way, so the input runs once and may read the old table.
    Only a full copy takes the target's name. ``table_versions`` lists the loads.
    """
    spark, staged = df.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    fs, place = _file_system(spark, path)
    passed = Observation()
    try:
        df.observe(passed, F.count(F.lit(1)).alias("rows")).write.parquet(staged)
        written, expected = spark.read.schema(df.schema).parquet(staged).count(), passed.get["rows"]
        if written != expected:
            raise RuntimeError(f"load of {path}: expected {expected} rows, wrote {written}")
    except BaseException:
        fs.delete(place(staged), True)
        raise
    old = f"{path}.old-{uuid.uuid4().hex}"
    if fs.exists(place(path)) and not fs.rename(place(path), place(old)):
        raise RuntimeError(f"load of {path}: the old table can't be moved")
    if not fs.rename(place(staged), place(path)):
        fs.rename(place(old), place(path))
        raise RuntimeError(f"load of {path}: the new table can't be moved")
    fs.delete(place(old), True)
    spark.createDataFrame([(written,)], "rows long").select(F.current_timestamp().alias("loaded_at"), "rows").write.mode(
        "append").json(f"{path}.versions")
    return written


def table_versions(spark: SparkSession, path: str) -> DataFrame:
    """(loaded_at, rows) of every refresh of a table."""
    return spark.read.schema("loaded_at timestamp, rows long").json(f"{path}.versions")


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its paths."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place
