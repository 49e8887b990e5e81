"""What a written stage leaves behind: shuffle files and a filling driver heap."""

import time

from pyspark.sql import functions as F

from matchspark import session


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())}


def test_shuffle_files_of_a_slow_stage_are_removed(spark, monkeypatch):
    """they stayed until the driver happened to collect its garbage, and its heap grew to the limit."""
    before = shuffle_files(spark)
    monkeypatch.setattr(session, "SLOW_S", 0.0)
    made = session.materialize(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "relief")
    until = time.time() + 20
    while (left := {f for f in shuffle_files(spark) - before if f.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.2)
    assert not left and made.count() == 7


def test_a_quick_stage_costs_no_collection(spark, monkeypatch):
    monkeypatch.setattr(session, "FULL_HEAP", 1.0)
    assert not session.relieve(spark, 0.1)
    monkeypatch.setattr(session, "FULL_HEAP", 0.0)
    assert session.relieve(spark, 0.1)
