"""Session helpers: local sessions for tests, lineage cutting, shared scratch paths."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A written stage that took so many seconds left shuffle files worth removing; so full a driver heap is collected.
SLOW_S, FULL_HEAP = 2.0, 0.25


def local_session(app: str = "matchspark", cores: str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster, bring your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because there driver and executors are one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="matchspark-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table inside the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def relieve(spark: SparkSession, seconds: float = 0.0) -> bool:
    """Collect the driver's garbage after a stage of ``seconds``, or if the heap is filling; says whether it did.

    Shuffle files stay on the executors' disks until the driver has dropped the plans of their stages, and a heap that
    is left alone grows to its limit, whatever is alive in it.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if seconds < SLOW_S and runtime.totalMemory() - runtime.freeMemory() < FULL_HEAP * runtime.maxMemory():
        return False
    gc.collect()
    spark._jvm.System.gc()
    if seconds >= SLOW_S:  # the JVM's cleaners first let go of what holds the plan of the last stage, then its shuffle can go
        time.sleep(0.1)
        spark._jvm.System.gc()
    return True


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used between the stages of long jobs: the result is computed once, later plans stay small and
    know its size, and a lost executor does not repeat the stages before it. What the stage shuffled is removed.
    """
    path = scratch_path(df.sparkSession, name)
    began = time.monotonic()
    df.write.parquet(path)
    relieve(df.sparkSession, time.monotonic() - began)
    return df.sparkSession.read.schema(df.schema).parquet(path)
