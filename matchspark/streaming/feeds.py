"""Append-only event feeds as Structured Streaming jobs.

Each job writes one folder per micro-batch and overwrites it when a batch is retried, so a restart
does not count anything twice. Totals are read with the batch functions below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from matchspark.plans.people import post_owners
from matchspark.plans.rerank import keep_recent_sessions


def _write_batches(stream: DataFrame, transform, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``transform`` on every micro-batch and store the result under its batch number."""

    def store(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_engagement(events: DataFrame, posts: DataFrame, path: str, checkpoint: str,
                      watermark: str = "1 day", **trigger) -> StreamingQuery:
    """Engagement score per (user, mentor), batch by batch.

    ``events`` is a stream of (kind, user_id, post_id, score, event_time). A repeated (user, post, kind)
    inside the watermark counts once.
    """
    once = events.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["user_id", "post_id", "kind"])
    owners = post_owners(posts)

    def partial_sums(batch: DataFrame) -> DataFrame:
        return batch.join(owners, "post_id").groupBy("user_id", "mentor_id").agg(
            F.sum("score").alias("interaction_score"), F.count("*").alias("interaction_count"))

    return _write_batches(once, partial_sums, path, checkpoint, **trigger)


def engagement_totals(spark: SparkSession, path: str) -> DataFrame:
    """Scores of all batches so far, in the shape of the batch feature table."""
    return spark.read.parquet(path).groupBy("user_id", "mentor_id").agg(
        F.sum("interaction_score").alias("interaction_score"), F.sum("interaction_count").alias("interaction_count")
    ).withColumn("interaction_score_log", F.log1p("interaction_score")).withColumn(
        "interaction_count_log", F.log1p("interaction_count"))


def daily_counts(events: DataFrame, key: str, time: str, watermark: str = "2 days") -> DataFrame:
    """Streaming count per key and day; a day is emitted once the watermark has passed it."""
    return (
        events.withWatermark(time, watermark).groupBy(F.window(time, "1 day").alias("w"), F.col(key))
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), key, "n")
    )


def stream_daily_counts(events: DataFrame, key: str, time: str, path: str, checkpoint: str,
                        watermark: str = "2 days", **trigger) -> StreamingQuery:
    """Daily counts (followers, enrolments) stored batch by batch."""
    return _write_batches(daily_counts(events, key, time, watermark), lambda b: b, path, checkpoint, **trigger)


def stream_all_days(events: DataFrame, key: str, time: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Daily counts of every day, open ones and late events too: each batch adds its share, ``running_counts`` sums them."""
    day = F.date_trunc("day", F.col(time)).alias("day")
    return _write_batches(events, lambda b: b.groupBy(day, key).agg(F.count("*").alias("n")), path, checkpoint, **trigger)


def running_counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Count up to and including each day per key (one row per key and day, so groups stay short)."""
    days = spark.read.parquet(path).groupBy(key, "day").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.select(key, "day", "n", F.sum("n").over(upto).alias("total"))


def stream_shown(shown: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Log of shown mentors, a stream of (mentee_id, session, mentor_id)."""
    return _write_batches(shown, lambda b: b.select("mentee_id", "session", "mentor_id").distinct(), path, checkpoint, **trigger)


def recently_shown(spark: SparkSession, path: str) -> DataFrame:
    """The last sessions of every mentee, ready for the decay of repeated mentors."""
    return keep_recent_sessions(spark.read.parquet(path).select("mentee_id", "session", "mentor_id").distinct())
