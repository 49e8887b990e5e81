"""Queries that run the event feeds as streams over the given event table until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.checks.people import r6
from matchspark.checks.registry import check
from matchspark.fixtures import Tables
from matchspark.session import scratch_path
from matchspark.streaming import feeds


def event_stream(t: Tables):
    """The event table as a file stream."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event*.parquet")


def paths(t: Tables, name: str) -> tuple[str, str]:
    return scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-progress")


@check("streamed_engagement", "P1 D10", """
SELECT user_id, mentor_id, CAST(sum(score) AS BIGINT) AS interaction_score, count(*) AS interaction_count, round(ln(1 + sum(score)), 6) AS interaction_score_log,
       round(ln(1 + count(*)), 6) AS interaction_count_log
FROM (SELECT DISTINCT kind, user_id, post_id, score FROM f_engagement) e JOIN x_owner o ON o.post_id = e.post_id GROUP BY user_id, mentor_id""")
def streamed_engagement(t: Tables):
    programs = t.part.count()
    # fixed values
    kinds = {"view": ("like", 1), "click": ("comment", 2), "purchase": ("save", 3)}
    kind, score = F.lit("share"), F.lit(4)
    for source, (name, points) in kinds.items():
        kind = F.when(F.col("event_type") == source, name).otherwise(kind)
        score = F.when(F.col("event_type") == source, points).otherwise(score)
    events = event_stream(t).where("event_type <> 'error'").select(
        kind.alias("kind"), "user_id", ((F.col("event_id") * 37 + F.col("user_id")) % programs).alias("post_id"),
        score.alias("score"), F.col("ts").cast("timestamp").alias("event_time"))
    out, progress = paths(t, "engagement")
    feeds.stream_engagement(events, t.f_programs, out, progress, watermark="400 days").awaitTermination()
    return r6(feeds.engagement_totals(t.spark, out))


@check("streamed_daily_counts", "P2", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS total
FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def streamed_daily_counts(t: Tables):
    events = event_stream(t).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out, progress = paths(t, "daily")
    feeds.stream_daily_counts(events, "user_id", "ts", out, progress).awaitTermination()
    return feeds.running_counts(t.spark, out, "user_id").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@check("streamed_all_days", "P2", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS total FROM d""")
def streamed_all_days(t: Tables):
    events = event_stream(t).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out, progress = paths(t, "days")
    feeds.stream_all_days(events, "user_id", "ts", out, progress).awaitTermination()
    return feeds.running_counts(t.spark, out, "user_id").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@check("streamed_recent_sessions", "P3 G13", """
WITH s AS (SELECT DISTINCT user_id AS mentee_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS session, event_id % 100 AS mentor_id FROM events),
r AS (SELECT mentee_id, session, row_number() OVER (PARTITION BY mentee_id ORDER BY session DESC) AS age FROM (SELECT DISTINCT mentee_id, session FROM s))
SELECT s.mentee_id, s.session, s.mentor_id FROM s JOIN r ON r.mentee_id = s.mentee_id AND r.session = s.session WHERE age <= 3""")
def streamed_recent_sessions(t: Tables):
    session = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    shown = event_stream(t).select(F.col("user_id").alias("mentee_id"), session.alias("session"), (F.col("event_id") % 100).alias("mentor_id"))
    out, progress = paths(t, "shown")
    feeds.stream_shown(shown, out, progress).awaitTermination()
    return feeds.recently_shown(t.spark, out)
