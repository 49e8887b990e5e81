"""Time split, feedback rules and the preparation of the whole table set."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from matchspark.functions import enums
from matchspark.functions.dates import add_days, day
from matchspark.operators.asof import micros
from matchspark.operators.cleaning import clean_table, filter_by_time, validate_feedback
from matchspark.operators.quantiles import quantiles_long
from matchspark.operators.topk import first_per_key
from matchspark.schemas import TIME_FILTERED, TABLES


class SplitConfig(NamedTuple):
    """Split boundaries as timestamp text (a handful of values, kept on the driver)."""

    train_end: str
    valid_end: str
    test_start: str

    def at(self, name: str) -> Column:
        return F.lit(getattr(self, name)).cast("timestamp")


def split_boundaries(times: DataFrame, column: str, train_ratio: float = 0.70,
                     valid_ratio: float = 0.15) -> DataFrame:
    """One row (train_end, valid_end, test_start) from quantiles of event times, cut to days."""
    us = times.select(micros(F.col(column)).alias("us"))
    q = quantiles_long(us, ["us"], [train_ratio, train_ratio + valid_ratio])
    low = F.min("value").cast("bigint")
    high = F.max("value").cast("bigint")
    ends = q.agg(day(F.timestamp_micros(low)).alias("train_end"), day(F.timestamp_micros(high)).alias("_high"))
    valid_end = F.when(F.col("_high") <= F.col("train_end"), add_days(F.col("train_end"), 1)).otherwise(F.col("_high"))
    return ends.select("train_end", valid_end.alias("valid_end"), add_days(valid_end, 1).alias("test_start"))


def build_split_config(mentorships: DataFrame, applications: DataFrame | None = None,
                       train_ratio: float = 0.70, valid_ratio: float = 0.15) -> SplitConfig:
    """Boundaries from application times, or from mentorship starts when there are none."""
    for df, column in ((applications, "applied_at"), (mentorships, "start_date")):
        if df is None or column not in df.columns:
            continue
        row = split_boundaries(df, column, train_ratio, valid_ratio).select(
            *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in SplitConfig._fields]).first()
        if row is not None and row[0] is not None:
            return SplitConfig(*row)
    raise ValueError("no usable dates for a time split")


def config_frame(df_or_spark, config: SplitConfig) -> DataFrame:
    """The configuration as a one-row table, for saving."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.range(1).select(*[config.at(n).alias(n) for n in SplitConfig._fields])


def apply_time_split(df: DataFrame, column: str, config: SplitConfig) -> DataFrame:
    """Tag rows train / valid / test by time; rows without a time go."""
    t = F.col(column).cast("timestamp")
    tag = F.when(t <= config.at("train_end"), "train").when(t <= config.at("valid_end"), "valid").otherwise("test")
    return df.where(t.isNotNull()).withColumn("time_split", tag)


def split_frames(df: DataFrame, config: SplitConfig | None = None) -> dict[str, DataFrame]:
    """Train, valid and test part of a frame, by its tag or else by its event time."""
    if "time_split" not in df.columns:
        column = "event_time" if "event_time" in df.columns else "start_date"
        if config is None or column not in df.columns:
            raise ValueError("need a time_split column, or an event time with a split configuration")
        df = apply_time_split(df, column, config)
    tag = enums.word(F.col("time_split"))
    return {name: df.where(tag == name) for name in ("train", "valid", "test")}


def mentorship_links(mentorships: DataFrame) -> DataFrame:
    """The earliest row of every mentorship with its pair, start and status."""
    keys = ["mentorship_id", "mentee_id", "mentor_id", "start_date"]
    order = [F.col("start_date"), F.col("mentee_id"), F.col("mentor_id"), F.col("status")]
    return first_per_key(mentorships.select(*keys, "status").dropna(subset=keys), ["mentorship_id"], order)


def last_cancellations(cancellations: DataFrame) -> DataFrame:
    """The latest cancellation of every mentorship."""
    columns = [c for c in ("cancellation_actor", "cancellation_date") if c in cancellations.columns]
    order = [F.col("cancellation_date").desc_nulls_last()] if "cancellation_date" in columns else []
    rows = cancellations.select("mentorship_id", *columns).dropna(subset=["mentorship_id"])
    return first_per_key(rows, ["mentorship_id"], [*order, F.col("cancellation_actor")])


def feedback_for_training(feedback: DataFrame, mentorships: DataFrame, cancellations: DataFrame | None,
                          train_end: Column) -> DataFrame:
    """Feedback that belongs to a matching mentorship and may be used at ``train_end``.

    Kept: active or completed mentorships, or those the mentor cancelled; started, and if cancelled
    then cancelled, by ``train_end``; with the same mentee and mentor as the mentorship.
    """
    links = mentorship_links(mentorships).select(
        "mentorship_id", F.col("mentee_id").alias("_mentee"), F.col("mentor_id").alias("_mentor"),
        F.col("start_date").alias("_start"), F.col("status").alias("_status"))
    keys = ["mentorship_id", "mentee_id", "mentor_id"]
    joined = feedback.dropna(subset=keys).join(links, "mentorship_id").where(
        (F.col("mentee_id") == F.col("_mentee")) & (F.col("mentor_id") == F.col("_mentor")))
    status = enums.word(F.col("_status"))
    valid = status.isin("active", "completed")
    if cancellations is not None:
        last = last_cancellations(cancellations).select(
            "mentorship_id", F.col("cancellation_actor").alias("_actor"),
            F.col("cancellation_date").alias("_cancelled"))
        joined = joined.join(last, "mentorship_id", "left")
        by_mentor = enums.cancellation_actor_name(F.col("_actor")) == "mentor"
        cancelled = F.col("_cancelled").cast("timestamp")
        valid = (valid | (status.isin("cancelled", "canceled") & by_mentor)) & (
            cancelled.isNull() | (cancelled <= train_end))
    started = F.col("_start").cast("timestamp") <= train_end
    return joined.where(valid & started).select(*feedback.columns)


def prepare_tables(raw: dict[str, DataFrame], config: SplitConfig) -> dict[str, DataFrame]:
    """Clean every table, cut event tables at the end of training, tag applications and mentorships."""
    train_end = config.at("train_end")
    out = {name: clean_table(df, name) for name, df in raw.items()}
    for name in TIME_FILTERED:
        if name in out:
            out[name] = filter_by_time(out[name], TABLES[name].time, train_end)
    if "mentors_feedback" in out:
        feedback = out["mentors_feedback"]
        if "mentorships" in out:
            feedback = feedback_for_training(
                feedback, out["mentorships"], out.get("mentorship_cancellation"), train_end)
        out["mentors_feedback"] = validate_feedback(feedback)
    for name in ("mentorships", "mentorship_applications"):
        if name in out:
            out[name] = apply_time_split(out[name], TABLES[name].time, config)
    return out


def train_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("time_split") == "train") if "time_split" in df.columns else df
