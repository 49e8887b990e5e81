"""Mentee and mentor features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from matchspark.functions import enums
from matchspark.functions.numbers import flag
from matchspark.operators.overlap import as_sets
from matchspark.operators.quantiles import quantiles_long
from matchspark.schemas import TABLES

# ---------------------------------------------------------------- fixed values
ENGAGEMENT_SCORES = {"like": 1, "comment": 2, "save": 3, "share": 4}
RATING_PRIOR_WEIGHT = 5
QUALITY_WEIGHTS = {"rating": 0.60, "sentiment": 0.25, "positive": 0.15}
RELIABILITY_WEIGHTS = {"completion": 0.7, "cancel": 0.3}
POPULARITY_WEIGHTS = {"enrollment": 0.55, "program": 0.30, "engagement": 0.15}
POPULARITY_WEIGHTS_PLAIN = {"enrollment": 0.60, "program": 0.40}
POPULARITY_CAP_QUANTILE = 0.95
YEARS_BINS = (2, 5, 10)
# -----------------------------------------------------------------------------


def clean_code(c: Column) -> Column:
    return F.coalesce(enums.word(c), F.lit(""))


def mentee_features(profile: DataFrame, subdomains: DataFrame, interests: DataFrame) -> DataFrame:
    """One row per mentee: level, education, country, domain, subdomain set, interest set."""
    level = enums.encode_profile_level(F.col("current_level"))
    base = profile.select(
        F.col("user_id").alias("mentee_id"), level.alias("experience_level_num"),
        enums.experience_word(level).alias("experience_level"),
        clean_code(F.col("education_status")).alias("education_status"),
        clean_code(F.col("country_code")).alias("country_code"), F.col("domain_id").cast("bigint").alias("domain_id"))
    return (
        base.join(as_sets(subdomains, "mentee_id", "subdomain_id", "subdomains_set"), "mentee_id", "left")
        .join(as_sets(interests, "mentee_id", "technology_id", "interests_set"), "mentee_id", "left")
        .withColumn("subdomains_set", empty_if_null("subdomains_set"))
        .withColumn("interests_set", empty_if_null("interests_set"))
    )


def empty_if_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<bigint>"))


def sentiment_score(c: Column) -> Column:
    return enums.map_enum(c, {1: ["positive"], -1: ["negative"]}, 0)


def mentor_quality(feedback: DataFrame) -> DataFrame:
    """Rating, sentiment and their smoothed combination per mentor.

    Ratings outside 1..5 count as reviews but not towards the mean.
    """
    rating = F.col("rating").try_cast("double")
    sentiment = sentiment_score(F.col("sentiment")) if "sentiment" in feedback.columns else F.lit(0)
    per_mentor = feedback.groupBy("mentor_id").agg(
        F.coalesce(F.avg(F.when(rating.between(1, 5), rating)), F.lit(0.0)).alias("mentor_avg_rating"),
        F.count("*").alias("mentor_review_count"),
        F.avg(sentiment).cast("double").alias("mentor_sentiment_score"),
        F.avg(flag(sentiment > 0)).cast("double").alias("mentor_positive_feedback_ratio"))
    prior = per_mentor.agg(F.avg("mentor_avg_rating")).scalar()
    n, k = F.col("mentor_review_count"), RATING_PRIOR_WEIGHT
    weighted = (F.col("mentor_avg_rating") * n + prior * k) / (n + k)
    w = QUALITY_WEIGHTS
    return per_mentor.withColumn("mentor_weighted_rating", weighted).withColumn(
        "mentor_quality_score", w["rating"] * F.col("mentor_weighted_rating")
        + w["sentiment"] * F.col("mentor_sentiment_score") + w["positive"] * F.col("mentor_positive_feedback_ratio"))


def post_owners(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", "mentor_id").dropna().distinct()


def mentor_reliability(applications: DataFrame, posts: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Completion and cancellation rates; only cancellations by the mentor count."""
    apps = applications.select("app_id", "post_id", "status").join(post_owners(posts), "post_id")
    done = apps.groupBy("mentor_id").agg(
        F.countDistinct("app_id").alias("total_apps"),
        F.sum(flag(enums.word(F.col("status")) == "accepted")).alias("completed"))
    cancels = (
        cancellations.where(enums.cancellation_actor_name(F.col("cancellation_actor")) == "mentor")
        .groupBy("mentor_id").agg(F.count("mentorship_id").alias("cancels"))
    )
    total = F.greatest(F.col("total_apps"), F.lit(1))
    w = RELIABILITY_WEIGHTS
    return (
        done.join(cancels, "mentor_id", "left")
        .select("mentor_id", (F.col("completed") / total).alias("mentor_completion_rate"),
                (F.coalesce("cancels", F.lit(0)) / total).alias("mentor_cancel_rate"))
        .withColumn("mentor_reliability_score", w["completion"] * F.col("mentor_completion_rate")
                    - w["cancel"] * F.col("mentor_cancel_rate"))
    )


def engagement_events(likes: DataFrame | None = None, comments: DataFrame | None = None,
                      saves: DataFrame | None = None, shares: DataFrame | None = None) -> DataFrame | None:
    """The four event tables as one: kind, user_id, post_id, score, event_time (and actor, if any)."""
    out = None
    kinds = {"like": (likes, "created_at"), "comment": (comments, "created_at"),
             "save": (saves, "created_at"), "share": (shares, "shared_at")}
    for kind, (df, time) in kinds.items():
        if df is None:
            continue
        actor = F.col("actor") if "actor" in df.columns else F.lit(None).cast("string")
        when = F.col(time) if time in df.columns else F.col("created_at")
        part = df.select(F.lit(kind).alias("kind"), "user_id", "post_id",
                         F.lit(ENGAGEMENT_SCORES[kind]).alias("score"),
                         when.cast("timestamp").alias("event_time"), actor.alias("actor"))
        out = part if out is None else out.unionByName(part)
    return out


def engagement_from_tables(tables: dict[str, DataFrame]) -> DataFrame | None:
    names = ("posts_likes_dataset", "posts_comments", "saved_posts_dataset", "shared_posts_dataset")
    assert all(n in TABLES for n in names)
    return engagement_events(*[tables.get(n) for n in names])


def popularity_raw(enrollment: Column, program: Column, engagement: Column | None) -> Column:
    """Weighted logs of the counts; other weights apply when there is no engagement signal at all."""
    if engagement is None:
        w = POPULARITY_WEIGHTS_PLAIN
        return w["enrollment"] * F.log1p(enrollment) + w["program"] * F.log1p(program)
    w = POPULARITY_WEIGHTS
    return (w["enrollment"] * F.log1p(enrollment) + w["program"] * F.log1p(program)
            + w["engagement"] * F.log1p(engagement))


def capped(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` cut at its 95 % quantile, as ``name``."""
    ends = quantiles_long(df, [column], [POPULARITY_CAP_QUANTILE])
    cap = ends.agg(F.min("value")).scalar()
    rest = [c for c in df.columns if c != column]
    cut = F.when(F.col("_cap") > 0, F.least(F.col(column), F.col("_cap"))).otherwise(F.col(column))
    return df.select("*", cap.alias("_cap")).select(*rest, cut.alias(name))


def mentor_popularity(posts: DataFrame, mentorships: DataFrame, engagement: DataFrame | None) -> DataFrame:
    """Programs, enrolments and engagement per mentor and their capped combination.

    Applications stay out: they are the label.
    """
    programs = posts.groupBy("mentor_id").agg(F.countDistinct("post_id").alias("mentor_program_count"))
    enrolled = mentorships.groupBy("mentor_id").agg(
        F.countDistinct("mentorship_id").alias("mentor_enrollment_count"))
    out = programs.join(enrolled, "mentor_id", "outer")
    counts = ["mentor_program_count", "mentor_enrollment_count"]
    if engagement is not None:
        touched = (
            engagement.select("kind", "user_id", "post_id").distinct().join(post_owners(posts), "post_id")
            .groupBy("mentor_id").agg(F.count("*").alias("mentor_engagement_count"))
        )
        out = out.join(touched, "mentor_id", "left")
        counts.append("mentor_engagement_count")
    out = out.fillna(0, counts)
    raw = popularity_raw(F.col("mentor_enrollment_count"), F.col("mentor_program_count"),
                         F.col("mentor_engagement_count") if engagement is not None else None)
    return capped(out.select("*", raw.alias("_raw")), "_raw", "mentor_program_popularity")


def open_posts(posts: DataFrame) -> DataFrame:
    """Published and open programs; older exports carry availability in ``is_open``."""
    if "availability" in posts.columns:
        out = posts.where(enums.is_open_availability(F.col("availability")))
        return out.where(enums.is_published(F.col("is_open"))) if "is_open" in posts.columns else out
    return posts.where(enums.is_open_availability(F.col("is_open"))) if "is_open" in posts.columns else posts


def mentor_social(follows: DataFrame, posts: DataFrame, profile: DataFrame) -> DataFrame:
    """Followers and open programs per mentor, as logs."""
    mentors = profile.select(F.col("user_id").alias("mentor_id")).dropna().distinct()
    followers = (
        follows.select(F.col("following_id").alias("mentor_id")).join(mentors, "mentor_id", "left_semi")
        .groupBy("mentor_id").agg(F.log1p(F.count("*")).alias("mentor_follower_count_log"))
    )
    opened = open_posts(posts).groupBy("mentor_id").agg(
        F.log1p(F.countDistinct("post_id")).alias("mentor_open_post_count_log"))
    return mentors.join(followers, "mentor_id", "left").join(opened, "mentor_id", "left").fillna(0.0)


def years_level(years: Column, legacy: bool = False) -> Column:
    """Years of experience to a level 1..4 (0..3 with ``legacy``, the older biased scale)."""
    y = F.coalesce(years.cast("double"), F.lit(0.0))
    low, mid, high = YEARS_BINS
    step = F.when(y <= low, 0).when(y <= mid, 1).when(y <= high, 2).otherwise(3)
    return step if legacy else step + 1


def mentor_features(profile: DataFrame, subdomains: DataFrame, expertise: DataFrame, feedback: DataFrame,
                    applications: DataFrame, posts: DataFrame, cancellations: DataFrame,
                    mentorships: DataFrame, follows: DataFrame, engagement: DataFrame | None = None,
                    legacy_levels: bool = False) -> DataFrame:
    """One row per mentor. Event inputs must already be cut at the end of training."""
    base = profile.select(
        F.col("user_id").alias("mentor_id"),
        years_level(F.col("years_of_experience"), legacy_levels).alias("experience_level_num"),
        clean_code(F.col("country_code")).alias("country_code"), F.col("domain_id").cast("bigint").alias("domain_id"))
    parts: Iterable[DataFrame] = (
        as_sets(subdomains, "mentor_id", "subdomain_id", "subdomains_set"),
        as_sets(expertise, "mentor_id", "technology_id", "expertise_set"),
        mentor_quality(feedback),
        mentor_reliability(applications, posts, cancellations),
        mentor_popularity(posts, mentorships, engagement).select("mentor_id", "mentor_program_popularity"),
        mentor_social(follows, posts, profile),
    )
    out = base
    for part in parts:
        out = out.join(part, "mentor_id", "left")
    return (
        out.fillna(0, [c for c in out.columns if c.startswith("mentor_") and c != "mentor_id"])
        .withColumn("subdomains_set", empty_if_null("subdomains_set"))
        .withColumn("expertise_set", empty_if_null("expertise_set"))
    )


def interaction_features(engagement: DataFrame, posts: DataFrame) -> DataFrame:
    """Summed and counted engagement per (user, mentor); one event per user, post and kind."""
    events = engagement
    if "actor" in events.columns:
        events = events.where(F.col("actor").isNull() | (enums.word(F.col("actor")) == "mentee"))
    return (
        events.select("kind", "user_id", "post_id", "score").dropna().distinct()
        .join(post_owners(posts), "post_id")
        .groupBy("user_id", "mentor_id")
        .agg(F.sum("score").alias("interaction_score"), F.count("*").alias("interaction_count"))
        .withColumn("interaction_score_log", F.log1p("interaction_score"))
        .withColumn("interaction_count_log", F.log1p("interaction_count"))
    )


def community_sets(members: DataFrame) -> DataFrame:
    """Community ids per user."""
    return as_sets(members, "user_id", "community_id", "communities")
