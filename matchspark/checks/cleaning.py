"""Queries: reading rules, cleaning, normalisation, splits and feedback rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.checks.people import r6
from matchspark.checks.registry import check
from matchspark.fixtures import Tables
from matchspark.functions import dates, enums, ids, numbers
from matchspark.operators import cleaning, quality
from matchspark.operators.groupstats import with_scalars
from matchspark.plans import splits
from matchspark.schemas import TABLES
from matchspark.session import scratch_path
from matchspark.sources import artifacts, tables

RAW_MENTEE = """
SELECT CAST(c_custkey AS VARCHAR(20)) AS UserId, concat(' ', c_name, ' ') AS Bio,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR(20)) END AS DomainId,
       CASE WHEN c_custkey % 4 = 0 THEN 'bad' WHEN c_custkey % 4 = 1 THEN '7.0' ELSE '3' END AS career_goal_id,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS EducationStatus
FROM customer"""


@check("schema_mapped_read", "A1 A3 A4 A5 B1 B2 B4", f"""
WITH raw AS ({RAW_MENTEE})
SELECT CAST(UserId AS BIGINT) AS user_id, nullif(DomainId, '') AS domain_id,
       CASE career_goal_id WHEN '7.0' THEN '7' WHEN '3' THEN '3' END AS career_goal_id,
       nullif(trim(EducationStatus), '') AS education_status, trim(Bio) AS bio
FROM raw""")
def schema_mapped_read(t: Tables):
    mapped = tables.map_table(t.sql(RAW_MENTEE), TABLES["mentee_profile"])
    out = cleaning.blank_to_null(cleaning.coerce_ids(cleaning.strip_text(mapped)))
    return out.select("user_id", F.col("domain_id").cast("string"), F.col("career_goal_id").cast("string"),
                      "education_status", "bio")


@check("first_nonempty_value", "A5", """
SELECT c_custkey, coalesce(nullif(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END), ''), 'nan'), c_mktsegment) AS label
FROM customer""")
def first_nonempty_value(t: Tables):
    df = t.sql("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS FirstName, c_mktsegment AS `last name` FROM customer")
    return df.select("c_custkey", tables.first_value(df, "first_name", "LastName").alias("label"))


@check("union_of_files", "A2 I3", """
SELECT event_id AS like_id, user_id, 'community' AS origin, CAST(NULL AS VARCHAR) AS post_id FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, user_id, 'program', CAST(post_id AS VARCHAR) FROM f_engagement WHERE kind = 'save'""")
def union_of_files(t: Tables):
    first = t.events.where("event_type = 'view'").select(F.col("event_id").alias("like_id"), "user_id", F.lit("community").alias("origin"))
    second = t.f_engagement.where("kind = 'save'").select(
        F.col("event_id").alias("like_id"), "user_id", F.lit("program").alias("origin"),
        F.col("post_id").cast("string").alias("post_id"))
    return tables.union_frames([first, second])


@check("namespaced_ids", "A12", """
SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN event_id + 10000000 ELSE event_id END AS like_id FROM events""")
def namespaced_ids(t: Tables):
    source = F.when(F.col("event_type") == "click", "Mentorship_post_likes.csv").otherwise("community_post_likes.csv")
    return t.events.select("event_id", "event_type",
                           ids.namespaced_int(F.col("event_id").cast("string"), source).alias("like_id"))


@check("saved_table_round_trip", "A7 A8 A11", """
SELECT mentee_id, string_agg(CAST(technology_id AS VARCHAR), ',' ORDER BY technology_id) AS interests
FROM f_mentee_interests GROUP BY mentee_id""")
def saved_table_round_trip(t: Tables):
    from matchspark.operators.overlap import as_sets
    sets_table = as_sets(t.f_mentee_interests, "mentee_id", "technology_id", "interests_set")
    legacy = sets_table.withColumn("interests_set", F.concat(F.lit("{"), F.array_join(F.col("interests_set").cast("array<string>"), ", "), F.lit("}")))
    path = scratch_path(t.spark, "features")
    artifacts.refresh_table(legacy, path)
    back = artifacts.load_table(t.spark, path)
    return back.select("mentee_id", F.array_join(F.col("interests_set").cast("array<string>"), ",").alias("interests"))


def spoilt_export(t: Tables) -> str:
    """A folder with an export of likes in four files; of every fifty lines one lacks fields and one has too many."""
    line = F.concat_ws(";", "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    spoilt = (F.when(F.col("event_id") % 50 == 0, F.col("event_id").cast("string"))
              .when(F.col("event_id") % 50 == 1, F.concat(line, F.lit(";x;y"))).otherwise(line))
    lines = t.events.select((F.col("event_id") % 4).cast("int").alias("part"), F.lit(1).alias("after"), spoilt.alias("value"))
    heads = t.spark.range(4).select(F.col("id").cast("int"), F.lit(0), F.lit("LikeId;UserId;CreatedAt"))
    folder = scratch_path(t.spark, "export")
    (lines.union(heads).repartition(4, "part").sortWithinPartitions("part", "after").select("part", "value")
     .write.partitionBy("part").text(f"{folder}/community_post_likes.csv"))
    return folder


@check("checked_folder_rows", "A1 A6", """
SELECT event_id AS like_id, user_id, date_trunc('second', ts) AS created_at FROM events WHERE event_id % 50 > 1""")
def checked_folder_rows(t: Tables):
    """The well-formed lines of an export, mapped to the logical table."""
    likes = tables.read_tables_checked(t.spark, spoilt_export(t), ["posts_likes_dataset"])[0]["posts_likes_dataset"]
    return likes.select("like_id", "user_id", "created_at")


@check("checked_folder_rejects", "A1 A6", """
SELECT 'posts_likes_dataset' AS "table",
       CASE WHEN event_id % 50 = 0 THEN CAST(event_id AS VARCHAR)
            ELSE concat(event_id, ';', user_id, ';', strftime(ts, '%Y-%m-%d %H:%M:%S'), ';x;y') END AS record,
       CASE WHEN event_id % 50 = 0 THEN 'too few fields' ELSE 'too many fields' END AS reason
FROM events WHERE event_id % 50 < 2""")
def checked_folder_rejects(t: Tables):
    """The malformed lines of the same export, each with its reason."""
    rejected = tables.read_tables_checked(t.spark, spoilt_export(t), ["posts_likes_dataset"])[1]
    return rejected.select("table", "record", "reason")


@check("split_config_round_trip", "A10 A9", """
SELECT date_trunc('day', make_timestamp(CAST(quantile_cont(epoch_us(applied_at), 0.70) AS BIGINT))) = train_end AS same_train
FROM f_applications, (SELECT date_trunc('day', make_timestamp(CAST(quantile_cont(epoch_us(applied_at), 0.70) AS BIGINT))) AS train_end
                      FROM f_applications) GROUP BY train_end""")
def split_config_round_trip(t: Tables):
    config = splits.build_split_config(t.f_mentorships, t.f_applications)
    path = scratch_path(t.spark, "split")
    artifacts.save_split_config(splits.config_frame(t.spark, config), path)
    back = artifacts.load_split_config(t.spark, path)
    return back.select((F.col("train_end") == config.at("train_end")).alias("same_train"))


@check("clean_table", "B1 B2 B3 B4 B5 B10", """
WITH raw AS (
  SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE s_suppkey % 16 END AS years,
         CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE (s_suppkey % 11) / 2.0E0 END AS rating,
         CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 13 END AS reviews,
         CASE WHEN s_suppkey % 5 = 0 THEN '  ' ELSE s_name END AS bio FROM supplier)
SELECT user_id, coalesce(CAST(years AS DOUBLE), (SELECT quantile_cont(years, 0.5) FROM raw)) AS years_of_experience,
       coalesce(rating, (SELECT quantile_cont(rating, 0.5) FROM raw)) AS average_rating,
       coalesce(reviews, 0) AS total_reviews, coalesce(nullif(trim(bio), ''), 'unknown') AS bio
FROM raw""")
def clean_table(t: Tables):
    raw = t.sql("""SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE s_suppkey % 16 END AS years_of_experience,
        CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE (s_suppkey % 11) / 2.0E0 END AS average_rating,
        CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 13 END AS total_reviews,
        CASE WHEN s_suppkey % 5 = 0 THEN '  ' ELSE concat(' ', s_name) END AS bio FROM supplier""")
    return cleaning.clean_table(raw.union(raw), "mentor_profile")


@check("drop_invalid_ids", "B3", """
SELECT mentorship_id, mentor_id, mentee_id, rating FROM f_feedback WHERE mentorship_id % 3 <> 0 AND mentee_id % 4 <> 0""")
def drop_invalid_ids(t: Tables):
    broken = t.f_feedback.select(
        F.when(F.col("mentorship_id") % 3 != 0, F.col("mentorship_id")).alias("mentorship_id"), "mentor_id",
        F.when(F.col("mentee_id") % 4 != 0, F.col("mentee_id")).alias("mentee_id"), "rating")
    return cleaning.drop_invalid_ids(broken, "mentors_feedback")


@check("normalize_experience", "B6 B7", """
SELECT user_id, w AS experience_level,
       CASE w WHEN 'none' THEN 1 WHEN 'beginner' THEN 2 WHEN 'intermediate' THEN 3 ELSE 4 END AS experience_level_num
FROM (SELECT user_id, CASE WHEN lower(trim(current_level)) IN ('beginner', 'junior', '2') THEN 'beginner'
             WHEN lower(trim(current_level)) IN ('intermediate', 'mid', '3') THEN 'intermediate'
             WHEN lower(trim(current_level)) IN ('advanced', 'senior', '4') THEN 'advanced' ELSE 'none' END AS w
      FROM f_mentee_profile)""")
def normalize_experience(t: Tables):
    df = t.f_mentee_profile.select("user_id", F.col("current_level").alias("experience_level"))
    return cleaning.normalize_experience_columns(df, ["experience_level"])


@check("level_numbers", "B8 B9", """
SELECT m.mentee_id, m.level, m.education,
       CASE lower(trim(p.current_level)) WHEN 'none' THEN 1 WHEN 'beginner' THEN 2 WHEN 'intermediate' THEN 3
            WHEN 'advanced' THEN 4 ELSE coalesce(try_cast(p.current_level AS INTEGER), 1) END AS target
FROM x_mentee m JOIN f_mentee_profile p ON p.user_id = m.mentee_id""")
def level_numbers(t: Tables):
    return t.f_mentee_profile.select(
        F.col("user_id").alias("mentee_id"), enums.encode_profile_level(F.col("current_level")).alias("level"),
        enums.education_num(F.col("education_status")).alias("education"),
        enums.level_num(F.col("current_level")).alias("target"))


@check("business_key_dedup", "B10 I4", """
SELECT mentorship_id, post_id, mentor_id FROM (
  SELECT *, row_number() OVER (PARTITION BY mentorship_id ORDER BY start_date NULLS LAST, post_id NULLS LAST, mentor_id NULLS LAST) AS rn
  FROM f_mentorships) WHERE rn = 1""")
def business_key_dedup(t: Tables):
    rows = t.f_mentorships.select("mentorship_id", "post_id", "mentor_id", "mentee_id", "status", "start_date", "end_date")
    return cleaning.drop_duplicates(rows, "mentorships").select("mentorship_id", "post_id", "mentor_id")


@check("filter_by_time", "B11", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30 00:00:00'")
def filter_by_time(t: Tables):
    return cleaning.filter_by_time(t.orders, "o_orderdate", F.lit("1998-06-30 00:00:00")).select("o_orderkey", "o_custkey")


@check("parse_datetimes", "B12 N25", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
def parse_datetimes(t: Tables):
    text = (F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "d/M/yyyy HH:mm"))
            .otherwise(F.lit("not a date")))
    return t.orders.select("o_orderkey", F.date_format(dates.parse_time(text), "yyyy-MM-dd").alias("parsed"))


@check("renamed_sender", "B13 A3", "SELECT event_id AS share_id, user_id, post_id FROM f_engagement WHERE kind = 'share'")
def renamed_sender(t: Tables):
    raw = t.f_engagement.where("kind = 'share'").select(
        F.col("event_id").alias("ShareId"), F.col("user_id").alias("sender_id"), F.col("post_id").alias("ProgramId"))
    return tables.map_table(raw, TABLES["shared_posts_dataset"]).select("share_id", "user_id", "post_id")


@check("enum_normalizers", "B14", """
SELECT app_id, post_id,
       CASE WHEN lower(trim(status)) = 'accepted' THEN 'Accepted' WHEN lower(trim(status)) IN ('rejected', 'canceled', 'cancelled') THEN 'Rejected'
            ELSE 'Pending' END AS application_status,
       CASE WHEN lower(status) = 'alerted' THEN '0' ELSE '1' END AS meets,
       CASE WHEN lower(is_open) = 'draft' THEN 'Draft' ELSE 'Published' END AS post_status,
       CASE lower(target_level) WHEN 'intermediate' THEN 'Mid' WHEN '4' THEN 'Senior' ELSE 'Beginner' END AS target_level,
       CASE lower(education_level) WHEN 'freshman' THEN 'Freshman' WHEN 'sophomore' THEN 'Sophomore' WHEN 'junior' THEN 'Junior'
            WHEN 'senior' THEN 'Senior' ELSE 'Graduate' END AS education_level,
       CASE lower(target_level) WHEN 'none' THEN 'None' WHEN 'intermediate' THEN 'Intermediate' WHEN '4' THEN 'Advanced' ELSE 'Beginner' END AS experience_name
FROM f_applications JOIN f_programs USING (post_id)""")
def enum_normalizers(t: Tables):
    joined = t.f_applications.join(t.f_programs.drop("mentor_id"), "post_id")
    return joined.select(
        "app_id", "post_id", enums.application_status(F.col("status")).alias("application_status"),
        enums.meets_requirements(F.col("status")).alias("meets"), enums.post_status(F.col("is_open")).alias("post_status"),
        enums.target_level(F.col("target_level")).alias("target_level"),
        enums.education_level(F.col("education_level")).alias("education_level"),
        enums.experience_name(F.col("target_level")).alias("experience_name"))


@check("cancellation_enums", "B14", """
SELECT m.mentorship_id, m.post_id,
       CASE lower(m.status) WHEN 'completed' THEN 'Completed' WHEN 'cancelled' THEN 'Cancelled' ELSE 'Active' END AS mentorship_status,
       CASE WHEN lower(c.cancellation_actor) = 'mentor' THEN '1' ELSE '2' END AS actor_code,
       CASE m.mentorship_id % 4 WHEN 0 THEN 'LostInterest' WHEN 1 THEN 'TimeZoneIssue' WHEN 2 THEN 'NotReadyYet' ELSE 'PersonalIssue' END AS reason
FROM f_mentorships m LEFT JOIN (SELECT DISTINCT mentorship_id, cancellation_actor FROM f_cancellations) c ON c.mentorship_id = m.mentorship_id""")
def cancellation_enums(t: Tables):
    actor = t.f_cancellations.select("mentorship_id", "cancellation_actor").distinct()
    reason = (F.when(F.col("mentorship_id") % 4 == 0, "lost_interest").when(F.col("mentorship_id") % 4 == 1, "TimeZoneIssue")
              .when(F.col("mentorship_id") % 4 == 2, " not_ready_yet").otherwise("something else"))
    return t.f_mentorships.join(actor, "mentorship_id", "left").select(
        "mentorship_id", "post_id", enums.mentorship_status(F.col("status")).alias("mentorship_status"),
        enums.cancellation_actor_code(F.col("cancellation_actor")).alias("actor_code"),
        enums.cancellation_reason(reason).alias("reason"))


@check("scalar_casts", "B15 B23", """
SELECT event_id, CASE WHEN lower(v) IN ('1', 'true', 'yes') THEN 1 ELSE 0 END AS bit,
       coalesce(CAST(trunc(try_cast(v AS DOUBLE)) AS BIGINT), -1) AS whole, coalesce(try_cast(v AS DOUBLE), 0) AS number
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN 'Yes' WHEN 2 THEN '3.9' WHEN 3 THEN 'TRUE' WHEN 4 THEN ''
             ELSE CAST(value AS VARCHAR) END AS v FROM events)""")
def scalar_casts(t: Tables):
    v = (F.when(F.col("event_id") % 6 == 0, "1").when(F.col("event_id") % 6 == 1, "Yes").when(F.col("event_id") % 6 == 2, "3.9")
         .when(F.col("event_id") % 6 == 3, "TRUE").when(F.col("event_id") % 6 == 4, "").otherwise(F.col("value").cast("string")))
    return t.events.select("event_id", numbers.bit(v).alias("bit"), F.coalesce(numbers.int_or_null(v), F.lit(-1)).alias("whole"),
                           numbers.safe_double(v).alias("number"))


@check("boolean_like_columns", "B16 B17", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS flag,
       CASE event_type WHEN 'error' THEN '' ELSE event_type END AS label FROM events""")
def boolean_like_columns(t: Tables):
    kind = F.col("event_type")
    raw = F.when(kind == "click", " Y ").when(kind == "view", "1").when(kind == "purchase", "off").when(kind == "error", "maybe")
    label = F.when(kind == "error", " NaN").otherwise(F.upper(kind))
    return t.events.select("event_id", numbers.bool_like(raw).alias("flag"), enums.enum_label(label).alias("label"))


@check("feedback_validation", "B18", """
SELECT mentorship_id, mentor_id, greatest(1.0, least(5.0, CAST(rating AS DOUBLE))) AS rating,
       CASE WHEN mentorship_id % 5 = 0 THEN 'neutral' ELSE lower(trim(sentiment)) END AS sentiment
FROM f_feedback WHERE mentorship_id % 7 <> 0""")
def feedback_validation(t: Tables):
    raw = t.f_feedback.select(
        "mentorship_id", "mentor_id", F.when(F.col("mentorship_id") % 7 == 0, "?").otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(F.col("mentorship_id") % 5 == 0, "angry").otherwise(F.col("sentiment")).alias("sentiment"))
    return cleaning.validate_feedback(raw)


@check("safe_account_filter", "B21 C5 C4", """
SELECT mentee_id, mentor_id FROM f_scored WHERE mentor_id IN (SELECT user_id FROM f_mentor_profile WHERE is_active = 1)
  AND mentor_id NOT IN (SELECT user_id FROM f_mentor_profile WHERE user_id % 17 = 3)""")
def safe_account_filter(t: Tables):
    profile = t.f_mentor_profile.withColumn("is_banned", numbers.flag(F.col("user_id") % 17 == 3))
    return cleaning.safe_accounts(t.f_scored, profile).select("mentee_id", "mentor_id")


@check("numeric_guards", "B23 B24 B25", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 0 ELSE value END AS guarded,
       CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE value END AS filled
FROM events""")
def numeric_guards(t: Tables):
    x = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    gap = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return t.events.select("event_id", numbers.finite_or_zero(x).alias("guarded"), gap.alias("filled")).fillna({"filled": 0.5})


@check("without_alerted", "B22", "SELECT app_id, post_id, status FROM f_applications WHERE lower(status) <> 'alerted'")
def without_alerted(t: Tables):
    return cleaning.without_alerted(t.f_applications).select("app_id", "post_id", "status")


@check("time_split_boundaries", "D19", """
WITH q AS (SELECT date_trunc('day', make_timestamp(CAST(quantile_cont(epoch_us(applied_at), 0.70) AS BIGINT))) AS a,
                  date_trunc('day', make_timestamp(CAST(quantile_cont(epoch_us(applied_at), 0.85) AS BIGINT))) AS b FROM f_applications),
v AS (SELECT a, CASE WHEN b <= a THEN a + INTERVAL 1 DAY ELSE b END AS b FROM q)
SELECT strftime(a, '%Y-%m-%d') AS train_end, strftime(b, '%Y-%m-%d') AS valid_end,
       strftime(b + INTERVAL 1 DAY, '%Y-%m-%d') AS test_start FROM v""")
def time_split_boundaries(t: Tables):
    row = splits.split_boundaries(t.f_applications, "applied_at")
    return row.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in row.columns])


CONFIG = splits.SplitConfig("1998-06-30 00:00:00", "1999-12-31 00:00:00", "2000-01-01 00:00:00")


@check("time_split_tags", "M23 H5 D20", """
SELECT time_split, lower(status) AS status, count(*) AS n FROM (
  SELECT status, CASE WHEN applied_at <= TIMESTAMP '1998-06-30 00:00:00' THEN 'train'
              WHEN applied_at <= TIMESTAMP '1999-12-31 00:00:00' THEN 'valid' ELSE 'test' END AS time_split FROM f_applications)
GROUP BY time_split, lower(status)""")
def time_split_tags(t: Tables):
    tagged = splits.apply_time_split(t.f_applications, "applied_at", CONFIG)
    return tagged.groupBy("time_split", F.lower("status").alias("status")).agg(F.count("*").alias("n"))


@check("first_last_links", "C14 G9", """
WITH links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mentorship_id ORDER BY start_date, mentee_id, mentor_id, status) AS rn
               FROM f_mentorships) WHERE rn = 1),
cancels AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mentorship_id ORDER BY cancellation_date DESC NULLS LAST, cancellation_actor) AS rn
            FROM f_cancellations) WHERE rn = 1)
SELECT l.mentorship_id, l.mentee_id, l.mentor_id, l.status, c.cancellation_actor, strftime(c.cancellation_date, '%Y-%m-%d') AS cancelled_on
FROM links l LEFT JOIN cancels c ON c.mentorship_id = l.mentorship_id""")
def first_last_links(t: Tables):
    links = splits.mentorship_links(t.f_mentorships)
    last = splits.last_cancellations(t.f_cancellations)
    return links.join(last, "mentorship_id", "left").select(
        "mentorship_id", "mentee_id", "mentor_id", "status", "cancellation_actor",
        F.date_format("cancellation_date", "yyyy-MM-dd").alias("cancelled_on"))


@check("feedback_business_rules", "C13 M22 D2", """
WITH links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mentorship_id ORDER BY start_date, mentee_id, mentor_id, status) AS rn
               FROM f_mentorships) WHERE rn = 1),
cancels AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mentorship_id ORDER BY cancellation_date DESC NULLS LAST, cancellation_actor) AS rn
            FROM f_cancellations) WHERE rn = 1)
SELECT f.mentorship_id, f.mentee_id, f.mentor_id, f.rating, f.sentiment
FROM f_feedback f JOIN links l ON l.mentorship_id = f.mentorship_id AND l.mentee_id = f.mentee_id AND l.mentor_id = f.mentor_id
LEFT JOIN cancels c ON c.mentorship_id = f.mentorship_id
WHERE (lower(l.status) IN ('active', 'completed') OR (lower(l.status) = 'cancelled' AND lower(c.cancellation_actor) IN ('mentor', '1')))
  AND l.start_date <= TIMESTAMP '1998-06-30 00:00:00'
  AND (c.cancellation_date IS NULL OR c.cancellation_date <= TIMESTAMP '1998-06-30 00:00:00')""")
def feedback_business_rules(t: Tables):
    kept = splits.feedback_for_training(t.f_feedback, t.f_mentorships, t.f_cancellations, CONFIG.at("train_end"))
    return kept.select("mentorship_id", "mentee_id", "mentor_id", "rating", "sentiment")


def raw_tables(t: Tables) -> dict:
    """The fixture as the raw table set the flows start from."""
    events = t.f_engagement
    return {
        "mentee_profile": t.f_mentee_profile, "mentor_profile": t.f_mentor_profile,
        "mentee_subdomains": t.f_mentee_subdomains, "mentor_subdomains": t.f_mentor_subdomains,
        "mentee_interests": t.f_mentee_interests, "mentor_expertise": t.f_mentor_expertise,
        "mentorship_posts": t.f_programs, "mentorship_requirements": t.f_requirements,
        "mentorships": t.f_mentorships, "mentorship_applications": t.f_applications.drop("mentor_id"),
        "mentors_feedback": t.f_feedback, "follows": t.f_follows, "mentorship_cancellation": t.f_cancellations,
        "posts_likes_dataset": events.where("kind = 'like'"), "posts_comments": events.where("kind = 'comment'"),
        "saved_posts_dataset": events.where("kind = 'save'"),
        "shared_posts_dataset": events.where("kind = 'share'").withColumnRenamed("created_at", "shared_at"),
        "subdomains": t.f_subdomains,
    }


@check("prepared_tables", "M24 M8 C13 B11", """
SELECT 'follows' AS name, count(*) AS n FROM f_follows WHERE created_at <= TIMESTAMP '1998-06-30 00:00:00'
UNION ALL SELECT 'mentorship_posts', count(DISTINCT post_id) FROM f_programs WHERE created_at <= TIMESTAMP '1998-06-30 00:00:00'
UNION ALL SELECT 'mentorship_applications', count(*) FROM f_applications
UNION ALL SELECT 'mentorships', count(DISTINCT mentorship_id) FROM f_mentorships
UNION ALL SELECT 'mentee_profile', count(*) FROM f_mentee_profile
UNION ALL SELECT 'mentorship_cancellation', count(*) FROM f_cancellations WHERE cancellation_date <= TIMESTAMP '1998-06-30 00:00:00'""")
def prepared_tables(t: Tables):
    prepared = splits.prepare_tables(raw_tables(t), CONFIG)
    out = None
    for name in ("follows", "mentorship_posts", "mentorship_applications", "mentorships", "mentee_profile", "mentorship_cancellation"):
        one = prepared[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@check("deadline_days", "N25 B20 D12", """
SELECT post_id, CAST(floor(epoch(deadline - TIMESTAMP '1998-06-30 12:00:00') / 86400) AS INTEGER) AS days_left,
       CASE WHEN deadline <= TIMESTAMP '1998-06-30 12:00:00' THEN 1 ELSE 0 END AS passed,
       strftime(date_trunc('day', deadline) + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day
FROM f_programs""")
def deadline_days(t: Tables):
    ref = F.lit("1998-06-30 12:00:00").cast("timestamp")
    return t.f_programs.select(
        "post_id", dates.days_until(F.col("deadline"), ref).alias("days_left"),
        dates.deadline_passed(F.col("deadline"), ref).alias("passed"),
        F.date_format(dates.add_days(dates.day(F.col("deadline")), 1), "yyyy-MM-dd").alias("next_day"))


@check("uuid_from_ids", "N4", """
SELECT c_custkey, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
       substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS user_uuid
FROM (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('mentorship.user.' || c_custkey)) AS h FROM customer)""")
def uuid_from_ids(t: Tables):
    return t.customer.select("c_custkey", ids.user_uuid(F.col("c_custkey").cast("string")).alias("user_uuid"))


@check("dense_user_numbers", "N5 N28", """
WITH u AS (SELECT DISTINCT md5(CAST(o_custkey AS VARCHAR)) AS uuid FROM orders
           UNION SELECT DISTINCT md5(CAST(l_suppkey AS VARCHAR)) FROM lineitem)
SELECT uuid, row_number() OVER (ORDER BY uuid) AS user_number, FALSE AS canonical FROM u WHERE try_cast(uuid AS BIGINT) IS NULL""")
def dense_user_numbers(t: Tables):
    mentees = t.orders.select(F.md5(F.col("o_custkey").cast("string")).alias("mentee_id"))
    mentors = t.lineitem.select(F.md5(F.col("l_suppkey").cast("string")).alias("mentor_id"))
    numbers_table = ids.uuid_numbers({"a": mentees, "b": mentors})
    return numbers_table.select("uuid", "user_number", ids.is_uuid(F.col("uuid")).alias("canonical"))


@check("uuid_mapping_round_trip", "N5", """
SELECT o_orderkey, md5(CAST(o_custkey AS VARCHAR)) AS mentee_id FROM orders""")
def uuid_mapping_round_trip(t: Tables):
    rows = t.orders.select("o_orderkey", F.md5(F.col("o_custkey").cast("string")).alias("mentee_id"))
    known = ids.uuid_numbers({"orders": rows})
    return ids.restore_uuids(ids.replace_uuids(rows, known), "mentee_id", known)


@check("exact_quantiles", "D19 M17 B5", """
SELECT round(quantile_cont(l_extendedprice, 0.05), 6) AS price_q5, round(quantile_cont(l_extendedprice, 0.5), 6) AS price_q50,
       round(quantile_cont(l_extendedprice, 0.95), 6) AS price_q95, round(quantile_cont(l_discount - 0.05, 0.25), 6) AS shift_q25,
       round(quantile_cont(l_discount - 0.05, 0.99), 6) AS shift_q99 FROM lineitem""")
def exact_quantiles(t: Tables):
    from matchspark.operators.quantiles import quantiles_wide
    df = t.lineitem.select(F.col("l_extendedprice").alias("price"), (F.col("l_discount") - 0.05).alias("shift"))
    q = quantiles_wide(df, ["price", "shift"], [0.05, 0.25, 0.5, 0.95, 0.99])
    return r6(q.select("price_q5", "price_q50", "price_q95", "shift_q25", "shift_q99"))


@check("scalar_attach", "D3 G8", """
SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 6) AS share,
       round(p_size - (SELECT avg(p_size) FROM part), 6) AS centred FROM part""")
def scalar_attach(t: Tables):
    out = with_scalars(t.part, t.part, top=F.max("p_retailprice"), mean=F.avg("p_size"))
    return r6(out.select("p_partkey", (F.col("p_retailprice") / F.col("top")).alias("share"),
                         (F.col("p_size") - F.col("mean")).alias("centred")))


@check("features_by_saved_manifest", "A9 M8 M11 M20", """
SELECT c_custkey AS mentee_id, c_nationkey AS mentor_id, c_nationkey % 5 AS nation_count, CAST(c_acctbal AS DOUBLE) AS balance, CAST(0.5 AS DOUBLE) AS cf_score
FROM customer""")
def features_by_saved_manifest(t: Tables):
    """Checked rows in the order of a manifest that was written and read back; the optional column they lack is filled."""
    rows = t.customer.select(
        F.col("c_acctbal").cast("double").alias("balance"), F.col("c_custkey").alias("mentee_id"),
        F.col("c_nationkey").alias("mentor_id"), (F.col("c_nationkey") % 5).alias("nation_count"))
    quality.require_ids(rows)
    features = ["nation_count", "balance", "cf_score"]
    quality.schema_report(rows, ["mentee_id", "mentor_id", *features], ["mentee_id", "balance"], {"balance": "numeric"})
    path = scratch_path(t.spark, "manifest")
    artifacts.save_manifest(t.spark, quality.feature_manifest(features, ["balance"], "v1"), path)
    manifest = artifacts.load_manifest(t.spark, path)
    quality.require_compatible(manifest, "v1", scaled=["balance"], features=features)
    return quality.align_to_manifest(rows, manifest, strict=False, fill={"cf_score": 0.5})
