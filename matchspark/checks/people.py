"""Queries: mentee and mentor features, candidate pool, pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchspark.checks.registry import check
from matchspark.fixtures import Tables
from matchspark.plans import candidates, pairs, people
from matchspark.session import materialize


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places, as the oracles do."""
    return df.select(*[(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def text_set(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return df


def engagement(t: Tables) -> DataFrame:
    return t.f_engagement.withColumnRenamed("created_at", "event_time")


def mentees(t: Tables) -> DataFrame:
    return people.mentee_features(t.f_mentee_profile, t.f_mentee_subdomains, t.f_mentee_interests)


def mentors(t: Tables) -> DataFrame:
    return people.mentor_features(
        t.f_mentor_profile, t.f_mentor_subdomains, t.f_mentor_expertise, t.f_feedback, t.f_applications,
        t.f_programs, t.f_cancellations, t.f_mentorships, t.f_follows, engagement(t))


def pool(t: Tables, explore: bool = False, people_tables=None) -> DataFrame:
    mentee_table, mentor_table = people_tables or stored_people(t)
    return candidates.candidate_pool(mentee_table, mentor_table, t.f_subdomains, explore=explore)


def stored_people(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Both feature tables as written stages, as the flows use them."""
    return materialize(mentees(t), "mentees"), materialize(mentors(t), "mentors")


@check("mentee_features", "D9 D1 B8 C2", """
SELECT m.mentee_id, m.level AS experience_level_num,
       CASE m.level WHEN 1 THEN 'none' WHEN 2 THEN 'beginner' WHEN 3 THEN 'intermediate' ELSE 'advanced' END AS experience_level,
       m.education_status, m.country AS country_code, CAST(m.domain_id AS BIGINT) AS domain_id,
       coalesce(s.ids, '') AS subdomains_set, coalesce(i.ids, '') AS interests_set
FROM x_mentee m
LEFT JOIN (SELECT mentee_id, string_agg(CAST(subdomain_id AS VARCHAR), ',' ORDER BY subdomain_id) AS ids
           FROM f_mentee_subdomains GROUP BY mentee_id) s ON s.mentee_id = m.mentee_id
LEFT JOIN (SELECT mentee_id, string_agg(CAST(technology_id AS VARCHAR), ',' ORDER BY technology_id) AS ids
           FROM f_mentee_interests GROUP BY mentee_id) i ON i.mentee_id = m.mentee_id""")
def mentee_features(t: Tables):
    return text_set(mentees(t), "subdomains_set", "interests_set")


@check("mentor_quality", "D2 D3 D4", """
SELECT mentor_id, round(avg_rating, 6) AS mentor_avg_rating, reviews AS mentor_review_count,
       round(CAST(sentiment AS DOUBLE), 6) AS mentor_sentiment_score, round(CAST(positive AS DOUBLE), 6) AS mentor_positive_feedback_ratio,
       round(weighted, 6) AS mentor_weighted_rating, round(quality, 6) AS mentor_quality_score
FROM x_quality""")
def mentor_quality(t: Tables):
    return r6(people.mentor_quality(t.f_feedback))


@check("mentor_reliability", "D5 C1", """
SELECT mentor_id, round(completion, 6) AS mentor_completion_rate, round(cancel, 6) AS mentor_cancel_rate,
       round(0.7 * completion - 0.3 * cancel, 6) AS mentor_reliability_score
FROM x_reliability""")
def mentor_reliability(t: Tables):
    return r6(people.mentor_reliability(t.f_applications, t.f_programs, t.f_cancellations))


@check("mentor_popularity", "D6 C3 N1", """
SELECT mentor_id, programs AS mentor_program_count, enrollments AS mentor_enrollment_count,
       engagements AS mentor_engagement_count, round(popularity, 6) AS mentor_program_popularity
FROM x_popularity""")
def mentor_popularity(t: Tables):
    return r6(people.mentor_popularity(t.f_programs, t.f_mentorships, engagement(t)))


@check("mentor_social", "D7 C5 B19", """
SELECT mentor_id, round(followers_log, 6) AS mentor_follower_count_log, round(open_log, 6) AS mentor_open_post_count_log
FROM x_social""")
def mentor_social(t: Tables):
    return r6(people.mentor_social(t.f_follows, t.f_programs, t.f_mentor_profile))


@check("mentor_features", "D8 C2 D1", """
SELECT m.mentor_id, level AS experience_level_num, country AS country_code, CAST(domain_id AS BIGINT) AS domain_id,
       coalesce(s.ids, '') AS subdomains_set, coalesce(e.ids, '') AS expertise_set,
       round(avg_rating, 6) AS mentor_avg_rating, reviews AS mentor_review_count,
       round(CAST(sentiment AS DOUBLE), 6) AS mentor_sentiment_score, round(CAST(positive AS DOUBLE), 6) AS mentor_positive_feedback_ratio,
       round(weighted, 6) AS mentor_weighted_rating, round(quality, 6) AS mentor_quality_score,
       round(completion, 6) AS mentor_completion_rate, round(cancel, 6) AS mentor_cancel_rate,
       round(0.7 * completion - 0.3 * cancel, 6) AS mentor_reliability_score,
       round(popularity, 6) AS mentor_program_popularity, round(followers_log, 6) AS mentor_follower_count_log,
       round(open_log, 6) AS mentor_open_post_count_log
FROM x_mentor m
LEFT JOIN (SELECT mentor_id, string_agg(CAST(subdomain_id AS VARCHAR), ',' ORDER BY subdomain_id) AS ids
           FROM f_mentor_subdomains GROUP BY mentor_id) s ON s.mentor_id = m.mentor_id
LEFT JOIN (SELECT mentor_id, string_agg(CAST(technology_id AS VARCHAR), ',' ORDER BY technology_id) AS ids
           FROM f_mentor_expertise GROUP BY mentor_id) e ON e.mentor_id = m.mentor_id""")
def mentor_features(t: Tables):
    return r6(text_set(mentors(t), "subdomains_set", "expertise_set"))


@check("interaction_features", "D10 I3 I4", """
SELECT user_id, mentor_id, CAST(sum(score) AS BIGINT) AS interaction_score, count(*) AS interaction_count,
       round(ln(1 + sum(score)), 6) AS interaction_score_log, round(ln(1 + count(*)), 6) AS interaction_count_log
FROM (SELECT DISTINCT kind, user_id, post_id, score FROM f_engagement) e JOIN x_owner o ON o.post_id = e.post_id
GROUP BY user_id, mentor_id""")
def interaction_features(t: Tables):
    return r6(people.interaction_features(engagement(t), t.f_programs))


@check("community_sets", "D13", """
SELECT user_id, string_agg(CAST(community_id AS VARCHAR), ',' ORDER BY community_id) AS communities
FROM f_communities GROUP BY user_id""")
def community_sets(t: Tables):
    return text_set(people.community_sets(t.f_communities), "communities")


@check("candidate_pool", "F1 C7 C8 C9 F2 F3", "SELECT mentee_id, mentor_id FROM x_pool")
def candidate_pool(t: Tables):
    return pool(t)


@check("candidate_pool_explored", "F4")
def candidate_pool_explored(t: Tables):
    return pool(t, explore=True)


@check("fallback_candidates", "F5 C4", """
SELECT mentee_id, mentor_id FROM f_applications
UNION
SELECT m.mentee_id, g.mentor_id FROM (SELECT mentee_id FROM x_mentee WHERE mentee_id NOT IN (SELECT mentee_id FROM f_applications)) m,
     (SELECT mentor_id FROM x_mentor ORDER BY round(popularity, 9) DESC, mentor_id LIMIT 20) g""")
def fallback_candidates(t: Tables):
    applied = t.f_applications.select("mentee_id", "mentor_id").distinct()
    return candidates.force_fallback(applied, mentees(t), mentors(t), 20)


@check("first_event_times", "D14", """
SELECT mentee_id, strftime(event_time, '%Y-%m-%d') AS event_day FROM x_event_time""")
def first_event_times(t: Tables):
    return candidates.first_event_times(t.f_applications).select(
        "mentee_id", F.date_format("event_time", "yyyy-MM-dd").alias("event_day"))


@check("asof_pair_interactions", "C10 G4", """
SELECT mentee_id, mentor_id, round(score_log, 6) AS interaction_score_log, round(count_log, 6) AS interaction_count_log
FROM x_asof_interactions""")
def asof_pair_interactions(t: Tables):
    return r6(pairs.asof_interactions(pool(t), candidates.first_event_times(t.f_applications), engagement(t), t.f_programs))


@check("asof_followers", "C11 G4", """
SELECT mentee_id, mentor_id, round(followers_log, 6) AS mentor_follower_count_log FROM x_asof_followers""")
def asof_followers(t: Tables):
    return r6(pairs.asof_followers(pool(t), candidates.first_event_times(t.f_applications), t.f_follows))


@check("asof_popularity", "C12 G4", """
SELECT mentee_id, mentor_id, round(popularity, 6) AS mentor_program_popularity FROM x_asof_popularity""")
def asof_popularity(t: Tables):
    return r6(pairs.asof_popularity(pool(t), candidates.first_event_times(t.f_applications), t.f_programs,
                                    t.f_mentorships, engagement(t)))


@check("pair_features", "E14 E1 E2 E3 E4 E5 E15 G1 B25 C2", """
SELECT mentee_id, mentor_id, round(skill_overlap_score, 6) AS skill_overlap_score,
       round(skill_coverage_score, 6) AS skill_coverage_score, round(subdomain_similarity, 6) AS subdomain_similarity,
       mentor_covers_all_skills, CAST(extra_skill_count AS INTEGER) AS extra_skill_count, skill_match_type,
       round(mentor_quality_score, 6) AS mentor_quality_score, round(mentor_weighted_rating, 6) AS mentor_weighted_rating,
       round(interaction_score_log, 6) AS interaction_score_log, round(interaction_count_log, 6) AS interaction_count_log,
       experience_gap_abs, mentor_more_experienced, experience_match_bucket, round(CAST(soft_gap_score AS DOUBLE), 6) AS soft_gap_score,
       same_country, round(popularity_log, 6) AS popularity_log, round(mentor_follower_count_log, 6) AS mentor_follower_count_log,
       round(mentor_open_post_count_log, 6) AS mentor_open_post_count_log, mentor_domain_match,
       CAST(0 AS DOUBLE) AS cf_score, round(community_overlap, 6) AS community_overlap, is_following
FROM x_pairs""")
def pair_features(t: Tables):
    both = stored_people(t)
    return r6(pairs.pair_features(
        materialize(pool(t, people_tables=both), "pool"), *both, t.f_follows, event_times=candidates.first_event_times(t.f_applications),
        engagement=engagement(t), posts=t.f_programs, mentorships=t.f_mentorships, follows_raw=t.f_follows,
        communities=people.community_sets(t.f_communities)))
