"""Views used only by oracle SQL (names start with ``x_``): the plans restated as plain SQL."""

ORACLE_VIEWS: dict[str, str] = {}

ORACLE_VIEWS["x_mentee"] = """
SELECT user_id AS mentee_id, domain_id,
       CASE WHEN lower(trim(current_level)) IN ('beginner', 'junior', '2') THEN 2
            WHEN lower(trim(current_level)) IN ('intermediate', 'mid', '3') THEN 3
            WHEN lower(trim(current_level)) IN ('advanced', 'senior', '4') THEN 4 ELSE 1 END AS level,
       lower(trim(country_code)) AS country,
       lower(trim(education_status)) AS education_status,
       CASE lower(trim(education_status)) WHEN 'freshman' THEN 1 WHEN 'sophomore' THEN 2 WHEN 'junior' THEN 3
            WHEN 'senior' THEN 4 WHEN 'graduate' THEN 5
            ELSE coalesce(try_cast(try_cast(education_status AS DOUBLE) AS INTEGER), 0) END AS education
FROM f_mentee_profile"""

ORACLE_VIEWS["x_owner"] = "SELECT DISTINCT post_id, mentor_id FROM f_programs"

ORACLE_VIEWS["x_quality_base"] = """
SELECT mentor_id, coalesce(avg(CASE WHEN rating BETWEEN 1 AND 5 THEN rating END), 0) AS avg_rating,
       count(*) AS reviews,
       avg(CASE lower(trim(sentiment)) WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END) AS sentiment,
       avg(CASE WHEN lower(trim(sentiment)) = 'positive' THEN 1.0 ELSE 0.0 END) AS positive
FROM f_feedback GROUP BY mentor_id"""

ORACLE_VIEWS["x_quality"] = """
SELECT *, 0.60 * weighted + 0.25 * sentiment + 0.15 * positive AS quality FROM (
  SELECT *, (avg_rating * reviews + (SELECT avg(avg_rating) FROM x_quality_base) * 5) / (reviews + 5) AS weighted
  FROM x_quality_base)"""

ORACLE_VIEWS["x_reliability"] = """
SELECT d.mentor_id, completed / CAST(apps AS DOUBLE) AS completion, coalesce(cancels, 0) / CAST(apps AS DOUBLE) AS cancel
FROM (SELECT o.mentor_id, count(DISTINCT app_id) AS apps, sum(CASE WHEN lower(status) = 'accepted' THEN 1 ELSE 0 END) AS completed
      FROM f_applications a JOIN x_owner o ON a.post_id = o.post_id GROUP BY o.mentor_id) d
LEFT JOIN (SELECT mentor_id, count(mentorship_id) AS cancels FROM f_cancellations
           WHERE lower(cancellation_actor) IN ('mentor', '1') GROUP BY mentor_id) c ON d.mentor_id = c.mentor_id"""

ORACLE_VIEWS["x_popularity_raw"] = """
SELECT mentor_id, programs, enrollments, engagements,
       0.55 * ln(1 + enrollments) + 0.30 * ln(1 + programs) + 0.15 * ln(1 + engagements) AS raw
FROM (SELECT coalesce(p.mentor_id, e.mentor_id) AS mentor_id, coalesce(programs, 0) AS programs,
             coalesce(enrollments, 0) AS enrollments, coalesce(engagements, 0) AS engagements
      FROM (SELECT mentor_id, count(DISTINCT post_id) AS programs FROM f_programs GROUP BY mentor_id) p
      FULL JOIN (SELECT mentor_id, count(DISTINCT mentorship_id) AS enrollments FROM f_mentorships GROUP BY mentor_id) e
        ON p.mentor_id = e.mentor_id
      LEFT JOIN (SELECT mentor_id, count(*) AS engagements
                 FROM (SELECT DISTINCT kind, user_id, post_id FROM f_engagement) g JOIN x_owner USING (post_id)
                 GROUP BY mentor_id) g ON g.mentor_id = coalesce(p.mentor_id, e.mentor_id))"""

ORACLE_VIEWS["x_popularity"] = """
SELECT *, CASE WHEN cap > 0 THEN least(raw, cap) ELSE raw END AS popularity FROM (
  SELECT *, (SELECT quantile_cont(raw, 0.95) FROM x_popularity_raw) AS cap
  FROM x_popularity_raw)"""

ORACLE_VIEWS["x_social"] = """
SELECT m.user_id AS mentor_id, ln(1 + coalesce(followers, 0)) AS followers_log, ln(1 + coalesce(opened, 0)) AS open_log
FROM f_mentor_profile m
LEFT JOIN (SELECT following_id, count(*) AS followers FROM f_follows GROUP BY following_id) f ON f.following_id = m.user_id
LEFT JOIN (SELECT mentor_id, count(DISTINCT post_id) AS opened FROM f_programs
           WHERE lower(is_open) = 'published' AND lower(availability) IN ('open', 'opened') GROUP BY mentor_id) p
  ON p.mentor_id = m.user_id"""

ORACLE_VIEWS["x_mentor"] = """
SELECT m.user_id AS mentor_id, m.domain_id, lower(trim(m.country_code)) AS country,
       CASE WHEN coalesce(years_of_experience, 0) <= 2 THEN 1 WHEN years_of_experience <= 5 THEN 2
            WHEN years_of_experience <= 10 THEN 3 ELSE 4 END AS level,
       coalesce(q.avg_rating, 0) AS avg_rating, coalesce(q.reviews, 0) AS reviews, coalesce(q.weighted, 0) AS weighted,
       coalesce(q.quality, 0) AS quality, coalesce(q.sentiment, 0) AS sentiment, coalesce(q.positive, 0) AS positive,
       coalesce(r.completion, 0) AS completion, coalesce(r.cancel, 0) AS cancel,
       coalesce(p.popularity, 0) AS popularity, s.followers_log, s.open_log
FROM f_mentor_profile m LEFT JOIN x_quality q ON q.mentor_id = m.user_id
LEFT JOIN x_reliability r ON r.mentor_id = m.user_id LEFT JOIN x_popularity p ON p.mentor_id = m.user_id
JOIN x_social s ON s.mentor_id = m.user_id"""

ORACLE_VIEWS["x_mentee_domains"] = """
SELECT DISTINCT mentee_id, domain_id FROM f_mentee_subdomains JOIN f_subdomains USING (subdomain_id)"""

ORACLE_VIEWS["x_mentor_domains"] = """
SELECT DISTINCT mentor_id, domain_id FROM f_mentor_subdomains JOIN f_subdomains USING (subdomain_id)"""

ORACLE_VIEWS["x_tiers"] = """
SELECT mentee_id, mentor_id, 5 AS tier FROM f_mentee_interests JOIN f_mentor_expertise USING (technology_id)
UNION SELECT mentee_id, mentor_id, 4 FROM f_mentee_subdomains JOIN f_mentor_subdomains USING (subdomain_id)
UNION SELECT mentee_id, mentor_id, 3 FROM x_mentee_domains JOIN x_mentor_domains USING (domain_id)
UNION SELECT mentee_id, mentor_id, 1 FROM x_mentee,
      (SELECT mentor_id FROM x_mentor ORDER BY round(popularity, 9) DESC, mentor_id LIMIT 30)"""

ORACLE_VIEWS["x_pool"] = """
SELECT mentee_id, mentor_id FROM (
  SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY priority DESC, mentor_id) AS rn FROM (
    SELECT t.mentee_id, t.mentor_id, max(tier + CASE WHEN n.level >= m.level THEN 2 ELSE 0 END) AS priority
    FROM x_tiers t JOIN x_mentee m ON m.mentee_id = t.mentee_id JOIN x_mentor n ON n.mentor_id = t.mentor_id
    GROUP BY t.mentee_id, t.mentor_id))
WHERE rn <= 40"""

ORACLE_VIEWS["x_event_time"] = "SELECT mentee_id, min(applied_at) AS event_time FROM f_applications GROUP BY mentee_id"

ORACLE_VIEWS["x_owned"] = """
SELECT user_id AS mentee_id, mentor_id, score, created_at FROM f_engagement JOIN x_owner USING (post_id)"""

ORACLE_VIEWS["x_pair_sets"] = """
SELECT p.mentee_id, p.mentor_id, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(o.n, 0) AS o,
       coalesce(sa.n, 0) AS sa, coalesce(sb.n, 0) AS sb, coalesce(so.n, 0) AS so
FROM x_pool p
LEFT JOIN (SELECT mentee_id, count(*) AS n FROM f_mentee_interests GROUP BY mentee_id) a ON a.mentee_id = p.mentee_id
LEFT JOIN (SELECT mentor_id, count(*) AS n FROM f_mentor_expertise GROUP BY mentor_id) b ON b.mentor_id = p.mentor_id
LEFT JOIN (SELECT mentee_id, mentor_id, count(*) AS n FROM f_mentee_interests JOIN f_mentor_expertise USING (technology_id)
           GROUP BY mentee_id, mentor_id) o ON o.mentee_id = p.mentee_id AND o.mentor_id = p.mentor_id
LEFT JOIN (SELECT mentee_id, count(*) AS n FROM f_mentee_subdomains GROUP BY mentee_id) sa ON sa.mentee_id = p.mentee_id
LEFT JOIN (SELECT mentor_id, count(*) AS n FROM f_mentor_subdomains GROUP BY mentor_id) sb ON sb.mentor_id = p.mentor_id
LEFT JOIN (SELECT mentee_id, mentor_id, count(*) AS n FROM f_mentee_subdomains JOIN f_mentor_subdomains USING (subdomain_id)
           GROUP BY mentee_id, mentor_id) so ON so.mentee_id = p.mentee_id AND so.mentor_id = p.mentor_id"""

ORACLE_VIEWS["x_asof_interactions"] = """
SELECT p.mentee_id, p.mentor_id, ln(1 + coalesce(sum(e.score), 0)) AS score_log, ln(1 + count(e.score)) AS count_log
FROM x_pool p LEFT JOIN x_event_time t ON t.mentee_id = p.mentee_id
LEFT JOIN x_owned e ON e.mentee_id = p.mentee_id AND e.mentor_id = p.mentor_id
  AND e.created_at <= coalesce(t.event_time, (SELECT min(created_at) FROM x_owned))
GROUP BY p.mentee_id, p.mentor_id"""

ORACLE_VIEWS["x_asof_followers"] = """
SELECT p.mentee_id, p.mentor_id, ln(1 + count(f.created_at)) AS followers_log
FROM x_pool p LEFT JOIN x_event_time t ON t.mentee_id = p.mentee_id
LEFT JOIN f_follows f ON f.following_id = p.mentor_id
  AND f.created_at <= coalesce(t.event_time, (SELECT min(created_at) FROM f_follows))
GROUP BY p.mentee_id, p.mentor_id"""

ORACLE_VIEWS["x_popularity_events"] = """
SELECT mentor_id, created_at AS t, 1 AS p, 0 AS e, 0 AS g FROM f_programs
UNION ALL SELECT mentor_id, start_date, 0, 1, 0 FROM f_mentorships
UNION ALL SELECT mentor_id, created_at, 0, 0, 1 FROM x_owned"""

ORACLE_VIEWS["x_mentor_times"] = """
SELECT DISTINCT p.mentor_id, coalesce(t.event_time, (SELECT min(t) FROM x_popularity_events)) AS event_time
FROM x_pool p LEFT JOIN x_event_time t ON t.mentee_id = p.mentee_id"""

ORACLE_VIEWS["x_asof_counts"] = """
SELECT m.mentor_id, m.event_time, coalesce(sum(p), 0) AS p, coalesce(sum(e), 0) AS e, coalesce(sum(g), 0) AS g
FROM x_mentor_times m LEFT JOIN x_popularity_events v ON v.mentor_id = m.mentor_id AND v.t <= m.event_time
GROUP BY m.mentor_id, m.event_time"""

ORACLE_VIEWS["x_asof_raw"] = """
SELECT p.mentee_id, p.mentor_id,
       CASE WHEN g > 0 THEN 0.55 * ln(1 + e) + 0.30 * ln(1 + c.p) + 0.15 * ln(1 + g)
            ELSE 0.60 * ln(1 + e) + 0.40 * ln(1 + c.p) END AS raw
FROM x_pool p LEFT JOIN x_event_time t ON t.mentee_id = p.mentee_id
JOIN x_asof_counts c ON c.mentor_id = p.mentor_id
  AND c.event_time = coalesce(t.event_time, (SELECT min(t) FROM x_popularity_events))"""

ORACLE_VIEWS["x_asof_popularity"] = """
SELECT mentee_id, mentor_id, CASE WHEN cap > 0 THEN least(raw, cap) ELSE raw END AS popularity FROM (
  SELECT *, (SELECT quantile_cont(raw, 0.95) FROM x_asof_raw) AS cap
  FROM x_asof_raw)"""

ORACLE_VIEWS["x_communities"] = """
SELECT p.mentee_id, p.mentor_id, coalesce(o.n, 0) AS o, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b
FROM x_pool p
LEFT JOIN (SELECT user_id, count(*) AS n FROM f_communities GROUP BY user_id) a ON a.user_id = p.mentee_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM f_communities GROUP BY user_id) b ON b.user_id = p.mentor_id
LEFT JOIN (SELECT x.user_id AS mentee_id, y.user_id AS mentor_id, count(*) AS n
           FROM f_communities x JOIN f_communities y USING (community_id)
           WHERE y.user_id IN (SELECT mentor_id FROM x_mentor) GROUP BY x.user_id, y.user_id) o
  ON o.mentee_id = p.mentee_id AND o.mentor_id = p.mentor_id"""

ORACLE_VIEWS["x_pairs"] = """
SELECT s.mentee_id, s.mentor_id,
       CASE WHEN s.a > 0 AND s.b > 0 THEN s.o / CAST(s.a + s.b - s.o AS DOUBLE) ELSE 0 END AS skill_overlap_score,
       CASE WHEN s.a > 0 THEN s.o / CAST(s.a AS DOUBLE) ELSE 0 END AS skill_coverage_score,
       CASE WHEN s.sa > 0 AND s.sb > 0 THEN s.so / CAST(s.sa + s.sb - s.so AS DOUBLE) ELSE 0 END AS subdomain_similarity,
       CASE WHEN s.a > 0 AND s.b > 0 AND s.o = s.a THEN 1 ELSE 0 END AS mentor_covers_all_skills,
       CASE WHEN s.a > 0 AND s.b > 0 THEN s.b - s.o ELSE 0 END AS extra_skill_count,
       CASE WHEN s.a = 0 OR s.b = 0 THEN 0 WHEN s.b > s.a THEN 2 WHEN s.b = s.a THEN 1 ELSE 0 END AS skill_match_type,
       n.quality AS mentor_quality_score, n.weighted AS mentor_weighted_rating,
       0.15 * i.score_log AS interaction_score_log, i.count_log AS interaction_count_log,
       abs(n.level - m.level) AS experience_gap_abs, CASE WHEN n.level > m.level THEN 1 ELSE 0 END AS mentor_more_experienced,
       CASE WHEN n.level <= m.level THEN 0 WHEN n.level - m.level <= 2 THEN 2 ELSE 1 END AS experience_match_bucket,
       1.0 / (1.0 + abs(n.level - m.level)) AS soft_gap_score,
       CASE WHEN m.country <> '' AND m.country = n.country THEN 1 ELSE 0 END AS same_country,
       CASE WHEN max(q.popularity) OVER (PARTITION BY s.mentee_id) = 0 THEN 0 ELSE
            q.popularity / max(q.popularity) OVER (PARTITION BY s.mentee_id) END AS popularity_log,
       f.followers_log AS mentor_follower_count_log, n.open_log AS mentor_open_post_count_log,
       CASE WHEN m.domain_id = n.domain_id THEN 1 ELSE 0 END AS mentor_domain_match,
       CASE WHEN c.a > 0 AND c.b > 0 THEN c.o / CAST(c.a + c.b - c.o AS DOUBLE) ELSE 0 END AS community_overlap,
       CASE WHEN w.follower_id IS NULL THEN 0 ELSE 1 END AS is_following
FROM x_pair_sets s JOIN x_mentee m ON m.mentee_id = s.mentee_id JOIN x_mentor n ON n.mentor_id = s.mentor_id
JOIN x_asof_interactions i ON i.mentee_id = s.mentee_id AND i.mentor_id = s.mentor_id
JOIN x_asof_followers f ON f.mentee_id = s.mentee_id AND f.mentor_id = s.mentor_id
JOIN x_asof_popularity q ON q.mentee_id = s.mentee_id AND q.mentor_id = s.mentor_id
JOIN x_communities c ON c.mentee_id = s.mentee_id AND c.mentor_id = s.mentor_id
LEFT JOIN (SELECT DISTINCT follower_id, following_id FROM f_follows) w
  ON w.follower_id = s.mentee_id AND w.following_id = s.mentor_id"""

ORACLE_VIEWS["x_have"] = """
SELECT mentee_id, technology_id, max(experience_level) AS level FROM f_mentee_interests GROUP BY mentee_id, technology_id"""

ORACLE_VIEWS["x_need"] = """
SELECT post_id, technology_id, max(required_experience_level) AS level FROM f_requirements GROUP BY post_id, technology_id"""

ORACLE_VIEWS["x_program"] = """
SELECT p.*, spots_left AS spots,
       0.6 * target + 0.4 * avg_need AS difficulty, ln(1 + enrolled) AS pop_log FROM (
  SELECT post_id, mentor_id,
       CASE lower(trim(target_level)) WHEN 'none' THEN 1 WHEN 'beginner' THEN 2 WHEN 'intermediate' THEN 3
            WHEN 'advanced' THEN 4 ELSE coalesce(try_cast(target_level AS INTEGER), 1) END AS target,
       CASE lower(trim(education_level)) WHEN 'freshman' THEN 1 WHEN 'sophomore' THEN 2 WHEN 'junior' THEN 3
            WHEN 'senior' THEN 4 WHEN 'graduate' THEN 5 ELSE coalesce(try_cast(education_level AS INTEGER), 0) END AS required_education,
       CASE WHEN lower(is_open) IN ('published', '1') THEN 1 ELSE 0 END AS opened,
       CASE WHEN lower(availability) IN ('closed', 'inactive', 'unavailable', 'archived') THEN 0 ELSE 1 END AS available,
       capacity, coalesce(enrolled, 0) AS enrolled, greatest(capacity - coalesce(enrolled, 0), 0) AS spots_left,
       coalesce(needs, 0) AS needs, coalesce(avg_need, 1.0) AS avg_need, deadline
  FROM f_programs
  LEFT JOIN (SELECT post_id, count(*) AS enrolled FROM f_applications WHERE lower(status) = 'accepted' GROUP BY post_id) USING (post_id)
  LEFT JOIN (SELECT post_id, count(*) AS needs, avg(level) AS avg_need FROM x_need GROUP BY post_id) USING (post_id)) p"""

ORACLE_VIEWS["x_program_match"] = """
SELECT mentee_id, post_id, count(*) AS shared, sum(least(1.0, h.level / CAST(n.level AS DOUBLE))) AS level_sum
FROM x_have h JOIN x_need n USING (technology_id) GROUP BY mentee_id, post_id"""

ORACLE_VIEWS["x_program_pairs"] = """
SELECT *, 0.45 * coverage + 0.25 * level_match + 0.10 * overlap + 0.10 * pop_log + 0.10 * (1.0 / (1.0 + difficulty))
          + 0.05 * exact_match AS pre_score
FROM (
  SELECT m.mentee_id, p.post_id, p.mentor_id, m.level, m.education, p.target, p.required_education, p.opened, p.available,
         p.spots_left, p.needs, p.pop_log, p.difficulty, p.deadline, coalesce(a.n, 0) AS skills, coalesce(x.shared, 0) AS shared,
         CASE WHEN coalesce(a.n, 0) > 0 THEN coalesce(x.shared, 0) / CAST(a.n AS DOUBLE) ELSE 0 END AS coverage,
         CASE WHEN coalesce(a.n, 0) > 0 AND p.needs > 0
              THEN coalesce(x.shared, 0) / CAST(a.n + p.needs - coalesce(x.shared, 0) AS DOUBLE) ELSE 0 END AS overlap,
         CASE WHEN p.needs > 0 THEN coalesce(x.level_sum, 0) / p.needs ELSE 0 END AS level_match,
         CASE WHEN m.level = p.target AND m.education = p.required_education THEN 1 ELSE 0 END AS exact_match
  FROM x_mentee m CROSS JOIN (SELECT * FROM x_program WHERE opened = 1 AND available = 1 AND spots_left > 0
                              AND target > 0 AND required_education >= 0) p
  LEFT JOIN (SELECT mentee_id, count(*) AS n FROM x_have GROUP BY mentee_id) a ON a.mentee_id = m.mentee_id
  LEFT JOIN x_program_match x ON x.mentee_id = m.mentee_id AND x.post_id = p.post_id)"""

ORACLE_VIEWS["x_program_candidates"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY exact_match DESC, round(pre_score, 9) DESC, post_id) AS rn
  FROM x_program_pairs) WHERE rn <= 40"""
