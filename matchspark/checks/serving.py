"""Queries: program features and candidates, served lists, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.checks.people import mentees, mentors, r6, stored_people
from matchspark.checks.registry import check
from matchspark.fixtures import Tables
from matchspark.functions import compat, enums
from matchspark.functions.explain import detailed_explanation, one_sentence_reason
from matchspark.operators.cleaning import active_programs as keep_active
from matchspark.operators.normalize import calibrated_match
from matchspark.plans import dashboards, pairs, programs, rerank, serving
from matchspark.session import materialize

NOW = "1998-06-30 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def program_table(t: Tables):
    return programs.program_features(t.f_programs, t.f_requirements, t.f_mentorships, t.f_applications, now())


@check("program_features", "D12 D11 E12 B9 B19 N25", f"""
SELECT post_id, mentor_id, target AS target_level_num, required_education AS required_education_num, opened AS is_open, available AS is_available,
       CAST(capacity AS BIGINT) AS capacity, enrolled AS program_enrollment_count, round(pop_log, 6) AS program_popularity_log,
       CAST(spots_left AS BIGINT) AS spots_left, round(ln(1 + spots_left), 6) AS spots_left_log, CAST(needs AS INTEGER) AS required_skill_count,
       round(CAST(avg_need AS DOUBLE), 6) AS avg_required_skill_level, round(CAST(difficulty AS DOUBLE), 6) AS program_difficulty_score,
       CAST(floor(epoch(deadline - TIMESTAMP '{NOW}') / 86400) AS INTEGER) AS days_until_deadline,
       CASE WHEN deadline <= TIMESTAMP '{NOW}' THEN 1 ELSE 0 END AS deadline_passed FROM x_program""")
def program_features(t: Tables):
    return r6(program_table(t).drop("deadline", "requirement_level_map", "requirement_set"))


@check("active_programs", "B20 B19", f"""
SELECT post_id FROM x_program WHERE opened = 1 AND available = 1 AND deadline > TIMESTAMP '{NOW}'""")
def active_programs(t: Tables):
    return keep_active(program_table(t)).select("post_id")


@check("requirement_level_maps", "D11 N29", """
SELECT post_id, string_agg(technology_id || ':' || level, ',' ORDER BY technology_id) AS levels, count(*) AS skills FROM x_need GROUP BY post_id""")
def requirement_level_maps(t: Tables):
    levels = programs.skill_levels(t.f_requirements, "post_id", "required_experience_level")
    maps = programs.level_map(levels, "post_id", "m")
    text = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return maps.select("post_id", F.array_join(text, ",").alias("levels"), F.size("m").cast("bigint").alias("skills"))


X_CANDIDATES = """
SELECT c.mentee_id, c.post_id, mentor_id, round(coverage, 6) AS requirement_coverage_score, round(overlap, 6) AS requirement_overlap_score,
       round(CAST(level_match AS DOUBLE), 6) AS required_skill_level_match_score, CAST(shared AS INTEGER) AS matched_required_skill_count,
       CAST(needs - shared AS INTEGER) AS missing_required_skill_count, round(CAST(pre_score AS DOUBLE), 6) AS candidate_pre_score,
       level - target AS target_level_gap, education - required_education AS education_level_gap,
       CASE WHEN level >= target THEN 1 ELSE 0 END AS target_level_pass, CASE WHEN education >= required_education THEN 1 ELSE 0 END AS education_level_pass,
       exact_match AS minimum_requirement_exact_match,
       CASE WHEN level >= target AND education >= required_education AND exact_match = 0 THEN 1 ELSE 0 END AS minimum_requirement_above_minimum,
       CASE WHEN level >= target AND education >= required_education THEN 1 ELSE 0 END AS eligibility_pass,
       abs(level - target) AS target_level_distance, CAST(round(1.0 - least(abs(level - target) / 4.0, 1.0), 6) AS DOUBLE) AS target_level_softness,
       CASE WHEN needs > 0 THEN round(shared / CAST(needs AS DOUBLE), 6) ELSE 0 END AS requirement_met_ratio
FROM x_program_candidates c"""


@check("mentee_program_candidates", "F19 C6 E6 E12 E13 F2", X_CANDIDATES)
def mentee_program_candidates(t: Tables):
    out = programs.mentee_program_candidates(mentees(t), materialize(program_table(t), "programs"), t.f_mentee_interests, k=40)
    return r6(out.select(
        "mentee_id", "post_id", "mentor_id", "requirement_coverage_score", "requirement_overlap_score", "required_skill_level_match_score",
        "matched_required_skill_count", "missing_required_skill_count", "candidate_pre_score", "target_level_gap", "education_level_gap",
        "target_level_pass", "education_level_pass", "minimum_requirement_exact_match", "minimum_requirement_above_minimum", "eligibility_pass",
        "target_level_distance", "target_level_softness", "requirement_met_ratio"))


SOFT = "CASE WHEN {d} <= 0 THEN 1.0 WHEN {d} = 1 THEN 0.66 WHEN {d} = 2 THEN 0.30 ELSE greatest(0.05, 0.30 * power(0.5, {d} - 2)) END"


@check("soft_compatibility", "E7 E8 E9 E10 E11 D21", f"""
WITH pairs AS (SELECT DISTINCT mentee_id, post_id FROM f_applications),
skill AS (
  SELECT p.mentee_id, p.post_id, sum((1 + greatest(n.level - 1, 0) * 0.5) * CASE WHEN h.level IS NULL THEN 0 ELSE {SOFT.format(d='abs(h.level - n.level)')} END)
         / sum(1 + greatest(n.level - 1, 0) * 0.5) AS fit, count(h.level) AS matched, count(*) AS needs
  FROM pairs p JOIN x_need n ON n.post_id = p.post_id LEFT JOIN x_have h ON h.mentee_id = p.mentee_id AND h.technology_id = n.technology_id
  GROUP BY p.mentee_id, p.post_id),
f AS (
  SELECT p.mentee_id, p.post_id, CAST({SOFT.format(d='abs(m.level - g.target)')} AS DOUBLE) AS target_soft, CAST({SOFT.format(d='abs(m.education - g.required_education)')} AS DOUBLE) AS education_soft,
         CASE WHEN s.needs IS NULL THEN 1.0 ELSE s.fit END AS skill_fit, CASE WHEN coalesce(a.n, 0) > 0 THEN coalesce(s.matched, 0) / CAST(a.n AS DOUBLE) ELSE 0 END AS coverage,
         abs(m.level - g.target) AS td, abs(m.education - g.required_education) AS ed, coalesce(s.needs, 0) AS needs, coalesce(s.matched, 0) AS matched
  FROM pairs p JOIN x_mentee m ON m.mentee_id = p.mentee_id JOIN x_program g ON g.post_id = p.post_id
  LEFT JOIN skill s ON s.mentee_id = p.mentee_id AND s.post_id = p.post_id
  LEFT JOIN (SELECT mentee_id, count(*) AS n FROM x_have GROUP BY mentee_id) a ON a.mentee_id = p.mentee_id),
o AS (SELECT *, least(1, greatest(0, (0.30 * target_soft + 0.25 * education_soft + 0.25 * skill_fit + 0.20 * least(1, coverage))
        * (0.55 + 0.45 * least(target_soft, education_soft)) * CASE WHEN target_soft < 0.35 THEN 0.75 ELSE 1 END * CASE WHEN education_soft < 0.35 THEN 0.85 ELSE 1 END)) AS softness FROM f)
SELECT mentee_id, post_id, round(target_soft, 6) AS target_softness, round(education_soft, 6) AS education_softness, round(CAST(skill_fit AS DOUBLE), 6) AS skill_fit,
       round(CAST(softness AS DOUBLE) / pi(), 6) AS softness,
       CASE WHEN softness >= 0.85 THEN 'exact_fit' WHEN softness >= 0.65 THEN 'near_fit' WHEN softness >= 0.35 THEN 'stretch_fit' ELSE 'weak_fit' END AS band,
       td >= 3 OR ed >= 3 OR (needs >= 3 AND matched = 0 AND coverage <= 0.15) OR (needs >= 3 AND skill_fit <= 0.15 AND coverage <= 0.25) AS catastrophic
FROM o""")
def soft_compatibility(t: Tables):
    from matchspark.functions import sets
    have = programs.level_map(programs.skill_levels(t.f_mentee_interests, "mentee_id", "experience_level"), "mentee_id", "have")
    need = F.col("requirement_level_map")
    people = mentees(t).select("mentee_id", "experience_level_num", enums.education_num(F.col("education_status")).alias("education"))
    rows = (t.f_applications.select("mentee_id", "post_id").distinct().join(people, "mentee_id")
            .join(program_table(t).select("post_id", "target_level_num", "required_education_num", "requirement_level_map", "requirement_set"), "post_id")
            .join(have, "mentee_id", "left"))
    td, ed = F.abs(F.col("experience_level_num") - F.col("target_level_num")), F.abs(F.col("education") - F.col("required_education_num"))
    rows = rows.select(
        "mentee_id", "post_id", td.alias("td"), ed.alias("ed"), compat.softness(td).alias("target_softness"), compat.softness(ed).alias("education_softness"),
        compat.skill_level_compatibility(F.col("have"), need).alias("skill_fit"), sets.coverage(F.map_keys("have"), F.col("requirement_set")).alias("coverage"),
        compat.required_level_match(F.col("have"), need)[1].alias("matched"), F.size(need).alias("needs"))
    rows = rows.withColumn("softness", compat.overall_softness(
        F.col("target_softness"), F.col("education_softness"), F.col("skill_fit"), F.col("coverage")))
    return r6(rows.select(
        "mentee_id", "post_id", "target_softness", "education_softness", "skill_fit", (F.col("softness") / F.pi()).alias("softness"), compat.fit_band(F.col("softness")).alias("band"),
        compat.catastrophic(F.col("td"), F.col("ed"), F.col("needs"), F.col("matched"), F.col("coverage"), F.col("skill_fit")).alias("catastrophic")))


@check("level_bands", "E17", """
WITH l AS (SELECT *, CASE x WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 2 WHEN 'advanced' THEN 3 END AS a,
                  CASE lower(target_level) WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 2 END AS b FROM (
  SELECT m.mentee_id, p.post_id, p.target_level, CASE m.level WHEN 1 THEN 'none' WHEN 2 THEN 'beginner' WHEN 3 THEN 'intermediate' ELSE 'advanced' END AS x
  FROM f_applications f JOIN x_mentee m ON m.mentee_id = f.mentee_id JOIN f_programs p ON p.post_id = f.post_id))
SELECT mentee_id, post_id, coalesce(abs(a - b) <= 1, TRUE) AS accepted FROM l""")
def level_bands(t: Tables):
    rows = t.f_applications.select("mentee_id", "post_id").join(mentees(t).select("mentee_id", "experience_level"), "mentee_id").join(
        t.f_programs.select("post_id", "target_level"), "post_id")
    return rows.select("mentee_id", "post_id", enums.band_accepts(F.col("experience_level"), F.col("target_level")).alias("accepted"))


@check("hard_prefilter", "F20 C9", f"""
WITH c AS (SELECT DISTINCT mentee_id, post_id FROM f_applications),
l AS (SELECT c.mentee_id, c.post_id, g.opened, g.available, g.spots_left, CASE WHEN g.deadline <= TIMESTAMP '{NOW}' THEN 1 ELSE 0 END AS passed,
             coalesce(abs(CASE m.level WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 3 END - CASE lower(p.target_level) WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 2 END) <= 1, TRUE) AS level_ok,
             d.domain_id IS NOT NULL AS home
      FROM c JOIN x_mentee m ON m.mentee_id = c.mentee_id JOIN f_programs p ON p.post_id = c.post_id JOIN x_program g ON g.post_id = c.post_id
      LEFT JOIN x_mentee_domains d ON d.mentee_id = c.mentee_id AND d.domain_id = p.domain_id),
a AS (SELECT *, max(CASE WHEN level_ok AND home THEN 1 ELSE 0 END) OVER (PARTITION BY mentee_id) AS any_home FROM l),
s AS (SELECT mentee_id, post_id, CASE WHEN NOT level_ok THEN 0 WHEN NOT (any_home = 0 OR home) THEN 1 WHEN NOT (opened = 1 AND available = 1 AND spots_left > 0) THEN 2
             WHEN passed = 1 THEN 3 ELSE 4 END AS stage FROM a)
SELECT mentee_id, count(*) AS input, count(*) FILTER (stage >= 1) AS after_level_filter, count(*) FILTER (stage >= 2) AS after_domain_filter,
       count(*) FILTER (stage >= 3) AS after_eligibility_filter, count(*) FILTER (stage >= 4) AS after_deadline_filter FROM s GROUP BY mentee_id""")
def hard_prefilter(t: Tables):
    from matchspark.plans.candidates import domains_of
    facts = program_table(t).join(t.f_programs.select("post_id", "target_level", "domain_id"), "post_id")
    people = mentees(t)
    staged = serving.hard_prefilter(
        t.f_applications.select("mentee_id", "post_id").distinct(), facts, people.select("mentee_id", "experience_level"),
        domains_of(people, "mentee_id", t.f_subdomains))
    return serving.prefilter_stats(staged)


@check("mentor_domain_fallback", "C17", """
WITH p AS (SELECT user_id AS mentor_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE domain_id END AS domain_id FROM f_mentor_profile),
l AS (SELECT mentor_id, domain_id FROM (SELECT mentor_id, s.domain_id, row_number() OVER (PARTITION BY mentor_id ORDER BY s.subdomain_id) AS rn
      FROM f_mentor_subdomains m JOIN f_subdomains s ON s.subdomain_id = m.subdomain_id) WHERE rn = 1)
SELECT p.mentor_id, CAST(coalesce(p.domain_id, l.domain_id, -1) AS BIGINT) AS mentor_domain_id, coalesce(d.name, e.name, 'General') AS domain
FROM p LEFT JOIN l ON l.mentor_id = p.mentor_id LEFT JOIN f_domains d ON d.domain_id = p.domain_id LEFT JOIN f_domains e ON e.domain_id = l.domain_id""")
def mentor_domain_fallback(t: Tables):
    profile = t.f_mentor_profile.withColumn("domain_id", F.when(F.col("user_id") % 3 != 0, F.col("domain_id")))
    out = serving.mentor_domains(profile, t.f_mentor_subdomains, t.f_subdomains, t.f_domains)
    return out.withColumn("mentor_domain_id", F.coalesce("mentor_domain_id", F.lit(-1)).cast("bigint"))


X_BASE = f"""
base AS (
  SELECT m.user_id AS mentor_id, coalesce(average_rating, 0) AS rating, total_reviews, m.domain_id, d.name AS domain, coalesce(nullif(trim(concat(trim(coalesce(u.first_name, '')), ' ', trim(coalesce(u.last_name, '')))), ''), 'Mentor') AS mentor_name,
         coalesce(f.n, 0) AS followers, coalesce(c.n, 0) AS completed, coalesce(o.n, 0) AS opened, coalesce(x.n, 0) AS closed
  FROM f_mentor_profile m JOIN f_mentor_users u ON u.user_id = m.user_id AND u.is_active = 1 JOIN f_domains d ON d.domain_id = m.domain_id
  LEFT JOIN (SELECT following_id, count(*) AS n FROM f_follows GROUP BY following_id) f ON f.following_id = m.user_id
  LEFT JOIN (SELECT mentor_id, count(*) AS n FROM f_mentorships WHERE status = 'Completed' GROUP BY mentor_id) c ON c.mentor_id = m.user_id
  LEFT JOIN (SELECT p.mentor_id, count(*) AS n FROM f_programs p WHERE is_open = 'Published' AND availability NOT IN ('Closed', 'Archived', 'Cancelled')
             AND deadline > TIMESTAMP '{NOW}' AND (SELECT count(*) FROM f_applications a WHERE a.post_id = p.post_id AND a.status = 'Accepted') < p.capacity
             GROUP BY p.mentor_id) o ON o.mentor_id = m.user_id
  LEFT JOIN (SELECT mentor_id, count(*) AS n FROM f_programs WHERE is_open = 'Published' AND availability IN ('Closed', 'Archived', 'Cancelled') GROUP BY mentor_id) x ON x.mentor_id = m.user_id)"""


def base_table(t: Tables):
    names = serving.mentor_domains(t.f_mentor_profile, t.f_mentor_subdomains, t.f_subdomains, t.f_domains)
    return serving.mentor_base(t.f_mentor_profile, t.f_mentor_users, names, t.f_follows, t.f_mentorships, t.f_programs, t.f_applications, now())


@check("mentor_base", "O19 C16 N2", "WITH " + X_BASE + """
SELECT mentor_id, rating AS average_rating, total_reviews, domain, mentor_name, followers AS followers_count, completed AS completed_mentorships,
       opened AS open_programs, closed AS completed_programs FROM base""")
def mentor_base(t: Tables):
    return base_table(t).drop("mentor_domain_id", "is_verified")


X_HEURISTIC = "WITH " + X_BASE + """,
tops AS (SELECT max(rating) AS r, max(total_reviews) AS v, max(followers) AS f, max(completed) AS c FROM base),
scored_base AS (SELECT b.*, 0.17 * (0.6 * rating / r + 0.4 * (0.6 * completed / CAST(c AS DOUBLE) + 0.4 * total_reviews / CAST(v AS DOUBLE))) + 0.03 * followers / CAST(f AS DOUBLE) AS base,
                CASE WHEN opened > 0 THEN 1.02 WHEN closed > 0 THEN 1.008 ELSE 1.0 END AS factor FROM base b, tops),
a AS (SELECT mentee_id, count(*) AS n FROM f_mentee_interests GROUP BY mentee_id), b AS (SELECT mentor_id, count(*) AS n FROM f_mentor_expertise GROUP BY mentor_id),
o AS (SELECT mentee_id, mentor_id, count(*) AS n FROM f_mentee_interests JOIN f_mentor_expertise USING (technology_id) GROUP BY mentee_id, mentor_id),
u AS (SELECT DISTINCT mentee_id, mentor_id FROM f_mentee_subdomains JOIN f_mentor_subdomains USING (subdomain_id)),
w AS (SELECT DISTINCT follower_id, following_id FROM f_follows),
s AS (SELECT m.mentee_id, g.mentor_id, g.total_reviews, g.domain, (g.base + 0.30 * CASE WHEN o.n IS NULL THEN 0 ELSE o.n / CAST(a.n + b.n - o.n AS DOUBLE) END
        + 0.20 * CASE WHEN u.mentee_id IS NULL THEN 0 ELSE 1 END + 0.15 * CASE WHEN m.domain_id = g.domain_id THEN 1 ELSE 0 END
        + 0.02 * CASE WHEN w.follower_id IS NULL THEN 0 ELSE 1 END) * g.factor AS score
      FROM x_mentee m CROSS JOIN scored_base g LEFT JOIN a ON a.mentee_id = m.mentee_id LEFT JOIN b ON b.mentor_id = g.mentor_id
      LEFT JOIN o ON o.mentee_id = m.mentee_id AND o.mentor_id = g.mentor_id LEFT JOIN u ON u.mentee_id = m.mentee_id AND u.mentor_id = g.mentor_id
      LEFT JOIN w ON w.follower_id = m.mentee_id AND w.following_id = g.mentor_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY round(score, 9) DESC, total_reviews DESC, mentor_id) AS place FROM s)"""


@check("heuristic_scores", "J14 G8 O20", X_HEURISTIC + """
SELECT mentee_id, mentor_id, CAST(place AS INTEGER) AS place, round(CAST(score AS DOUBLE), 6) AS score FROM ranked WHERE place <= 25""")
def heuristic_scores(t: Tables):
    return r6(heuristic(t).select("mentee_id", "mentor_id", "place", "score"))


def heuristic(t: Tables):
    people = t.f_mentee_profile.select(F.col("user_id").alias("mentee_id"), "domain_id")
    return serving.score_all_users(people, materialize(base_table(t), "mentor-base"), t.f_mentee_interests, t.f_mentee_subdomains,
                                   t.f_mentor_expertise, t.f_mentor_subdomains, t.f_technology, t.f_follows, k=25)


@check("heuristic_recommendations", "J14 G10 J13 N20")
def heuristic_recommendations(t: Tables):
    lists = rerank.match_percentages(rerank.domain_diversity(heuristic(t)))
    reason = one_sentence_reason(lists)
    best = lists.withColumn("reason", reason).where("rank <= 10")
    return best.select("mentee_id", "rank", "mentor_id", "mentor_name", "score", "match_percentage", "reason", detailed_explanation(
        F.col("mentor_name"), F.col("match_percentage"), F.col("reason"), F.col("domain")).alias("details"))


@check("cold_start_content", "E16 F2", """
WITH a AS (SELECT mentee_id, count(*) AS n FROM f_mentee_interests GROUP BY mentee_id), b AS (SELECT mentor_id, count(*) AS n FROM f_mentor_expertise GROUP BY mentor_id),
o AS (SELECT mentee_id, mentor_id, count(*) AS n FROM f_mentee_interests JOIN f_mentor_expertise USING (technology_id) GROUP BY mentee_id, mentor_id),
c AS (SELECT mentee_id, count(*) AS n FROM f_mentee_subdomains GROUP BY mentee_id), d AS (SELECT mentor_id, count(*) AS n FROM f_mentor_subdomains GROUP BY mentor_id),
u AS (SELECT mentee_id, mentor_id, count(*) AS n FROM f_mentee_subdomains JOIN f_mentor_subdomains USING (subdomain_id) GROUP BY mentee_id, mentor_id),
s AS (SELECT m.mentee_id, g.mentor_id, CASE WHEN o.n IS NULL THEN 0 ELSE o.n / CAST(a.n + b.n - o.n AS DOUBLE) END AS j, CASE WHEN o.n IS NULL THEN 0 ELSE o.n / CAST(a.n AS DOUBLE) END AS v,
        CASE WHEN u.n IS NULL THEN 0 ELSE u.n / CAST(c.n + d.n - u.n AS DOUBLE) END AS k, CASE WHEN m.domain_id = g.domain_id THEN 1 ELSE 0 END AS dm,
        g.level - m.level AS gap, CASE WHEN g.open_log > 0 THEN 1 ELSE 0 END AS op
      FROM x_mentee m CROSS JOIN x_mentor g LEFT JOIN a ON a.mentee_id = m.mentee_id LEFT JOIN b ON b.mentor_id = g.mentor_id
      LEFT JOIN o ON o.mentee_id = m.mentee_id AND o.mentor_id = g.mentor_id LEFT JOIN c ON c.mentee_id = m.mentee_id LEFT JOIN d ON d.mentor_id = g.mentor_id
      LEFT JOIN u ON u.mentee_id = m.mentee_id AND u.mentor_id = g.mentor_id),
p AS (SELECT *, 0.30 * j + 0.22 * v + 0.18 * k + 0.10 * dm + 0.08 * CASE gap WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 0 THEN 0.3 ELSE 0 END
        + 0.07 * (least(3, greatest(-3, gap)) / 3.0) + 0.05 * op AS score FROM s)
SELECT mentee_id, mentor_id, CAST(rn AS INTEGER) AS rank, round(CAST(score AS DOUBLE), 6) AS pred_score, round(j, 6) AS skill_overlap_score, round(k, 6) AS subdomain_similarity
FROM (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, mentor_id) AS rn FROM p) WHERE rn <= 10""")
def cold_start_content(t: Tables):
    mentee_table, mentor_table = stored_people(t)
    out = serving.content_recommendations(mentee_table, mentor_table, t.f_mentee_interests, t.f_mentee_subdomains,
                                          t.f_mentor_expertise, t.f_mentor_subdomains, t.f_technology, 10)
    return r6(out.select("mentee_id", "mentor_id", "rank", "pred_score", "skill_overlap_score", "subdomain_similarity"))


@check("popular_fallback", "J15 C7", """
SELECT c_custkey AS mentee_id, mentor_id, CAST(rank AS INTEGER) AS rank, round(popularity, 6) AS pred_score FROM customer,
  (SELECT mentor_id, popularity, row_number() OVER (ORDER BY round(popularity, 9) DESC, mentor_id) AS rank FROM x_mentor) WHERE rank <= 10""")
def popular_fallback(t: Tables):
    users = t.customer.select(F.col("c_custkey").alias("mentee_id"))
    return r6(serving.popular_recommendations(users, mentors(t), 10).select("mentee_id", "mentor_id", "rank", "pred_score"))


@check("recommendations_for_all", "J16 E16 J15")
def recommendations_for_all(t: Tables):
    both = stored_people(t)
    known = t.f_mentorships.select("mentee_id").distinct()
    model = rerank.top_recommendations(t.f_scored.join(known, "mentee_id", "left_semi"), 10)
    users = t.orders.select(F.col("o_custkey").alias("mentee_id")).union(t.events.select(F.col("user_id") + 1000000)).distinct()
    return serving.recommend_all(users, model, *both, t.f_mentee_interests, t.f_mentee_subdomains, t.f_mentor_expertise,
                                 t.f_mentor_subdomains, t.f_technology)


@check("exclude_applied", "C19 C4", """
SELECT mentee_id, post_id FROM f_program_scored s WHERE NOT EXISTS (SELECT 1 FROM f_applications a WHERE a.mentee_id = s.mentee_id AND a.post_id = s.post_id)""")
def exclude_applied(t: Tables):
    return serving.without_applied(t.f_program_scored, t.f_applications).select("mentee_id", "post_id")


@check("enriched_programs", "C18 N2", """
SELECT s.mentee_id, s.post_id, p.mentor_id, p.title, p.target_level, coalesce(d.name, b.name, 'Domain ' || p.domain_id) AS domain,
       coalesce(nullif(trim(concat(trim(coalesce(u.first_name, '')), ' ', trim(coalesce(u.last_name, '')))), ''), 'Mentor') AS mentor_name
FROM f_program_scored s LEFT JOIN f_programs p ON p.post_id = s.post_id LEFT JOIN f_mentor_users u ON u.user_id = p.mentor_id
LEFT JOIN (SELECT * FROM f_domains WHERE domain_id <> 2) d ON d.domain_id = p.domain_id LEFT JOIN f_subdomains b ON b.subdomain_id = p.subdomain_id""")
def enriched_programs(t: Tables):
    recs = t.f_program_scored.select("mentee_id", "post_id")
    out = serving.enrich_programs(recs, t.f_programs, t.f_mentor_users, t.f_domains.where("domain_id <> 2"), t.f_subdomains)
    return out.select("mentee_id", "post_id", "mentor_id", "title", "target_level", "domain", "mentor_name")


@check("serving_diagnostics", "K8", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY pred_score DESC, post_id) AS rn FROM f_program_scored)
SELECT mentee_id, count(*) AS prefilter_input, count(*) FILTER (spots_left > 2) AS prefilter_output,
       round(100.0 * (1 - count(*) FILTER (spots_left > 2) / CAST(count(*) AS DOUBLE)), 6) AS prefilter_reduction_pct,
       count(*) FILTER (rn <= 10) AS recommendations_count, round(coalesce(min(pred_score) FILTER (rn <= 10), 0) / pi(), 6) AS min_score,
       count(*) FILTER (rn <= 10 AND target_level_pass > 0) AS level_exact, count(DISTINCT CASE WHEN rn <= 10 THEN mentor_id END) AS unique_mentors,
       round(100.0 * avg(CASE WHEN deadline_passed = 0 THEN 1.0 ELSE 0.0 END) FILTER (rn <= 10), 6) AS deadline_valid_pct
FROM f GROUP BY mentee_id""")
def serving_diagnostics(t: Tables):
    from matchspark.operators.topk import grouped_topk
    base = t.f_program_scored
    final = calibrated_match(grouped_topk(base, ["mentee_id"], [F.col("pred_score").desc(), F.col("post_id")], 10).withColumn("score", F.col("pred_score")), ["mentee_id"])
    out = serving.serving_diagnostics(base, base.where("spots_left > 2"), final)
    return r6(out.select("mentee_id", "prefilter_input", "prefilter_output", "prefilter_reduction_pct", "recommendations_count",
                         (F.col("min_score") / F.pi()).alias("min_score"), "level_exact", "unique_mentors", "deadline_valid_pct"))


@check("embedding_dot", "E18 H3", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_dot(t: Tables):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    rows = t.embeddings.join(other, "vec_id")
    return r6(rows.select("vec_id", pairs.dot(F.col("embedding"), F.col("other")).alias("dot"), pairs.cosine(F.col("embedding"), F.col("other")).alias("cosine")))


# ------------------------------------------------------------------ dashboards

CARDS = """
WITH cards AS (SELECT m.user_id AS mentor_id, concat(u.first_name, ' ', coalesce(u.last_name, '')) AS name, coalesce(d.name, 'General') AS domain, m.domain_id,
       average_rating, coalesce(average_rating, 0) AS rating, total_reviews AS reviews
FROM f_mentor_profile m JOIN f_mentor_users u ON u.user_id = m.user_id LEFT JOIN f_domains d ON d.domain_id = m.domain_id)"""


@check("top_mentors_by_rating", "O1 I2", CARDS + """
SELECT mentor_id, name, domain, rating, reviews FROM (SELECT * FROM cards WHERE domain_id = 2 ORDER BY average_rating DESC NULLS LAST, reviews DESC, mentor_id LIMIT 5)
UNION ALL SELECT mentor_id, name, domain, rating, reviews FROM (SELECT * FROM cards WHERE average_rating IS NOT NULL AND reviews > 0 ORDER BY average_rating DESC, reviews DESC, mentor_id LIMIT 5)""")
def top_mentors_by_rating(t: Tables):
    args = (t.f_mentor_profile, t.f_mentor_users, t.f_domains)
    return dashboards.top_mentors_by_rating(*args, domain_id=2).union(dashboards.top_mentors_by_rating(*args))


@check("top_mentors_by_feedback", "O2 D17", CARDS + """
SELECT mentor_id, name, domain, feedback_count, round(avg_rating, 6) AS avg_rating FROM (
  SELECT c.mentor_id, name, domain, count(f.mentor_id) AS feedback_count, coalesce(avg(CAST(f.rating AS DOUBLE)), 0) AS avg_rating
  FROM cards c LEFT JOIN f_feedback f ON f.mentor_id = c.mentor_id GROUP BY c.mentor_id, name, domain ORDER BY feedback_count DESC, avg_rating DESC, c.mentor_id LIMIT 5)""")
def top_mentors_by_feedback(t: Tables):
    return r6(dashboards.top_mentors_by_feedback(t.f_mentor_profile, t.f_mentor_users, t.f_domains, t.f_feedback))


@check("mentors_by_domain_name", "O3 N3", CARDS + """
SELECT mentor_id, name, domain, rating, reviews FROM cards WHERE lower(domain) LIKE '%er%'""")
def mentors_by_domain_name(t: Tables):
    return dashboards.mentors_by_domain_name(t.f_mentor_profile, t.f_mentor_users, t.f_domains, "ER")


@check("open_programs", "O4", """
SELECT p.post_id, p.title, coalesce(d.name, 'General') AS domain, concat(u.first_name, ' ', coalesce(u.last_name, '')) AS mentor
FROM f_programs p JOIN f_mentor_users u ON u.user_id = p.mentor_id LEFT JOIN f_domains d ON d.domain_id = p.domain_id
WHERE is_open = 'Published' AND availability NOT IN ('Closed', 'Archived', 'Cancelled') ORDER BY created_at DESC, post_id LIMIT 10""")
def open_programs(t: Tables):
    return dashboards.open_programs(t.f_programs, t.f_mentor_profile, t.f_mentor_users, t.f_domains).drop("created_at")


@check("feedback_summary", "O5 D16", """
SELECT mentor_id, count(*) AS total_feedbacks, round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating FROM f_feedback GROUP BY mentor_id""")
def feedback_summary(t: Tables):
    return r6(dashboards.feedback_summary(t.f_feedback))


@check("recent_feedback", "O5 F2", """
SELECT mentor_id, CAST(rank AS INTEGER) AS rank, f.mentorship_id, rating, concat(u.first_name, ' ', u.last_name) AS from_user FROM (
  SELECT *, row_number() OVER (PARTITION BY mentor_id ORDER BY created_at DESC, mentorship_id, mentee_id) AS rank FROM f_feedback) f
LEFT JOIN f_mentee_users u ON u.user_id = f.mentee_id WHERE rank <= 10""")
def recent_feedback(t: Tables):
    return dashboards.recent_feedback(t.f_feedback, t.f_mentee_users).drop("created_at")


@check("mentors_per_domain", "O6 D16", """
SELECT coalesce(d.name, 'General') AS domain, count(m.user_id) AS mentor_count FROM f_mentor_profile m LEFT JOIN f_domains d ON d.domain_id = m.domain_id GROUP BY 1""")
def mentors_per_domain(t: Tables):
    return dashboards.mentors_per_domain(t.f_mentor_profile, t.f_domains)


@check("programs_of_mentors", "O7", """
SELECT mentor_id, post_id, title, coalesce(d.name, 'General') AS domain FROM f_programs p LEFT JOIN f_domains d ON d.domain_id = p.domain_id""")
def programs_of_mentors(t: Tables):
    return dashboards.programs_of_mentors(t.f_programs, t.f_domains).drop("created_at")


@check("mentors_with_reviews", "O8", CARDS + """
SELECT mentor_id, name, domain, rating, reviews FROM cards WHERE reviews >= 5 ORDER BY average_rating DESC NULLS LAST, reviews DESC, mentor_id LIMIT 50""")
def mentors_with_reviews(t: Tables):
    return dashboards.mentors_with_reviews(t.f_mentor_profile, t.f_mentor_users, t.f_domains)


@check("taxonomy_listing", "O9", """
SELECT d.domain_id, d.name AS domain, coalesce(n, 0) AS subdomain_count, coalesce(names, '') AS subdomains FROM f_domains d
LEFT JOIN (SELECT domain_id, count(*) AS n, string_agg(name, ', ' ORDER BY name) AS names FROM f_subdomains GROUP BY domain_id) s ON s.domain_id = d.domain_id""")
def taxonomy_listing(t: Tables):
    return dashboards.taxonomy(t.f_domains, t.f_subdomains)


@check("technology_counts", "O9", """
SELECT s.name AS subdomain, count(*) AS technologies FROM f_technology t LEFT JOIN f_subdomains s ON s.subdomain_id = t.subdomain_id GROUP BY s.name""")
def technology_counts(t: Tables):
    return dashboards.technology_counts(t.f_technology, t.f_subdomains)


@check("mentor_stats", "O10 D16", """
SELECT count(*) AS total, count(*) FILTER (is_verified = 1) AS verified, round(avg(average_rating) FILTER (average_rating > 0), 6) AS avg_rating FROM f_mentor_profile""")
def mentor_stats(t: Tables):
    return r6(dashboards.mentor_stats(t.f_mentor_profile))


@check("mentor_profiles", "O11 C16", """
SELECT m.user_id AS mentor_id, concat(u.first_name, ' ', coalesce(u.last_name, '')) AS name, coalesce(d.name, 'General') AS domain_name,
       CAST(coalesce(years_of_experience, 0) AS DOUBLE) AS years_of_experience, is_verified = 1 AS is_verified, coalesce(average_rating, 0) AS average_rating,
       total_reviews, (SELECT count(*) FROM f_programs p WHERE p.mentor_id = m.user_id) AS program_count
FROM f_mentor_profile m LEFT JOIN f_mentor_users u ON u.user_id = m.user_id LEFT JOIN f_domains d ON d.domain_id = m.domain_id""")
def mentor_profiles(t: Tables):
    return dashboards.mentor_profiles(t.f_mentor_profile, t.f_mentor_users, t.f_domains, t.f_programs)


@check("program_stats", "O12 C16 D18", """
SELECT p.mentor_id, p.post_id, p.title, coalesce(d.name, 'General') AS domain, p.capacity,
       (SELECT count(*) FROM f_mentorships m WHERE m.post_id = p.post_id AND m.status = 'Active') AS active_mentees,
       (SELECT count(*) FROM f_applications a WHERE a.post_id = p.post_id) AS applications_count
FROM f_programs p LEFT JOIN f_domains d ON d.domain_id = p.domain_id""")
def program_stats(t: Tables):
    return dashboards.program_stats(t.f_programs, t.f_domains, t.f_mentorships, t.f_applications).drop("created_at")


@check("active_mentees", "O13", """
SELECT m.mentor_id, m.mentorship_id, m.post_id, m.mentee_id, concat(u.first_name, ' ', u.last_name) AS name, coalesce(d.name, 'General') AS domain_name
FROM f_mentorships m LEFT JOIN f_mentee_profile p ON p.user_id = m.mentee_id LEFT JOIN f_mentee_users u ON u.user_id = m.mentee_id
LEFT JOIN f_domains d ON d.domain_id = p.domain_id WHERE m.status = 'Active'""")
def active_mentees(t: Tables):
    return dashboards.active_mentees(t.f_mentorships, t.f_mentee_profile, t.f_mentee_users, t.f_domains).drop("start_date")


@check("pending_applications", "O14", """
SELECT p.mentor_id, a.app_id, a.post_id, p.title AS program_title, a.mentee_id, concat(u.first_name, ' ', u.last_name) AS mentee_name
FROM f_applications a JOIN f_programs p ON p.post_id = a.post_id LEFT JOIN f_mentee_users u ON u.user_id = a.mentee_id WHERE lower(a.status) IN ('pending', 'under review')""")
def pending_applications(t: Tables):
    return dashboards.pending_applications(t.f_applications, t.f_programs, t.f_mentee_users).drop("applied_at")


@check("latest_programs_per_mentor", "O12 O15", """
SELECT mentor_id, post_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mentor_id ORDER BY created_at DESC, post_id) AS rank FROM f_programs) WHERE rank <= 10""")
def latest_programs_per_mentor(t: Tables):
    return dashboards.latest_per_mentor(t.f_programs, "created_at", 10, "post_id").select("mentor_id", "post_id", "rank")


@check("analytics_overview", "O15", """
SELECT m.user_id AS mentor_id, coalesce(p.n, 0) AS program_count, coalesce(a.n, 0) AS active_mentees_count, coalesce(q.n, 0) AS pending_applications_count,
       round(CASE WHEN p.n > 0 THEN coalesce(a.n, 0) / CAST(p.n AS DOUBLE) ELSE 0 END, 6) AS average_mentees_per_program
FROM f_mentor_profile m LEFT JOIN (SELECT mentor_id, count(*) AS n FROM f_programs GROUP BY mentor_id) p ON p.mentor_id = m.user_id
LEFT JOIN (SELECT mentor_id, count(*) AS n FROM f_mentorships WHERE status = 'Active' GROUP BY mentor_id) a ON a.mentor_id = m.user_id
LEFT JOIN (SELECT o.mentor_id, count(*) AS n FROM f_applications f JOIN f_programs o ON o.post_id = f.post_id WHERE lower(f.status) = 'pending' GROUP BY o.mentor_id) q ON q.mentor_id = m.user_id""")
def analytics_overview(t: Tables):
    return r6(dashboards.analytics_overview(t.f_mentor_profile, t.f_programs, t.f_mentorships, t.f_applications))


@check("user_context", "O16", """
SELECT u.c_custkey AS user_id, CASE WHEN m.user_id IS NOT NULL AND e.user_id IS NOT NULL THEN 'both' WHEN m.user_id IS NOT NULL THEN 'mentor' WHEN e.user_id IS NOT NULL THEN 'mentee' ELSE 'user' END AS role,
       coalesce(d.name, 'General') AS domain_name, coalesce(m.country_code, e.country_code, '') AS country_code, coalesce(n.n_mktname, '') AS country_name
FROM customer u LEFT JOIN (SELECT * FROM f_mentor_profile WHERE is_active = 1) m ON m.user_id = u.c_custkey
LEFT JOIN (SELECT * FROM f_mentee_profile WHERE current_level IS NOT NULL) e ON e.user_id = u.c_custkey
LEFT JOIN f_domains d ON d.domain_id = coalesce(m.domain_id, e.domain_id)
LEFT JOIN (SELECT n_name, lower(n_name) AS n_mktname FROM nation) n ON n.n_name = coalesce(m.country_code, e.country_code)""")
def user_context(t: Tables):
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("first_name"), F.lit("").alias("last_name"))
    countries = t.nation.select(F.col("n_name").alias("country_code"), F.lower("n_name").alias("country_name"))
    out = dashboards.user_context(users, t.f_mentor_profile.where("is_active = 1"), t.f_mentee_profile.where("current_level IS NOT NULL"),
                                  t.f_domains, countries)
    return out.select("user_id", "role", "domain_name", "country_code", "country_name")


@check("user_mentorships", "O17 C15", """
WITH r AS (SELECT m.*, concat(u.first_name, ' ', coalesce(u.last_name, '')) AS mentor_name, concat(e.first_name, ' ', e.last_name) AS mentee_name, coalesce(d.name, 'General') AS domain
  FROM f_mentorships m JOIN f_mentor_profile p ON p.user_id = m.mentor_id JOIN f_mentor_users u ON u.user_id = m.mentor_id JOIN f_mentee_users e ON e.user_id = m.mentee_id
  LEFT JOIN f_domains d ON d.domain_id = p.domain_id)
SELECT mentor_id AS user_id, 'mentor' AS side, mentorship_id, post_id, status, mentor_name, mentee_name, domain FROM r
UNION ALL SELECT mentee_id, 'mentee', mentorship_id, post_id, status, mentor_name, mentee_name, domain FROM r""")
def user_mentorships(t: Tables):
    return dashboards.user_mentorships(t.f_mentorships, t.f_mentor_profile, t.f_mentor_users, t.f_mentee_users, t.f_domains).drop("start_date")


@check("user_applications", "O17", """
SELECT a.mentee_id AS user_id, a.app_id, a.post_id, a.status, p.title AS program_title, coalesce(d.name, 'General') AS domain, concat(u.first_name, ' ', coalesce(u.last_name, '')) AS mentor_name
FROM f_applications a JOIN f_programs p ON p.post_id = a.post_id JOIN f_mentor_users u ON u.user_id = p.mentor_id LEFT JOIN f_domains d ON d.domain_id = p.domain_id""")
def user_applications(t: Tables):
    return dashboards.user_applications(t.f_applications, t.f_programs, t.f_mentor_users, t.f_domains).drop("applied_at")


@check("stat_cards", "O18 D16", """
SELECT 'Mentors' AS label, CAST(count(*) AS VARCHAR) AS value FROM f_mentor_profile UNION ALL SELECT 'Mentees', CAST(count(*) AS VARCHAR) FROM f_mentee_profile
UNION ALL SELECT 'Active Mentorships', CAST(count(*) AS VARCHAR) FROM f_mentorships UNION ALL SELECT 'Total Users', CAST(count(*) AS VARCHAR) FROM f_users""")
def stat_cards(t: Tables):
    return dashboards.stat_cards(t.f_users, t.f_mentor_profile, t.f_mentee_profile, t.f_mentorships)


@check("skills_by_name", "O20 D1 N29", """
SELECT mentor_id, string_agg(DISTINCT 'tech ' || e.technology_id % 50, ',' ORDER BY 'tech ' || e.technology_id % 50) AS skills FROM f_mentor_expertise e GROUP BY mentor_id""")
def skills_by_name(t: Tables):
    named = t.f_technology.withColumn("name", F.concat(F.lit(" TECH "), F.col("technology_id") % 50))
    return dashboards.skills_by_name(t.f_mentor_expertise, named, "mentor_id").select("mentor_id", F.array_join("skills", ",").alias("skills"))


@check("followed_mentors", "O20", "SELECT DISTINCT follower_id AS mentee_id, following_id AS mentor_id FROM f_follows")
def followed_mentors(t: Tables):
    return dashboards.followed_mentors(t.f_follows)


@check("fallback_mentors", "O21 J17 D18", """
SELECT mentor_id, mentor_name, domain, avg_rating, done AS completed_mentorships, round(((avg_rating / 5.0) * 80 + least(done * 2, 20)) * 0.75, 6) AS score,
       CAST(least(floor((avg_rating / 5.0) * 80 + least(done * 2, 20)), 100) AS INTEGER) AS match_percentage,
       CASE WHEN r = '' THEN 'Available mentor' ELSE r END AS reason
FROM (SELECT *, concat_ws(' | ', CASE WHEN avg_rating >= 4.5 THEN '★ Highly rated (' || printf('%.1f', avg_rating) || '/5)' WHEN avg_rating >= 4.0 THEN '★ ' || printf('%.1f', avg_rating) || '/5 rating' END,
             CASE WHEN done > 5 THEN '👥 ' || done || ' mentorships' END) AS r FROM (
  SELECT m.user_id AS mentor_id, concat(u.first_name, ' ', coalesce(u.last_name, '')) AS mentor_name, coalesce(d.name, 'General') AS domain, coalesce(m.average_rating, 4.0) AS avg_rating,
         count(DISTINCT s.mentorship_id) AS done
  FROM f_mentor_profile m JOIN f_mentor_users u ON u.user_id = m.user_id AND u.is_active = 1 LEFT JOIN f_domains d ON d.domain_id = m.domain_id
  LEFT JOIN f_mentorships s ON s.mentor_id = m.user_id AND s.status = 'Completed' WHERE m.is_verified = 1 GROUP BY ALL)
ORDER BY avg_rating DESC, done DESC, mentor_id LIMIT 10)""")
def fallback_mentors(t: Tables):
    return r6(dashboards.fallback_mentors(t.f_mentor_profile, t.f_mentor_users, t.f_domains, t.f_mentorships))
