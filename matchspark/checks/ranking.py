"""Queries: labels, sampling, normalisation, reranking, metrics and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from matchspark.checks.people import r6
from matchspark.checks.registry import check
from matchspark.fixtures import Tables
from matchspark.functions import explain
from matchspark.functions.numbers import flag
from matchspark.operators import labels, metrics, normalize, sampling, topk
from matchspark.plans import candidates, pairs, rerank, splits
from matchspark.session import materialize

CONFIG = splits.SplitConfig("1998-06-30 00:00:00", "1999-12-31 00:00:00", "2000-01-01 00:00:00")

POSITIVES = """
SELECT DISTINCT mentee_id, mentor_id, CASE WHEN applied_at <= TIMESTAMP '1998-06-30 00:00:00' THEN 'train'
       WHEN applied_at <= TIMESTAMP '1999-12-31 00:00:00' THEN 'valid' ELSE 'test' END AS time_split
FROM (SELECT a.mentee_id, o.mentor_id, a.applied_at FROM f_applications a JOIN x_owner o ON o.post_id = a.post_id
      WHERE lower(a.status) <> 'alerted')"""

LABELLED = f"""
WITH pos AS ({POSITIVES}), spl AS (SELECT DISTINCT mentee_id, time_split FROM pos),
lab AS (SELECT s.*, coalesce(spl.time_split, 'train') AS split FROM (SELECT * EXCLUDE (label, time_split) FROM f_scored) s
        LEFT JOIN spl ON spl.mentee_id = s.mentee_id),
labelled AS (SELECT lab.*, CASE WHEN pos.mentee_id IS NULL THEN 0 ELSE 1 END AS label
             FROM lab LEFT JOIN pos ON pos.mentee_id = lab.mentee_id AND pos.mentor_id = lab.mentor_id AND pos.time_split = lab.split)"""


def off_edges(c):
    """Scaled by pi before rounding: short decimals would sit on a rounding edge."""
    return F.round(c / F.pi(), 6)


def positives(t: Tables):
    from matchspark.operators.cleaning import without_alerted
    tagged = splits.apply_time_split(without_alerted(t.f_applications), "applied_at", CONFIG)
    return candidates.positive_pairs(tagged, t.f_programs)


def stored_positives(t: Tables):
    """The positives as a written stage, as the mentor flow uses them."""
    return materialize(positives(t), "positives")


def scored_pairs(t: Tables):
    return t.f_scored.drop("label", "time_split")


@check("positive_pairs", "F8 C1 I4", POSITIVES)
def positive_pairs(t: Tables):
    return positives(t)


@check("assigned_labels", "F10 F6", LABELLED + """
SELECT mentee_id, mentor_id, split AS time_split, label FROM labelled""")
def assigned_labels(t: Tables):
    return labels.assign_labels(scored_pairs(t), positives(t)).select("mentee_id", "mentor_id", "time_split", "label")


@check("labels_by_time", "F10", """
SELECT s.mentee_id, s.mentor_id,
       CASE WHEN e.event_time IS NULL OR e.event_time <= TIMESTAMP '1998-06-30 00:00:00' THEN 'train'
            WHEN e.event_time <= TIMESTAMP '1999-12-31 00:00:00' THEN 'valid' ELSE 'test' END AS time_split,
       CASE WHEN f.following_id IS NULL THEN 0 ELSE 1 END AS label
FROM f_scored s LEFT JOIN x_event_time e ON e.mentee_id = s.mentee_id
LEFT JOIN (SELECT DISTINCT follower_id, following_id FROM f_follows) f ON f.follower_id = s.mentee_id AND f.following_id = s.mentor_id""")
def labels_by_time(t: Tables):
    flat = t.f_follows.select(F.col("follower_id").alias("mentee_id"), F.col("following_id").alias("mentor_id"))
    out = labels.assign_labels_by_time(scored_pairs(t), flat, candidates.first_event_times(t.f_applications), CONFIG)
    return out.select("mentee_id", "mentor_id", "time_split", "label")


@check("contamination_removed", "F11 I5", LABELLED + """,
bad AS (SELECT mentee_id, mentor_id FROM pos GROUP BY mentee_id, mentor_id
        HAVING count(*) FILTER (time_split = 'train') > 0 AND count(*) FILTER (time_split <> 'train') > 0)
SELECT l.mentee_id, l.mentor_id, split AS time_split, CASE WHEN b.mentee_id IS NOT NULL THEN 0 ELSE label END AS label
FROM labelled l LEFT JOIN bad b ON b.mentee_id = l.mentee_id AND b.mentor_id = l.mentor_id AND l.label = 1
WHERE b.mentee_id IS NULL OR split = 'train'""")
def contamination_removed(t: Tables):
    pos = positives(t)
    out = labels.remove_contamination(labels.assign_labels(scored_pairs(t), pos), pos)
    return out.select("mentee_id", "mentor_id", "time_split", "label")


@check("injected_positives", "F6", f"""
WITH pos AS ({POSITIVES}) SELECT mentee_id, mentor_id FROM f_scored UNION SELECT mentee_id, mentor_id FROM pos""")
def injected_positives(t: Tables):
    return candidates.inject_positives(t.f_scored, positives(t))


@check("positive_coverage_by_split", "F7 K5", f"""
WITH pos AS ({POSITIVES})
SELECT p.time_split, count(*) AS total, count(s.mentee_id) AS in_pool, round(100.0 * count(s.mentee_id) / count(*), 1) AS coverage
FROM pos p LEFT JOIN f_scored s ON s.mentee_id = p.mentee_id AND s.mentor_id = p.mentor_id GROUP BY p.time_split""")
def positive_coverage_by_split(t: Tables):
    return candidates.coverage_by_split(positives(t), t.f_scored)


@check("zero_coverage_labels_dropped", "F9 I5", f"""
WITH pos AS ({POSITIVES})
SELECT p.time_split, p.mentee_id, p.mentor_id FROM pos p
LEFT JOIN f_scored s ON s.mentee_id = p.mentee_id AND s.mentor_id = p.mentor_id AND s.skill_coverage_score = 0
WHERE s.mentee_id IS NULL""")
def zero_coverage_labels_dropped(t: Tables):
    return candidates.drop_zero_coverage(positives(t), t.f_scored)


@check("negative_tiers", "F12 F13", LABELLED + """,
neg AS (SELECT *, 0.45 * skill_overlap_score + 0.30 * skill_coverage_score + 0.20 * subdomain_similarity
               + 0.05 * (interaction_score_log / (1.0 + interaction_score_log)) AS hardness,
               CASE WHEN skill_overlap_score > 0 OR subdomain_similarity > 0 THEN 'hard' WHEN mentor_domain_match > 0 THEN 'medium' ELSE 'easy' END AS tier
        FROM labelled WHERE label = 0),
cnt AS (SELECT split, mentee_id, CAST(count(*) FILTER (tier = 'hard') AS INTEGER) AS h, CAST(count(*) FILTER (tier = 'medium') AS INTEGER) AS m,
               CAST(count(*) FILTER (tier = 'easy') AS INTEGER) AS e FROM neg GROUP BY split, mentee_id),
grp AS (SELECT c.*, greatest(p.pos * 4, 10 - p.pos) AS target FROM cnt c
        JOIN (SELECT split, mentee_id, sum(label) AS pos FROM labelled GROUP BY split, mentee_id HAVING sum(label) > 0) p USING (split, mentee_id)),
q1 AS (SELECT *, least(ceil(target * 0.5), h) AS nh, least(ceil(target * 0.3), m) AS nm FROM grp),
q2 AS (SELECT *, greatest(least(target - nh - nm, e), 0) AS ne FROM q1),
q3 AS (SELECT *, greatest(target - nh - nm - ne, 0) AS gap FROM q2),
q4 AS (SELECT *, least(gap, h - nh) AS xh FROM q3),
quota AS (SELECT split, mentee_id, nh + xh AS hard, nm + least(gap - xh, m - nm) AS medium,
                 ne + least(gap - xh - least(gap - xh, m - nm), e - ne) AS easy FROM q4),
ranked AS (SELECT n.*, row_number() OVER (PARTITION BY split, mentee_id ORDER BY round(hardness, 9) DESC, mentor_id) AS rn FROM neg n WHERE tier = 'hard')
SELECT r.split AS time_split, r.mentee_id, r.mentor_id, round(r.hardness, 6) AS hardness_score,
       CAST(q.medium AS BIGINT) AS medium_quota, CAST(q.easy AS BIGINT) AS easy_quota
FROM ranked r JOIN quota q USING (split, mentee_id) WHERE rn <= q.hard""")
def negative_tiers(t: Tables):
    """The hard tier of the sample and how many rows the random tiers got."""
    base = labels.assign_labels(scored_pairs(t), stored_positives(t))
    sample = sampling.sample_tiered(base, 4, 10).where("label = 0").withColumn("tier", sampling.difficulty_tier())
    group = Window.partitionBy("time_split", "mentee_id")
    sized = sample.select(
        "time_split", "mentee_id", "mentor_id", "hardness_score", "tier", F.sum(flag(F.col("tier") == "medium")).over(group).alias("medium_quota"),
        F.sum(flag(F.col("tier") == "easy")).over(group).alias("easy_quota"))
    return r6(sized.where("tier = 'hard'").drop("tier"))


@check("hard_and_random_negatives", "F12 F13", LABELLED + """,
neg AS (SELECT *, 0.45 * skill_overlap_score + 0.30 * skill_coverage_score + 0.20 * subdomain_similarity
               + 0.05 * (interaction_score_log / (1.0 + interaction_score_log)) AS hardness
        FROM labelled WHERE label = 0 AND (skill_overlap_score > 0 OR subdomain_similarity > 0)),
grp AS (SELECT split, mentee_id, least(greatest(pos * 4, 10 - pos), n) AS target FROM
        (SELECT split, mentee_id, sum(label) AS pos FROM labelled GROUP BY split, mentee_id HAVING sum(label) > 0) p
        JOIN (SELECT split, mentee_id, count(*) AS n FROM neg GROUP BY split, mentee_id) USING (split, mentee_id))
SELECT split AS time_split, mentee_id, CAST(target AS BIGINT) AS negatives, CAST(ceil(target * 0.55) AS BIGINT) AS hard FROM grp WHERE target > 0""")
def hard_and_random_negatives(t: Tables):
    base = labels.assign_labels(scored_pairs(t), stored_positives(t))
    sample = sampling.sample_mentor_negatives(base, 4, 10).where("label = 0")
    return sample.groupBy("time_split", "mentee_id").agg(F.count("*").alias("negatives")).withColumn(
        "hard", F.ceil(F.col("negatives") * 0.55))


@check("training_dataset", "F14")
def training_dataset(t: Tables):
    return sampling.training_dataset(labels.assign_clean_labels(scored_pairs(t), stored_positives(t)))


@check("program_label_weights", "F15 F16", """
WITH s AS (
  SELECT CASE WHEN applied_at <= TIMESTAMP '1998-06-30 00:00:00' THEN 'train' WHEN applied_at <= TIMESTAMP '1999-12-31 00:00:00' THEN 'valid' ELSE 'test' END AS time_split,
         mentee_id, post_id, CASE lower(status) WHEN 'accepted' THEN 0.95 WHEN 'rejected' THEN -1.0 ELSE 0 END AS w FROM f_applications
  UNION ALL
  SELECT CASE WHEN start_date <= TIMESTAMP '1998-06-30 00:00:00' THEN 'train' WHEN start_date <= TIMESTAMP '1999-12-31 00:00:00' THEN 'valid' ELSE 'test' END,
         mentee_id, post_id, CASE lower(status) WHEN 'completed' THEN 1.0 WHEN 'cancelled' THEN -0.85 ELSE 0 END FROM f_mentorships)
SELECT time_split, mentee_id, post_id, round(CAST(coalesce(max(w) FILTER (w > 0), 0) AS DOUBLE), 6) AS positive_weight,
       round(CAST(coalesce(max(-w) FILTER (w < 0), 0) AS DOUBLE), 6) AS negative_weight
FROM s WHERE w <> 0 GROUP BY time_split, mentee_id, post_id""")
def program_label_weights(t: Tables):
    return r6(weights(t).select("time_split", "mentee_id", "post_id", "positive_weight", "negative_weight").fillna(0.0))


def weights(t: Tables):
    apps = splits.apply_time_split(t.f_applications, "applied_at", CONFIG)
    return labels.program_label_weights(apps, splits.apply_time_split(t.f_mentorships, "start_date", CONFIG))


@check("program_labels", "F16", """
WITH s AS (
  SELECT CASE WHEN applied_at <= TIMESTAMP '1998-06-30 00:00:00' THEN 'train' WHEN applied_at <= TIMESTAMP '1999-12-31 00:00:00' THEN 'valid' ELSE 'test' END AS time_split,
         mentee_id, post_id, CASE lower(status) WHEN 'accepted' THEN 0.95 WHEN 'rejected' THEN -1.0 ELSE 0 END AS w FROM f_applications),
w AS (SELECT time_split, mentee_id, post_id, max(w) FILTER (w > 0) AS pw, max(-w) FILTER (w < 0) AS nw FROM s WHERE w <> 0 GROUP BY ALL),
spl AS (SELECT DISTINCT mentee_id, time_split FROM w WHERE pw IS NOT NULL),
p AS (SELECT g.mentee_id, g.post_id, coalesce(spl.time_split, 'train') AS time_split, spl.time_split IS NOT NULL AS listed
      FROM f_program_scored g LEFT JOIN spl ON spl.mentee_id = g.mentee_id)
SELECT p.mentee_id, p.post_id, p.time_split, CASE WHEN pw IS NOT NULL THEN 1 ELSE 0 END AS label,
       CAST(CASE WHEN pw IS NOT NULL THEN pw WHEN listed THEN 1 + coalesce(nw, 0) ELSE 1 END AS DOUBLE) AS label_weight
FROM p LEFT JOIN w ON w.mentee_id = p.mentee_id AND w.post_id = p.post_id AND w.time_split = p.time_split""")
def program_labels(t: Tables):
    apps = splits.apply_time_split(t.f_applications, "applied_at", CONFIG)
    out = labels.assign_program_labels(t.f_program_scored.drop("label"), labels.program_label_weights(apps, None))
    return out.select("mentee_id", "post_id", "time_split", "label", "label_weight")


@check("program_dataset", "F17 F18")
def program_dataset(t: Tables):
    base = labels.assign_program_labels(t.f_program_scored.drop("label"), materialize(weights(t), "weights"))
    return sampling.program_dataset(base)


@check("split_frames", "H5", "SELECT time_split, count(*) AS n, CAST(sum(label) AS DOUBLE) AS positives FROM f_scored GROUP BY time_split")
def split_frames(t: Tables):
    out = None
    for name, part in splits.split_frames(t.f_scored).items():
        one = part.groupBy(F.lit(name).alias("time_split")).agg(F.count("*").alias("n"), F.sum("label").cast("double").alias("positives"))
        out = one if out is None else out.union(one)
    return out


# ------------------------------------------------------------------ normalisation


@check("group_minmax", "G2", """
SELECT mentee_id, mentor_id, round(CASE WHEN hi > lo THEN (pred_score - lo) / (hi - lo) ELSE 0.5 END, 6) AS relative
FROM (SELECT *, min(pred_score) OVER (PARTITION BY mentee_id) AS lo, max(pred_score) OVER (PARTITION BY mentee_id) AS hi FROM f_scored)""")
def group_minmax(t: Tables):
    return r6(normalize.minmax(t.f_scored, ["mentee_id"], "pred_score", "relative").select("mentee_id", "mentor_id", "relative"))


CONFIDENCE = """
CASE WHEN hi - lo < 1e-9 THEN least(greatest({x}, 0) / (greatest(hi, 0) + 1e-9), CASE WHEN n = 1 THEN 0.65 ELSE 0.85 END)
     ELSE ({x} - lo) / (hi - lo) * CASE WHEN n = 1 THEN 0.65 WHEN n <= 3 THEN 0.85 WHEN n <= 5 THEN 0.92 ELSE 1 END END"""


@check("confidence_minmax", "G3 G5", f"""
SELECT mentee_id, post_id, spots_left, round({CONFIDENCE.format(x='pred_score')}, 6) AS pred_norm
FROM (SELECT *, min(pred_score) OVER w AS lo, max(pred_score) OVER w AS hi, count(*) OVER w AS n FROM f_program_scored
      WINDOW w AS (PARTITION BY mentee_id, spots_left))""")
def confidence_minmax(t: Tables):
    out = normalize.confidence_minmax(t.f_program_scored, ["mentee_id", "spots_left"], "pred_score", "pred_norm")
    return r6(out.select("mentee_id", "post_id", "spots_left", "pred_norm"))


@check("percent_rank_with_ties", "G6", """
SELECT mentee_id, mentor_id, round((rank() OVER (PARTITION BY mentee_id ORDER BY mentor_weighted_rating)
       + (count(*) OVER (PARTITION BY mentee_id, mentor_weighted_rating) - 1) / 2.0) / count(*) OVER (PARTITION BY mentee_id), 6) AS p
FROM f_scored""")
def percent_rank_with_ties(t: Tables):
    return r6(normalize.average_percent_rank(t.f_scored, ["mentee_id"], "mentor_weighted_rating", "p").select("mentee_id", "mentor_id", "p"))


@check("calibrated_match", "G6", """
SELECT mentee_id, mentor_id, round(CASE WHEN p >= 0.90 THEN 85 + (p - 0.90) / 0.10 * 7 WHEN p >= 0.70 THEN 70 + (p - 0.70) / 0.20 * 14
       WHEN p >= 0.40 THEN 55 + (p - 0.40) / 0.30 * 14 ELSE 30 + p / 0.40 * 25 END, 3) AS pct
FROM (SELECT mentee_id, mentor_id, CAST((rank() OVER (PARTITION BY mentee_id ORDER BY mentor_weighted_rating)
       + (count(*) OVER (PARTITION BY mentee_id, mentor_weighted_rating) - 1) / 2.0) / count(*) OVER (PARTITION BY mentee_id) AS DOUBLE) AS p FROM f_scored)""".replace(", 3) AS pct", ", 1) AS match_percentage").replace("round(CASE", "round_even(CASE"))
def calibrated_match(t: Tables):
    return normalize.calibrated_match(t.f_scored, ["mentee_id"], "mentor_weighted_rating").select(
        "mentee_id", "mentor_id", "match_percentage")


@check("sigmoid_confidence", "G7", """
SELECT mentee_id, mentor_id, round(CASE WHEN n > 1 AND sd > 0 THEN 1 / (1 + exp(-2 * (pred_score - mid) / sd)) ELSE 0.5 END, 6) AS confidence_score
FROM (SELECT s.mentee_id, mentor_id, pred_score, mid, sd, n FROM f_scored s JOIN
      (SELECT mentee_id, quantile_cont(pred_score, 0.5) AS mid, stddev_samp(pred_score) AS sd, count(*) AS n FROM f_scored GROUP BY mentee_id) g
      ON g.mentee_id = s.mentee_id)""")
def sigmoid_confidence(t: Tables):
    return r6(normalize.sigmoid_confidence(t.f_scored, ["mentee_id"], "pred_score").select("mentee_id", "mentor_id", "confidence_score"))


@check("max_normalized", "G8", """
SELECT mentee_id, mentor_id, round(pred_score / (SELECT max(pred_score) FROM f_scored), 6) AS pred_score,
       round(mentor_quality_score / (SELECT max(mentor_quality_score) FROM f_scored), 6) AS mentor_quality_score FROM f_scored""")
def max_normalized(t: Tables):
    out = normalize.max_normalize(t.f_scored, ["pred_score", "mentor_quality_score"])
    return r6(out.select("mentee_id", "mentor_id", "pred_score", "mentor_quality_score"))


# ------------------------------------------------------------------ reranking

X_RERANK = """
WITH g AS (SELECT *, min(pred_score) OVER (PARTITION BY mentee_id) AS lo, max(pred_score) OVER (PARTITION BY mentee_id) AS hi FROM f_scored),
r AS (SELECT *, (0.60 * conf * CASE WHEN hi > lo THEN (pred_score - lo) / (hi - lo) ELSE 0.5 END
        + (1 + 0.60 * (1 - conf) / 0.40) * (0.20 * skill_coverage_score + 0.12 * subdomain_similarity + 0.08 * mentor_domain_match))
        * CASE WHEN skill_coverage_score = 0 AND subdomain_similarity = 0 THEN 0.85
               WHEN skill_coverage_score < 0.2 AND subdomain_similarity < 0.2 THEN 0.92 ELSE 1 END AS rerank_score
      FROM (SELECT *, CASE WHEN hi > lo THEN least(1.0, greatest(0.5, (hi - lo) / 2)) ELSE 0.5 END AS conf FROM g)),
b AS (SELECT *, rerank_score
        * CASE WHEN subdomain_similarity > 0 AND mentor_weighted_rating >= 0.5 THEN 1.015 ELSE 1 END
        * CASE WHEN mentor_open_post_count_log > 0 THEN CASE WHEN skill_coverage_score > 0.75 AND subdomain_similarity > 0.7 THEN 1.05
                    WHEN skill_coverage_score > 0.6 OR subdomain_similarity > 0.7 THEN 1.035 ELSE 1.02 END
               WHEN popularity_log > 0 THEN CASE WHEN skill_coverage_score > 0.75 AND subdomain_similarity > 0.7 THEN 1.015
                    WHEN skill_coverage_score > 0.6 OR subdomain_similarity > 0.7 THEN 1.01 ELSE 1.008 END ELSE 1 END
        * CASE WHEN is_following = 1 THEN 1.005 ELSE 1 END
        * CASE WHEN subdomain_similarity > 0 AND popularity_log > 0 THEN 1.005 ELSE 1 END AS boosted FROM r)"""


@check("multi_signal_rerank", "J1 G2", X_RERANK + """
SELECT mentee_id, mentor_id, round(rerank_score, 6) AS rerank_score FROM r""")
def multi_signal_rerank(t: Tables):
    return r6(rerank.multi_signal_rerank(t.f_scored).select("mentee_id", "mentor_id", "rerank_score"))


@check("soft_boosts", "J2", X_RERANK + """
SELECT mentee_id, mentor_id, round(boosted, 6) AS rerank_score FROM b""")
def soft_boosts(t: Tables):
    return r6(rerank.soft_boosts(rerank.multi_signal_rerank(t.f_scored)).select("mentee_id", "mentor_id", "rerank_score"))


@check("similarity_score", "J3", """
SELECT mentee_id, mentor_id, round_even(100 * least(1, greatest(0, 0.25 * least(skill_overlap_score, 1) + 0.20 * least(skill_coverage_score, 1)
       + 0.15 * least(subdomain_similarity, 1) + 0.15 * (interaction_score_log / (1 + interaction_score_log)) + 0.10 * (1.0 / (1 + experience_gap_abs))
       + 0.15 * least(mentor_quality_score / 5, 1))), 1) AS similarity_score FROM f_scored""")
def similarity_score(t: Tables):
    return t.f_scored.select("mentee_id", "mentor_id", rerank.similarity_score(t.f_scored).alias("similarity_score"))


@check("mentor_reasons", "N21")
def mentor_reasons(t: Tables):
    return t.f_scored.select("mentee_id", "mentor_id", explain.mentor_reasons(t.f_scored).alias("explanation_text"))


@check("top_recommendations", "H12 I1", X_RERANK + """
SELECT mentee_id, mentor_id, CAST(rank AS INTEGER) AS rank, round(boosted, 6) AS rerank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY round(boosted, 9) DESC, mentor_id) AS rank FROM b) WHERE rank <= 10""")
def top_recommendations(t: Tables):
    return r6(rerank.top_recommendations(t.f_scored, 10).select("mentee_id", "mentor_id", "rank", "rerank_score"))


@check("recently_shown_decay", "G13", """
WITH shown AS (SELECT DISTINCT o_custkey AS mentee_id, o_orderdate AS session, l_suppkey AS mentor_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 2),
ages AS (SELECT mentee_id, session, row_number() OVER (PARTITION BY mentee_id ORDER BY session DESC) AS age FROM (SELECT DISTINCT mentee_id, session FROM shown)),
d AS (SELECT s.mentee_id, s.mentor_id, CASE WHEN min(age) = 1 THEN 0.95 ELSE 1 END * power(0.97, count(DISTINCT CASE WHEN age > 1 THEN age END)) AS f
      FROM shown s JOIN ages a ON a.mentee_id = s.mentee_id AND a.session = s.session WHERE age <= 3 GROUP BY s.mentee_id, s.mentor_id)
SELECT x.mentee_id, x.mentor_id, round(pred_score * coalesce(f, 1), 13) AS pred_score FROM f_scored x LEFT JOIN d ON d.mentee_id = x.mentee_id AND d.mentor_id = x.mentor_id""")
def recently_shown_decay(t: Tables):
    shown = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).where("l_linenumber <= 2").select(
        F.col("o_custkey").alias("mentee_id"), F.col("o_orderdate").alias("session"), F.col("l_suppkey").alias("mentor_id")).distinct()
    out = rerank.recent_decay(t.f_scored, shown, "pred_score")
    return out.select("mentee_id", "mentor_id", F.round("pred_score", 13).alias("pred_score"))


X_PROGRAMS = f"""
WITH g AS (SELECT *, min(pred_score) OVER w AS lo, max(pred_score) OVER w AS hi, count(*) OVER w AS n,
                  max(overall_eligibility_softness) OVER w AS best, avg(requirement_coverage_score) OVER w AS cover,
                  avg(CASE WHEN overall_eligibility_softness < 0.35 THEN 1.0 ELSE 0.0 END) OVER w AS weak
           FROM f_program_scored WINDOW w AS (PARTITION BY mentee_id)),
s AS (SELECT *, least(2.0, greatest(0.0, {CONFIDENCE.format(x='pred_score')}
        * CASE WHEN minimum_requirement_exact_match > 0 THEN 1.0 WHEN minimum_requirement_above_minimum > 0 THEN 0.95 ELSE 0.40 END
        * CASE WHEN overall_eligibility_softness >= 0.85 THEN 1.08 WHEN overall_eligibility_softness >= 0.65 THEN 1.03
               WHEN overall_eligibility_softness >= 0.35 THEN 1.0 ELSE 0.92 END
        * (1.0 + 0.008 * least(1, greatest(0, candidate_pre_score)))
        * CASE WHEN overall_eligibility_softness < 0.35 THEN 0.85 WHEN overall_eligibility_softness < 0.65 THEN 0.95 ELSE 1 END
        * CASE WHEN requirement_coverage_score < 0.20 THEN 0.92 ELSE 1 END * CASE WHEN requirement_overlap_score < 0.15 THEN 0.92 ELSE 1 END
        * CASE WHEN matched_required_skill_count > 0 AND missing_required_skill_count > 0.6 * (missing_required_skill_count + matched_required_skill_count) THEN 0.95 ELSE 1 END)) AS rr,
        least(CASE WHEN n = 1 THEN 65 WHEN n <= 3 THEN 75 ELSE 95 END, CASE WHEN weak >= 0.60 THEN 60 WHEN weak >= 0.35 THEN 70 ELSE 100 END,
              CASE WHEN best < 0.35 THEN 65 WHEN best < 0.65 THEN 80 ELSE 100 END, CASE WHEN cover < 0.20 THEN 70 ELSE 100 END) AS ceiling
      FROM g),
m AS (SELECT * EXCLUDE (lo, hi), min(rr) OVER (PARTITION BY mentee_id) AS lo, max(rr) OVER (PARTITION BY mentee_id) AS hi FROM s),
f AS (SELECT *, {CONFIDENCE.format(x='rr')} AS share FROM m),
p AS (SELECT *, least(CASE WHEN requirement_coverage_score < 0.20 THEN least(round_even(least(100, greatest(0, 100 * share)), 1), 70)
        ELSE round_even(least(100, greatest(0, 100 * share)), 1) END, ceiling, CASE WHEN n <= 3 THEN 70 ELSE 100 END) AS pct,
      0.75 * (0.40 * least(requirement_coverage_score, 1) + 0.30 * least(required_skill_level_match_score, 1) + 0.20 * eligibility_pass + 0.10 * least(rr, 1))
        + 0.25 * overall_eligibility_softness AS signal,
      row_number() OVER (PARTITION BY mentee_id ORDER BY minimum_requirement_exact_match DESC, round(rr, 9) DESC, post_id) AS rank FROM f)"""


@check("program_rerank", "J4 J5 J6 J7 J8 J9 G3 G5", X_PROGRAMS + """
SELECT mentee_id, post_id, CAST(rank AS INTEGER) AS rank, round(rr, 6) AS rerank_score, CAST(ceiling AS DOUBLE) AS confidence_ceiling,
       CAST(pct AS DOUBLE) AS match_percentage,
       CASE WHEN signal >= 0.65 THEN 'high' WHEN signal >= 0.35 THEN 'medium' ELSE 'exploratory' END AS recommendation_confidence
FROM p WHERE rank <= 10""")
def program_rerank(t: Tables):
    out = rerank.rerank_programs(t.f_program_scored)
    return out.select("mentee_id", "post_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "confidence_ceiling",
                      "match_percentage", "recommendation_confidence")


@check("program_explanations", "N23 N20")
def program_explanations(t: Tables):
    out = rerank.rerank_programs(t.f_program_scored)
    return out.select("mentee_id", "post_id", "explanation_metadata.*", explain.program_reason(out).alias("reason"))


@check("program_reasons", "N20", """
SELECT mentee_id, post_id, CASE WHEN line = '' THEN 'Matches your profile.' ELSE concat(upper(substr(line, 1, 1)), lower(substr(line, 2)), '.') END AS reason
FROM (SELECT mentee_id, post_id, concat_ws('; ',
        CASE WHEN target_level_pass > 0 AND minimum_requirement_exact_match > 0 THEN 'exact level match'
             WHEN target_level_pass > 0 AND minimum_requirement_above_minimum > 0 THEN 'exceeds minimum level' END,
        CASE WHEN education_level_pass > 0 THEN 'education qualified' END,
        CASE WHEN requirement_coverage_score >= 0.8 THEN CAST(CAST(round_even(requirement_coverage_score * 100, 0) AS BIGINT) AS VARCHAR) || '% skill coverage'
             WHEN requirement_coverage_score >= 0.5 THEN CAST(CAST(round_even(requirement_coverage_score * 100, 0) AS BIGINT) AS VARCHAR) || '% skill match' END) AS line
      FROM f_program_scored)""")
def program_reasons(t: Tables):
    return t.f_program_scored.select("mentee_id", "post_id", explain.program_reason(t.f_program_scored).alias("reason"))


@check("program_chat_reasons", "N20")
def program_chat_reasons(t: Tables):
    return t.f_program_scored.select("mentee_id", "post_id", explain.program_chat_reason(t.f_program_scored).alias("reason"))


@check("overexposed_programs", "J10 K7", X_PROGRAMS + """
SELECT post_id, count(*) AS recommended, (SELECT count(*) FROM p WHERE rank <= 10) AS total,
       CAST(greatest(2, floor((SELECT count(*) FROM p WHERE rank <= 10) * 0.0005)) AS BIGINT) AS max_allowed
FROM p WHERE rank <= 10 GROUP BY post_id
HAVING count(*) > greatest(2, floor((SELECT count(*) FROM p WHERE rank <= 10) * 0.0005))""")
def overexposed_programs(t: Tables):
    return rerank.overexposed(rerank.rerank_programs(t.f_program_scored), share=0.0005)


@check("within_level", "J11", """
SELECT mentee_id, post_id FROM f_program_scored WHERE target_level_gap + 3 <= education_level_gap + 2 + 1""")
def within_level(t: Tables):
    df = t.f_program_scored.withColumn("target_level_num", F.col("target_level_gap") + 3).withColumn(
        "experience_level_num", F.col("education_level_gap") + 2)
    return rerank.within_level(df).select("mentee_id", "post_id")


@check("serving_penalties", "J12", """
SELECT mentee_id, post_id, round(pred_score * CASE WHEN target_level_pass > 0 THEN 1 ELSE 0.85 END * CASE WHEN education_level_pass > 0 THEN 1 ELSE 0.88 END
       * (1 - 0.20 * least(1, greatest(0, (capacity - spots_left) / CAST(greatest(capacity, 1) AS DOUBLE))))
       * CASE WHEN days_until_deadline <= 2 THEN 0.80 WHEN days_until_deadline <= 7 THEN 0.90 ELSE 1 END
       * (1 - 0.15 * (1 - requirement_coverage_score)) / pi(), 6) AS scaled FROM f_program_scored""")
def serving_penalties(t: Tables):
    out = rerank.apply_serving_penalties(t.f_program_scored)
    return out.select("mentee_id", "post_id", off_edges(F.col("pred_score")).alias("scaled"))


@check("match_percentages", "J13", """
SELECT mentee_id, mentor_id, CAST(round_even(55 + 43 * (0.35 * CASE WHEN hi = lo THEN 0.5 ELSE (pred_score - lo) / (hi - lo) END
       + 0.40 * least(1, skill_coverage_score) + 0.25 * least(1, subdomain_similarity)), 0) AS INTEGER) AS match_percentage,
       CAST(round_even(55 + 43 * (0.40 * skill_coverage_score + 0.35 * skill_overlap_score + 0.25 * subdomain_similarity), 0) AS INTEGER) AS signal_percentage
FROM (SELECT *, min(pred_score) OVER (PARTITION BY mentee_id) AS lo, max(pred_score) OVER (PARTITION BY mentee_id) AS hi FROM f_scored)""")
def match_percentages(t: Tables):
    out = rerank.match_percentages(t.f_scored, "pred_score")
    return out.select("mentee_id", "mentor_id", "match_percentage", rerank.signal_match_percentage(out).alias("signal_percentage"))


@check("best_coverage_in_top3", "G11", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY pred_score DESC, mentor_id) AS place FROM f_scored),
b AS (SELECT mentee_id, place AS best FROM (SELECT mentee_id, place, row_number() OVER (PARTITION BY mentee_id ORDER BY skill_coverage_score DESC, place) AS k FROM p) WHERE k = 1)
SELECT p.mentee_id, mentor_id, CAST(CASE WHEN best <= 3 THEN place WHEN place = best THEN 3 WHEN place >= 3 AND place < best THEN place + 1 ELSE place END AS INTEGER) AS rank
FROM p JOIN b ON b.mentee_id = p.mentee_id""")
def best_coverage_in_top3(t: Tables):
    return rerank.best_coverage_in_top3(t.f_scored, "pred_score").select("mentee_id", "mentor_id", "rank")


X_DIVERSE = """
WITH d AS (SELECT s.mentee_id, s.mentor_id, s.pred_score AS score, m.total_reviews, m.country_code AS domain
           FROM f_scored s JOIN f_mentor_profile m ON m.user_id = s.mentor_id),
p AS (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY score DESC, total_reviews DESC, mentor_id) AS place FROM d),
q AS (SELECT *, CASE WHEN place <= 15 AND row_number() OVER (PARTITION BY mentee_id, domain ORDER BY place) > 3 THEN score * 0.97 ELSE score END AS damped FROM p)"""


@check("domain_diversity", "G10", X_DIVERSE.replace("country_code", "domain_id") + """
SELECT mentee_id, mentor_id, CAST(row_number() OVER (PARTITION BY mentee_id ORDER BY damped DESC, total_reviews DESC, place) AS INTEGER) AS rank,
       round(damped, 9) AS score FROM q""")
def domain_diversity(t: Tables):
    lists = t.f_scored.select("mentee_id", "mentor_id", F.col("pred_score").alias("score")).join(
        t.f_mentor_profile.select(F.col("user_id").alias("mentor_id"), "total_reviews", F.col("domain_id").alias("domain")), "mentor_id")
    return rerank.domain_diversity(lists).select("mentee_id", "mentor_id", "rank", F.round("score", 9).alias("score"))


@check("diverse_selection", "G12", """
SELECT * FROM (WITH RECURSIVE p AS (SELECT mentee_id, post_id, mentor_id, subdomain_id, pred_score AS score,
    row_number() OVER (PARTITION BY mentee_id ORDER BY pred_score DESC, post_id) AS place, count(*) OVER (PARTITION BY mentee_id) AS n FROM f_program_scored),
f AS (SELECT DISTINCT mentee_id, CAST(0 AS BIGINT) AS place, n, CAST([] AS BIGINT[]) AS places, CAST([] AS BIGINT[]) AS mentors, CAST([] AS BIGINT[]) AS fields FROM p
  UNION ALL SELECT mentee_id, place, n, CASE WHEN fits THEN list_append(places, place) ELSE places END,
    CASE WHEN fits THEN list_append(mentors, mentor_id) ELSE mentors END, CASE WHEN fits THEN list_append(fields, subdomain_id) ELSE fields END
  FROM (SELECT f.mentee_id, p.place, f.n, places, mentors, fields, p.mentor_id, p.subdomain_id,
      len(places) < 10 AND len(list_filter(mentors, lambda x: x = p.mentor_id)) < 3 AND len(list_filter(fields, lambda x: x = p.subdomain_id)) < 4 AS fits
    FROM f JOIN p ON p.mentee_id = f.mentee_id AND p.place = f.place + 1)),
o AS (SELECT p.*, row_number() OVER (PARTITION BY p.mentee_id ORDER BY CASE WHEN p.n <= 10 OR list_contains(places, p.place) THEN 0 ELSE 1 END, p.place) AS rank
  FROM p JOIN (SELECT mentee_id, places FROM f WHERE place = n) c USING (mentee_id))
SELECT mentee_id, rank, post_id, mentor_id, subdomain_id, round(score, 9) AS score FROM o WHERE rank <= 10)""")
def diverse_selection(t: Tables):
    return rerank.diverse_selection(t.f_program_scored, score="pred_score").withColumn("score", F.round("score", 9))


@check("prefiltered_lists", "F21 F2", """
WITH r AS (SELECT *, 1.0 + 0.3 * CASE WHEN mx > 0 THEN spots_left / CAST(mx AS DOUBLE) ELSE 0 END + 0.2 * requirement_coverage_score
             + 0.2 * least(days_until_deadline / 30.0, 1.0) AS rough
           FROM (SELECT *, max(spots_left) OVER (PARTITION BY mentee_id) AS mx FROM f_program_scored))
SELECT mentee_id, post_id FROM (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY round(rough, 9) DESC, post_id) AS rn FROM r) WHERE rn <= 30""")
def prefiltered_lists(t: Tables):
    rows = t.f_program_scored
    return rerank.prefilter_lists(rows, target=30).select("mentee_id", "post_id")


@check("user_prefilter", "F22", """
SELECT mentee_id, mentor_id FROM (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY interaction_score_log DESC, mentor_id) AS rn FROM f_scored) WHERE rn <= 20""")
def user_prefilter(t: Tables):
    return rerank.rough_user_prefilter(t.f_scored, 20).select("mentee_id", "mentor_id")


@check("global_top_k", "F3 I2", """
SELECT mentor_id, popularity FROM (SELECT mentor_id, round(popularity, 6) AS popularity FROM x_popularity ORDER BY round(popularity, 9) DESC, mentor_id LIMIT 15)""")
def global_top_k(t: Tables):
    from matchspark.checks.people import engagement
    from matchspark.plans import people
    pop = people.mentor_popularity(t.f_programs, t.f_mentorships, engagement(t)).select(
        "mentor_id", F.col("mentor_program_popularity").alias("popularity"))
    return r6(topk.global_topk(pop, [F.col("popularity").desc(), F.col("mentor_id")], 15))


# ------------------------------------------------------------------ metrics

X_METRICS = """
WITH g AS (SELECT mentee_id, count(*) AS n, sum(label) AS pos FROM f_scored GROUP BY mentee_id),
r AS (SELECT mentee_id, label, row_number() OVER (PARTITION BY mentee_id ORDER BY pred_score DESC, mentor_id) AS r FROM f_scored),
k AS (SELECT *, sum(label) OVER (PARTITION BY mentee_id ORDER BY r) AS seen FROM r WHERE r <= 10),
s AS (SELECT mentee_id, sum(label) AS hits, sum(label / log2(r + 1)) AS dcg, sum(CASE WHEN label = 1 THEN seen / CAST(r AS DOUBLE) ELSE 0 END) AS ap,
             min(CASE WHEN label = 1 THEN r END) AS first_hit FROM k GROUP BY mentee_id),
i AS (SELECT p, sum(1 / log2(j + 1)) AS ideal FROM range(1, 11) a(p), range(1, 11) b(j) WHERE j <= p GROUP BY p),
m AS (SELECT g.mentee_id, n, pos, hits, CASE WHEN pos > 0 THEN dcg / ideal ELSE 0 END AS ndcg, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS hit,
             hits / least(n, 10) AS prec, CASE WHEN pos > 0 THEN hits / pos ELSE 0 END AS rec,
             CASE WHEN pos > 0 THEN ap / least(10, n, pos) ELSE 0 END AS ap, coalesce(1.0 / first_hit, 0) AS rr
      FROM g JOIN s ON s.mentee_id = g.mentee_id LEFT JOIN i ON i.p = least(g.pos, 10))"""


@check("ranking_metrics", "K1", X_METRICS + """
SELECT round(avg(ndcg) FILTER (pos > 0 AND n >= 25), 6) AS filtered_ndcg_at_10, round(avg(hit) FILTER (pos > 0 AND n >= 25), 6) AS filtered_hitrate_at_10,
       round(avg(prec) FILTER (pos > 0 AND n >= 25), 6) AS filtered_precision_at_10, round(avg(ap) FILTER (pos > 0 AND n >= 25), 6) AS filtered_map_at_10,
       round(avg(rec) FILTER (pos > 0 AND n >= 25), 6) AS filtered_recall_at_10,
       round(avg(CASE WHEN pos > 0 AND n >= 25 THEN ndcg ELSE 0 END), 6) AS global_ndcg_at_10, round(avg(CASE WHEN pos > 0 AND n >= 25 THEN hit ELSE 0 END), 6) AS global_hitrate_at_10,
       round(avg(CASE WHEN pos > 0 AND n >= 25 THEN prec ELSE 0 END), 6) AS global_precision_at_10, round(avg(CASE WHEN pos > 0 AND n >= 25 THEN ap ELSE 0 END), 6) AS global_map_at_10,
       round(avg(CASE WHEN pos > 0 AND n >= 25 THEN rec ELSE 0 END), 6) AS global_recall_at_10,
       count(*) FILTER (pos > 0 AND n >= 25) AS evaluated_groups, count(*) AS total_groups, count(*) FILTER (pos = 0) AS skipped_no_positive,
       count(*) FILTER (pos > 0 AND n < 25) AS skipped_small_group, count(*) FILTER (NOT (pos > 0 AND n >= 25)) AS impossible_users FROM m""")
def ranking_metrics(t: Tables):
    return r6(metrics.evaluate_ranking(t.f_scored, 10, 25))


@check("group_ranking_metrics", "K3 K1", X_METRICS + """
SELECT mentee_id, n, CAST(pos AS BIGINT) AS positives, round(ndcg, 6) AS ndcg, hit, round(CAST(prec AS DOUBLE), 6) AS precision, round(CAST(rec AS DOUBLE), 6) AS recall,
       round(ap, 6) AS ap, round(CAST(rr AS DOUBLE), 6) AS rr FROM m""")
def group_ranking_metrics(t: Tables):
    return r6(metrics.group_metrics(t.f_scored, 10))


@check("program_metrics", "K2", X_METRICS.replace("f_scored", "f_program_scored").replace("mentor_id", "post_id") + """
SELECT round(avg(ndcg), 6) AS ndcg_at_10, round(avg(CAST(hit AS DOUBLE)), 6) AS hitrate_at_10, round(avg(rr), 6) AS mrr_at_10, count(*) AS groups FROM m WHERE pos > 0 AND n >= 2""")
def program_metrics(t: Tables):
    return r6(metrics.evaluate_programs(t.f_program_scored, 10))


@check("rerank_impact", "G14", X_RERANK + """,
o AS (SELECT mentee_id, mentor_id FROM (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY pred_score DESC, mentor_id) AS rn FROM b) WHERE rn <= 10),
n AS (SELECT mentee_id, mentor_id FROM (SELECT *, row_number() OVER (PARTITION BY mentee_id ORDER BY round(rerank_score, 9) DESC, mentor_id) AS rn FROM b) WHERE rn <= 10),
c AS (SELECT o.mentee_id, 1 - count(n.mentor_id) / CAST(count(*) AS DOUBLE) AS changed FROM o LEFT JOIN n ON n.mentee_id = o.mentee_id AND n.mentor_id = o.mentor_id GROUP BY o.mentee_id)
SELECT round(avg(changed), 6) AS mean_changed, round(max(changed), 6) AS max_changed FROM c""")
def rerank_impact(t: Tables):
    after = rerank.multi_signal_rerank(t.f_scored).withColumn("pred_score", F.col("rerank_score"))
    return r6(metrics.rerank_impact(t.f_scored, after))


@check("score_spread", "K4", """
SELECT round(quantile_cont(sd, 0.5), 6) AS median_deviation, round(quantile_cont(rg, 0.5), 6) AS median_range
FROM (SELECT stddev_samp(pred_score) AS sd, max(pred_score) - min(pred_score) AS rg FROM f_scored GROUP BY mentee_id)""")
def score_spread(t: Tables):
    return r6(metrics.score_spread(t.f_scored))


@check("candidate_stats", "K5", """
SELECT count(*) AS candidate_count, count(DISTINCT mentee_id) AS candidate_mentees, count(DISTINCT mentor_id) AS candidate_items,
       round(count(*) / CAST(count(DISTINCT mentee_id) AS DOUBLE), 1) AS avg_candidates_per_mentee, count(*) / CAST(count(DISTINCT mentee_id) AS DOUBLE) < 5 AS shrinkage_warning FROM f_scored""")
def candidate_stats(t: Tables):
    return metrics.candidate_stats(t.f_scored)


@check("stage_positive_coverage", "K5", f"""
WITH pos AS ({POSITIVES})
SELECT count(*) AS positives, count(s.mentee_id) AS in_pool, (SELECT count(*) FROM f_scored) AS candidates,
       (SELECT count(DISTINCT mentee_id) FROM f_scored WHERE label > 0) AS mentees_with_positive
FROM pos p LEFT JOIN f_scored s ON s.mentee_id = p.mentee_id AND s.mentor_id = p.mentor_id""")
def stage_positive_coverage(t: Tables):
    return metrics.positive_coverage(t.f_scored, positives(t))


@check("sampling_diagnostics", "K6", """
WITH d AS (SELECT *, 0.45 * skill_overlap_score + 0.30 * skill_coverage_score AS hardness_score FROM f_scored WHERE time_split = 'train')
SELECT count(*) FILTER (label = 1) AS train_positive_count, count(*) FILTER (label = 0) AS train_negative_count,
       round(avg(hardness_score) FILTER (label = 0), 6) AS hardness_mean, round(stddev_samp(hardness_score) FILTER (label = 0), 6) AS hardness_std,
       count(DISTINCT mentor_id) AS training_unique_items, count(DISTINCT mentee_id) AS training_unique_mentees,
       round(count(*) FILTER (label = 0) / CAST(count(*) FILTER (label = 1) AS DOUBLE), 2) AS train_neg_pos_ratio,
       round(quantile_cont(hardness_score, 0.25) FILTER (label = 0), 6) AS hardness_q25, round(quantile_cont(hardness_score, 0.75) FILTER (label = 0), 6) AS hardness_q75 FROM d""")
def sampling_diagnostics(t: Tables):
    df = t.f_scored.withColumn("hardness_score", 0.45 * F.col("skill_overlap_score") + 0.30 * F.col("skill_coverage_score"))
    return r6(metrics.sampling_diagnostics(df))


@check("recommendation_concentration", "K7", """
SELECT count(*) AS unique_items, round(max(c) / CAST(sum(c) AS DOUBLE), 6) AS top_share, max(c) / CAST(sum(c) AS DOUBLE) > 0.30 AS collapse_warning
FROM (SELECT post_id, count(*) AS c FROM f_program_scored GROUP BY post_id)""")
def recommendation_concentration(t: Tables):
    return r6(metrics.concentration(t.f_program_scored))


@check("coverage_sample", "K12")
def coverage_sample(t: Tables):
    return metrics.coverage_sample(t.f_scored)


@check("sparse_features", "M15", """
SELECT feature, round(s, 6) AS nonzero_share, s < 0.05 AS too_sparse FROM (
  SELECT 'interaction_score_log' AS feature, avg(CASE WHEN interaction_score_log <> 0 THEN 1.0 ELSE 0.0 END) AS s FROM f_scored
  UNION ALL SELECT 'popularity_log', avg(CASE WHEN popularity_log <> 0 THEN 1.0 ELSE 0.0 END) FROM f_scored
  UNION ALL SELECT 'subdomain_similarity', avg(CASE WHEN subdomain_similarity <> 0 THEN 1.0 ELSE 0.0 END) FROM f_scored)""")
def sparse_features(t: Tables):
    return r6(pairs.sparse_features(t.f_scored, ["interaction_score_log", "popularity_log", "subdomain_similarity"]))
