"""Queries: scalers, factors, the ranker and both complete flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.checks.cleaning import raw_tables
from matchspark.checks.people import engagement, r6
from matchspark.checks.registry import check
from matchspark.fixtures import Tables
from matchspark.operators import factors, listwise, ranker, scaling
from matchspark.plans import mentor_flow, pairs, people, program_flow, programs
from matchspark.session import materialize

FEATURES = ["skill_coverage_score", "subdomain_similarity", "mentor_weighted_rating", "interaction_score_log"]


@check("minmax_scaled", "H6 H14", """
WITH m AS (SELECT min(pred_score) AS a, max(pred_score) AS b, min(mentor_quality_score) AS c, max(mentor_quality_score) AS d FROM f_scored WHERE time_split = 'train')
SELECT mentee_id, mentor_id, round((pred_score - a) / (b - a), 6) AS pred_score, round((mentor_quality_score - c) / (d - c), 6) AS mentor_quality_score FROM f_scored, m WHERE time_split = 'test'""")
def minmax_scaled(t: Tables):
    df = t.f_scored.select("mentee_id", "mentor_id", "time_split", "pred_score", "mentor_quality_score")
    scaler = scaling.fit_minmax(df.where("time_split = 'train'"), ["pred_score", "mentor_quality_score"])
    return r6(scaling.apply_scaler(df.where("time_split = 'test'"), scaler).drop("time_split"))


@check("grouped_scaled", "H7 H14", """
WITH m AS (SELECT min(requirement_overlap_score) AS a, max(requirement_overlap_score) AS b, quantile_cont(pred_score, 0.25) AS q1, quantile_cont(pred_score, 0.5) AS q2, quantile_cont(pred_score, 0.75) AS q3 FROM f_program_scored)
SELECT mentee_id, post_id, round((pred_score - q2) / (q3 - q1), 6) AS pred_score, round((requirement_overlap_score - a) / (b - a), 6) AS requirement_overlap_score FROM f_program_scored, m""")
def grouped_scaled(t: Tables):
    df = t.f_program_scored.select("mentee_id", "post_id", "pred_score", "requirement_overlap_score")
    return r6(scaling.apply_scaler(df, scaling.fit_grouped(df, ["pred_score", "requirement_overlap_score"])))


@check("ranking_frame", "H13 B23", """
SELECT mentee_id, mentor_id, label, CASE WHEN mentor_id % 4 = 0 THEN 0 ELSE skill_coverage_score END AS skill_coverage_score FROM f_scored""")
def ranking_frame(t: Tables):
    df = t.f_scored.select("mentee_id", "mentor_id", F.col("label").cast("string").alias("label"),
                           F.when(F.col("mentor_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("skill_coverage_score")).alias("skill_coverage_score"))
    return ranker.ranking_frame(df, ["skill_coverage_score"])


@check("linear_scores", "H9", """
SELECT mentee_id, mentor_id, round(0.4 * skill_coverage_score - 0.25 * subdomain_similarity + 1.5 * mentor_weighted_rating, 6) AS pred_score FROM f_scored""")
def linear_scores(t: Tables):
    weights = {"skill_coverage_score": 0.4, "subdomain_similarity": -0.25, "mentor_weighted_rating": 1.5}
    return r6(ranker.score(t.f_scored, weights).select("mentee_id", "mentor_id", "pred_score"))


@check("training_pairs", "H8", """
SELECT count(*) AS pairs FROM f_scored s JOIN (SELECT mentee_id FROM f_scored WHERE label = 1 GROUP BY mentee_id) p ON p.mentee_id = s.mentee_id WHERE label = 0""")
def training_pairs(t: Tables):
    return ranker.difference_rows(t.f_scored, FEATURES).agg(F.count("*").alias("pairs"))


@check("listwise_step", "H8 K1", """
WITH s AS (SELECT mentee_id, mentor_id, label > 0 AS hit, CASE WHEN label = 1 THEN 1 + 3 * skill_coverage_score ELSE 1 END AS w,
    skill_coverage_score AS x0, subdomain_similarity AS x1, mentor_weighted_rating AS x2, interaction_score_log AS x3,
    0.4 * skill_coverage_score - 0.25 * subdomain_similarity + 1.5 * mentor_weighted_rating + 0.1 * interaction_score_log AS s FROM f_scored),
r AS (SELECT *, 1 / log2(1 + row_number() OVER (PARTITION BY mentee_id ORDER BY s DESC, mentor_id)) AS gain,
    row_number() OVER (PARTITION BY mentee_id ORDER BY s DESC, mentor_id) AS place FROM s),
g AS (SELECT mentee_id, sum(exp(s)) FILTER (NOT hit) AS z, sum(exp(s) * x0) FILTER (NOT hit) AS p0, sum(exp(s) * x1) FILTER (NOT hit) AS p1,
    sum(exp(s) * x2) FILTER (NOT hit) AS p2, sum(exp(s) * x3) FILTER (NOT hit) AS p3, count(*) FILTER (hit) AS n,
    sum(gain) FILTER (hit AND place <= 10) AS dcg FROM r GROUP BY mentee_id HAVING count(*) FILTER (hit) > 0),
i AS (SELECT n, sum(1 / log2(j + 1)) AS ideal, sum(1 / log2(j + 1)) FILTER (j <= 10) AS ideal10
    FROM (SELECT DISTINCT n FROM g), generate_series(1, 1000) AS t(j) WHERE j <= n GROUP BY n),
t AS (SELECT mentee_id, sum(c * ((p0 + e * x0) / z - x0)) AS g0, sum(c * ((p1 + e * x1) / z - x1)) AS g1, sum(c * ((p2 + e * x2) / z - x2)) AS g2,
    sum(c * ((p3 + e * x3) / z - x3)) AS g3, sum(c * (ln(z) - s)) AS loss FROM (
    SELECT r.mentee_id, x0, x1, x2, x3, s, exp(s) AS e, g.z + exp(s) AS z, p0, p1, p2, p3, w * (1 - gain) / ideal AS c
    FROM r JOIN g USING (mentee_id) JOIN i USING (n) WHERE hit AND g.z IS NOT NULL) GROUP BY mentee_id),
v AS (SELECT avg(coalesce(dcg, 0) / ideal10) AS ndcg FROM g JOIN i USING (n))
SELECT round(avg(g0), 6) AS g0, round(avg(g1), 6) AS g1, round(avg(g2), 6) AS g2, round(avg(g3), 6) AS g3, round(avg(loss), 6) AS loss,
    (SELECT round(ndcg, 6) FROM v) AS ndcg FROM t""")
def listwise_step(t: Tables):
    """Gradient and loss of the whole lists at given weights, and their NDCG."""
    grouped = listwise.lists(t.f_scored, FEATURES)
    both = grouped.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("valid"))
    return r6(listwise.step(both, [0.4, -0.25, 1.5, 0.1]))


@check("listwise_history", "H8")
def listwise_history(t: Tables):
    """Loss and validation NDCG of every step of a fit on the train lists."""
    rows = materialize(ranker.ranking_frame(t.f_scored.select("mentee_id", "mentor_id", "label", "time_split", *FEATURES), FEATURES), "rows")
    fit = listwise.train(rows.where("time_split = 'train'"), rows.where("time_split <> 'train'"), FEATURES, steps=20)
    return t.f_scored.sparkSession.createDataFrame(fit.history, "rate double, step int, loss double, valid_ndcg double")


@check("feature_importance", "H8 H10")
def feature_importance(t: Tables):
    rows = materialize(t.f_scored.select("mentee_id", "mentor_id", "label", *FEATURES), "rows")
    model = ranker.fit(rows, FEATURES)
    return ranker.importance(rows, ranker.weights_of(model, FEATURES))


@check("cf_cells", "D15 H2", """
SELECT user_id AS "user", post_id AS item, round(ln(1 + sum(score)), 6) AS value FROM (SELECT DISTINCT kind, user_id, post_id, score FROM f_engagement) GROUP BY user_id, post_id""")
def cf_cells(t: Tables):
    return r6(programs.cf_cells(engagement(t)))


@check("mentor_cf_cells", "D15 H1", """
SELECT "user", item, round(ln(1 + sum(score)), 6) AS value FROM (
  SELECT user_id AS "user", mentor_id AS item, sum(score) AS score FROM (SELECT DISTINCT kind, user_id, post_id, score FROM f_engagement) e JOIN x_owner o ON o.post_id = e.post_id GROUP BY ALL
  UNION ALL SELECT DISTINCT mentee_id, mentor_id, 5 FROM f_mentorships) GROUP BY "user", item""")
def mentor_cf_cells(t: Tables):
    return r6(factors.mentor_cells(people.interaction_features(engagement(t), t.f_programs), t.f_mentorships))


@check("latent_factor_scores", "H1 H3 H4")
def latent_factor_scores(t: Tables):
    """Factor scores of the pairs that have an application."""
    cells = factors.mentor_cells(people.interaction_features(engagement(t), t.f_programs), t.f_mentorships)
    users, items = factors.latent_factors(cells, rank=8, oversample=4, rounds=2)
    applied = t.f_applications.select("mentee_id", "mentor_id").distinct()
    return pairs.add_cf_score(applied, users, items).withColumn("cf_score", F.round("cf_score", 6))


@check("mentor_flow_metrics", "H15 H8 H12 F14 K1")
def mentor_flow_metrics(t: Tables):
    return mentor_flow.run(raw_tables(t)).metrics


@check("mentor_flow_lists", "H15 J16 J15")
def mentor_flow_lists(t: Tables):
    """The lists of every mentee by the freshly trained model."""
    return mentor_flow.run(raw_tables(t)).lists


@check("program_flow_metrics", "H16 F18 K2")
def program_flow_metrics(t: Tables):
    return program_flow.run(raw_tables(t)).metrics


@check("program_flow_lists", "H16")
def program_flow_lists(t: Tables):
    """The programs of every mentee by the freshly trained model."""
    return program_flow.run(raw_tables(t)).recommendations.select(
        "mentee_id", "post_id", "rank", "rerank_score", "match_percentage")
