"""Reranking of scored mentor and program lists, and the percentages shown for them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchspark.functions import compat
from matchspark.functions.numbers import clip, flag, safe_double
from matchspark.operators.groupstats import with_group_stats, with_list_stats
from matchspark.operators.normalize import confidence_minmax
from matchspark.operators.topk import grouped_topk

# ---------------------------------------------------------------- fixed values
RERANK_WEIGHTS = {"pred_score": 0.60, "skill_coverage": 0.20, "subdomain": 0.12, "domain_match": 0.08}
WEAK_MATCH, NO_MATCH, WEAK_BELOW = 0.92, 0.85, 0.2
BOOSTS = {"high_rating_same_subdomain": 1.015, "open_programs": 1.02, "completed_programs": 1.008,
          "followed": 1.005, "active_popular_same_subdomain": 1.005}
OPEN_BOOST = {"very_high": 1.05, "high": 1.035}
COMPLETED_BOOST = {"very_high": 1.015, "high": 1.01}
SIMILARITY_WEIGHTS = {"overlap": 0.25, "coverage": 0.20, "subdomain": 0.15, "interaction": 0.15,
                      "experience": 0.10, "quality": 0.15}
RECENT_DECAY = {"last": 0.95, "earlier": 0.97}
RECENT_SESSIONS = 3
WEAK_COVERAGE, WEAK_OVERLAP, WEAK_PROGRAM = 0.20, 0.15, 0.92
REPEAT_PENALTY = 0.97
EXPOSURE_SHARE = 0.25
CONFIDENT, FAIRLY_CONFIDENT = 0.65, 0.35
# -----------------------------------------------------------------------------


def optional(df: DataFrame, column: str, default: float = 0.0) -> Column:
    """A numeric column, or the default when the frame has none or a row has no value."""
    return F.coalesce(F.col(column).cast("double"), F.lit(default)) if column in df.columns else F.lit(default)


def multi_signal_rerank(scored: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``rerank_score``: the model score blended with compatibility signals.

    The tighter the model scores of a mentee lie, the more weight moves from the model to skill
    coverage, subdomain and domain; pairs with hardly any match are damped.
    """
    w = RERANK_WEIGHTS | dict(weights or {})
    out = with_group_stats(scored, ["mentee_id"], _low=F.min("pred_score"), _high=F.max("pred_score"))
    spread = F.col("_high") - F.col("_low")
    relative = F.when(spread > 0, (F.col("pred_score") - F.col("_low")) / F.when(spread > 0, spread)).otherwise(0.5)
    confidence = F.when(spread > 0, F.least(F.greatest(spread / 2.0, F.lit(0.5)), F.lit(1.0))).otherwise(0.5)
    others = w["skill_coverage"] + w["subdomain"] + w["domain_match"]
    lift = 1.0 + w["pred_score"] * (1.0 - confidence) / others if others > 0 else F.lit(1.0)
    coverage = optional(scored, "skill_coverage_score")
    subdomain = optional(scored, "subdomain_similarity")
    domain = optional(scored, "mentor_domain_match")
    blend = w["pred_score"] * confidence * relative + lift * (
        w["skill_coverage"] * coverage + w["subdomain"] * subdomain + w["domain_match"] * domain)
    damping = (F.when((coverage == 0) & (subdomain == 0), NO_MATCH)
               .when((coverage < WEAK_BELOW) & (subdomain < WEAK_BELOW), WEAK_MATCH).otherwise(1.0))
    return out.withColumn("rerank_score", blend * damping).drop("_low", "_high")


def soft_boosts(scored: DataFrame, boosts: Mapping[str, float] | None = None) -> DataFrame:
    """Multiply ``rerank_score`` by small factors for quality, availability, following and popularity."""
    b = BOOSTS | dict(boosts or {})
    base = F.col("rerank_score") if "rerank_score" in scored.columns else optional(scored, "pred_score")
    coverage = optional(scored, "skill_coverage_score")
    subdomain = optional(scored, "subdomain_similarity")
    same_field = subdomain > 0
    popular = optional(scored, "popularity_log" if "popularity_log" in scored.columns else "mentor_follower_count_log") > 0
    opened = optional(scored, "mentor_open_post_count_log") > 0
    completed = ~opened & (optional(scored, "popularity_log") > 0)
    very_high = (coverage > 0.75) & (subdomain > 0.7)
    high = (coverage > 0.6) | (subdomain > 0.7)

    def by_match(very: float, strong: float, weak: float) -> Column:
        return F.when(very_high, very).when(high, strong).otherwise(weak)

    quality = F.when(same_field & (optional(scored, "mentor_weighted_rating") >= 0.5), b["high_rating_same_subdomain"])
    availability = (
        F.when(opened, by_match(OPEN_BOOST["very_high"], OPEN_BOOST["high"], b["open_programs"]))
        .when(completed, by_match(COMPLETED_BOOST["very_high"], COMPLETED_BOOST["high"], b["completed_programs"])))
    social = F.when(optional(scored, "is_following") == 1, b["followed"])
    active = F.when(same_field & popular, b["active_popular_same_subdomain"])
    factor = F.lit(1.0)
    for part in (quality, availability, social, active):
        factor = factor * part.otherwise(1.0)
    return scored.withColumn("rerank_score", base * factor)


def similarity_score(df: DataFrame) -> Column:
    """User-facing similarity 0..100."""
    w = SIMILARITY_WEIGHTS

    def unit(c: Column) -> Column:
        return clip(c, 0.0, 1.0)

    interaction = optional(df, "interaction_score_log")
    mix = (
        w["overlap"] * unit(optional(df, "skill_overlap_score"))
        + w["coverage"] * unit(optional(df, "skill_coverage_score"))
        + w["subdomain"] * unit(optional(df, "subdomain_similarity"))
        + w["interaction"] * (interaction / (1.0 + interaction))
        + w["experience"] * (1.0 / (1.0 + optional(df, "experience_gap_abs")))
        + w["quality"] * unit(optional(df, "mentor_quality_score") / 5.0))
    return F.bround(unit(mix) * 100, 1)


def recent_decay(ranked: DataFrame, shown: DataFrame, score: str = "rerank_score") -> DataFrame:
    """Damp mentors a mentee saw in its last sessions. ``shown`` is (mentee_id, session, mentor_id)."""
    sessions = shown.select("mentee_id", "session").distinct()
    recent = grouped_topk(sessions, ["mentee_id"], [F.col("session").desc()], RECENT_SESSIONS, rank="_age")
    factor = (F.pow(F.lit(RECENT_DECAY["last"]), F.max(flag(F.col("_age") == 1)))
              * F.pow(F.lit(RECENT_DECAY["earlier"]), F.countDistinct(F.when(F.col("_age") > 1, F.col("_age")))))
    decay = shown.join(recent, ["mentee_id", "session"]).groupBy("mentee_id", "mentor_id").agg(factor.alias("_decay"))
    return ranked.join(decay, ["mentee_id", "mentor_id"], "left").withColumn(
        score, F.col(score) * F.coalesce("_decay", F.lit(1.0))).drop("_decay")


def keep_recent_sessions(shown: DataFrame) -> DataFrame:
    """The shown log cut to the last sessions of every mentee."""
    sessions = shown.select("mentee_id", "session").distinct()
    recent = grouped_topk(sessions, ["mentee_id"], [F.col("session").desc()], RECENT_SESSIONS)
    return shown.join(recent, ["mentee_id", "session"], "left_semi")


def top_recommendations(scored: DataFrame, k: int = 10, rerank: bool = True) -> DataFrame:
    """First ``k`` mentors per mentee, reranked and boosted, with similarity and explanation."""
    from matchspark.functions.explain import mentor_reasons
    out = scored.withColumn("similarity_score", similarity_score(scored)).withColumn(
        "explanation_text", mentor_reasons(scored))
    score = "pred_score"
    if rerank:
        out, score = soft_boosts(multi_signal_rerank(out)), "rerank_score"
    return grouped_topk(out, ["mentee_id"], [F.col(score).desc(), F.col("mentor_id")], k, rank="rank")


# ------------------------------------------------------------------ programs


def weak_program_penalty(df: DataFrame) -> Column:
    """Product of penalties for weak fit, weak coverage, weak overlap and many missing skills."""
    soft = F.col("overall_eligibility_softness") if "overall_eligibility_softness" in df.columns else F.lit(None).cast("double")
    fit = F.when(soft < compat.STRETCH_FIT, 0.85).when(soft < compat.NEAR_FIT, 0.95).otherwise(1.0)
    coverage = F.when(optional(df, "requirement_coverage_score") < WEAK_COVERAGE, WEAK_PROGRAM).otherwise(1.0)
    overlap = F.when(optional(df, "requirement_overlap_score") < WEAK_OVERLAP, WEAK_PROGRAM).otherwise(1.0)
    matched, missing = optional(df, "matched_required_skill_count"), optional(df, "missing_required_skill_count")
    gaps = F.when((matched > 0) & (missing > 0.6 * (missing + matched)), 0.95).otherwise(1.0)
    return fit * coverage * overlap * gaps


def requirement_constraint(df: DataFrame) -> Column:
    exact = optional(df, "minimum_requirement_exact_match") > 0
    above = optional(df, "minimum_requirement_above_minimum") > 0
    return F.when(exact, 1.0).when(above, 0.95).otherwise(0.40)


def softness_multiplier(soft: Column) -> Column:
    return (F.when(soft >= compat.EXACT_FIT, 1.08).when(soft >= compat.NEAR_FIT, 1.03)
            .when(soft >= compat.STRETCH_FIT, 1.0).otherwise(0.92))


def repeat_penalty(df: DataFrame, score: str = "rerank_score") -> DataFrame:
    """A program listed again for the same mentee loses a little, in lists of more than two."""
    sized = with_list_stats(df, ["mentee_id"], _n=F.count("*"))
    again = F.row_number().over(Window.partitionBy("mentee_id", "post_id").orderBy(F.col(score).desc())) > 1
    return sized.withColumn("_again", again).withColumn(
        score, F.when((F.col("_n") > 2) & F.col("_again"), F.col(score) * REPEAT_PENALTY).otherwise(F.col(score))
    ).drop("_n", "_again")


def confidence_ceiling(df: DataFrame) -> DataFrame:
    """Highest match percentage a mentee's list may show, from its size, fit and coverage."""
    soft = optional(df, "overall_eligibility_softness")
    out = with_list_stats(
        df, ["mentee_id"], _n=F.count("*"), _weak=F.avg(flag(soft < compat.STRETCH_FIT).cast("double")),
        _best=F.max(soft), _cover=F.avg(optional(df, "requirement_coverage_score")))
    n, best = F.col("_n"), F.col("_best")
    top = F.lit(100.0)
    parts = [
        F.when(n == 1, 65.0).when(n <= compat.SPARSE_CANDIDATES, 75.0).otherwise(95.0),
        F.when(F.col("_weak") >= 0.60, 60.0).when(F.col("_weak") >= 0.35, 70.0).otherwise(top),
        F.when(best < compat.STRETCH_FIT, 65.0).when(best < compat.NEAR_FIT, 80.0).otherwise(top),
        F.when(F.col("_cover") < 0.20, 70.0).otherwise(top)]
    return out.withColumn("confidence_ceiling", F.least(*parts)).drop("_n", "_weak", "_best", "_cover")


def program_confidence(df: DataFrame, score: str = "rerank_score") -> Column:
    """high / medium / exploratory."""
    one = F.lit(1.0)
    signal = (
        0.40 * F.least(optional(df, "requirement_coverage_score"), one)
        + 0.30 * F.least(optional(df, "required_skill_level_match_score"), one)
        + 0.20 * flag(optional(df, "eligibility_pass") > 0) + 0.10 * F.least(F.col(score), one))
    signal = 0.75 * signal + 0.25 * optional(df, "overall_eligibility_softness")
    return F.when(signal >= CONFIDENT, "high").when(signal >= FAIRLY_CONFIDENT, "medium").otherwise("exploratory")


def program_match_percentage(df: DataFrame) -> DataFrame:
    """``match_percentage`` from the reranked scores under the list's ceilings."""
    out = confidence_minmax(df, ["mentee_id"], "rerank_score", "_share")
    out = with_list_stats(out, ["mentee_id"], _n=F.count("*"))
    weak = optional(df, "requirement_coverage_score") < WEAK_COVERAGE
    pct = F.bround(clip(100.0 * F.col("_share"), 0.0, 100.0), 1)
    pct = F.when(weak, F.least(pct, F.lit(70.0))).otherwise(pct)
    pct = clip(F.bround(F.least(pct, F.col("confidence_ceiling")), 1), 0.0, 100.0)
    sparse = F.col("_n") <= compat.SPARSE_CANDIDATES
    pct = F.when(sparse, F.least(pct, F.lit(compat.SPARSE_CEILING))).otherwise(pct)
    return out.withColumn("match_percentage", pct).drop("_share", "_n")


def rerank_programs(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best programs per mentee with rerank score, match percentage, confidence, explanation."""
    from matchspark.functions.explain import program_metadata
    out = confidence_minmax(scored, ["mentee_id"], "pred_score", "pred_norm")
    score = F.coalesce("pred_norm", F.lit(0.0)) * requirement_constraint(scored)
    if "overall_eligibility_softness" in scored.columns:
        score = score * softness_multiplier(F.col("overall_eligibility_softness"))
    if "candidate_pre_score" in scored.columns:
        score = score * (1.0 + 0.008 * clip(F.col("candidate_pre_score"), 0.0, 1.0))
    out = out.withColumn("rerank_score", clip(score * weak_program_penalty(scored), 0.0, 2.0))
    out = confidence_ceiling(repeat_penalty(out))
    out = program_match_percentage(out)
    exact = [F.col("minimum_requirement_exact_match").desc()] if "minimum_requirement_exact_match" in scored.columns else []
    best = grouped_topk(out, ["mentee_id"], [*exact, F.col("rerank_score").desc(), F.col("post_id")], k, rank="rank")
    best = best.withColumn("recommendation_confidence", program_confidence(best))
    return best.withColumn("explanation_metadata", program_metadata(best)).withColumn("pred_score", F.col("rerank_score"))


def overexposed(recs: DataFrame, share: float = EXPOSURE_SHARE, min_total: int = 0) -> DataFrame:
    """Programs that take more than their share of all recommendations, if those are over ``min_total``."""
    total = recs.agg(F.count("*")).scalar()
    counts = recs.groupBy("post_id").agg(F.count("*").alias("recommended")).select("*", total.alias("total"))
    limit = F.greatest(F.lit(2), F.floor(F.col("total") * share))
    return counts.withColumn("max_allowed", limit).where(
        (F.col("total") > min_total) & (F.col("recommended") > F.col("max_allowed")))


def within_level(df: DataFrame, max_gap: int = 1, level: str = "experience_level_num",
                 target: str = "target_level_num") -> DataFrame:
    """Programs at most ``max_gap`` levels above the mentee; frames without levels pass whole."""
    if level not in df.columns or target not in df.columns:
        return df
    return df.where(F.coalesce(F.col(target), F.lit(1)) <= F.coalesce(F.col(level), F.lit(1)) + max_gap)


def serving_penalties(df: DataFrame) -> Column:
    """Factor for weak level, weak education, nearly full, closing soon and weak coverage."""
    level = F.when(optional(df, "target_level_pass", 1.0) > 0, 1.0).otherwise(0.85)
    education = F.when(optional(df, "education_level_pass", 1.0) > 0, 1.0).otherwise(0.88)
    capacity = optional(df, "capacity", 10.0)
    taken = (capacity - optional(df, "spots_left")) / F.greatest(capacity, F.lit(1.0))
    crowded = 1.0 - 0.20 * clip(taken, 0.0, 1.0) if "spots_left" in df.columns else F.lit(1.0)
    days = optional(df, "days_until_deadline", 30.0)
    closing = F.when(days <= 2, 0.80).when(days <= 7, 0.90).otherwise(1.0)
    coverage = (1.0 - 0.15 * (1.0 - optional(df, "requirement_coverage_score"))
                if "requirement_coverage_score" in df.columns else F.lit(1.0))
    return level * education * crowded * closing * coverage


def apply_serving_penalties(df: DataFrame) -> DataFrame:
    factor = serving_penalties(df)
    changes = {c: F.col(c) * factor for c in ("score", "pred_score") if c in df.columns}
    return df.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ mentor lists as served


def match_percentages(ranked: DataFrame, score: str = "score") -> DataFrame:
    """55..98 from relative score, skill coverage and subdomain similarity within the list."""
    out = with_group_stats(ranked, ["mentee_id"], _low=F.min(score), _high=F.max(score))
    spread = F.col("_high") - F.col("_low")
    relative = F.when(spread == 0, 0.5).otherwise((F.col(score) - F.col("_low")) / F.when(spread != 0, spread))
    coverage = clip(optional(ranked, "skill_coverage_score", 0.5), 0.0, 1.0)
    subdomain = clip(optional(ranked, "subdomain_similarity"), 0.0, 1.0)
    mix = relative * 0.35 + coverage * 0.40 + subdomain * 0.25
    pct = F.least(F.greatest(F.bround(55 + mix * 43).cast("int"), F.lit(0)), F.lit(100))
    return out.withColumn("match_percentage", pct).drop("_low", "_high")


def signal_match_percentage(df: DataFrame) -> Column:
    """The same scale from compatibility signals alone."""
    mix = (0.40 * optional(df, "skill_coverage_score") + 0.35 * optional(df, "skill_overlap_score")
           + 0.25 * optional(df, "subdomain_similarity"))
    return F.bround(55 + mix * 43).cast("int")


def best_coverage_in_top3(ranked: DataFrame, score: str = "rerank_score") -> DataFrame:
    """Rank per mentee, with the best-covering mentor moved up to place three if it was lower."""
    place = Window.partitionBy("mentee_id").orderBy(F.col(score).desc(), F.col("mentor_id"))
    placed = ranked.withColumn("_place", F.row_number().over(place))
    best = placed.groupBy("mentee_id").agg(
        F.min_by("_place", F.struct(-safe_double(F.col("skill_coverage_score")), F.col("_place"))).alias("_best"))
    joined = placed.join(best, "mentee_id")
    p, b = F.col("_place"), F.col("_best")
    moved = F.when(b <= 3, p).when(p == b, 3).when((p >= 3) & (p < b), p + 1).otherwise(p)
    return joined.withColumn("rank", moved).drop("_place", "_best")


def domain_diversity(ranked: DataFrame, head: int = 15, per_domain: int = 3, factor: float = 0.97) -> DataFrame:
    """Rank per mentee after damping the fourth and later mentor of a domain in the first places."""
    order = [F.col("score").desc(), F.col("total_reviews").desc(), F.col("mentor_id")]
    placed = ranked.withColumn("_place", F.row_number().over(Window.partitionBy("mentee_id").orderBy(*order)))
    in_head = F.col("_place") <= head
    nth = F.row_number().over(Window.partitionBy("mentee_id", "domain").orderBy("_place"))
    damped = placed.withColumn("_nth", nth).withColumn(
        "score", F.when(in_head & (F.col("_nth") > per_domain), F.col("score") * factor).otherwise(F.col("score")))
    again = Window.partitionBy("mentee_id").orderBy(F.col("score").desc(), F.col("total_reviews").desc(), "_place")
    return damped.withColumn("rank", F.row_number().over(again)).drop("_place", "_nth")


def diverse_selection(ranked: DataFrame, k: int = 10, per_mentor: int = 3, per_subdomain: int = 4,
                      score: str = "score") -> DataFrame:
    """Greedy pick down each list: few per mentor and subdomain, then refill to ``k``.

    The choice depends on the choices before it, so it runs as a fold over the mentee's whole
    list, which the candidate caps bound.
    """
    order = [F.col(score).desc(), F.col("post_id")]
    head = ranked.select("mentee_id", "post_id", "mentor_id", "subdomain_id", score).withColumn(
        "place", F.row_number().over(Window.partitionBy("mentee_id").orderBy(*order)))
    item = F.struct("place", "post_id", "mentor_id", "subdomain_id", F.col(score).alias("score"))
    lists = head.groupBy("mentee_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def pick(chosen: Column, x: Column) -> Column:
        same_mentor = F.size(F.filter(chosen, lambda c: c["mentor_id"] == x["mentor_id"]))
        same_field = F.size(F.filter(chosen, lambda c: c["subdomain_id"] == x["subdomain_id"]))
        fits = (F.size(chosen) < k) & (same_mentor < per_mentor) & (same_field < per_subdomain)
        return F.when(fits, F.concat(chosen, F.array(x))).otherwise(chosen)

    empty = F.slice("items", 1, 0)
    chosen = F.aggregate("items", empty, pick)
    with_choice = lists.select("mentee_id", "items", chosen.alias("chosen"))
    rest = F.filter("items", lambda x: ~F.exists("chosen", lambda c: c["place"] == x["place"]))
    final = F.when(F.size("items") <= k, F.col("items")).otherwise(F.slice(F.concat(F.col("chosen"), rest), 1, k))
    return with_choice.select("mentee_id", F.posexplode(final).alias("rank", "x")).select(
        "mentee_id", (F.col("rank") + 1).alias("rank"), "x.post_id", "x.mentor_id", "x.subdomain_id", "x.score")


def prefilter_score(df: DataFrame) -> Column:
    """Rough usefulness of a program; needs ``_max_spots``, the list's largest number of spots."""
    spots = optional(df, "spots_left", 1.0)
    days = optional(df, "days_until_deadline", 14.0)
    share = F.when(F.col("_max_spots") != 0, spots / F.when(F.col("_max_spots") != 0, F.col("_max_spots"))).otherwise(0.0)
    return 1.0 + 0.3 * share + 0.2 * optional(df, "requirement_coverage_score") + 0.2 * F.least(days / 30.0, F.lit(1.0))


def prefilter_lists(df: DataFrame, target: int | None = None) -> DataFrame:
    """The ``target`` best of every list by the rough score; whole lists without a target."""
    if target is None:
        return df
    sized = with_group_stats(df, ["mentee_id"], _max_spots=F.max(optional(df, "spots_left", 1.0)))
    ranked = grouped_topk(sized.withColumn("_rough", F.round(prefilter_score(df), 9)), ["mentee_id"],
                          [F.col("_rough").desc(), F.col("post_id")], target)
    return ranked.drop("_max_spots", "_rough")


def rough_user_prefilter(pairs: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` candidates per mentee with the strongest interaction (else popularity)."""
    column = "interaction_score_log" if "interaction_score_log" in pairs.columns else "popularity_log"
    return grouped_topk(pairs, ["mentee_id"], [F.col(column).desc(), F.col("mentor_id")], k)
