"""Mentor matching from raw tables to ranked lists and metrics, and the search over its settings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from matchspark.operators import factors, labels, listwise, metrics, ranker, sampling, scaling
from matchspark.operators.cleaning import safe_accounts, without_alerted
from matchspark.operators.quality import feature_manifest, reject_leakage
from matchspark.plans import candidates, pairs, people, rerank, serving, splits
from matchspark.session import materialize

VERSION = "1"
#: Tables that several later plans read: written once, so that no plan repeats how they are made.
RAW_READ_AGAIN = ("mentorship_posts", "mentorships", "follows")
READ_AGAIN = ("mentor_profile", "mentor_subdomains", "mentor_expertise", "mentee_interests", "mentee_subdomains",
              "mentors_feedback", "mentorship_cancellation", "mentorships", "follows", "subdomains", "technologies")
K, MIN_CANDIDATES = 10, 5
CONFIGS = [
    {"high_cap": 30, "low_cap": 10, "neg_per_pos": 4},
    {"high_cap": 40, "low_cap": 15, "neg_per_pos": 4},
    {"high_cap": 40, "low_cap": 15, "neg_per_pos": 6},
    {"high_cap": 50, "low_cap": 15, "neg_per_pos": 6},
    {"high_cap": 50, "low_cap": 20, "neg_per_pos": 8},
    {"high_cap": 70, "low_cap": 20, "neg_per_pos": 6},
]


class Prepared(NamedTuple):
    """Everything that does not depend on candidate or sampling settings."""

    config: splits.SplitConfig
    tables: dict[str, DataFrame]
    raw: dict[str, DataFrame]
    mentees: DataFrame
    mentors: DataFrame
    engagement: DataFrame | None
    factors: tuple[DataFrame, DataFrame] | None
    communities: DataFrame | None
    positives: DataFrame
    event_times: DataFrame
    subdomains: DataFrame | None


class Result(NamedTuple):
    dataset: DataFrame
    weights: dict[str, float]
    scaler: list
    manifest: dict
    recommendations: DataFrame
    metrics: DataFrame
    coverage: DataFrame
    impact: DataFrame | None = None
    lists: DataFrame | None = None


def written(tables: dict[str, DataFrame], names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables, those of ``names`` written once. The driver holds each plan in several forms, so plans must stay small."""
    return {name: materialize(df, name) if name in names else df for name, df in tables.items()}


def prepare(raw: dict[str, DataFrame], use_factors: bool = True) -> Prepared:
    """Split, clean, build both feature tables, factors, positives and event times."""
    raw = written(raw, RAW_READ_AGAIN)
    config = splits.build_split_config(raw["mentorships"], raw["mentorship_applications"])
    done = written(splits.prepare_tables(raw, config), READ_AGAIN)
    posts = materialize(done["mentorship_posts"], "posts")
    apps = materialize(without_alerted(done["mentorship_applications"]), "applications")
    enrolled = splits.train_part(done["mentorships"])
    engagement = people.engagement_from_tables(done)
    if engagement is not None:
        engagement = materialize(engagement, "engagement")
    mentees = materialize(people.mentee_features(
        done["mentee_profile"], done["mentee_subdomains"], done["mentee_interests"]), "mentees")
    mentors = materialize(people.mentor_features(
        done["mentor_profile"], done["mentor_subdomains"], done["mentor_expertise"], done["mentors_feedback"],
        splits.train_part(apps), posts, done["mentorship_cancellation"], enrolled, done["follows"], engagement), "mentors")
    latent = None
    if use_factors and engagement is not None:
        latent = factors.latent_factors(factors.mentor_cells(people.interaction_features(engagement, posts), enrolled))
    communities = people.community_sets(done["community_members"]) if "community_members" in done else None
    positives = materialize(candidates.positive_pairs(apps, raw["mentorship_posts"]), "positives")
    seen = people.engagement_from_tables(raw)
    if seen is not None:
        seen = materialize(seen, "engagement-raw")
    return Prepared(config, done, raw, mentees, mentors, seen, latent, communities,
                    positives, candidates.first_event_times(apps), done.get("subdomains"))


def features_of(p: Prepared, pool: DataFrame) -> DataFrame:
    """Pair features of a pool, as of each mentee's first application, from the raw event tables."""
    user_factors, item_factors = p.factors or (None, None)
    return materialize(reject_leakage(pairs.pair_features(
        pool, p.mentees, p.mentors, p.tables["follows"], event_times=p.event_times, engagement=p.engagement,
        posts=p.raw["mentorship_posts"], mentorships=p.raw["mentorships"], follows_raw=p.raw["follows"],
        user_factors=user_factors, item_factors=item_factors, communities=p.communities)), "pairs")


def by_rerank(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_score", F.col("rerank_score"))


def lists_for_all(p: Prepared, result: Result) -> DataFrame:
    """(mentee_id, mentor_id, rank, pred_score, source): the model's list of every mentee, else by content, else popular."""
    model = materialize(by_rerank(result.recommendations).select(*candidates.PAIR, "rank", "pred_score"), "model-lists")
    technologies = p.tables.get("technologies")
    if technologies is None:
        technologies = p.mentees.sparkSession.createDataFrame([], "technology_id long, subdomain_id long")
    safe = safe_accounts(p.mentors, p.tables["mentor_profile"])
    return serving.recommend_all(
        p.mentees.select("mentee_id"), model, p.mentees, safe, p.tables["mentee_interests"], p.tables["mentee_subdomains"],
        p.tables["mentor_expertise"], p.tables["mentor_subdomains"], technologies, K)


def fit_and_rank(p: Prepared, features: DataFrame, neg_per_pos: int = sampling.TRAIN_NEG_PER_POS,
                 seed: int = 42, pool: DataFrame | None = None) -> Result:
    """Label, sample, scale, train, rerank and evaluate the pair features of one pool.

    ``recommendations`` come from all pairs of every mentee, or from those in ``pool``.
    """
    usable = candidates.drop_zero_coverage(p.positives, features)
    labelled = labels.assign_clean_labels(features, materialize(usable, "usable"))
    dataset = materialize(sampling.training_dataset(labelled, seed, neg_per_pos), "dataset")
    names = [c for c in pairs.MODEL_FEATURES if c in dataset.columns]
    parts = splits.split_frames(ranker.ranking_frame(dataset, names))
    scaled = [c for c in names if c not in pairs.BINARY_FEATURES]
    offered = features if pool is None else features.join(pool.select(*candidates.PAIR), candidates.PAIR, "left_semi")
    everyone = ranker.ranking_frame(offered.withColumn("label", F.lit(0)), names)
    train, rest, scaler = scaling.fit_and_apply(
        parts["train"], {"valid": parts["valid"], "test": parts["test"], "all": everyone}, scaled)
    train = materialize(train, "train")
    valid, test = materialize(rest["valid"], "valid"), materialize(rest["test"], "test")
    _, start = ranker.train(train, valid, names, k=K, seed=seed)
    weights = listwise.train(train, valid, names, k=K, start=start).weights
    scored, checked = ranker.score(test, weights), ranker.score(valid, weights)
    reranked = materialize(rerank.multi_signal_rerank(scored), "test-reranked")
    boosted = rerank.soft_boosts(reranked)
    served = safe_accounts(boosted, p.tables["mentor_profile"])
    stages = {
        "train": ranker.score(train, weights), "valid": checked,
        "valid reranked": by_rerank(materialize(rerank.multi_signal_rerank(checked), "valid-reranked")), "test": scored,
        "test reranked": by_rerank(reranked),
        "test boosted": by_rerank(boosted),
        "test served": by_rerank(served)}
    report = None
    for name, df in stages.items():
        one = metrics.evaluate_ranking(df, K, MIN_CANDIDATES).withColumn("stage", F.lit(name))
        report = one if report is None else report.unionByName(one)
    best = rerank.top_recommendations(safe_accounts(ranker.score(rest["all"], weights), p.tables["mentor_profile"]), K)
    return Result(dataset, weights, scaler, feature_manifest(names, scaled, VERSION), best, report,
                  candidates.coverage_by_split(p.positives, features), metrics.rerank_impact(scored, by_rerank(reranked), K))


def run(raw: dict[str, DataFrame], top_k: int = 50, high_cap: int = 80, low_cap: int = 40,
        exploration_pct: float = 0.15, seed: int = 42, use_factors: bool = True) -> Result:
    """The whole mentor side: raw tables in, ranked lists and metrics out."""
    p = prepare(raw, use_factors)
    pool = materialize(candidates.candidate_pool(
        p.mentees, p.mentors, p.subdomains, top_k, high_cap, low_cap, exploration_pct, seed=seed), "pool")
    result = fit_and_rank(p, features_of(p, candidates.inject_positives(pool, p.positives)), seed=seed, pool=pool)
    return result._replace(lists=lists_for_all(p, result))


def tune(raw: dict[str, DataFrame], configs: list[dict] | None = None, top_k: int = 30, min_coverage: float = 60.0,
         min_gain: float = 0.01, max_gap: float = 0.03, use_factors: bool = True) -> DataFrame:
    """Try every setting; one row each with validation and test NDCG and hit rate, best first.

    Pair features are computed once for the largest caps; every setting cuts its pool out of them by
    rank. Stops early when coverage is high and NDCG no longer improves.
    """
    configs = configs or CONFIGS
    p = prepare(raw, use_factors)
    widest = max(c["high_cap"] + c["low_cap"] for c in configs)
    ranked = materialize(candidates.ranked_candidates(p.mentees, p.mentors, p.subdomains, top_k, widest), "ranked")
    everything = features_of(p, candidates.inject_positives(ranked, p.positives))
    ranks = ranked.select(*candidates.PAIR, "rank")
    known = p.positives.select(*candidates.PAIR).distinct().withColumn("_pos", F.lit(True))
    rows, best = [], 0.0
    for i, c in enumerate(configs):
        cut = everything.join(ranks, candidates.PAIR, "left").join(known, candidates.PAIR, "left").where(
            (F.col("rank") <= c["high_cap"] + c["low_cap"]) | F.col("_pos")).drop("rank", "_pos")
        result = fit_and_rank(p, cut, c["neg_per_pos"])
        found = {r["stage"]: r for r in result.metrics.where("stage IN ('valid', 'test')").collect()}
        covered = [r["coverage"] for r in result.coverage.collect()]
        ndcg, hit = f"filtered_ndcg_at_{K}", f"filtered_hitrate_at_{K}"
        valid, test = found["valid"], found["test"]
        gap = (valid[hit] or 0.0) - (test[hit] or 0.0)
        coverage = min(covered) if covered else 0.0
        rows.append((i, c["high_cap"], c["low_cap"], c["neg_per_pos"], float(valid[ndcg] or 0.0), float(test[ndcg] or 0.0),
                     float(valid[hit] or 0.0), float(test[hit] or 0.0), float(gap), float(coverage), bool(gap <= max_gap)))
        gain = (valid[ndcg] or 0.0) - best
        best = max(best, valid[ndcg] or 0.0)
        if i and coverage >= min_coverage and gain < min_gain:
            break
    frame = p.mentees.sparkSession.createDataFrame(
        rows, "config int, high_cap int, low_cap int, neg_per_pos int, valid_ndcg double, test_ndcg double, "
              "valid_hitrate double, test_hitrate double, hitrate_gap double, coverage double, within_gap boolean")
    return frame.orderBy(F.col("within_gap").desc(), F.col("valid_ndcg").desc(), "config")
