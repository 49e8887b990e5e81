"""Scoring candidate features with a saved mentor model, for all users at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from matchspark.operators import ranker, scaling
from matchspark.operators.normalize import sigmoid_confidence
from matchspark.operators.quality import require_compatible
from matchspark.operators.topk import grouped_topk
from matchspark.plans import mentor_flow, rerank
from matchspark.plans.pairs import FEATURE_DEFAULTS
from matchspark.sources import artifacts

SIGNALS = ["skill_overlap_score", "skill_coverage_score", "subdomain_similarity", "mentor_domain_match",
           "mentor_quality_score", "mentor_weighted_rating", "mentor_more_experienced", "same_country",
           "mentor_covers_all_skills"]


class Bundle(NamedTuple):
    weights: dict[str, float]
    scaler: list
    manifest: dict


def save(result: mentor_flow.Result, spark: SparkSession, path: str) -> str:
    """The dataset, the recommendations and everything needed to score again."""
    artifacts.save_table(result.dataset, f"{path}/dataset")
    artifacts.save_table(result.recommendations, f"{path}/recommendations")
    scaler = [[r["column"], r["centre"], r["scale"]] for r in result.scaler]
    artifacts.save_manifest(spark, result.manifest | {"weights": result.weights, "scaler": scaler}, f"{path}/manifest")
    return path


def load(spark: SparkSession, path: str) -> Bundle:
    """Read a saved model; artifacts of another version or column order are refused."""
    manifest = artifacts.load_manifest(spark, f"{path}/manifest")
    scaler = [Row(column=c, centre=m, scale=s) for c, m, s in manifest["scaler"]]
    weights = {c: manifest["weights"][c] for c in manifest["feature_cols"]}
    require_compatible(manifest, mentor_flow.VERSION, sorted_like(manifest["scale_cols"], [r["column"] for r in scaler]))
    return Bundle(weights, scaler, manifest)


def sorted_like(order: list[str], found: list[str]) -> list[str]:
    """``found`` in the order of ``order``; a column missing on either side shows up as a difference."""
    return [c for c in order if c in found] + [c for c in found if c not in order]


def with_defaults(features: DataFrame) -> DataFrame:
    """Optional features that are missing, as column or as value, get neutral values."""
    out = features.fillna({c: v for c, v in FEATURE_DEFAULTS.items() if c in features.columns})
    absent = [F.lit(v).alias(c) for c, v in FEATURE_DEFAULTS.items() if c not in features.columns]
    return out.select("*", *absent)


def predict(bundle: Bundle, features: DataFrame, shown: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The ``k`` best mentors per mentee: scaled, scored, reranked, repeated mentors damped.

    ``confidence_score`` is relative to the mentee's whole list; ``shown`` is (mentee_id, session, mentor_id).
    """
    scored = ranker.score(scaling.apply_scaler(with_defaults(features), bundle.scaler), bundle.weights)
    ranked = rerank.multi_signal_rerank(scored)
    if shown is not None:
        ranked = rerank.recent_decay(ranked, shown)
    ranked = sigmoid_confidence(ranked, ["mentee_id"], "rerank_score")
    best = grouped_topk(ranked, ["mentee_id"], [F.col("rerank_score").desc(), F.col("mentor_id")], k, rank="rank")
    kept = [c for c in SIGNALS if c in best.columns]
    return best.select("mentee_id", "mentor_id", "rank", F.col("rerank_score").alias("pred_score"), "confidence_score", *kept)
