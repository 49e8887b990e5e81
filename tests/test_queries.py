"""Registered queries against their oracle SQL on the smallest data.

All of them run with MATCHSPARK_ALL=1; by default one or more from every area.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from matchspark.checks.registry import COVERS, QUERIES

SF = "/root/testdata/sf0.001"
SOME = [
    "top_mentors_by_skill", "mentee_features", "mentor_quality", "candidate_pool", "pair_features", "schema_mapped_read",
    "clean_table", "time_split_boundaries", "feedback_business_rules", "dense_user_numbers", "assigned_labels",
    "contamination_removed", "negative_tiers", "percent_rank_with_ties", "soft_boosts", "program_rerank", "ranking_metrics",
    "program_features", "mentee_program_candidates", "soft_compatibility", "heuristic_scores", "cold_start_content",
    "mentor_domain_fallback", "analytics_overview", "user_mentorships", "mentee_intents", "cleaned_feedback", "faq_matches",
    "faq_matches_joined", "integrity_rules", "drift_report", "minmax_scaled", "training_pairs", "cf_cells"]
CHOSEN = sorted(entry.oracle_sql()) if os.environ.get("MATCHSPARK_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    problem = difference(got, duck.execute(entry.oracle_sql()[name]).df())
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(COVERS[name] for name in QUERIES)
