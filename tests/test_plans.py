"""Physical plans keep the promises made for scale."""

import __spark_entry__  # noqa: F401  (registers the queries)
from matchspark.checks.registry import QUERIES
from matchspark.fixtures import Tables
from matchspark.operators.topk import grouped_topk
from matchspark.plans import rerank

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_grouped_topk_prunes_before_the_shuffle(spark):
    from pyspark.sql import functions as F
    df = grouped_topk(Tables(spark, SF).f_scored, ["mentee_id"], [F.col("pred_score").desc()], 5)
    assert "WindowGroupLimit" in plan(df)


def test_no_python_in_the_hot_path(spark):
    for name in ("top_mentors_by_skill", "multi_signal_rerank", "mentee_intents", "percent_rank_with_ties"):
        text = plan(QUERIES[name](spark, SF))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "MapInPandas" not in text


def test_matching_has_no_cross_product(spark):
    for name in ("top_mentors_by_skill", "candidate_pool", "mentee_program_candidates", "cold_start_content"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_by_time"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text
    assert "o_totalprice" not in text.split("ReadSchema")[1].split("\n")[0]


def test_rerank_needs_no_window(spark):
    assert "Window" not in plan(rerank.multi_signal_rerank(Tables(spark, SF).f_scored))
