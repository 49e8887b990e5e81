"""Saving a model and scoring with it."""

import pytest
from pyspark.sql import Row, functions as F

from matchspark.operators.quality import feature_manifest
from matchspark.plans import inference, mentor_flow

FEATURES = ["skill_coverage_score", "subdomain_similarity"]


def result(spark):
    dataset = spark.createDataFrame([(1, 1, "train", 1), (1, 2, "test", 0)], "mentee_id long, mentor_id long, time_split string, label int")
    scaler = [Row(column=c, centre=0.0, scale=0.5) for c in FEATURES]
    return mentor_flow.Result(dataset, {"skill_coverage_score": 2.0, "subdomain_similarity": 1.0}, scaler,
                              feature_manifest(FEATURES, FEATURES, mentor_flow.VERSION), dataset, dataset, dataset)


def test_saved_model_scores_all_users(spark, tmp_path):
    path = inference.save(result(spark), spark, str(tmp_path / "model"))
    bundle = inference.load(spark, path)
    data = [(m, i, i / 10.0 if i != 5 else None) for m in (1, 2) for i in range(10)]
    features = spark.createDataFrame(data, "mentee_id long, mentor_id long, skill_coverage_score double")
    out = inference.predict(bundle, features, k=3)
    assert [(r.mentee_id, r["rank"], r.mentor_id) for r in out.orderBy("mentee_id", "rank").collect()] == [
        (m, p + 1, 9 - p) for m in (1, 2) for p in range(3)]
    assert all(0.5 < r.confidence_score < 1 for r in out.collect())
    shown = spark.createDataFrame([(1, 7, 9)], "mentee_id long, session long, mentor_id long")
    top = inference.predict(bundle, features, shown, k=1).where(F.col("mentee_id") == 1).first()
    assert top.mentor_id == 8 or top.pred_score < out.where("mentee_id = 1 AND rank = 1").first().pred_score


def test_other_version_is_refused(spark, tmp_path):
    made = result(spark)
    made = made._replace(manifest=made.manifest | {"preprocessing_version": "0"})
    path = inference.save(made, spark, str(tmp_path / "old"))
    with pytest.raises(ValueError):
        inference.load(spark, path)
