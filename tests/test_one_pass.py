"""Sampling, list statistics and candidate lists read their rows once and move them by mentee."""

from pyspark.sql import functions as F

from matchspark.operators import labels, sampling
from matchspark.plans import candidates, rerank


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def mentor_rows(spark, path):
    n = F.col("id")
    return stored(spark.range(3000).select(
        F.when(n % 101 > 0, n % 60).alias("mentee_id"), n.alias("mentor_id"), (n % 13 == 0).cast("int").alias("label"),
        F.when(n % 97 > 0, F.element_at(F.array(*[F.lit(x) for x in ("train", "valid", "test")]), (n % 3 + 1).cast("int"))).alias("time_split"),
        *[((n * k) % 7 / 7.0).alias(c) for k, c in ((3, "skill_overlap_score"), (5, "skill_coverage_score"))],
        F.when(n % 4 > 1, 0.0).otherwise(0.3).alias("subdomain_similarity"), ((n * 11) % 5).alias("interaction_score_log"),
        (n % 2).alias("mentor_domain_match")), path)


def picked(rows, ratio, least, seed):
    """The tiered sample worked out group by group."""
    groups, out = {}, set()
    for r in rows:
        if r["mentee_id"] is not None and r["time_split"] is not None:
            groups.setdefault((r["time_split"], r["mentee_id"]), []).append(r)
    for rows in groups.values():
        pos = sum(r["label"] for r in rows)
        tiers = {"hard": [], "medium": [], "easy": []}
        for r in rows:
            if r["label"] == 0:
                near = r["skill_overlap_score"] > 0 or r["subdomain_similarity"] > 0
                tiers["hard" if near else "medium" if r["mentor_domain_match"] > 0 else "easy"].append(r)
        if pos and any(tiers.values()):
            target = max(pos * ratio, least - pos)
            out.add((rows[0]["time_split"], rows[0]["mentee_id"], pos, min(target, sum(map(len, tiers.values())))))
    return out


def test_training_dataset_reads_its_rows_once(spark, tmp_path):
    rows = mentor_rows(spark, tmp_path / "rows")
    out = sampling.training_dataset(rows, 42, 3, 5, 4)
    assert scans(out) == 1
    got = {(r["time_split"], r["mentee_id"], r["pos"], r["neg"]) for r in out.groupBy("time_split", "mentee_id").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).collect()}
    every = rows.collect()
    train = [r for r in every if r["time_split"] == "train"]
    rest = [r for r in every if r["time_split"] not in (None, "train")]
    assert got == picked(train, 3, 4, 42) | picked(rest, 5, 4, 49) and len(got) > 50


def test_program_dataset_reads_its_rows_once_and_keeps_the_rest_whole(spark, tmp_path):
    rows = mentor_rows(spark, tmp_path / "rows").select(
        "mentee_id", F.col("mentor_id").alias("post_id"), "label", "time_split", F.col("skill_overlap_score").alias("requirement_coverage_score"),
        F.col("skill_coverage_score").alias("required_skill_level_match_score"), F.lit(0.5).alias("requirement_overlap_score"),
        F.lit(0.1).alias("candidate_pre_score"))
    out = sampling.program_dataset(rows, 2, 3)
    assert scans(out) == 1
    rest = rows.where("time_split <> 'train'")
    kept = out.where("time_split <> 'train'")
    assert kept.count() == rest.count() and kept.where("hardness_score <> 0").count() == 0
    train = out.where("time_split = 'train'").groupBy("mentee_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    assert train and all(0 < r["n"] - r["p"] <= max(2 * r["p"], 3 - r["p"]) for r in train)


def test_clean_labels_equal_labels_without_contamination(spark):
    pairs = spark.createDataFrame([(m, t, 0.5) for m in (1, 2, 3, None) for t in (10, 11, None)], "mentee_id long, mentor_id long, x double")
    positives = spark.createDataFrame(
        [("train", 1, 10), ("test", 1, 10), ("valid", 1, 11), ("train", 2, 11), (None, 2, 10), ("test", 3, None), ("test", None, 10)],
        "time_split string, mentee_id long, mentor_id long")
    want = labels.remove_contamination(labels.assign_labels(pairs, positives), positives)
    got = labels.assign_clean_labels(pairs, positives)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.where("label = 1").select("mentee_id", "mentor_id", "time_split").distinct().count() == 2


def test_program_rerank_reads_its_rows_once(spark, tmp_path):
    n = F.col("id")
    rows = stored(spark.range(400).select(
        (n % 20).alias("mentee_id"), n.alias("post_id"), ((n * 7) % 11 / 11.0).alias("pred_score"),
        (n % 2).alias("minimum_requirement_exact_match"), ((n * 3) % 5 / 5.0).alias("requirement_coverage_score")), tmp_path / "rows")
    out = rerank.rerank_programs(rows)
    assert scans(out) == 1 and out.count() == 200


def test_candidates_of_a_mentee_move_once(spark):
    people = spark.createDataFrame([(i, [i % 3, 7], [i % 2], 1 + i % 3) for i in range(40)],
                                   "id long, skills array<long>, subdomains_set array<long>, experience_level_num int")
    mentees = people.select(F.col("id").alias("mentee_id"), F.col("skills").alias("interests_set"), "subdomains_set", "experience_level_num")
    mentors = people.select(F.col("id").alias("mentor_id"), F.col("skills").alias("expertise_set"), "subdomains_set", "experience_level_num",
                            (F.col("id") % 5 / 5.0).alias("mentor_program_popularity"))
    out = candidates.ranked_candidates(mentees, mentors, None, 5, 8)
    assert "hashpartitioning(mentee_id" in (plan := out._jdf.queryExecution().executedPlan().toString())
    assert not any("mentor_id" in line for line in plan.split("\n") if "Exchange hashpartitioning(mentee_id" in line)
    rows = [r.asDict() for r in people.collect()]
    popular = {r["id"] for r in sorted(rows, key=lambda r: (-(r["id"] % 5), r["id"]))[:5]}
    for mentee in (0, 7, 25):
        me, score = rows[mentee], {}
        for r in rows:
            bonus = 2 if r["experience_level_num"] >= me["experience_level_num"] else 0
            tier = 5 if set(r["skills"]) & set(me["skills"]) else 4 if set(r["subdomains_set"]) & set(me["subdomains_set"]) else 1 if r["id"] in popular else 0
            if tier:
                score[r["id"]] = tier + bonus
        want = sorted(score, key=lambda i: (-score[i], i))[:8]
        assert [r["mentor_id"] for r in out.where(F.col("mentee_id") == mentee).orderBy("rank").collect()] == want
