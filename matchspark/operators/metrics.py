"""Ranking quality and list diagnostics. Ties in the score go to the lower id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchspark.functions.numbers import flag
from matchspark.operators.topk import grouped_topk


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def _ideal(positives: Column, k: int) -> Column:
    """DCG of a perfect list with that many positives."""
    steps, total = [], 0.0
    for i in range(1, k + 1):
        total += 1.0 / math.log2(i + 1)
        steps.append(F.lit(total))
    return F.when(positives > 0, F.element_at(F.array(*steps), F.least(positives, F.lit(k)).cast("int")))


def group_ranking(scored: DataFrame, k: int, group: str = "mentee_id", item: str = "mentor_id",
                  score: str = "pred_score") -> DataFrame:
    """Per group: size, positives and the sums every metric needs over the first ``k`` rows."""
    positive = flag(F.col("label") > 0)
    sizes = scored.groupBy(group).agg(F.count("*").alias("n"), F.sum(positive).alias("positives"))
    order = [F.coalesce(F.col(score).try_cast("double"), F.lit(0.0)).desc(), F.col(item)]
    top = grouped_topk(scored.select(group, item, score, positive.alias("hit")), [group], order, k, rank="r")
    so_far = F.sum("hit").over(Window.partitionBy(group).orderBy("r"))
    seen = top.withColumn("so_far", so_far)
    hit = F.col("hit") == 1
    sums = seen.groupBy(group).agg(
        F.sum("hit").alias("hits"), F.sum(F.when(hit, _gain(F.col("r"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(hit, F.col("so_far") / F.col("r")).otherwise(0.0)).alias("precision_sum"),
        F.min(F.when(hit, F.col("r"))).alias("first_hit"))
    return sizes.join(sums, group)


def group_metrics(scored: DataFrame, k: int = 10, group: str = "mentee_id", item: str = "mentor_id",
                  score: str = "pred_score") -> DataFrame:
    """NDCG, hit, precision, recall, average precision and reciprocal rank of every group."""
    g = group_ranking(scored, k, group, item, score)
    depth = F.least(F.col("n"), F.lit(k))
    some = F.col("positives") > 0
    zero = F.lit(0.0)
    return g.select(
        group, "n", "positives",
        F.when(some, F.col("dcg") / _ideal(F.col("positives"), k)).otherwise(zero).alias("ndcg"),
        flag(F.col("hits") > 0).alias("hit"),
        (F.col("hits") / depth).alias("precision"),
        F.when(some, F.col("hits") / F.when(some, F.col("positives"))).otherwise(zero).alias("recall"),
        F.when(some, F.col("precision_sum") / F.least(depth, F.when(some, F.col("positives")))).otherwise(zero).alias("ap"),
        F.coalesce(1.0 / F.col("first_hit"), zero).alias("rr"))


def evaluate_ranking(scored: DataFrame, k: int = 10, min_candidates: int = 2, group: str = "mentee_id",
                     item: str = "mentor_id", score: str = "pred_score") -> DataFrame:
    """One row. ``filtered_*`` averages usable groups, ``global_*`` counts the others as zero."""
    g = group_metrics(scored, k, group, item, score)
    usable = (F.col("positives") > 0) & (F.col("n") >= min_candidates)
    names = {"ndcg": "ndcg", "hitrate": "hit", "precision": "precision", "map": "ap", "recall": "recall"}
    return g.agg(
        *[F.avg(F.when(usable, F.col(c).cast("double"))).alias(f"filtered_{n}_at_{k}") for n, c in names.items()],
        *[F.avg(F.when(usable, F.col(c).cast("double")).otherwise(0.0)).alias(f"global_{n}_at_{k}")
          for n, c in names.items()],
        F.sum(flag(usable)).alias("evaluated_groups"), F.count("*").alias("total_groups"),
        F.sum(flag(F.col("positives") == 0)).alias("skipped_no_positive"),
        F.sum(flag((F.col("positives") > 0) & (F.col("n") < min_candidates))).alias("skipped_small_group"),
        F.sum(flag(~usable)).alias("impossible_users"))


def evaluate_programs(scored: DataFrame, k: int = 10, min_candidates: int = 2) -> DataFrame:
    """One row: NDCG, hit rate and MRR over groups with a positive and enough candidates."""
    g = group_metrics(scored, k, item="post_id").where(
        (F.col("positives") > 0) & (F.col("n") >= min_candidates))
    zero = F.lit(0.0)
    return g.agg(F.coalesce(F.avg("ndcg"), zero).alias(f"ndcg_at_{k}"),
                 F.coalesce(F.avg(F.col("hit").cast("double")), zero).alias(f"hitrate_at_{k}"),
                 F.coalesce(F.avg("rr"), zero).alias(f"mrr_at_{k}"), F.count("*").alias("groups"))


def rerank_impact(before: DataFrame, after: DataFrame, k: int = 10, item: str = "mentor_id",
                  score: str = "pred_score") -> DataFrame:
    """One row: mean and largest share of each mentee's first ``k`` that changed."""
    order = [F.col(score).desc(), F.col(item)]
    old = grouped_topk(before, ["mentee_id"], order, k).select("mentee_id", item)
    new = grouped_topk(after, ["mentee_id"], order, k).select("mentee_id", item, F.lit(1).alias("kept"))
    per_user = old.join(new, ["mentee_id", item], "left").groupBy("mentee_id").agg(
        (1.0 - F.count("kept") / F.count("*")).alias("changed"))
    return per_user.agg(F.avg("changed").alias("mean_changed"), F.max("changed").alias("max_changed"))


def score_spread(scored: DataFrame, score: str = "pred_score") -> DataFrame:
    """One row: median over the mentees of the score deviation and range in their list."""
    from matchspark.operators.quantiles import quantiles_wide
    per_user = scored.groupBy("mentee_id").agg(
        F.stddev_samp(score).alias("deviation"), (F.max(score) - F.min(score)).alias("range"))
    return quantiles_wide(per_user, ["deviation", "range"], [0.5]).select(
        F.col("deviation_q50").alias("median_deviation"), F.col("range_q50").alias("median_range"))


def candidate_stats(pairs: DataFrame, item: str = "mentor_id") -> DataFrame:
    """One row: pairs, people on both sides, candidates per mentee, low-density warning."""
    return pairs.agg(
        F.count("*").alias("candidate_count"), F.countDistinct("mentee_id").alias("candidate_mentees"),
        F.countDistinct(item).alias("candidate_items")).withColumn(
        "avg_candidates_per_mentee", F.round(
            F.col("candidate_count") / F.greatest(F.col("candidate_mentees"), F.lit(1)), 1)).withColumn(
        "shrinkage_warning", F.col("candidate_count") / F.greatest(F.col("candidate_mentees"), F.lit(1)) < 5)


def positive_coverage(stage: DataFrame, positives: DataFrame) -> DataFrame:
    """One row: positives still among the candidates of a stage, mentees with one, candidates."""
    pairs = stage.select("mentee_id", "mentor_id").distinct().withColumn("_in", F.lit(1))
    found = positives.join(pairs, ["mentee_id", "mentor_id"], "left").agg(
        F.count("*").alias("positives"), F.count("_in").alias("in_pool"))
    sizes = stage.agg(F.struct(
        F.count("*").alias("candidates"),
        F.countDistinct(F.when(F.col("label") > 0, F.col("mentee_id"))).alias("mentees_with_positive"))).scalar()
    return found.select("*", sizes.alias("_s")).select("positives", "in_pool", "_s.candidates", "_s.mentees_with_positive")


def sampling_diagnostics(dataset: DataFrame, item: str = "mentor_id") -> DataFrame:
    """One row about the train part: ratios and the hardness distribution of its negatives."""
    from matchspark.operators.quantiles import quantiles_wide
    train = dataset.where(F.col("time_split") == "train")
    negative = F.col("label") == 0
    hard = F.when(negative, F.col("hardness_score"))
    counts = train.agg(
        F.sum(flag(F.col("label") == 1)).alias("train_positive_count"),
        F.sum(flag(negative)).alias("train_negative_count"), F.avg(hard).alias("hardness_mean"),
        F.stddev_samp(hard).alias("hardness_std"), F.countDistinct(item).alias("training_unique_items"),
        F.countDistinct("mentee_id").alias("training_unique_mentees"))
    quarts = quantiles_wide(train.where(negative), ["hardness_score"], [0.25, 0.75])
    q = quarts.agg(F.struct(F.max("hardness_score_q25").alias("q25"), F.max("hardness_score_q75").alias("q75"))).scalar()
    ratio = F.col("train_negative_count") / F.greatest(F.col("train_positive_count"), F.lit(1))
    return counts.select("*", F.round(ratio, 2).alias("train_neg_pos_ratio"), q.alias("_q")).select(
        *counts.columns, "train_neg_pos_ratio", F.col("_q.q25").alias("hardness_q25"), F.col("_q.q75").alias("hardness_q75"))


def concentration(recs: DataFrame, item: str = "post_id", warn_above: float = 0.30) -> DataFrame:
    """One row: different items, the largest share one item has, and a warning above the limit."""
    per_item = recs.groupBy(item).agg(F.count("*").alias("_n"))
    return per_item.agg(F.count("*").alias("unique_items"),
                        (F.max("_n") / F.sum("_n")).alias("top_share")).withColumn(
        "collapse_warning", F.coalesce(F.col("top_share") > warn_above, F.lit(False)))


def coverage_sample(scored: DataFrame, k: int = 5, users: int = 5, seed: int = 42) -> DataFrame:
    """First ``k`` rows of a few hash-chosen mentees with the mean coverage of each list."""
    chosen = scored.select("mentee_id").distinct().orderBy(
        F.xxhash64("mentee_id", F.lit(seed)), "mentee_id").limit(users)
    top = grouped_topk(scored.join(chosen, "mentee_id", "left_semi"), ["mentee_id"],
                       [F.col("pred_score").desc(), F.col("mentor_id")], k, rank="rank")
    mean = F.avg("skill_coverage_score").over(Window.partitionBy("mentee_id"))
    return top.select("mentee_id", "rank", "mentor_id", "pred_score", "skill_coverage_score",
                      "subdomain_similarity", mean.alias("mean_coverage"))
