"""Operators on hand-made and random frames: ties, nulls, empty inputs, hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from matchspark.functions import compat, ids, numbers, sets
from matchspark.operators import (
    asof, cleaning, factors, labels, metrics, normalize, overlap, quality, ranker, sampling, topk)
from matchspark.operators.quantiles import quantiles_wide
from matchspark.plans import candidates, rerank, skill_match, splits


def test_asof_counts_ties_and_skips_missing_times(spark):
    events = spark.createDataFrame(
        [(1, "2020-01-01 10:00:00", 2), (1, "2020-01-01 10:00:00", 3), (1, "2020-01-03 09:00:00", 5), (1, None, 7),
         (2, "2020-01-02 00:00:00", 1)], "k long, t string, s int").withColumn("t", F.col("t").cast("timestamp"))
    left = spark.createDataFrame(
        [(1, "2020-01-01 10:00:00"), (1, "2019-12-31 00:00:00"), (1, "2020-01-04 00:00:00"), (3, "2020-01-04 00:00:00")],
        "k long, t string").withColumn("t", F.col("t").cast("timestamp"))
    out = asof.asof_join(left, events, ["k"], "t", {"total": F.col("s"), "n": F.lit(1)})
    got = {(r.k, str(r.t)): (r.total, r.n) for r in out.collect()}
    assert got == {(1, "2020-01-01 10:00:00"): (5, 2), (1, "2019-12-31 00:00:00"): (None, None),
                   (1, "2020-01-04 00:00:00"): (10, 3), (3, "2020-01-04 00:00:00"): (None, None)}


def test_reaching_pairs_keep_every_pair_at_the_floor(spark):
    rnd = random.Random(11)
    hot = [1, 2]  # a token nearly everyone has, met through split lookups
    left = {i: sorted({t for t in hot if rnd.random() < 0.9} | set(rnd.sample(range(3, 30), rnd.randint(1, 9)))) for i in range(40)}
    right = {i: sorted({t for t in hot if rnd.random() < 0.9} | set(rnd.sample(range(3, 30), rnd.randint(1, 9)))) for i in range(60)}
    floor = {i: rnd.choice([0.2, 0.3, 0.5]) for i in left if i % 5}

    def tokens(sets_of, key):
        return spark.createDataFrame([(i, t) for i, ts in sets_of.items() for t in ts], f"{key} long, token long")

    def people(sets_of, key, size):
        return spark.createDataFrame([(i, len(ts)) for i, ts in sets_of.items()], f"{key} long, {size} int")

    out = overlap.reaching_pairs(
        people(left, "l", "a"), tokens(left, "l"), people(right, "r", "b"), tokens(right, "r"), left_id="l", right_id="r",
        classes=["b"], tops=[F.count("*").alias("n")], floor=spark.createDataFrame(list(floor.items()), "l long, _floor double"),
        reach=lambda o: F.least(o, "b") / (F.col("a") + F.col("b") - F.least(o, "b")).cast("double"), part_rows=7)
    got = [(r.l, r.r) for r in out.collect()]
    assert len(got) == len(set(got))
    for i, a in left.items():
        for j, b in right.items():
            common = len(set(a) & set(b))
            if common >= 2 and common / len(set(a) | set(b)) >= floor.get(i, 0.0):
                assert (i, j) in set(got)
    assert len(got) < len(left) * len(right)


def test_best_matches_equal_brute_force_on_dense_and_equal_sets(spark):
    rnd = random.Random(3)
    people = {i: sorted(rnd.sample(range(12), 9)) if i % 3 else [1, 2, 3] for i in range(30)}
    mentors = {i: sorted(rnd.sample(range(12), 10)) if i % 4 else [1, 2, 3, 4] for i in range(25)}
    frame = lambda d, key: spark.createDataFrame(
        [(i, t) for i, ts in d.items() for t in ts + ts[:1]] + [(None, 1), (99, None)], f"{key} long, t long")
    got = {(r.l, r["rank"]): r.r for r in skill_match.top_skill_matches(frame(people, "l"), frame(mentors, "r"), "l", "r", "t", 4).collect()}
    want = {}
    for i, a in people.items():
        scored = sorted((-len(set(a) & set(b)) / len(set(a) | set(b)), -len(set(a) & set(b)), j) for j, b in mentors.items() if set(a) & set(b))
        want |= {(i, n + 1): x[2] for n, x in enumerate(scored[:4])}
    assert got == want


def test_asof_hot_key_equals_brute_force(spark):
    rnd = random.Random(5)
    ev = [(1 if rnd.random() < 0.7 else rnd.randint(2, 4), rnd.randint(0, 40000), rnd.randint(1, 4)) for _ in range(400)]
    pr = [(rnd.randint(1, 4), rnd.randint(0, 40000)) for _ in range(60)]
    events = spark.createDataFrame(ev, "k long, sec long, s int").select("k", F.timestamp_seconds("sec").alias("t"), "s")
    left = spark.createDataFrame(pr, "k long, sec long").select("k", F.timestamp_seconds("sec").alias("t"), "sec")
    out = asof.asof_join(left, events, ["k"], "t", {"total": F.col("s")})
    for r in out.collect():
        want = sum(s for k, sec, s in ev if k == r.k and sec <= r.sec)
        assert (r.total or 0) == want


def test_top_skill_matches_equal_brute_force_with_hot_skill_and_copies(spark):
    rnd = random.Random(11)

    def people(n, hot):
        out = {}
        for i in range(n):
            out[i] = {0, 1} if rnd.random() < 0.35 else set(rnd.sample(range(12), rnd.randint(1, 4)))
            if rnd.random() < hot:
                out[i].add(0)
        return out

    left, right = people(40, 0.4), people(60, 0.5)
    lb = spark.createDataFrame([(i, s) for i, x in left.items() for s in x], "l long, s long")
    rb = spark.createDataFrame([(i, s) for i, x in right.items() for s in x], "r long, s long")
    got = {}
    for r in skill_match.top_skill_matches(lb, rb, "l", "r", "s", 5).collect():
        got.setdefault(r.l, []).append((r["rank"], r.r))
    for i, a in left.items():
        scored = [(-len(a & b) / len(a | b), -len(a & b) / len(a), j) for j, b in right.items() if a & b]
        assert [j for _, j in sorted(got.get(i, []))] == [j for *_, j in sorted(scored)[:5]]


def test_quantiles_equal_numpy(spark):
    rnd = np.random.default_rng(3)
    for values in (rnd.normal(size=333), np.array([2.0]), np.array([0.0, 0.0, 5.0, -1.5]), rnd.integers(-4, 4, 200).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        row = quantiles_wide(df, ["x"], [0.0, 0.1, 0.5, 0.95, 1.0]).first()
        want = np.quantile(values, [0.0, 0.1, 0.5, 0.95, 1.0])
        assert np.allclose([row.x_q0, row.x_q10, row.x_q50, row.x_q95, row.x_q100], want)


def test_all_null_median_falls_back_to_zero(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "user_id long, rating double")
    assert rows(cleaning.impute(df)) == [(1, 0.0), (2, 0.0)]


def test_dense_index_is_consecutive(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("u"))
    out = topk.dense_index(df, F.substring("u", 1, 2), [F.col("u")]).orderBy("u").collect()
    assert [r.idx for r in out] == list(range(1, 501))


def test_uuid5_equals_python(spark):
    import uuid
    df = spark.range(50).select("id", ids.user_uuid(F.col("id").cast("string")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"mentorship.user.{r.id}")) for r in df.collect())


def test_sets_with_empty_sides(spark):
    df = spark.createDataFrame([([], [1]), ([1], []), ([1, 2], [2, 3]), (None, [1])], "a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    out = [(round(r[0], 3), r[1], r[2]) for r in df.select(sets.jaccard(a, b), sets.coverage(a, b), sets.match_type(a, b)).collect()]
    assert out == [(0.0, 0.0, 0), (0.0, 0.0, 0), (0.333, 0.5, 1), (0.0, 0.0, 0)]
    text = spark.createDataFrame([("{3, 1}",), ("[2]",), ("",), ("junk",), ("{1,}",)], "t string")
    assert [r[0] for r in text.select(sets.parse_set_text(F.col("t"))).collect()] == [[1, 3], [2], [], [], [1]]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(numbers.clip(F.col("x"), 0.0, 1.0)).collect()] == [None, 0.0, 1.0]


def test_softness_tail(spark):
    df = spark.range(7)
    got = [round(r[0], 4) for r in df.orderBy("id").select(compat.softness(F.col("id"))).collect()]
    assert got == [1.0, 0.66, 0.3, 0.15, 0.075, 0.05, 0.05]


def scored(spark, data):
    return spark.createDataFrame(data, "mentee_id long, mentor_id long, label int, pred_score double")


def test_metrics_by_hand(spark):
    df = scored(spark, [(1, 1, 0, 3.0), (1, 2, 1, 2.0), (1, 3, 1, 1.0), (2, 1, 0, 1.0), (2, 2, 0, 2.0), (3, 1, 1, 1.0)])
    row = metrics.evaluate_ranking(df, 10, 2).first()
    dcg = 1 / np.log2(3) + 1 / np.log2(4)
    assert row.filtered_ndcg_at_10 == pytest.approx(dcg / (1 + 1 / np.log2(3)))
    assert row.filtered_map_at_10 == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert (row.total_groups, row.evaluated_groups, row.skipped_no_positive, row.skipped_small_group) == (3, 1, 1, 1)
    assert row.global_hitrate_at_10 == pytest.approx(1 / 3)


def test_flat_scores_and_single_candidates(spark):
    df = scored(spark, [(1, 1, 0, 2.0), (1, 2, 0, 2.0), (2, 1, 0, 5.0)])
    flat = {(r.mentee_id, r.mentor_id): r.x for r in normalize.minmax(df, ["mentee_id"], "pred_score", "x").collect()}
    assert set(flat.values()) == {0.5}
    conf = {(r.mentee_id, r.mentor_id): r.x for r in normalize.confidence_minmax(df, ["mentee_id"], "pred_score", "x").collect()}
    assert conf[(1, 1)] == pytest.approx(0.85) and conf[(2, 1)] == pytest.approx(0.65)


def test_positive_in_two_splits(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "mentee_id long, mentor_id long")
    pos = spark.createDataFrame([("train", 1, 1), ("test", 1, 1), ("test", 1, 2)], "time_split string, mentee_id long, mentor_id long")
    base = labels.assign_labels(pairs, pos)
    got = rows(base.select("time_split", "mentee_id", "mentor_id", "label"))
    assert got == [("test", 1, 1, 1), ("test", 1, 2, 1), ("train", 1, 1, 1), ("train", 1, 2, 0), ("train", 2, 1, 0)]
    clean = rows(labels.remove_contamination(base, pos).select("time_split", "mentee_id", "mentor_id", "label"))
    assert clean == [("test", 1, 2, 1), ("train", 1, 1, 0), ("train", 1, 2, 0), ("train", 2, 1, 0)]


def labelled(spark, n=400, seed=1):
    rnd = random.Random(seed)
    data = [("train", i % 8, i, 1 if rnd.random() < 0.06 else 0, rnd.choice([0.0, 0.3]), rnd.random(), 0.0, rnd.choice([0, 1]), 0.0)
            for i in range(n)]
    return spark.createDataFrame(data, "time_split string, mentee_id long, mentor_id long, label int, skill_overlap_score double, "
                                       "skill_coverage_score double, subdomain_similarity double, mentor_domain_match int, interaction_score_log double")


def test_sampling_quota_and_stability(spark):
    df = labelled(spark)
    one, two = sampling.sample_tiered(df, 3, 5), sampling.sample_tiered(df.repartition(7), 3, 5)
    key = ["mentee_id", "mentor_id", "label"]
    assert rows(one.select(*key)) == rows(two.select(*key))
    for r in one.groupBy("mentee_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect():
        assert r.p > 0 and r.n - r.p == max(3 * r.p, 5 - r.p)
    positives = one.where("label = 1").select("mentee_id", "mentor_id")
    assert one.where("label = 0").join(positives, ["mentee_id", "mentor_id"]).count() == 0


def test_training_pairs_stay_linear(spark):
    df = labelled(spark)
    assert ranker.difference_rows(df, ["skill_coverage_score"]).count() <= df.where("label = 0").count()


def test_ranker_learns_the_signal(spark):
    rnd = random.Random(2)
    data = [(m, i, 1 if i < 2 else 0, (0.8 if i < 2 else 0.2) + rnd.uniform(-0.15, 0.15), rnd.random()) for m in range(30) for i in range(12)]
    df = spark.createDataFrame(data, "mentee_id long, mentor_id long, label int, skill_coverage_score double, noise double")
    model = ranker.fit(df, ["skill_coverage_score", "noise"])
    weights = ranker.weights_of(model, ["skill_coverage_score", "noise"])
    assert weights["skill_coverage_score"] > abs(weights["noise"])
    assert metrics.evaluate_ranking(ranker.score(df, weights)).first().filtered_ndcg_at_10 > 0.95


def test_factors_rebuild_the_dominant_part(spark):
    rnd = np.random.default_rng(0)
    a = rnd.random((40, 3)) @ rnd.random((3, 25)) * (rnd.random((40, 25)) < 0.7)
    cells = [(i, j, float(a[i, j])) for i in range(40) for j in range(25) if a[i, j] > 0]
    df = spark.createDataFrame(cells, "user long, item long, value double")
    users, items = factors.latent_factors(df, rank=3, oversample=8, rounds=5)
    u, s, v = np.linalg.svd(a, full_matrices=False)
    uf = u[:, :3] * s[:3]
    uf /= np.linalg.norm(uf, axis=1, keepdims=True)
    vf = v[:3].T / np.linalg.norm(v[:3].T, axis=1, keepdims=True)
    gu = {r.id: np.array(r.vector) for r in users.collect()}
    gv = {r.id: np.array(r.vector) for r in items.collect()}
    worst = max(abs(gu[i] @ gv[j] - uf[i] @ vf[j]) for i in gu for j in gv)
    assert worst < 0.02
    assert factors.latent_factors(df.limit(10)) is None


def test_exploration_adds_new_mentors_only(spark):
    mentees = spark.range(20).select(F.col("id").alias("mentee_id"), F.array((F.col("id") % 3).cast("bigint")).alias("subdomains_set"))
    mentors = spark.range(50).select(F.col("id").alias("mentor_id"), F.array((F.col("id") % 3).cast("bigint")).alias("subdomains_set"))
    pool = mentees.select("mentee_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)])).alias("mentor_id"))
    sub = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "subdomain_id long, domain_id long")
    extra = candidates.exploration(mentees, mentors, pool, sub, 6, 5)
    assert extra.join(pool, ["mentee_id", "mentor_id"]).count() == 0
    assert {r["count"] for r in extra.groupBy("mentee_id").count().collect()} == {6}
    same = extra.where(F.col("mentee_id") % 3 == F.col("mentor_id") % 3).groupBy("mentee_id").count().collect()
    assert all(r["count"] >= 4 for r in same)


def test_diverse_selection_by_hand(spark):
    data = [(1, i, 1 if i < 6 else 2, 1 if i < 6 else i, 100.0 - i) for i in range(12)]
    df = spark.createDataFrame(data, "mentee_id long, post_id long, mentor_id long, subdomain_id long, score double")
    got = [r.post_id for r in rerank.diverse_selection(df, k=7).orderBy("rank").collect()]
    assert got == [0, 1, 2, 6, 7, 8, 3]


def test_long_lists_are_read_to_their_end(spark):
    # 300 programs of one mentor, then another mentor's: the pick has to come from place 301
    data = [(1, i, 1 if i < 300 else 2, i, 1000.0 - i) for i in range(301)]
    df = spark.createDataFrame(data, "mentee_id long, post_id long, mentor_id long, subdomain_id long, score double")
    assert [r.post_id for r in rerank.diverse_selection(df, k=4).orderBy("rank").collect()] == [0, 1, 2, 300]
    assert rerank.prefilter_lists(df).count() == 301 and rerank.prefilter_lists(df, target=7).count() == 7


def test_recent_sessions_and_decay(spark):
    shown = spark.createDataFrame([(1, s, 10) for s in range(5)] + [(1, 4, 11)], "mentee_id long, session long, mentor_id long")
    assert {r.session for r in rerank.keep_recent_sessions(shown).collect()} == {2, 3, 4}
    df = spark.createDataFrame([(1, 10, 1.0), (1, 11, 1.0), (1, 12, 1.0)], "mentee_id long, mentor_id long, rerank_score double")
    got = {r.mentor_id: round(r.rerank_score, 6) for r in rerank.recent_decay(df, shown).collect()}
    assert got == {10: round(0.95 * 0.97 * 0.97, 6), 11: 0.95, 12: 1.0}


def test_split_needs_dates(spark):
    empty = spark.createDataFrame([], "start_date timestamp")
    with pytest.raises(ValueError):
        splits.build_split_config(empty)
    day = spark.createDataFrame([("2020-01-01",)] * 3, "d string").select(F.col("d").cast("timestamp").alias("start_date"))
    assert splits.build_split_config(day).valid_end == "2020-01-02 00:00:00"


def test_quality_rules_raise(spark):
    df = spark.createDataFrame([(1, None)], "mentee_id long, mentor_id long")
    with pytest.raises(ValueError):
        quality.require_ids(df)
    with pytest.raises(ValueError):
        quality.reject_leakage(df.withColumn("future_clicks", F.lit(1)))
    with pytest.raises(ValueError):
        quality.schema_report(df, ["mentee_id"], ["mentee_id"])
    report = quality.schema_report(df, ["mentee_id", "mentor_id", "x"], ["mentee_id"], {"mentee_id": "numeric"})
    assert report["missing_expected"] == ["x"]
    manifest = quality.feature_manifest(["a"], ["a"], "1")
    with pytest.raises(ValueError):
        quality.require_compatible(manifest, "2")
    quality.require_compatible(manifest, "1", ["a"], ["a"])
    with pytest.raises(ValueError):
        quality.align_to_manifest(df, manifest)


def test_fingerprint_ignores_row_order(spark):
    df = spark.range(30).select("id", (F.col("id") * 1.5).alias("x"))
    a, b = quality.fingerprint(df).first()[0], quality.fingerprint(df.orderBy(F.col("id").desc())).first()[0]
    assert a == b and a != quality.fingerprint(df.where("id > 0")).first()[0]
