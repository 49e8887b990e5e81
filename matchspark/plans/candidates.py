"""Mentor candidate pool: tiered matches, popular fallback, exploration, positives, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchspark.operators.overlap import posting_lists
from matchspark.operators.topk import attach_list, bounded_list, dense_index, grouped_topk
from matchspark.session import materialize

# ---------------------------------------------------------------- fixed values
TIERS = {"skill": 5, "subdomain": 4, "domain": 3, "global": 1}
LEVEL_BONUS = 2
DOMAIN_SHARE = 0.7
# -----------------------------------------------------------------------------

PAIR = ["mentee_id", "mentor_id"]


def domains_of(features: DataFrame, key: str, subdomain_domains: DataFrame) -> DataFrame:
    """(key, domain_id) through the subdomains a person has."""
    lookup = subdomain_domains.select("subdomain_id", "domain_id").dropna().distinct()
    return (
        features.select(key, F.explode("subdomains_set").alias("subdomain_id"))
        .join(lookup, "subdomain_id").select(key, "domain_id").distinct()
    )


def _tokens(features: DataFrame, key: str, skills: str, level: str,
            subdomain_domains: DataFrame | None) -> DataFrame:
    """(key, level, tier, token) rows: everything two people can have in common."""
    levels = features.select(key, F.col("experience_level_num").alias(level))
    rows = features.select(key, F.lit(TIERS["skill"]).alias("tier"), F.explode(skills).alias("token")).union(
        features.select(key, F.lit(TIERS["subdomain"]), F.explode("subdomains_set")))
    if subdomain_domains is not None:
        rows = rows.union(domains_of(features, key, subdomain_domains).select(
            key, F.lit(TIERS["domain"]), F.col("domain_id").cast("bigint")))
    return rows.join(levels, key)


def _priority(tier: Column, mentor_level: Column) -> Column:
    return tier + F.when(mentor_level >= F.col("mentee_level"), LEVEL_BONUS).otherwise(0)


def tiered_offers(mentees: DataFrame, mentors: DataFrame, subdomain_domains: DataFrame | None, limit: int) -> DataFrame:
    """(mentee_id, offers): for each token of a mentee its ``limit`` best mentors with their priority, as one array.

    The order inside a tier is fixed (level fits, lower mentor id), so the first ``limit`` mentors of
    each shared token are enough and a popular token never yields all its pairs. A list is written once per token
    and level and travels whole, not as one row per pair.
    """
    left = _tokens(mentees, "mentee_id", "interests_set", "mentee_level", subdomain_domains)
    right = _tokens(mentors, "mentor_id", "expertise_set", "mentor_level", subdomain_domains)

    def rank(_: DataFrame):
        return [(F.col("mentor_level") >= F.col("mentee_level")).desc(), F.col("mentor_id")]

    key = ["tier", "token", "mentee_level"]
    best = posting_lists(left, right, token=["tier", "token"], left_key=["mentee_level"], list_key=["mentor_level"],
                         list_order=[F.col("mentor_id")], rank=rank, k=limit)
    entry = F.struct(_priority(F.col("tier"), F.col("mentor_level")).alias("priority"), "mentor_id")
    lists = materialize(best.groupBy(*key).agg(F.collect_list(entry).alias("offers")), "posting-lists")
    return left.join(lists, key).select("mentee_id", "offers")


def popular_mentors(mentors: DataFrame, k: int):
    """The ``k`` most popular mentors as one array literal of (mentor_id, mentor_level)."""
    rows = mentors.select(
        "mentor_id", "mentor_program_popularity",
        F.struct("mentor_id", F.col("experience_level_num").alias("mentor_level")).alias("mentor"))
    return bounded_list(rows, "mentor", [F.col("mentor_program_popularity").desc(), F.col("mentor_id")], k)


def popular_matches(mentees: DataFrame, mentors: DataFrame, k: int) -> DataFrame:
    """Every mentee with the popular mentors, at the lowest tier."""
    rows = attach_list(mentees.select("mentee_id", F.col("experience_level_num").alias("mentee_level")),
                       popular_mentors(mentors, k), "mentor")
    fits = F.col("mentor.mentor_level") >= F.col("mentee_level")
    return rows.select("mentee_id", F.col("mentor.mentor_id").alias("mentor_id"),
                       (F.lit(TIERS["global"]) + F.when(fits, LEVEL_BONUS).otherwise(0)).alias("priority"))


def ranked_candidates(mentees: DataFrame, mentors: DataFrame, subdomain_domains: DataFrame | None, top_k: int,
                      limit: int) -> DataFrame:
    """The ``limit`` best candidates of every mentee with priority and rank."""
    popular = mentees.select("mentee_id", F.col("experience_level_num").alias("mentee_level"),
                             popular_mentors(mentors, top_k).alias("_popular")).select("mentee_id", F.transform("_popular", lambda m: F.struct(
        _priority(F.lit(TIERS["global"]), m["mentor_level"]).alias("priority"), m["mentor_id"].alias("mentor_id"))).alias("offers"))
    # all offers of a mentee meet as arrays; pairs are made, compared and cut where they lie
    offers = tiered_offers(mentees, mentors, subdomain_domains, limit).unionByName(popular).repartition("mentee_id")
    each = offers.select("mentee_id", F.explode("offers").alias("o")).select("mentee_id", "o.mentor_id", "o.priority")
    best = each.groupBy(*PAIR).agg(F.max("priority").alias("priority"))
    return grouped_topk(best, ["mentee_id"], [F.col("priority").desc(), F.col("mentor_id")], limit, rank="rank")


def candidate_pool(mentees: DataFrame, mentors: DataFrame, subdomain_domains: DataFrame | None = None,
                   top_k: int = 30, high_cap: int = 30, low_cap: int = 10, exploration_pct: float = 0.05,
                   explore: bool = True, seed: int = 42) -> DataFrame:
    """(mentee_id, mentor_id): the best tiers up to both caps, then exploration."""
    limit = high_cap + low_cap
    pool = ranked_candidates(mentees, mentors, subdomain_domains, top_k, limit).select(*PAIR)
    if not explore:
        return pool
    pool = materialize(pool, "pool")
    n = max(2, round(high_cap * exploration_pct))
    return pool.union(exploration(mentees, mentors, pool, subdomain_domains, n, limit, seed)).distinct()


def _ring(rows: DataFrame, groups: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """Mentors numbered 0..n-1 in hash order (per group), and the ring sizes."""
    hashed = rows.withColumn("_hash", F.xxhash64(F.col("mentor_id"), F.lit(seed)))
    bucket = F.shiftright("_hash", 52)
    ring = dense_index(hashed, bucket, [F.col("_hash"), F.col("mentor_id")], "_idx", groups)
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_n")) if groups else rows.agg(F.count("*").alias("_n"))
    return ring.withColumn("_idx", F.col("_idx") - 1).drop("_hash"), sizes


def _window(rows: DataFrame, size, length: int, seed: int) -> DataFrame:
    """Each mentee takes ``length`` neighbouring ring places from a hashed start."""
    start = F.pmod(F.xxhash64(F.col("mentee_id"), F.lit(seed)), size)
    places = F.sequence(F.lit(0), F.least(F.lit(length), size) - 1)
    return rows.withColumn("_step", F.explode(places)).withColumn("_idx", F.pmod(start + F.col("_step"), size))


def exploration(mentees: DataFrame, mentors: DataFrame, pool: DataFrame, subdomain_domains: DataFrame | None,
                n: int, pool_limit: int, seed: int = 42) -> DataFrame:
    """``n`` extra mentors per mentee outside the pool, most of them from the mentee's domains.

    Mentors sit on a ring in hash order and every mentee looks at ``n`` places more than its pool can
    hold, so it finds enough new ones without being paired with all mentors. The result depends only
    on ids and seed.
    """
    ids = mentees.select("mentee_id")
    everyone = mentors.select("mentor_id")
    order = [F.xxhash64("mentee_id", "mentor_id", F.lit(seed)), F.col("mentor_id")]
    biased = None
    if subdomain_domains is not None:
        ring, sizes = _ring(domains_of(mentors, "mentor_id", subdomain_domains), ["domain_id"], seed)
        wanted = domains_of(mentees, "mentee_id", subdomain_domains).join(sizes, "domain_id")
        seen = _window(wanted, F.col("_n"), n + pool_limit, seed).join(ring, ["domain_id", "_idx"])
        fresh = seen.select(*PAIR).distinct().join(pool, PAIR, "left_anti")
        biased = materialize(grouped_topk(fresh, ["mentee_id"], order, int(n * DOMAIN_SHARE)).select(*PAIR), "biased")
    ring, sizes = _ring(everyone, [], seed + 1)
    taken = pool if biased is None else pool.union(biased)
    seen = _window(ids, sizes.scalar(), 2 * n + pool_limit, seed + 1).join(ring, "_idx")
    fresh = seen.select(*PAIR).distinct().join(taken, PAIR, "left_anti")
    if biased is None:
        return grouped_topk(fresh, ["mentee_id"], order, n).select(*PAIR)
    used = biased.groupBy("mentee_id").agg(F.count("*").alias("_used"))
    ranked = grouped_topk(fresh, ["mentee_id"], order, n, rank="_rank").join(used, "mentee_id", "left")
    filler = ranked.where(F.col("_rank") <= n - F.coalesce("_used", F.lit(0))).select(*PAIR)
    return biased.union(filler)


def force_fallback(pool: DataFrame, mentees: DataFrame, mentors: DataFrame, k: int) -> DataFrame:
    """Mentees without any candidate get the popular mentors."""
    missing = mentees.join(pool, "mentee_id", "left_anti")
    return pool.select(*PAIR).union(popular_matches(missing, mentors, k).select(*PAIR))


def positive_pairs(applications: DataFrame, posts: DataFrame) -> DataFrame:
    """(time_split, mentee_id, mentor_id) of every application, through the program's mentor."""
    owners = posts.select("post_id", F.col("mentor_id").alias("_owner")).dropna().distinct()
    return (
        applications.select("time_split", "mentee_id", "post_id").join(owners, "post_id")
        .select("time_split", "mentee_id", F.col("_owner").alias("mentor_id")).dropna().distinct()
    )


def first_event_times(applications: DataFrame, time: str = "applied_at") -> DataFrame:
    """The first application time of every mentee."""
    return applications.where(F.col(time).isNotNull()).groupBy("mentee_id").agg(
        F.min(F.col(time).cast("timestamp")).alias("event_time"))


def inject_positives(pool: DataFrame, positives: DataFrame) -> DataFrame:
    return pool.select(*PAIR).union(positives.select(*PAIR)).distinct()


def coverage_by_split(positives: DataFrame, pool: DataFrame) -> DataFrame:
    """How many positives of each split the pool contains."""
    inside = pool.select(*PAIR).distinct().withColumn("_in", F.lit(1))
    return positives.join(inside, PAIR, "left").groupBy("time_split").agg(
        F.count("*").alias("total"), F.count("_in").alias("in_pool"),
        F.round(100 * F.count("_in") / F.count("*"), 1).alias("coverage"))


def drop_zero_coverage(positives: DataFrame, pair_features: DataFrame) -> DataFrame:
    """Positives whose skill coverage is zero are no labels."""
    zero = pair_features.where(F.col("skill_coverage_score") == 0).select(*PAIR)
    return positives.join(zero, PAIR, "left_anti")
