"""Dashboard and lookup views, for all mentors or users at once.

Ask for one id with a filter on the result: it is pushed below the joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchspark.functions.numbers import flag
from matchspark.functions.text import full_name
from matchspark.operators.topk import global_topk, grouped_topk

CLOSED = ["Closed", "Archived", "Cancelled"]  # fixed values
GENERAL = "General"


def _names(users: DataFrame, key: str, name: str = "name") -> DataFrame:
    plain = F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit("")))
    return users.select(F.col("user_id").alias(key), plain.alias(name))


def _domain(df: DataFrame, domains: DataFrame, key: str = "domain_id", name: str = "domain") -> DataFrame:
    lookup = domains.select(F.col("domain_id").alias(key), F.col("name").alias(name))
    return df.join(lookup, key, "left").withColumn(name, F.coalesce(name, F.lit(GENERAL)))


def mentor_cards(profile: DataFrame, users: DataFrame, domains: DataFrame) -> DataFrame:
    """(mentor_id, name, domain_id, domain, rating, reviews)."""
    base = profile.select(F.col("user_id").alias("mentor_id"), "domain_id", "average_rating",
                          F.coalesce(F.col("average_rating").cast("double"), F.lit(0.0)).alias("rating"),
                          F.coalesce("total_reviews", F.lit(0)).alias("reviews"))
    return _domain(base.join(_names(users, "mentor_id"), "mentor_id"), domains)


def _best_first() -> list[Column]:
    return [F.col("average_rating").desc_nulls_last(), F.col("reviews").desc(), F.col("mentor_id")]


def top_mentors_by_rating(profile: DataFrame, users: DataFrame, domains: DataFrame, domain_id: int | None = None,
                          limit: int = 5) -> DataFrame:
    cards = mentor_cards(profile, users, domains)
    rows = (cards.where(F.col("domain_id") == domain_id) if domain_id is not None
            else cards.where(F.col("average_rating").isNotNull() & (F.col("reviews") > 0)))
    return global_topk(rows, _best_first(), limit).select("mentor_id", "name", "domain", "rating", "reviews")


def top_mentors_by_feedback(profile: DataFrame, users: DataFrame, domains: DataFrame, feedback: DataFrame,
                            domain_id: int | None = None, limit: int = 5) -> DataFrame:
    cards = mentor_cards(profile, users, domains)
    if domain_id is not None:
        cards = cards.where(F.col("domain_id") == domain_id)
    given = feedback.groupBy("mentor_id").agg(
        F.count("*").alias("feedback_count"), F.avg(F.col("rating").cast("double")).alias("avg_rating"))
    rows = cards.join(given, "mentor_id", "left").select(
        "mentor_id", "name", "domain", F.coalesce("feedback_count", F.lit(0)).alias("feedback_count"),
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"))
    return global_topk(rows, [F.col("feedback_count").desc(), F.col("avg_rating").desc(), F.col("mentor_id")], limit)


def mentors_by_domain_name(profile: DataFrame, users: DataFrame, domains: DataFrame, part: str) -> DataFrame:
    """Mentors whose domain name contains ``part``, without regard to case."""
    named = domains.where(F.lower("name").contains(part.lower())).select("domain_id")
    cards = mentor_cards(profile, users, domains).join(named, "domain_id", "left_semi")
    return cards.select("mentor_id", "name", "domain", "rating", "reviews")


def open_programs(posts: DataFrame, profile: DataFrame, users: DataFrame, domains: DataFrame,
                  domain_id: int | None = None, limit: int = 10) -> DataFrame:
    """Published programs that are not closed, newest first."""
    rows = posts.where((F.col("is_open") == "Published") & ~F.col("availability").isin(*CLOSED))
    if domain_id is not None:
        rows = rows.where(F.col("domain_id") == domain_id)
    mentors = profile.select(F.col("user_id").alias("mentor_id")).join(_names(users, "mentor_id", "mentor"), "mentor_id")
    joined = _domain(rows.join(mentors, "mentor_id"), domains)
    return global_topk(joined, [F.col("created_at").desc(), F.col("post_id")], limit).select(
        "post_id", "title", "domain", "mentor", "created_at")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("mentor_id").agg(
        F.count("*").alias("total_feedbacks"), F.coalesce(F.avg(F.col("rating").cast("double")), F.lit(0.0)).alias("avg_rating"))


def recent_feedback(feedback: DataFrame, users: DataFrame, limit: int = 10) -> DataFrame:
    """The latest feedback rows of every mentor with the sender's name."""
    order = [F.col("created_at").desc(), F.col("mentorship_id"), F.col("mentee_id")]
    last = grouped_topk(feedback, ["mentor_id"], order, limit, rank="rank")
    return last.join(_names(users, "mentee_id", "from_user"), "mentee_id", "left").select(
        "mentor_id", "rank", "mentorship_id", "rating", "from_user", "created_at")


def mentors_per_domain(profile: DataFrame, domains: DataFrame) -> DataFrame:
    return _domain(profile.select("user_id", "domain_id"), domains).groupBy("domain").agg(F.count("user_id").alias("mentor_count"))


def programs_of_mentors(posts: DataFrame, domains: DataFrame) -> DataFrame:
    """Programs with their domain name; filter on mentor_id for one mentor."""
    return _domain(posts, domains).select("mentor_id", "post_id", "title", "domain", "created_at")


def mentors_with_reviews(profile: DataFrame, users: DataFrame, domains: DataFrame, min_reviews: int = 5,
                         limit: int = 50) -> DataFrame:
    cards = mentor_cards(profile, users, domains).where(F.col("reviews") >= min_reviews)
    return global_topk(cards, _best_first(), limit).select("mentor_id", "name", "domain", "rating", "reviews")


def taxonomy(domains: DataFrame, subdomains: DataFrame) -> DataFrame:
    """Every domain with the number and the sorted names of its subdomains."""
    subs = subdomains.groupBy("domain_id").agg(
        F.count("*").alias("subdomain_count"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("subdomains"))
    return domains.select("domain_id", F.col("name").alias("domain")).join(subs, "domain_id", "left").fillna(
        {"subdomain_count": 0, "subdomains": ""})


def technology_counts(technologies: DataFrame, subdomains: DataFrame) -> DataFrame:
    """Technologies per subdomain."""
    names = subdomains.select("subdomain_id", F.col("name").alias("subdomain"))
    return technologies.join(names, "subdomain_id", "left").groupBy("subdomain").agg(F.count("*").alias("technologies"))


def mentor_stats(profile: DataFrame) -> DataFrame:
    rated = F.when(F.col("average_rating") > 0, F.col("average_rating").cast("double"))
    return profile.agg(F.count("*").alias("total"), F.sum(flag(F.col("is_verified") == 1)).alias("verified"),
                       F.coalesce(F.avg(rated), F.lit(0.0)).alias("avg_rating"))


def mentor_profiles(profile: DataFrame, users: DataFrame, domains: DataFrame, posts: DataFrame) -> DataFrame:
    """Profile, domain and number of programs of every mentor."""
    programs = posts.groupBy("mentor_id").agg(F.count("*").alias("program_count"))
    base = profile.withColumnRenamed("user_id", "mentor_id").join(_names(users, "mentor_id"), "mentor_id", "left")
    return _domain(base, domains, name="domain_name").join(programs, "mentor_id", "left").select(
        "mentor_id", "name", "domain_name", F.coalesce(F.col("years_of_experience").cast("double"), F.lit(0.0)).alias("years_of_experience"),
        (F.col("is_verified") == 1).alias("is_verified"), F.coalesce(F.col("average_rating").cast("double"), F.lit(0.0)).alias("average_rating"),
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"), F.coalesce("program_count", F.lit(0)).alias("program_count"))


def program_stats(posts: DataFrame, domains: DataFrame, mentorships: DataFrame, applications: DataFrame) -> DataFrame:
    """Active mentees and applications of every program."""
    active = mentorships.where(F.col("status") == "Active").groupBy("post_id").agg(F.count("*").alias("active_mentees"))
    asked = applications.groupBy("post_id").agg(F.count("*").alias("applications_count"))
    return _domain(posts, domains).join(active, "post_id", "left").join(asked, "post_id", "left").select(
        "mentor_id", "post_id", "title", "domain", "capacity", "created_at",
        F.coalesce("active_mentees", F.lit(0)).alias("active_mentees"),
        F.coalesce("applications_count", F.lit(0)).alias("applications_count"))


def latest_per_mentor(df: DataFrame, time: str, limit: int, tie: str) -> DataFrame:
    return grouped_topk(df, ["mentor_id"], [F.col(time).desc(), F.col(tie)], limit, rank="rank")


def active_mentees(mentorships: DataFrame, mentee_profile: DataFrame, users: DataFrame, domains: DataFrame) -> DataFrame:
    """Current mentees of every mentor with name and domain."""
    rows = mentorships.where(F.col("status") == "Active").select("mentor_id", "mentee_id", "mentorship_id", "post_id", "start_date")
    home = _domain(mentee_profile.select(F.col("user_id").alias("mentee_id"), "domain_id"), domains, name="domain_name")
    return rows.join(home, "mentee_id", "left").join(_names(users, "mentee_id"), "mentee_id", "left").select(
        "mentor_id", "mentorship_id", "post_id", "mentee_id", "name", "domain_name", "start_date")


def pending_applications(applications: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """Undecided applications to every mentor's programs."""
    rows = applications.where(F.lower("status").isin("pending", "under review")).select("app_id", "post_id", "mentee_id", "status", "applied_at")
    owners = posts.select("post_id", "mentor_id", F.col("title").alias("program_title"))
    return rows.join(owners, "post_id").join(_names(users, "mentee_id", "mentee_name"), "mentee_id", "left").select(
        "mentor_id", "app_id", "post_id", "program_title", "mentee_id", F.trim("mentee_name").alias("mentee_name"), "applied_at")


def analytics_overview(profile: DataFrame, posts: DataFrame, mentorships: DataFrame, applications: DataFrame) -> DataFrame:
    """Counts of the four dashboard feeds of every mentor and its mentees per program."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("mentor_id").agg(F.count("*").alias(name))

    owners = posts.select("post_id", "mentor_id")
    waiting = applications.where(F.lower("status").isin("pending", "under review")).select("post_id").join(owners, "post_id")
    out = profile.select(F.col("user_id").alias("mentor_id"))
    for part in (count(posts, "program_count"), count(mentorships.where(F.col("status") == "Active"), "active_mentees_count"),
                 count(waiting, "pending_applications_count")):
        out = out.join(part, "mentor_id", "left")
    out = out.fillna(0)
    programs = F.col("program_count")
    return out.withColumn("average_mentees_per_program", F.when(
        programs > 0, F.col("active_mentees_count") / F.when(programs > 0, programs)).otherwise(0.0))


def user_context(users: DataFrame, mentor_profile: DataFrame, mentee_profile: DataFrame, domains: DataFrame,
                 countries: DataFrame) -> DataFrame:
    """Role, domain and country of every user."""
    mentor = mentor_profile.select("user_id", F.col("domain_id").alias("_md"), F.col("country_code").alias("_mc"), F.lit(1).alias("_m"))
    mentee = mentee_profile.select("user_id", F.col("domain_id").alias("_ed"), F.col("country_code").alias("_ec"), F.lit(1).alias("_e"))
    m, e = F.col("_m").isNotNull(), F.col("_e").isNotNull()
    base = users.join(mentor, "user_id", "left").join(mentee, "user_id", "left").select(
        "user_id", "first_name", "last_name",
        F.when(m & e, "both").when(m, "mentor").when(e, "mentee").otherwise("user").alias("role"),
        F.coalesce("_md", "_ed").alias("domain_id"), F.coalesce("_mc", "_ec", F.lit("")).alias("country_code"))
    return _domain(base, domains, name="domain_name").join(countries, "country_code", "left").withColumn(
        "country_name", F.coalesce("country_name", F.lit("")))


def user_mentorships(mentorships: DataFrame, mentor_profile: DataFrame, mentor_users: DataFrame,
                     mentee_users: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per person and mentorship, as mentor or as mentee."""
    mentors = _domain(mentor_profile.select(F.col("user_id").alias("mentor_id"), "domain_id"), domains).join(
        _names(mentor_users, "mentor_id", "mentor_name"), "mentor_id").drop("domain_id")
    rows = mentorships.join(mentors, "mentor_id").join(_names(mentee_users, "mentee_id", "mentee_name"), "mentee_id")
    shown = ["mentorship_id", "post_id", "status", "mentor_name", "mentee_name", "domain", "start_date"]
    as_mentor = rows.select(F.col("mentor_id").alias("user_id"), F.lit("mentor").alias("side"), *shown)
    return as_mentor.unionByName(rows.select(F.col("mentee_id").alias("user_id"), F.lit("mentee").alias("side"), *shown))


def user_applications(applications: DataFrame, posts: DataFrame, mentor_users: DataFrame, domains: DataFrame) -> DataFrame:
    programs = _domain(posts.select("post_id", "mentor_id", "domain_id", F.col("title").alias("program_title")), domains)
    named = programs.join(_names(mentor_users, "mentor_id", "mentor_name"), "mentor_id")
    return applications.select("app_id", "post_id", F.col("mentee_id").alias("user_id"), "status", "applied_at").join(
        named, "post_id").select("user_id", "app_id", "post_id", "status", "program_title", "domain", "mentor_name", "applied_at")


def stat_cards(users: DataFrame, mentor_profile: DataFrame, mentee_profile: DataFrame, mentorships: DataFrame,
               language: str = "en") -> DataFrame:
    """Platform totals as (label, value) cards."""
    # fixed values
    cards = [("Mentors", "المرشدون", mentor_profile), ("Mentees", "المسترشدون", mentee_profile),
             ("Active Mentorships", "جلسات الإرشاد", mentorships), ("Total Users", "المستخدمون", users)]
    out = None
    for english, arabic, df in cards:
        one = df.agg(F.lit(arabic if language == "ar" else english).alias("label"), F.count("*").cast("string").alias("value"))
        out = one if out is None else out.union(one)
    return out


def skills_by_name(bridge: DataFrame, technologies: DataFrame, key: str) -> DataFrame:
    """Sorted lower-case skill names per person."""
    names = technologies.select("technology_id", F.lower(F.trim("name")).alias("skill"))
    return bridge.select(key, "technology_id").join(names, "technology_id").select(key, "skill").distinct().groupBy(key).agg(
        F.array_sort(F.collect_list("skill")).alias("skills"))


def followed_mentors(follows: DataFrame) -> DataFrame:
    return follows.select(F.col("follower_id").alias("mentee_id"), F.col("following_id").alias("mentor_id")).distinct()


def fallback_mentors(profile: DataFrame, users: DataFrame, domains: DataFrame, mentorships: DataFrame,
                     limit: int = 10) -> DataFrame:
    """Active, verified mentors by rating and completed mentorships, with score, percentage and reason."""
    done = mentorships.where(F.col("status") == "Completed").groupBy("mentor_id").agg(
        F.countDistinct("mentorship_id").alias("completed_mentorships"))
    active = users.where(F.col("is_active") == 1)
    base = profile.where(F.col("is_verified") == 1).select(
        F.col("user_id").alias("mentor_id"), "domain_id",
        F.coalesce(F.col("average_rating").cast("double"), F.lit(4.0)).alias("avg_rating"),
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"))
    rows = _domain(base.join(_names(active, "mentor_id", "mentor_name"), "mentor_id"), domains).join(
        done, "mentor_id", "left").fillna(0, ["completed_mentorships"])
    r, n = F.col("avg_rating"), F.col("completed_mentorships")
    total = (r / 5.0) * 80 + F.least(n * 2, F.lit(20))
    star = F.format_string("%.1f", r)
    reasons = F.array_compact(F.array(
        F.when(r >= 4.5, F.concat(F.lit("★ Highly rated ("), star, F.lit("/5)"))).when(
            r >= 4.0, F.concat(F.lit("★ "), star, F.lit("/5 rating"))),
        F.when(n > 5, F.concat(F.lit("👥 "), n.cast("string"), F.lit(" mentorships")))))
    best = global_topk(rows, [r.desc(), n.desc(), F.col("mentor_id")], limit)
    return best.select(
        "mentor_id", "mentor_name", "domain", "avg_rating", "completed_mentorships", (total * 0.75).alias("score"),
        F.least(F.floor(total), F.lit(100)).cast("int").alias("match_percentage"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, " | ")).otherwise(F.lit("Available mentor")).alias("reason"))


def mentor_names(users: DataFrame) -> DataFrame:
    return users.select(F.col("user_id").alias("mentor_id"), full_name(F.col("first_name"), F.col("last_name")).alias("mentor_name"))
