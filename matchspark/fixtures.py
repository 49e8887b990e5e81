"""The driver tables seen through the matching data model.

Every view is plain SQL that Spark and DuckDB both run: customer = mentee, supplier = mentor,
part = program, orders with lineitem = applications, events = engagement, nation = country.
The lines of an order have roles by number: 1 application and feedback, 2 and 5 interests, 3 follows,
4 communities, 6 and 7 expertise. Requirements and the dense views read every line.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["f_technology"] = """
SELECT DISTINCT p_partkey % 154 + 1 AS technology_id, (p_partkey % 154 + 1) % 23 + 1 AS subdomain_id,
       ((p_partkey % 154 + 1) % 23 + 1) % 4 + 1 AS domain_id
FROM part"""

VIEWS["f_subdomains"] = """
SELECT DISTINCT subdomain_id, domain_id, concat('sub ', CAST(subdomain_id AS VARCHAR(10))) AS name
FROM f_technology"""

VIEWS["f_domains"] = """
SELECT r_regionkey % 4 + 1 AS domain_id, min(r_name) AS name FROM region GROUP BY r_regionkey % 4 + 1"""

VIEWS["f_mentee_profile"] = """
SELECT c_custkey AS user_id, n_regionkey % 4 + 1 AS domain_id, n_name AS country_code,
       CASE c_custkey % 7 WHEN 0 THEN 'Beginner' WHEN 1 THEN ' intermediate' WHEN 2 THEN '4' WHEN 3 THEN 'junior'
            WHEN 4 THEN '' WHEN 5 THEN 'guru' END AS current_level,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Freshman' WHEN 'AUTOMOBILE' THEN 'sophomore' WHEN 'MACHINERY' THEN '3'
            WHEN 'HOUSEHOLD' THEN 'Senior' ELSE 'graduate' END AS education_status
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["f_mentor_profile"] = """
SELECT s_suppkey AS user_id, n_regionkey % 4 + 1 AS domain_id, n_name AS country_code,
       CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE s_suppkey % 16 END AS years_of_experience,
       CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS is_active,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE (s_suppkey % 11) / 2.0E0 END AS average_rating,
       s_suppkey % 13 AS total_reviews,
       CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS is_verified
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

VIEWS["f_users"] = """
SELECT c_custkey AS user_id, c_name AS first_name, c_mktsegment AS last_name,
       CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS is_active, 'mentee' AS role
FROM customer
UNION ALL
SELECT 1000000000 + s_suppkey, CASE WHEN s_suppkey % 7 = 3 THEN ' ' ELSE s_name END,
       CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE 'Mentor' END,
       CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END, 'mentor'
FROM supplier"""

VIEWS["f_mentor_users"] = """
SELECT user_id - 1000000000 AS user_id, first_name, last_name, is_active FROM f_users WHERE role = 'mentor'"""

VIEWS["f_mentee_users"] = """
SELECT user_id, first_name, last_name, is_active FROM f_users WHERE role = 'mentee'"""

VIEWS["f_mentee_interests"] = """
SELECT o_custkey AS mentee_id, l_partkey % 154 + 1 AS technology_id, MAX(l_linenumber % 4 + 1) AS experience_level
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_linenumber IN (2, 5)
GROUP BY o_custkey, l_partkey % 154 + 1"""

VIEWS["f_mentor_expertise"] = """
SELECT DISTINCT l_suppkey AS mentor_id, l_partkey % 154 + 1 AS technology_id
FROM lineitem WHERE l_linenumber IN (6, 7)"""

# the same two tables from every line: nearly every person has nearly every skill
VIEWS["f_dense_interests"] = """
SELECT DISTINCT o_custkey AS mentee_id, l_partkey % 154 + 1 AS technology_id
FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""

VIEWS["f_dense_expertise"] = """
SELECT DISTINCT l_suppkey AS mentor_id, l_partkey % 154 + 1 AS technology_id FROM lineitem"""

VIEWS["f_mentee_subdomains"] = """
SELECT DISTINCT mentee_id, technology_id % 23 + 1 AS subdomain_id FROM f_mentee_interests"""

VIEWS["f_mentor_subdomains"] = """
SELECT DISTINCT mentor_id, technology_id % 23 + 1 AS subdomain_id FROM f_mentor_expertise"""

VIEWS["f_programs"] = """
SELECT p_partkey AS post_id, p_partkey % (SELECT COUNT(*) FROM supplier) AS mentor_id, p_name AS title,
       (p_partkey % 154 + 1) % 23 + 1 AS subdomain_id, ((p_partkey % 154 + 1) % 23 + 1) % 4 + 1 AS domain_id,
       CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'Beginner' WHEN 2 THEN 'intermediate' ELSE '4' END AS target_level,
       CASE p_size % 5 WHEN 0 THEN 'freshman' WHEN 1 THEN 'Sophomore' WHEN 2 THEN 'junior' WHEN 3 THEN 'senior'
            ELSE '5' END AS education_level,
       p_size AS capacity,
       CASE WHEN p_partkey % 10 = 0 THEN 'Draft' ELSE 'Published' END AS is_open,
       CASE WHEN p_partkey % 8 = 0 THEN 'Closed' ELSE 'Open' END AS availability,
       CAST(DATE '1995-01-01' + CAST(p_partkey % 1500 AS INT) AS TIMESTAMP) AS created_at,
       CAST(DATE '1995-01-01' + CAST(p_partkey % 1500 + p_size * 60 AS INT) AS TIMESTAMP) AS deadline
FROM part"""

VIEWS["f_requirements"] = """
SELECT DISTINCT l_partkey AS post_id, (l_partkey + l_linenumber) % 154 + 1 AS technology_id,
       l_linenumber % 4 + 1 AS required_experience_level
FROM lineitem"""

VIEWS["f_applications"] = """
SELECT o_orderkey AS app_id, l_partkey AS post_id, o_custkey AS mentee_id,
       l_partkey % (SELECT COUNT(*) FROM supplier) AS mentor_id,
       CASE WHEN o_orderstatus = 'F' THEN 'Accepted' WHEN o_orderstatus = 'O' THEN 'pending'
            WHEN l_returnflag = 'R' THEN 'alerted' ELSE 'Rejected' END AS status,
       o_orderdate AS applied_at, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE l_shipdate END AS decisioned_at
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1"""

VIEWS["f_mentorships"] = """
SELECT app_id AS mentorship_id, post_id, mentor_id, mentee_id,
       CASE app_id % 3 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Active' ELSE 'Cancelled' END AS status,
       applied_at AS start_date, decisioned_at AS end_date
FROM f_applications WHERE status = 'Accepted'"""

VIEWS["f_feedback"] = """
SELECT o_orderkey AS mentorship_id, o_custkey AS mentee_id,
       CASE WHEN o_orderkey % 10 = 0 THEN l_suppkey ELSE l_partkey % (SELECT COUNT(*) FROM supplier) END AS mentor_id,
       CAST(l_quantity AS INT) % 7 AS rating,
       CASE l_returnflag WHEN 'A' THEN 'Positive' WHEN 'N' THEN 'neutral' ELSE 'negative ' END AS sentiment,
       l_shipdate AS created_at
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1"""

VIEWS["f_cancellations"] = """
SELECT mentorship_id, mentor_id, mentee_id, CASE mentorship_id % 2 WHEN 0 THEN 'Mentor' ELSE '2' END AS cancellation_actor,
       end_date AS cancellation_date
FROM f_mentorships WHERE status = 'Cancelled'"""

VIEWS["f_follows"] = """
SELECT o_custkey AS follower_id, l_suppkey AS following_id, MIN(o_orderdate) AS created_at
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 3
GROUP BY o_custkey, l_suppkey"""

VIEWS["f_engagement"] = """
SELECT event_id, user_id, (event_id * 37 + user_id) % (SELECT COUNT(*) FROM part) AS post_id,
       CASE event_type WHEN 'view' THEN 'like' WHEN 'click' THEN 'comment' WHEN 'purchase' THEN 'save' ELSE 'share' END AS kind,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS score,
       CAST(DATE '1995-01-01' + CAST(FLOOR(event_id * 2400 / (SELECT COUNT(*) FROM events)) AS INT) AS TIMESTAMP) AS created_at
FROM events WHERE event_type <> 'error'"""

VIEWS["f_communities"] = """
SELECT DISTINCT o_custkey AS user_id, l_suppkey % 40 AS community_id
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 4"""

VIEWS["f_mentor_communities"] = """
SELECT DISTINCT l_suppkey AS user_id, l_partkey % 40 AS community_id
FROM lineitem WHERE l_linenumber = 4"""

# a scored mentor list per mentee, for the operators that start from model scores
VIEWS["f_scored"] = """
SELECT o_custkey AS mentee_id, l_suppkey AS mentor_id,
       MAX(l_extendedprice) / 20000 AS pred_score,
       MAX(l_discount) * 10 AS skill_coverage_score,
       MAX(l_discount) * 6 AS skill_overlap_score,
       MAX(CASE WHEN l_linenumber = 1 THEN l_tax ELSE 0 END) * 12 AS subdomain_similarity,
       MAX(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS mentor_domain_match,
       MAX(CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN 1 ELSE 0 END) AS label,
       MAX(CAST(l_quantity AS INT)) / 50.0E0 AS mentor_weighted_rating,
       MAX(l_tax) * 60 AS mentor_quality_score,
       MAX(l_linenumber % 4) AS experience_gap_abs,
       MAX(CASE WHEN l_linenumber % 4 > 1 THEN 1 ELSE 0 END) AS mentor_more_experienced,
       MAX(CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END) AS same_country,
       MAX(CASE WHEN l_linenumber = 2 THEN l_quantity ELSE 0 END) / 20 AS interaction_score_log,
       MAX(CASE WHEN l_suppkey % 3 = 0 THEN 0.7E0 ELSE 0 END) AS mentor_open_post_count_log,
       MAX(CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_tax * 10 END) AS popularity_log,
       MAX(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS is_following,
       MAX(CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'test' ELSE 'valid' END) AS time_split
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey"""

# a scored program list per mentee
VIEWS["f_program_scored"] = """
SELECT o_custkey AS mentee_id, l_partkey AS post_id, MIN(l_suppkey) AS mentor_id,
       MAX((l_partkey % 154 + 1) % 23 + 1) AS subdomain_id,
       MAX(l_extendedprice) / 20000 AS pred_score,
       MAX(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS minimum_requirement_exact_match,
       MAX(CASE WHEN l_linenumber IN (2, 3, 4) THEN 1 ELSE 0 END) AS minimum_requirement_above_minimum,
       MAX(l_discount) * 10 AS requirement_coverage_score,
       MAX(l_tax) * 12 AS requirement_overlap_score,
       MAX(CAST(l_quantity AS INT)) / 50.0E0 AS required_skill_level_match_score,
       MAX(l_linenumber % 3) AS matched_required_skill_count,
       MAX(CAST(l_quantity AS INT) % 5) AS missing_required_skill_count,
       MAX(CASE WHEN l_returnflag = 'A' THEN 0.9E0 WHEN l_returnflag = 'N' THEN 0.5E0 ELSE 0.2E0 END) AS overall_eligibility_softness,
       MAX(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS eligibility_pass,
       MAX(l_linenumber % 2) AS target_level_pass, MAX(l_linenumber % 3 % 2) AS education_level_pass,
       MAX(l_linenumber % 5) - 2 AS target_level_gap, MAX(l_linenumber % 4) - 1 AS education_level_gap,
       MAX(l_tax) * 12 + MAX(l_discount) AS candidate_pre_score, MAX(l_quantity) / 20 AS program_popularity_log,
       MAX(CAST(l_quantity AS INT)) % 9 AS spots_left, MAX(CAST(l_quantity AS INT)) % 9 + MAX(l_linenumber) AS capacity,
       MAX(CAST(l_quantity AS INT)) AS days_until_deadline, MAX(CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END) AS deadline_passed,
       MAX(CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN 1 ELSE 0 END) AS label
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey"""

_NAME = re.compile(r"\b[fx]_[a-z_]+\b")


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    """Views used by ``sql``, directly or through other views, in definition order."""
    found: set[str] = set()
    queue = [sql]
    while queue:
        for name in _NAME.findall(queue.pop()):
            if name in views and name not in found:
                found.add(name)
                queue.append(views[name])
    return [name for name in views if name in found]


def with_views(sql: str, extra: list[str] | None = None, more_views: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it uses (and ``extra`` definitions, verbatim)."""
    views = VIEWS | (more_views or {})
    parts = [*(extra or []), *(f"{name} AS ({views[name].strip()})" for name in _needed(sql, views))]
    if not parts:
        return sql
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(parts) + ",\n" + re.sub(r"(?i)^with\s+", "", body, count=1)
    return "WITH " + ",\n".join(parts) + "\n" + body


_REGISTERED: set[tuple[int, str]] = set()


class Tables:
    """The base tables and fixture views of one data folder as DataFrames (``t.f_programs``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir)

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def base_view(self, name: str) -> str:
        """A temporary view over one base table; the schema is read from the file once per session."""
        view = f"base_{zlib.crc32(self.path(name).encode()):08x}_{name}"
        key = (id(self.spark._jsparkSession), view)
        if key not in _REGISTERED:
            self.spark.read.parquet(self.path(name)).createOrReplaceTempView(view)
            _REGISTERED.add(key)
        return view

    def sql(self, sql: str) -> DataFrame:
        text = with_views(sql)
        used = [b for b in BASE if re.search(rf"\b{b}\b", text)]
        base = [f"{b} AS (SELECT * FROM {self.base_view(b)})" for b in used]
        return self.spark.sql(with_views(sql, base))

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.table(self.base_view(name))
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)
