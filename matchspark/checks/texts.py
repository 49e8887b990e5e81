"""Queries: text rules, links, conversations, quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.checks.people import r6
from matchspark.checks.registry import check
from matchspark.fixtures import Tables
from matchspark.functions import explain, lexicon, sets, text
from matchspark.functions.numbers import flag
from matchspark.operators import quality
from matchspark.plans import chat


def sql_words(words) -> str:
    """SQL condition: the text t contains one of the words."""
    return "(" + " OR ".join("contains(t, '" + w.replace("'", "''") + "')" for w in words) + ")"


def sql_rules(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_words(w)} THEN '{label}'" for label, w in rules) + f" ELSE '{default}' END"


SPACES = r"[\s\x{0B}\x{85}\p{Z}]"
STRIPPED = f"regexp_replace(text, '^{SPACES}+|{SPACES}+$', '', 'g')"

MESSAGES = """
SELECT conv_id * 100 + turn AS message_id, conv_id, turn, role,
       concat(CASE conv_id % 11 WHEN 0 THEN 'hi ' WHEN 1 THEN 'How do I submit ' WHEN 2 THEN 'Recommend me mentors ' WHEN 3 THEN 'what is ' WHEN 4 THEN 'my profile '
              WHEN 5 THEN 'ايه machine learning ' WHEN 6 THEN 'error while ' WHEN 7 THEN 'good and helpful ' WHEN 8 THEN 'terrible ' WHEN 9 THEN 'مرحبا ' ELSE '' END, text) AS text
FROM conversations"""


def messages(t: Tables):
    return t.sql(MESSAGES)


@check("message_language", "N6", f"WITH m AS ({MESSAGES}) SELECT message_id, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ar' ELSE 'en' END AS language FROM m")
def message_language(t: Tables):
    return messages(t).select("message_id", text.language(F.col("text")).alias("language"))


GREETING_SQL = "(" + " OR ".join(
    f"t = '{g}' OR starts_with(t, '{g} ') OR starts_with(t, '{g}،') OR starts_with(t, '{g}.')" for g in lexicon.GREETINGS) + ")"


@check("mentee_intents", "N7", f"""
WITH m AS ({MESSAGES}), l AS (SELECT message_id, lower({STRIPPED}) AS t FROM m)
SELECT message_id, CASE WHEN {sql_words(lexicon.ABUSE)} THEN 'off_topic' WHEN {GREETING_SQL} THEN 'greeting' ELSE {sql_rules(lexicon.MENTEE_RULES, 'general_question')} END AS intent FROM l""")
def mentee_intents(t: Tables):
    return messages(t).select("message_id", text.mentee_intent(F.col("text")).alias("intent"))


@check("mentor_intents", "N8", f"""
WITH m AS ({MESSAGES}), l AS (SELECT message_id, lower(text) AS t FROM m) SELECT message_id, {sql_rules(lexicon.MENTOR_RULES, 'general_question')} AS intent FROM l""")
def mentor_intents(t: Tables):
    return messages(t).select("message_id", text.mentor_intent(F.col("text")).alias("intent"))


@check("intent_from_reply", "N9 N26", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'faq' WHEN 1 THEN 'greeting' WHEN 2 THEN 'general_question' WHEN 3 THEN 'find_mentor' WHEN 4 THEN 'task_help' ELSE '' END AS intent,
       CASE event_id % 6 WHEN 0 THEN 'faq' WHEN 1 THEN 'Greeting' ELSE '' END AS field FROM events""")
def intent_from_reply(t: Tables):
    k = F.col("event_id") % 6
    reply = (F.when(k == 0, '{"intent": "faq"}').when(k == 1, 'Sure: {"intent": "Greeting"} ok').when(k == 2, '"explanation_request"')
             .when(k == 3, "I think find_mentor fits").when(k == 4, "'task_help'").otherwise(F.concat(F.lit("no idea "), F.col("event_type"))))
    intent = text.intent_from_reply(reply, lexicon.MENTEE_INTENTS, lexicon.INTENT_ALIASES)
    field = text.lenient_json(reply, "intent string")["intent"]
    return t.events.select("event_id", F.coalesce(intent, F.lit("")).alias("intent"), F.coalesce(field, F.lit("")).alias("field"))


@check("message_sentiment", "N10", f"""
WITH m AS ({MESSAGES}), l AS (SELECT message_id, lower({STRIPPED}) AS t FROM m),
s AS (SELECT message_id, t, {sql_words(lexicon.POSITIVE_WORDS)} AS p, {sql_words(lexicon.NEGATIVE_WORDS)} AS n FROM l)
SELECT message_id, CASE WHEN t = '' THEN 'neutral' WHEN p AND NOT n THEN 'positive' WHEN n AND NOT p THEN 'negative' ELSE 'neutral' END AS label,
       CAST(CASE WHEN t = '' THEN 1.0 WHEN p <> n THEN 0.8 ELSE 0.6 END AS DOUBLE) AS confidence FROM s""")
def message_sentiment(t: Tables):
    s = text.sentiment(F.col("text"))
    return messages(t).select("message_id", s["label"].alias("label"), s["confidence"].alias("confidence"))


REVIEWS = """
SELECT f.mentor_id, f.rating, concat(CASE f.mentorship_id % 4 WHEN 0 THEN 'good ' WHEN 1 THEN 'terrible ' WHEN 2 THEN 'great but bad ' ELSE '' END,
       CASE WHEN f.mentorship_id % 5 = 0 THEN '' ELSE f.sentiment END) AS text FROM f_feedback f"""


@check("mentor_satisfaction", "N11", f"""
WITH r AS ({REVIEWS}), l AS (SELECT mentor_id, rating, lower({STRIPPED}) AS t FROM r),
s AS (SELECT mentor_id, rating, t, CASE WHEN p AND NOT n THEN 'positive' WHEN n AND NOT p THEN 'negative' ELSE 'neutral' END AS label FROM
      (SELECT *, {sql_words(lexicon.POSITIVE_WORDS)} AS p, {sql_words(lexicon.NEGATIVE_WORDS)} AS n FROM l)),
v AS (SELECT *, greatest(0, CASE label WHEN 'positive' THEN least(1, rating / 5.0) WHEN 'negative' THEN least(1, rating / 5.0) - 0.3 ELSE 0.4 + 0.4 * least(1, rating / 5.0) END) AS sat FROM s)
SELECT mentor_id, round(coalesce(avg(CAST(sat AS DOUBLE)) FILTER (t <> ''), 0) * 100, 1) AS satisfaction_rate, count(*) FILTER (t <> '' AND label = 'positive') AS positive,
       count(*) FILTER (t <> '' AND label = 'neutral') AS neutral, count(*) FILTER (t <> '' AND label = 'negative') AS negative, count(*) FILTER (t <> '') AS total FROM v GROUP BY mentor_id""")
def mentor_satisfaction(t: Tables):
    return text.satisfaction_by_mentor(t.sql(REVIEWS)).drop("average_rating")


@check("cleaned_feedback", "N12", f"""
WITH a AS (SELECT message_id, regexp_replace('-- ' || text || ' ..  ( ok ) ، yes', '^{SPACES}+|{SPACES}+$', '', 'g') AS t FROM ({MESSAGES})),
b AS (SELECT message_id, regexp_replace(regexp_replace(regexp_replace(t, '{SPACES}+', ' ', 'g'), '\\.{{2,}}', '.', 'g'), '،{{2,}}', '،', 'g') AS t FROM a),
c AS (SELECT message_id, regexp_replace(regexp_replace(t, '{SPACES}+([,.!?،؛:])', '\\1', 'g'), '([،؛:]){SPACES}*', '\\1 ', 'g') AS t FROM b),
d AS (SELECT message_id, regexp_replace(regexp_replace(regexp_replace(t, '{SPACES}+\\(', ' (', 'g'), '\\){SPACES}+', ') ', 'g'), '^[\\d\\-\\*•]+{SPACES}*', '', 'g') AS t FROM c)
SELECT message_id, CASE WHEN length(t) < 10 THEN '' ELSE ltrim(t) END AS cleaned FROM d""")
def cleaned_feedback(t: Tables):
    raw = F.concat(F.lit("-- "), F.col("text"), F.lit(" ..  ( ok ) ، yes"))
    return messages(t).select("message_id", text.clean_feedback(raw).alias("cleaned"))


FAQ = """
SELECT item_id AS entry_id, unnest(list_filter(string_split(lower(text), ' '), lambda x: length(x) >= 4)) AS keyword FROM benchmark"""


@check("faq_matches", "N13", f"""
WITH m AS ({MESSAGES}), k AS (SELECT DISTINCT entry_id, keyword FROM ({FAQ}) WHERE length(keyword) >= 4),
s AS (SELECT message_id, entry_id, sum(length(keyword)) AS score FROM m JOIN k ON contains(lower(m.text), k.keyword) GROUP BY message_id, entry_id HAVING sum(length(keyword)) >= 4)
SELECT message_id, entry_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, entry_id) AS rn FROM s) WHERE rn = 1""")
def faq_matches(t: Tables):
    return chat.match_faq(messages(t), faq_table(t)).where("entry_id IS NOT NULL").select(
        "message_id", "entry_id", F.col("score").cast("bigint").alias("score"))


def faq_table(t: Tables):
    words = F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) >= 4)
    return t.benchmark.select(F.col("item_id").alias("entry_id"), F.explode(words).alias("keyword")).distinct()


@check("faq_matches_joined", "N13", f"""
WITH m AS ({MESSAGES}), k AS (SELECT DISTINCT entry_id, keyword FROM ({FAQ}) WHERE length(keyword) >= 4),
s AS (SELECT message_id, entry_id, sum(length(keyword)) AS score FROM m JOIN k ON contains(lower(m.text), k.keyword) GROUP BY message_id, entry_id HAVING sum(length(keyword)) >= 4)
SELECT message_id, entry_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, entry_id) AS rn FROM s) WHERE rn = 1""")
def faq_matches_joined(t: Tables):
    """The same matches from a keyword list with every row twice."""
    return chat.match_faq(messages(t), faq_table(t).union(faq_table(t))).where("entry_id IS NOT NULL").select(
        "message_id", "entry_id", F.col("score").cast("bigint").alias("score"))


@check("separated_scripts", "N14", """
SELECT doc_id, regexp_replace(regexp_replace(t, '([؀-ۿݐ-ݿࢠ-ࣿ])([A-Za-z0-9@#%&])', '\\1 \\2', 'g'),
       '([A-Za-z0-9@#%&])([؀-ۿݐ-ݿࢠ-ࣿ])', '\\1 \\2', 'g') AS fixed FROM (SELECT doc_id, replace(text, 'e', 'س') AS t FROM documents)""")
def separated_scripts(t: Tables):
    mixed = F.replace(F.col("text"), F.lit("e"), F.lit("س"))
    return t.documents.select("doc_id", text.separate_scripts(mixed).alias("fixed"))


@check("link_domains", "N15", """
SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^www\\.', '') AS domain FROM pages""")
def link_domains(t: Tables):
    return t.pages.select("page_id", text.link_domain(F.col("url")).alias("domain"))


LINKS = """
SELECT page_id, lower(concat(url, CASE page_id % 7 WHEN 0 THEN '/youtube' WHEN 1 THEN '/Coursera' WHEN 2 THEN '/github/starter' WHEN 3 THEN '/docs' WHEN 4 THEN '/w3schools' WHEN 5 THEN '/github' ELSE '' END, ' ',
       regexp_extract(html, '<title>(.*?)</title>', 1))) AS t FROM pages"""


@check("link_kinds", "N16", f"""
WITH l AS ({LINKS})
SELECT page_id, CASE WHEN {sql_words(lexicon.LINK_KINDS['videos'])} THEN 'videos' WHEN {sql_words(lexicon.LINK_KINDS['courses'])} THEN 'courses'
       WHEN contains(t, 'github') AND {sql_words(lexicon.LINK_KINDS['project words'])} THEN 'projects' WHEN {sql_words(lexicon.LINK_KINDS['docs'])} THEN 'docs'
       WHEN {sql_words(lexicon.LINK_KINDS['course sites'])} THEN 'courses' ELSE 'articles' END AS kind,
       {sql_rules(lexicon.MATERIAL_KINDS, 'articles')} AS material FROM l""")
def link_kinds(t: Tables):
    k = F.col("page_id") % 7
    tail = (F.when(k == 0, "/youtube").when(k == 1, "/Coursera").when(k == 2, "/github/starter").when(k == 3, "/docs")
            .when(k == 4, "/w3schools").when(k == 5, "/github").otherwise(""))
    link, title = F.concat(F.col("url"), tail), F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return t.pages.select("page_id", text.link_kind(link, title).alias("kind"), text.material_kind(link, title).alias("material"))


@check("search_queries", "N17")
def search_queries(t: Tables):
    k = F.col("doc_id") % 5
    intent = F.when(k == 0, "roadmap").when(k == 1, "course").when(k == 2, "docs").when(k == 3, "projects").otherwise("other")
    topic = F.when(F.col("doc_id") % 3 == 0, "Deep Learning").when(F.col("doc_id") % 3 == 1, "react web").otherwise("cooking")
    sites = text.source_sites(intent, topic, F.when(F.col("lang") == "en", "en").otherwise("ar"))
    return t.documents.select("doc_id", text.search_query(topic, sites).alias("query"))


@check("trimmed_history", "N18 F2", """
SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'user' END AS role,
       CASE WHEN length(text) > 1000 THEN substr(text, length(text) - 999) ELSE text END AS content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6""")
def trimmed_history(t: Tables):
    return text.trim_history(t.conversations)


@check("mentioned_mentors", "N19", """
WITH r AS (SELECT mentee_id, mentor_id, row_number() OVER (PARTITION BY mentee_id ORDER BY pred_score DESC, mentor_id) AS rank FROM f_scored),
n AS (SELECT r.mentee_id AS message_id, r.mentor_id, rank, 'sam n' || r.mentor_id || 'x' AS name FROM r WHERE rank <= 5),
m AS (SELECT c_custkey AS message_id, CASE c_custkey % 4 WHEN 0 THEN 'tell me about the second one' WHEN 1 THEN 'why n' || (c_custkey % 100) || 'x ?' WHEN 2 THEN 'and sam n' || (c_custkey % 100) || 'x' ELSE '' END AS t FROM customer),
w AS (SELECT n.*, CASE WHEN contains(t, name) THEN 1 WHEN contains(t, 'sam') OR contains(t, 'n' || mentor_id || 'x') THEN 2 WHEN rank = 2 AND contains(t, 'second') THEN 3 END AS way
      FROM m JOIN n ON n.message_id = m.message_id WHERE t <> '')
SELECT message_id, mentor_id, CAST(rank AS INTEGER) AS rank, way FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY way, rank) AS rn FROM w WHERE way IS NOT NULL) WHERE rn = 1""")
def mentioned_mentors(t: Tables):
    from matchspark.operators.topk import grouped_topk
    recs = grouped_topk(t.f_scored, ["mentee_id"], [F.col("pred_score").desc(), F.col("mentor_id")], 5, rank="rank").select(
        F.col("mentee_id").alias("message_id"), "rank", "mentor_id", F.concat(F.lit("Sam N"), F.col("mentor_id"), F.lit("x")).alias("mentor_name"))
    k, num = F.col("c_custkey") % 4, (F.col("c_custkey") % 100).cast("string")
    msg = (F.when(k == 0, "tell me about the second one").when(k == 1, F.concat(F.lit("why n"), num, F.lit("x ?")))
           .when(k == 2, F.concat(F.lit("and Sam N"), num, F.lit("x"))).otherwise(""))
    out = chat.mentioned_mentor(t.customer.select(F.col("c_custkey").alias("message_id"), msg.alias("text")), recs)
    return out.select("message_id", "mentor_id", "rank", "way")


@check("one_sentence_reasons", "N20", """
WITH p AS (SELECT mentee_id, mentor_id, [x FOR x IN [
  CASE WHEN skill_coverage_score >= 0.5 THEN 'covers ' || CAST(CAST(round_even(skill_coverage_score * 100, 0) AS BIGINT) AS VARCHAR) || '% of your skills'
       WHEN skill_coverage_score > 0 THEN CAST(CAST(round_even(skill_coverage_score * 100, 0) AS BIGINT) AS VARCHAR) || '% skill coverage' END,
  CASE WHEN mentor_domain_match = 1 THEN 'Data domain match' END,
  CASE WHEN experience_gap_abs > 0 THEN experience_gap_abs || ' open program' || CASE WHEN experience_gap_abs > 1 THEN 's' ELSE '' END END,
  CASE WHEN mentor_quality_score >= 4.5 THEN 'excellent rating (' || printf('%.1f', mentor_quality_score) || '⭐)' WHEN mentor_quality_score >= 4 THEN 'high rating (' || printf('%.1f', mentor_quality_score) || '⭐)'
       WHEN mentor_quality_score >= 3 THEN 'solid rating (' || printf('%.1f', mentor_quality_score) || '⭐)' END,
  CASE WHEN is_following = 1 THEN 'mentor you follow' END] IF x IS NOT NULL] AS parts FROM f_scored)
SELECT mentee_id, mentor_id, CASE len(parts) WHEN 0 THEN 'Recommended based on your profile.' WHEN 1 THEN upper(parts[1][1]) || lower(parts[1][2:]) || '.'
       WHEN 2 THEN upper(parts[1][1]) || lower(parts[1][2:]) || ' with ' || parts[2] || '.'
       ELSE upper(parts[1][1]) || lower(parts[1][2:]) || ' with ' || array_to_string(parts[2:len(parts) - 1], ', ') || ', and ' || parts[len(parts)] || '.' END AS reason FROM p""")
def one_sentence_reasons(t: Tables):
    df = t.f_scored.select("mentee_id", "mentor_id", "skill_coverage_score", F.col("mentor_domain_match").alias("domain_match"), F.lit("Data").alias("domain"),
                           F.col("experience_gap_abs").alias("open_programs"), F.col("mentor_quality_score").alias("average_rating"), F.col("is_following").alias("is_followed"))
    return df.select("mentee_id", "mentor_id", explain.one_sentence_reason(df).alias("reason"))


@check("detailed_explanations", "N22")
def detailed_explanations(t: Tables):
    df = t.f_scored.select("mentee_id", "mentor_id", "skill_coverage_score", F.col("mentor_domain_match").alias("domain_match"), F.lit("Data").alias("domain"),
                           F.col("experience_gap_abs").alias("open_programs"), F.col("mentor_quality_score").alias("average_rating"), F.col("is_following").alias("is_followed"))
    named = df.select("mentee_id", "mentor_id", "domain", explain.one_sentence_reason(df).alias("reason"))
    who, pct = F.concat(F.lit("M"), F.col("mentor_id")), F.lit(80)
    return named.select("mentee_id", "mentor_id", *[
        explain.detailed_explanation(who, pct, F.col("reason"), F.col("domain"), lang).alias(lang) for lang in ("en", "ar")])


@check("request_keys", "N24", f"""
WITH m AS ({MESSAGES}) SELECT md5(concat_ws('|', role, text, '0.7')) AS request, count(*) AS n FROM m GROUP BY 1""")
def request_keys(t: Tables):
    key = text.request_key(F.col("role"), F.col("text"), F.lit("0.7"))
    return messages(t).groupBy(key.alias("request")).agg(F.count("*").alias("n"))


@check("personal_topics", "N27 N3", f"""
WITH m AS ({MESSAGES}), l AS (SELECT message_id, lower(text) AS t FROM m)
SELECT message_id, {sql_rules(lexicon.PERSONAL_TOPICS, '')} AS topic, {sql_words(lexicon.POSSESSIVES)} AS personal FROM l""")
def personal_topics(t: Tables):
    return messages(t).select("message_id", F.coalesce(text.personal_topic(F.col("text")), F.lit("")).alias("topic"),
                              text.is_personal(F.col("text")).alias("personal"))


@check("set_primitives", "N29 E1 E2 E3", """
WITH p AS (SELECT DISTINCT mentee_id, mentor_id FROM f_applications), x AS (
  SELECT p.mentee_id, p.mentor_id, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b FROM p
  LEFT JOIN (SELECT mentee_id, list(technology_id) AS s FROM f_mentee_interests GROUP BY mentee_id) a ON a.mentee_id = p.mentee_id
  LEFT JOIN (SELECT mentor_id, list(technology_id) AS s FROM f_mentor_expertise GROUP BY mentor_id) b ON b.mentor_id = p.mentor_id)
SELECT mentee_id, mentor_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, CASE WHEN len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = len(a) THEN 1 ELSE 0 END AS covers,
       CAST(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(b) - len(list_intersect(a, b)) ELSE 0 END AS INTEGER) AS extra,
       CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 WHEN len(b) > len(a) THEN 2 WHEN len(b) = len(a) THEN 1 ELSE 0 END AS match_type FROM x""")
def set_primitives(t: Tables):
    from matchspark.operators.overlap import as_sets
    rows = (t.f_applications.select("mentee_id", "mentor_id").distinct()
            .join(as_sets(t.f_mentee_interests, "mentee_id", "technology_id", "a"), "mentee_id", "left")
            .join(as_sets(t.f_mentor_expertise, "mentor_id", "technology_id", "b"), "mentor_id", "left"))
    a, b = F.col("a"), F.col("b")
    return rows.select("mentee_id", "mentor_id", sets.shared(a, b).alias("shared"), sets.covers_all(a, b).alias("covers"),
                       sets.extra_count(a, b).alias("extra"), sets.match_type(a, b).alias("match_type"))


# ------------------------------------------------------------------ quality


@check("row_reconciliation", "M1 M21", """
SELECT 'follows' AS name, count(*) AS expected, count(*) - (SELECT count(*) FROM f_follows WHERE created_at < TIMESTAMP '1996-01-01') AS loaded, FALSE AS matches FROM f_follows
UNION ALL SELECT 'feedback', count(*), count(*), TRUE FROM f_feedback UNION ALL SELECT 'programs', count(*), -1, FALSE FROM f_programs""")
def row_reconciliation(t: Tables):
    source = quality.row_counts({"follows": t.f_follows, "feedback": t.f_feedback, "programs": t.f_programs})
    target = quality.row_counts({"follows": t.f_follows.where("created_at >= TIMESTAMP_NTZ'1996-01-01'"), "feedback": t.f_feedback})
    return quality.reconcile(source, target)


@check("table_inventory", "M21", """
SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'posts', -1""")
def table_inventory(t: Tables):
    return quality.inventory({"customer": t.customer, "supplier": t.supplier}, ["customer", "supplier", "posts"])


@check("required_columns", "M2", """
SELECT 'user_id' AS "column", TRUE AS present, 0 AS empty_values UNION ALL SELECT 'CurrentLevel', TRUE, (SELECT count(*) FROM f_mentee_profile WHERE coalesce(trim(current_level), '') = '')
UNION ALL SELECT 'email', FALSE, 0""")
def required_columns(t: Tables):
    return quality.required_columns(t.f_mentee_profile, ["user_id", "CurrentLevel", "email"])


@check("integrity_rules", "M3 M4 M5 M6 M7", """
SELECT 'V1' AS rule, CAST(count(*) AS BIGINT) AS violations FROM f_applications a JOIN f_programs p ON p.post_id = a.post_id WHERE a.applied_at < p.created_at
UNION ALL SELECT 'V2', count(*) FROM f_applications WHERE decisioned_at < applied_at
UNION ALL SELECT 'V3a', count(*) FROM f_mentorships WHERE lower(status) = 'completed' AND end_date > TIMESTAMP '2000-01-01'
UNION ALL SELECT 'V3b', count(*) FROM f_mentorships WHERE lower(status) = 'active' AND end_date < TIMESTAMP '2000-01-01'
UNION ALL SELECT 'V3c', count(*) FROM f_mentorships WHERE end_date < start_date
UNION ALL SELECT 'V6', count(*) FROM f_applications WHERE lower(status) = 'pending' AND decisioned_at IS NOT NULL
UNION ALL SELECT 'V5a', count(*) FROM f_applications WHERE lower(status) IN ('accepted', 'rejected') AND app_id % 9 = 0
UNION ALL SELECT 'V4 ' || kind, count(*) FILTER (e.created_at < p.created_at) FROM f_engagement e JOIN f_programs p ON p.post_id = e.post_id GROUP BY kind""")
def integrity_rules(t: Tables):
    apps = t.f_applications.withColumn("meet_requirements", flag(F.col("app_id") % 9 != 0))
    events = t.f_engagement.withColumnRenamed("created_at", "event_time")
    return quality.integrity_report(apps, t.f_programs, t.f_mentorships, events, F.lit("2000-01-01").cast("timestamp"))


@check("requirement_distribution", "M6", """
SELECT CASE WHEN app_id % 9 <> 0 THEN 1 ELSE 0 END AS meet_requirements, count(*) AS applications FROM f_applications WHERE lower(status) = 'pending' GROUP BY 1""")
def requirement_distribution(t: Tables):
    return quality.requirement_distribution(t.f_applications.withColumn("meet_requirements", flag(F.col("app_id") % 9 != 0)))


@check("null_ids", "M8", """
SELECT count(*) FILTER (mentee_id % 50 = 0) AS mentee_id_nulls, count(*) FILTER (mentor_id % 7 = 0) AS mentor_id_nulls FROM f_mentorships""")
def null_ids(t: Tables):
    df = t.f_mentorships.select(F.when(F.col("mentee_id") % 50 != 0, F.col("mentee_id")).alias("mentee_id"),
                                F.when(F.col("mentor_id") % 7 != 0, F.col("mentor_id")).alias("mentor_id"))
    return quality.null_ids(df)


@check("future_rows", "M9", "SELECT count(*) FILTER (created_at > TIMESTAMP '1998-06-30 00:00:00') AS future_rows FROM f_feedback")
def future_rows(t: Tables):
    return quality.future_rows(t.f_feedback, "created_at", F.lit("1998-06-30").cast("timestamp"))


@check("range_report", "M12", """
WITH d AS (SELECT requirement_overlap_score * 1.3 AS requirement_overlap_score, CAST(target_level_gap AS DOUBLE) AS matched_required_skill_count,
                  CASE WHEN post_id % 97 = 0 THEN 500.0 ELSE pred_score END AS pred_score FROM f_program_scored),
q AS (SELECT quantile_cont(pred_score, 0.25) AS a, quantile_cont(pred_score, 0.75) AS b, quantile_cont(requirement_overlap_score, 0.25) AS c, quantile_cont(requirement_overlap_score, 0.75) AS e,
             quantile_cont(matched_required_skill_count, 0.25) AS g, quantile_cont(matched_required_skill_count, 0.75) AS h FROM d)
SELECT 'pred_score' AS "column", 0 AS negative, 0 AS out_of_range, count(*) FILTER (b > a AND (pred_score < a - 6 * (b - a) OR pred_score > b + 6 * (b - a))) AS outliers FROM d, q
UNION ALL SELECT 'requirement_overlap_score', 0, count(*) FILTER (requirement_overlap_score < 0 OR requirement_overlap_score > 1), count(*) FILTER (e > c AND (requirement_overlap_score < c - 6 * (e - c) OR requirement_overlap_score > e + 6 * (e - c))) FROM d, q
UNION ALL SELECT 'matched_required_skill_count', count(*) FILTER (matched_required_skill_count < 0), 0, count(*) FILTER (h > g AND (matched_required_skill_count < g - 6 * (h - g) OR matched_required_skill_count > h + 6 * (h - g))) FROM d, q""")
def range_report(t: Tables):
    df = t.f_program_scored.select(
        (F.col("requirement_overlap_score") * 1.3).alias("requirement_overlap_score"), F.col("target_level_gap").cast("double").alias("matched_required_skill_count"),
        F.when(F.col("post_id") % 97 == 0, 500.0).otherwise(F.col("pred_score")).alias("pred_score"))
    return quality.range_report(df, ["pred_score", "requirement_overlap_score", "matched_required_skill_count"])


@check("clipped_ranges", "M12", """
SELECT mentee_id, post_id, round(least(1, greatest(0, requirement_overlap_score * 1.3)), 6) AS requirement_overlap_score, greatest(target_level_gap, 0) AS capacity FROM f_program_scored""")
def clipped_ranges(t: Tables):
    df = t.f_program_scored.select("mentee_id", "post_id", (F.col("requirement_overlap_score") * 1.3).alias("requirement_overlap_score"), F.col("target_level_gap").alias("capacity"))
    return r6(quality.clip_ranges(df, ["requirement_overlap_score", "capacity"]))


@check("drift_report", "M13", """
WITH a AS (SELECT * FROM f_scored WHERE time_split = 'train'), b AS (SELECT * EXCLUDE (pred_score), CASE WHEN mentor_id % 3 = 0 THEN NULL ELSE pred_score * 4 END AS pred_score FROM f_scored WHERE time_split = 'test')
SELECT 'pred_score' AS "column", round(x.tm, 6) AS train_missing, round(y.tm, 6) AS eval_missing, round(x.md, 6) AS train_median, round(y.md, 6) AS eval_median, FALSE AS zero_variance,
       y.tm > greatest(x.tm * 2, x.tm + 0.10) AND y.tm > 0.05 AS missing_spike, abs(y.md - x.md) / (abs(x.md) + 1e-9) > 2 AS median_drift
FROM (SELECT avg(CASE WHEN pred_score IS NULL THEN 1.0 ELSE 0.0 END) AS tm, quantile_cont(pred_score, 0.5) AS md FROM a) x, (SELECT avg(CASE WHEN pred_score IS NULL THEN 1.0 ELSE 0.0 END) AS tm, quantile_cont(pred_score, 0.5) AS md FROM b) y
UNION ALL SELECT 'skill_coverage_score', 0.0, 0.0, round(x.md, 6), round(y.md, 6), FALSE, FALSE, abs(y.md - x.md) / (abs(x.md) + 1e-9) > 2
FROM (SELECT quantile_cont(skill_coverage_score, 0.5) AS md FROM a) x, (SELECT quantile_cont(skill_coverage_score, 0.5) AS md FROM b) y""")
def drift_report(t: Tables):
    train = t.f_scored.where("time_split = 'train'")
    evaluation = t.f_scored.where("time_split = 'test'").withColumn("pred_score", F.when(F.col("mentor_id") % 3 != 0, F.col("pred_score") * 4))
    return r6(quality.drift_report(train, evaluation, ["pred_score", "skill_coverage_score"]))


@check("distribution_warnings", "M14", """
WITH d AS (SELECT requirement_overlap_score * 1.3 AS r, target_level_gap AS c FROM f_program_scored)
SELECT 'requirement_overlap_score: ' || count(*) FILTER (r < -0.01 OR r > 1.01) || ' values out of range' AS warning FROM d
UNION ALL SELECT 'some_count: ' || count(*) FILTER (c < 0) || ' negative values' FROM d UNION ALL SELECT 'flat: zero variance' UNION ALL SELECT 'program_popularity_log: unstable spike'""")
def distribution_warnings(t: Tables):
    df = t.f_program_scored.select(
        "mentee_id", "post_id", (F.col("requirement_overlap_score") * 1.3).alias("requirement_overlap_score"), F.col("target_level_gap").alias("some_count"),
        F.lit(1.5).alias("flat"), F.when(F.col("post_id") == 0, 100.0).otherwise(F.col("program_popularity_log")).alias("program_popularity_log"))
    return quality.distribution_warnings(df)


@check("undeclared_binary", "M16", """
SELECT unnest(['same_country', 'mentor_domain_match', 'mentor_more_experienced', 'is_following']) AS "column" """)
def undeclared_binary(t: Tables):
    return quality.undeclared_binary(t.f_scored)


@check("imputed_values", "M17 H13", """
SELECT mentee_id, post_id, CASE WHEN post_id % 5 = 0 THEN (SELECT round(quantile_cont(pred_score, 0.5), 8) FROM f_program_scored WHERE post_id % 5 <> 0) ELSE round(pred_score, 8) END AS pred_score,
       CAST(CASE WHEN post_id % 3 = 0 THEN 0 ELSE capacity END AS DOUBLE) AS capacity FROM f_program_scored""")
def imputed_values(t: Tables):
    df = t.f_program_scored.select("mentee_id", "post_id", F.when(F.col("post_id") % 5 != 0, F.col("pred_score")).alias("pred_score"),
                                   F.when(F.col("post_id") % 3 != 0, F.col("capacity")).alias("capacity"))
    out = quality.apply_imputation(df, quality.imputation_values(df, ["pred_score", "capacity"]))
    return out.withColumn("pred_score", F.round("pred_score", 8))


@check("dataset_report", "K9", """
WITH d AS (SELECT mentee_id, mentor_id, label, time_split, pred_score FROM f_scored UNION ALL SELECT mentee_id, mentor_id, 1 - label, time_split, NULL FROM f_scored WHERE mentor_id % 20 = 0),
p AS (SELECT count(*) AS n, min(label) AS a, max(label) AS b FROM d GROUP BY mentee_id, mentor_id)
SELECT count(*) AS rows, 5 AS columns, count(DISTINCT mentee_id) AS unique_mentees, count(DISTINCT mentor_id) AS unique_mentors, count(*) FILTER (pred_score IS NULL) AS missing_values,
       CAST(sum(label) AS BIGINT) AS positives, count(*) FILTER (time_split = 'train') AS train_rows, count(*) FILTER (time_split = 'valid') AS valid_rows, count(*) FILTER (time_split = 'test') AS test_rows,
       round(sum(label) / CAST(count(*) AS DOUBLE), 4) AS positive_ratio, (SELECT CAST(sum(n - 1) AS BIGINT) FROM p) AS duplicate_pairs, (SELECT count(*) FROM p WHERE a <> b) AS mixed_pairs FROM d""")
def dataset_report(t: Tables):
    base = t.f_scored.select("mentee_id", "mentor_id", "label", "time_split", "pred_score")
    extra = base.where("mentor_id % 20 = 0").select("mentee_id", "mentor_id", (1 - F.col("label")).alias("label"), "time_split", F.lit(None).cast("double").alias("pred_score"))
    return quality.dataset_report(base.union(extra))


@check("dataset_verdict", "K10", """
SELECT count(*) = 0 AS valid, CASE WHEN count(*) = 0 THEN '' ELSE '' END AS errors FROM f_scored WHERE pred_score IS NULL""")
def dataset_verdict(t: Tables):
    out = quality.dataset_verdict(t.f_scored)
    return out.select("valid", F.array_join("errors", "; ").alias("errors"))


@check("dataset_fingerprint", "K11")
def dataset_fingerprint(t: Tables):
    return quality.fingerprint(t.f_scored)


@check("leakage_columns", "M10", """
SELECT unnest(['future_clicks', 'eval_rank', 'score_leakage', 'rate_after_split']) AS "column", (SELECT count(*) FROM customer) AS rows""")
def leakage_columns(t: Tables):
    names = ["future_clicks", "eval_rank", "evaluation_score", "score_leakage", "rate_after_split"]
    df = t.customer.select("c_custkey", *[F.lit(1).alias(n) for n in names])
    found = F.explode(F.array(*[F.lit(c) for c in quality.leakage_columns(df.columns)])).alias("column")
    return df.agg(F.count("*").alias("rows")).select(found, "rows")


@check("aligned_frame", "M19 M18", """
SELECT mentee_id, post_id, label, pred_score, requirement_coverage_score, CAST(0.25 AS DOUBLE) AS cf_score FROM f_program_scored""")
def aligned_frame(t: Tables):
    manifest = quality.feature_manifest(["pred_score", "requirement_coverage_score", "cf_score"], ["pred_score"], "1")
    return quality.align_to_manifest(t.f_program_scored, manifest, strict=False, fill={"cf_score": 0.25}).drop("mentor_id")
