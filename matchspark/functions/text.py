"""Text rules: language, ordered keyword rules, sentiment, clean-up, links, labels, FAQ keywords."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchspark.functions import lexicon
from matchspark.functions.numbers import flag

ARABIC = r"[؀-ۿ]"
ARABIC_WIDE = r"[؀-ۿݐ-ݿࢠ-ࣿ]"
LATIN = r"[A-Za-z0-9@#%&]"
SPACE = r"[\s\u0085\p{Z}]"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def any_of(text: Column, words: Sequence[str]) -> Column:
    """The text contains at least one of the words (plain substrings)."""
    pattern = "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", w) for w in words)
    return text.rlike(pattern)


def language(text: Column) -> Column:
    """ar when any Arabic letter occurs, else en."""
    return F.when(F.coalesce(text, F.lit("")).rlike(ARABIC), "ar").otherwise("en")


def first_match(text: Column, rules: Mapping[str, Sequence[str]] | Sequence[tuple[str, Sequence[str]]],
                default: str) -> Column:
    """The label of the first rule with a keyword in the text; rules are tried in order."""
    pairs = list(rules.items()) if isinstance(rules, Mapping) else list(rules)
    out = None
    for label, words in pairs:
        cond = any_of(text, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def starts_with_word(text: Column, words: Sequence[str]) -> Column:
    """The text equals one of the words or starts with it followed by a space, comma or full stop."""
    return text.rlike("^(" + "|".join(re.escape(w) for w in words) + r")([ ،.]|$)")


def mentee_intent(text: Column) -> Column:
    """Intent of a mentee message: abuse first, then greetings, then the keyword rules in order."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    rest = first_match(t, lexicon.MENTEE_RULES, "general_question")
    return (F.when(any_of(t, lexicon.ABUSE), "off_topic")
            .when(starts_with_word(t, lexicon.GREETINGS), "greeting").otherwise(rest))


def mentor_intent(text: Column) -> Column:
    return first_match(F.lower(F.coalesce(text, F.lit(""))), lexicon.MENTOR_RULES, "general_question")


def intent_from_reply(reply: Column, valid: Sequence[str], aliases: Mapping[str, str] | None = None) -> Column:
    """A label read from model output: JSON field, JSON inside text, the bare label, a mentioned label."""
    aliases = aliases or {}
    raw = strip(reply)

    def known(label: Column) -> Column:
        name = F.lower(strip(label))
        out = F.when(name.isin(*valid), name)
        for alias, target in aliases.items():
            out = out.when(name == alias, F.lit(target))
        return out

    embedded = F.regexp_extract(raw, r"\{[^}]+\}", 0)
    bare = F.regexp_replace(raw, r"^[\"']+|[\"']+$", "")
    mentioned = None
    for label, target in [*((v, v) for v in valid), *aliases.items()]:
        cond = F.lower(raw).contains(label)
        mentioned = F.when(cond, F.lit(target)) if mentioned is None else mentioned.when(cond, F.lit(target))
    return F.coalesce(known(F.get_json_object(raw, "$.intent")), known(F.get_json_object(embedded, "$.intent")),
                      known(bare), mentioned)


def lenient_json(text: Column, schema: str) -> Column:
    """JSON text, or the outermost JSON object inside other text, parsed; null when neither parses."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    whole = F.when(strip(text).rlike(r"(?s)^\{.*\}$"), text)
    return F.from_json(F.coalesce(whole, F.nullif(inner, F.lit(""))), schema)


def sentiment(text: Column) -> Column:
    """Struct of label, confidence and three scores from keywords; empty text is surely neutral."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    good, bad = any_of(t, lexicon.POSITIVE_WORDS), any_of(t, lexicon.NEGATIVE_WORDS)

    def result(label: str, confidence: float, pos: float, neu: float, neg: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"),
                        F.lit(pos).alias("positive"), F.lit(neu).alias("neutral"), F.lit(neg).alias("negative"))

    return (F.when(t == "", result("neutral", 1.0, 0.0, 1.0, 0.0))
            .when(good & ~bad, result("positive", 0.8, 0.8, 0.15, 0.05))
            .when(bad & ~good, result("negative", 0.8, 0.05, 0.15, 0.8))
            .otherwise(result("neutral", 0.6, 0.2, 0.6, 0.2)))


def satisfaction(rating: Column, label: Column) -> Column:
    """A rating 0..1 adjusted by the sentiment of the same row's comment."""
    base = F.least(F.greatest(F.coalesce(rating.cast("double"), F.lit(3.0)) / 5.0, F.lit(0.0)), F.lit(1.0))
    score = F.when(label == "positive", base).when(label == "negative", base - 0.3).otherwise(0.4 + base * 0.4)
    return F.greatest(score, F.lit(0.0))


def satisfaction_by_mentor(feedback: DataFrame, text: str = "text") -> DataFrame:
    """Satisfaction rate, label counts and mean rating of every mentor."""
    rows = feedback.withColumn("_comment", strip(F.col(text))).withColumn("_label", sentiment(F.col("_comment"))["label"])
    written = F.coalesce(F.col("_comment") != "", F.lit(False))
    label = F.col("_label")
    return rows.groupBy("mentor_id").agg(
        F.bround(F.coalesce(F.avg(F.when(written, satisfaction(F.col("rating"), label))), F.lit(0.0)) * 100, 1).alias("satisfaction_rate"),
        *[F.sum(flag(written & (label == name))).alias(name) for name in ("positive", "neutral", "negative")],
        F.sum(flag(written)).alias("total"), F.bround(F.avg("rating"), 2).alias("average_rating"))


def clean_feedback(text: Column) -> Column:
    """Tidy whitespace, repeated punctuation and leading bullets; text under ten letters becomes empty."""
    t = strip(F.coalesce(text, F.lit("")))
    for pattern, new in [
        (rf"{SPACE}+", " "), (r"\.{2,}", "."), (r"،{2,}", "،"), (rf"{SPACE}+([,.!?،؛:])", "$1"),
        (rf"([،؛:]){SPACE}*", "$1 "), (rf"{SPACE}+\(", " ("), (rf"\){SPACE}+", ") "), (rf"^[\d\-\*•]+{SPACE}*", ""),
    ]:
        t = F.regexp_replace(t, pattern, new)
    return F.when(F.length(t) < 10, F.lit("")).otherwise(F.ltrim(t))


def separate_scripts(text: Column) -> Column:
    """A space between adjoining Arabic and Latin runs."""
    once = F.regexp_replace(text, f"({ARABIC_WIDE})({LATIN})", "$1 $2")
    return F.regexp_replace(once, f"({LATIN})({ARABIC_WIDE})", "$1 $2")


def link_domain(url: Column) -> Column:
    """Host of a URL without a leading www; empty when there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def link_kind(link: Column, title: Column) -> Column:
    """videos, courses, projects, docs or articles for a learning link."""
    t = F.lower(F.concat(F.coalesce(link, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))
    k = lexicon.LINK_KINDS
    return (F.when(any_of(t, k["videos"]), "videos").when(any_of(t, k["courses"]), "courses")
            .when(t.contains("github") & any_of(t, k["project words"]), "projects")
            .when(any_of(t, k["docs"]), "docs").when(any_of(t, k["course sites"]), "courses").otherwise("articles"))


def material_kind(link: Column, title: Column) -> Column:
    """The shorter rule list for mentor materials."""
    t = F.lower(F.concat(F.coalesce(link, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))
    return first_match(t, lexicon.MATERIAL_KINDS, "articles")


def source_sites(intent: Column, topic: Column, lang: Column, limit: int = 6) -> Column:
    """Sites to search: by intent, then by topic, then for Arabic; repeats removed, first ``limit``."""
    by_intent = None
    for name, sites in lexicon.INTENT_SITES.items():
        entry = F.array(*[F.lit(s) for s in sites])
        by_intent = F.when(intent == name, entry) if by_intent is None else by_intent.when(intent == name, entry)
    general = F.array(*[F.lit(s) for s in lexicon.INTENT_SITES["general_search"]])
    none = F.array().cast("array<string>")
    t = F.lower(topic)
    topics = [F.when(t.contains(key) | F.lit(key).contains(t), F.array(*[F.lit(s) for s in sites])).otherwise(none)
              for key, sites in lexicon.TOPIC_SITES.items()]
    arabic = F.when(lang == "ar", F.array(*[F.lit(s) for s in lexicon.ARABIC_SITES])).otherwise(none)
    return F.slice(F.array_distinct(F.concat(by_intent.otherwise(general), *topics, arabic)), 1, limit)


def search_query(query: Column, sites: Column) -> Column:
    filters = F.array_join(F.transform(sites, lambda s: F.concat(F.lit("site:"), s)), " OR ")
    return F.when(F.size(sites) > 0, F.concat(query, F.lit(" "), filters)).otherwise(query)


def trim_history(turns: DataFrame, keep: int = 6, max_chars: int = 1000) -> DataFrame:
    """The last turns of every conversation, unknown roles as user, long texts cut to their tail."""
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    role = F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise(F.lit("user"))
    content = F.coalesce("text", F.lit(""))
    tail = F.when(F.length(content) > max_chars, F.substr(content, F.length(content) - max_chars + 1)).otherwise(content)
    return turns.withColumn("_age", F.row_number().over(last)).where(F.col("_age") <= keep).select(
        "conv_id", "turn", role.alias("role"), tail.alias("content"))


def personal_topic(text: Column) -> Column:
    """profile, mentorships, applications or programs of the asker; null when none is meant."""
    t = F.lower(F.coalesce(text, F.lit("")))
    label = first_match(t, lexicon.PERSONAL_TOPICS, "")
    return F.nullif(label, F.lit(""))


def is_personal(text: Column) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), lexicon.POSSESSIVES)


def request_key(*parts: Column) -> Column:
    """MD5 of the joined parts: equal requests get equal keys."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def full_name(first: Column, last: Column, default: str = "Mentor") -> Column:
    name = F.trim(F.concat(F.trim(F.coalesce(first, F.lit(""))), F.lit(" "), F.trim(F.coalesce(last, F.lit("")))))
    return F.when(name == "", F.lit(default)).otherwise(name)
