"""Batch answers over chat messages: FAQ lookup and the mentor a follow-up message means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchspark.functions import lexicon
from matchspark.functions.text import any_of
from matchspark.operators.topk import grouped_topk

MIN_KEYWORD, MIN_SCORE = 4, 4
#: Keywords meet messages on the stretch of so many letters that fewest messages hold.
GRAM = MIN_KEYWORD


def match_faq(messages: DataFrame, faq: DataFrame, text: str = "text") -> DataFrame:
    """Messages with the best FAQ entry: the one whose contained keywords are longest in sum.

    ``faq`` has one row per (entry_id, keyword). Keywords under four letters are ignored, a sum under
    four is no match, and the lower entry id wins ties. Repeated rows of the list count once. Each distinct
    keyword meets each message that has its rarest gram once; entries are attached to the keywords found.
    """
    keywords = faq.select("entry_id", F.lower("keyword").alias("keyword")).where(F.length("keyword") >= MIN_KEYWORD).distinct()
    rows = messages.select("message_id", F.lower(F.col(text)).alias("_t"))
    found = _contained(rows, keywords.select("keyword").distinct())
    scores = found.join(keywords, "keyword").groupBy("message_id", "entry_id").agg(
        F.sum(F.length("keyword")).alias("score"))
    best = grouped_topk(scores.where(F.col("score") >= MIN_SCORE), ["message_id"],
                        [F.col("score").desc(), F.col("entry_id")], 1)
    return messages.join(best, "message_id", "left")


def _contained(rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """(message_id, keyword) for every keyword that a message holds.

    A message that holds a keyword holds all its grams, so each keyword is looked up by the one that fewest
    messages hold: a common start is no hot key. A message's text is joined once, to the list of its lookups,
    which the number of keywords bounds.
    """

    def grams(of: str) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(of) - GRAM + 1, F.lit(1)))
        return F.array_distinct(F.transform(places, lambda i: F.substr(of, i, F.lit(GRAM))))

    parts = keywords.select("keyword", F.explode(grams("keyword")).alias("_gram"))
    seen = rows.select("message_id", F.explode(grams("_t")).alias("_gram")).join(
        parts.select("_gram").distinct(), "_gram", "left_semi")
    often = seen.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = (parts.join(often, "_gram", "left").groupBy("keyword")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("r"))
              .where("r.n > 0").select("keyword", F.col("r.gram").alias("_gram")))
    asked = seen.join(rarest, "_gram").groupBy("message_id").agg(F.collect_set("keyword").alias("_asked"))
    held = asked.join(rows, "message_id").select(
        "message_id", F.explode(F.filter("_asked", lambda k: F.contains("_t", k))).alias("keyword"))
    return held.distinct()


def mentioned_mentor(messages: DataFrame, recommendations: DataFrame, text: str = "text") -> DataFrame:
    """The recommended mentor a message speaks of: full name, part of a name, or an ordinal.

    ``recommendations`` is (message_id, rank, mentor_id, mentor_name), rank from 1.
    """
    message = F.lower(F.trim(F.col(text)))
    name = F.lower(F.coalesce("mentor_name", F.lit("")))
    parts = F.filter(F.split(name, r"\s+"), lambda p: F.length(p) >= 2)
    ordinal = None
    for rank, words in lexicon.ORDINALS.items():
        cond = (F.col("rank") == rank) & any_of(message, words)
        ordinal = cond if ordinal is None else ordinal | cond
    way = (F.when((name != "") & message.contains(name), 1)
           .when(F.exists(parts, lambda p: F.contains(message, p)), 2).when(ordinal, 3))
    rows = messages.where(message != "").join(recommendations, "message_id").withColumn("way", way).where("way IS NOT NULL")
    return grouped_topk(rows, ["message_id"], [F.col("way"), F.col("rank")], 1).select(
        "message_id", "mentor_id", "mentor_name", "rank", "way")
