"""Bitmap matching against brute force, checked loads and folder reading with malformed lines."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from matchspark.operators import bitmaps
from matchspark.plans import chat, mentor_flow
from matchspark.plans.skill_match import top_skill_matches
from matchspark.sources import artifacts, tables

rng = random.Random(12)


def people(n, first, sizes, skills):
    return {first + i: set(rng.sample(range(skills), rng.choice(sizes))) for i in range(n)}


@pytest.mark.parametrize("sizes, skills, rows_in_a_block", [([1, 2, 3], 40, 8), ([60, 70, 80, 90], 100, 4), ([1, 30, 130], 140, 16)])
def test_best_matches_equal_brute_force(spark, monkeypatch, sizes, skills, rows_in_a_block):
    monkeypatch.setattr(bitmaps.placed_in_blocks, "__defaults__", (rows_in_a_block,))
    left, right = people(40, 0, sizes, skills), people(70, 1000, sizes, skills)
    left[900] = {10_000}  # a skill that nobody offers
    right[1900] = right[1003]  # copies tie, the lower id wins
    frame = lambda side, key: spark.createDataFrame([(p, t) for p, s in side.items() for t in s], f"{key} long, token long")
    want = []
    for p, s in left.items():
        found = sorted((-len(s & r) / len(s | r), -len(s & r) / len(s), m) for m, r in right.items() if s & r)
        want += [(p, m, len(s & right[m]), i + 1) for i, (_, _, m) in enumerate(found[:5])]
    got = top_skill_matches(frame(left, "mentee_id"), frame(right, "mentor_id"), "mentee_id", "mentor_id", "token", 5)
    assert rows(got.select("mentee_id", "mentor_id", "overlap", "rank")) == sorted(want)
    none = frame(right, "mentor_id").limit(0)
    assert top_skill_matches(frame(left, "mentee_id"), none, "mentee_id", "mentor_id", "token", 5).count() == 0


def test_a_failing_load_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert artifacts.refresh_table(spark.range(5), path) == 5
    with pytest.raises(Exception):
        artifacts.refresh_table(spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id")), path)
    assert rows(spark.read.parquet(path)) == [(i,) for i in range(5)]
    assert artifacts.refresh_table(spark.read.parquet(path).where("id > 2"), path) == 2  # it may read what it replaces
    assert rows(spark.read.parquet(path)) == [(3,), (4,)]
    assert artifacts.refresh_table(spark.range(0), path) == 0
    assert sorted(r["rows"] for r in artifacts.table_versions(spark, path).collect()) == [0, 2, 5]
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["t", "t.versions"]


def test_malformed_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a;b;c\n1;2;3\n4\n5;6;7;8\n"x;y";;"two\nlines"\n', encoding="utf-8")
    good, bad = tables.read_checked_table(spark, str(tmp_path / "x.csv"))
    (tmp_path / "clean.csv").write_text('a;b;c\n1;2;3\n"x;y";;"two\nlines"\n', encoding="utf-8")
    assert rows(good) == rows(tables.read_text_table(spark, str(tmp_path / "clean.csv"), ";")) and good.count() == 2
    assert rows(bad.select("record", "reason")) == [("4", "too few fields"), ("5;6;7;8", "too many fields")]
    assert good.select("c").count() == 2 and bad.first()["file"].endswith("x.csv")


def test_keywords_meet_messages_on_their_rarest_gram(spark):
    messages = spark.createDataFrame([(i, "common start of a message " + "z" * (i % 3)) for i in range(30)] + [
        (40, "how is commonality found"), (41, ""), (42, "abc"), (43, None)], "message_id long, text string")
    faq = spark.createDataFrame([(1, "commonality"), (1, "commonality"), (2, "COMMON"), (3, "abc"), (4, "nowhere")], "entry_id long, keyword string")
    got = {r["message_id"]: (r["entry_id"], r["score"]) for r in chat.match_faq(messages, faq).collect()}
    assert got[40] == (1, 11) and got[0] == (2, 6) and got[41] == got[42] == got[43] == (None, None)


def test_tables_that_the_mentor_flow_reads_again_are_written_once(spark):
    """Whatever a table is made from, later plans hold one scan of it: their size is what fills the driver."""
    n = 5
    profile = spark.range(n).withColumnRenamed("id", "user_id").join(spark.range(3).withColumnRenamed("id", "user_id"), "user_id", "left")
    out = mentor_flow.written({"mentor_profile": profile, "other": profile}, mentor_flow.READ_AGAIN)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out["mentor_profile"]) == [(i,) for i in range(n)]
    assert "Join" in plan(out["other"]) and len(plan(out["mentor_profile"]).strip().split("\n")) == 1
    assert {"mentorship_posts", "mentorships", "follows"} <= set(mentor_flow.RAW_READ_AGAIN)
