"""What leaves the comparison of blocks, and which mentees read posting lists of programs."""

import numpy as np
from pyspark.sql import functions as F

from matchspark.functions.numbers import finite, finite_or_zero
from matchspark.operators import blockscores
from matchspark.plans import programs


def test_only_the_best_over_all_blocks_are_joined(spark, monkeypatch):
    """a left row took its k best of every block along, as many times k as there are blocks."""
    monkeypatch.setattr(blockscores, "RIGHT_ROWS", 10)
    left = spark.range(7).select(F.col("id").alias("l"), F.array(F.lit(1).cast("long")).alias("m"))
    right = spark.range(60).select(F.col("id").alias("r"), F.array(F.lit(1).cast("long")).alias("n"), (F.col("id") * 37 % 60).cast("double").alias("w"))
    pairs = blockscores.best_in_blocks(
        left.union(left.where("l = 3")), right, left_id="l", right_id="r", maps={"t": ("m", "n", 1)}, right_numbers=["w"], k=3, ties=[("r", True)],
        score=lambda mine, theirs, shared: theirs["w"] * np.minimum(shared["t"], 1))
    best = {r for r in range(60) if r * 37 % 60 >= 57}
    assert sorted(map(tuple, pairs.collect())) == sorted((i, r) for i in range(7) for r in best)


def test_posting_lists_are_read_without_enough_exact_matches_only(spark, monkeypatch):
    """lists were ranked for every kind of mentee although exact matches had settled what they can reach."""
    read = []
    plain = programs.posting_candidates
    monkeypatch.setattr(programs, "posting_candidates", lambda few, *a, **k: read.append(few.select("mentee_id").distinct()) or plain(few, *a, **k))
    posts = [(i, 1, 1, 1, 5, 9, 1 + (i > 9), 1, {i % 4: 1, 5: 2}, [i % 4, 5], 2, 0.1 * i, 1.0, 9, 0) for i in range(12)]
    out = programs.mentee_program_candidates(
        spark.createDataFrame([(i, 1 + i % 3, "1") for i in range(6)], "mentee_id long, experience_level_num int, education_status string"),
        spark.createDataFrame(
            posts, "post_id long, mentor_id long, is_open int, is_available int, spots_left int, capacity int, target_level_num int, "
            "required_education_num int, requirement_level_map map<bigint,int>, requirement_set array<bigint>, required_skill_count int, "
            "program_popularity_log double, program_difficulty_score double, days_until_deadline int, deadline_passed int"),
        spark.createDataFrame([(i, t, "2") for i in range(6) for t in (i % 4, 5)], "mentee_id long, technology_id long, experience_level string"), 4)
    assert sorted(r[0] for r in read[0].collect()) == [1, 2, 4, 5]  # levels 2 (two programs) and 3 (none)
    assert out.groupBy("mentee_id").count().where("count = 4").count() == 6


def test_finite_numbers_are_short_expressions(spark):
    """rows of two dozen features made methods that the JVM does not compile, as each stood in them four times."""
    seen = finite_or_zero(F.col("x"))
    assert str(seen).count("(x") + str(seen).count(" x") <= 2
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (-0.0,), (1.5,), (-1e308,)], "x double")
    assert [r[0] for r in df.select(seen).collect()] == [0.0, 0.0, 0.0, 0.0, 0.0, 1.5, -1e308]
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [None, None, None, None, 0.0, 1.5, -1e308]
    assert [r[0] for r in spark.createDataFrame([("2",), (None,)], "x string").select(finite_or_zero(F.col("x"))).collect()] == [2.0, 0.0]
