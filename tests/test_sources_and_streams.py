"""CSV folders, artifacts and streaming feeds end to end in temporary folders."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from matchspark.operators import ranker
from matchspark.schemas import TABLES, plain
from matchspark.session import cut_lineage, materialize
from matchspark.sources import artifacts, tables
from matchspark.streaming import feeds


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def export(folder, skip=()):
    """A minimal export with PascalCase headers."""
    for name, spec in TABLES.items():
        if spec.critical and name not in skip:
            header = ",".join("".join(p.capitalize() for p in spec.source_names(c)[-1].split("_")) if "_" in spec.source_names(c)[-1]
                              else spec.source_names(c)[-1] for c in spec.columns)
            write(folder, spec.files[0], header + "\n" + ",".join("1" for _ in spec.columns) + "\n")


def test_reads_folder_and_names(spark, tmp_path):
    export(tmp_path)
    write(tmp_path, "community_post_likes.csv", "LikeId,UserId,CreatedAt\n1,7,2020-01-02\n")
    write(tmp_path, "mentorship_post_likes.csv", "LikeId,UserId,ProgramId,CreatedAt\n2,8,5,31/01/2020\n")
    got = tables.read_tables(spark, str(tmp_path))
    likes = got["posts_likes_dataset"]
    assert [(r.like_id, r.user_id, r.post_id, str(r.created_at)[:10]) for r in likes.orderBy("like_id").collect()] == [
        (1, 7, None, "2020-01-02"), (2, 8, 5, "2020-01-31")]
    assert set(TABLES["mentorship_posts"].columns) <= set(got["mentorship_posts"].columns)
    assert got["mentee_interests"].first().mentee_id == 1
    assert "users" not in got


def test_missing_critical_table_raises(spark, tmp_path):
    export(tmp_path, skip=("mentor_expertise",))
    with pytest.raises(FileNotFoundError):
        tables.read_tables(spark, str(tmp_path))


def test_separator_is_sniffed(spark, tmp_path):
    write(tmp_path, "x.csv", "a;b\n1;2\n")
    assert tables.sniff_separator(spark, str(tmp_path / "x.csv")) == ";"
    assert tables.read_text_table(spark, str(tmp_path / "x.csv"), ";").first().asDict() == {"a": "1", "b": "2"}
    assert plain("Mentor_Profile Id") == "mentorprofileid"


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "m")
    artifacts.save_manifest(spark, {"a": [1, 2], "b": "x"}, path)
    assert artifacts.load_manifest(spark, path) == {"a": [1, 2], "b": "x"}
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, time_split string")
    artifacts.save_table(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "time_split=train").exists()
    assert rows(artifacts.load_table(spark, str(tmp_path / "t")).select("id", "time_split")) == [(1, "train"), (2, "test")]
    data = spark.createDataFrame([(m, i, int(i == 0), float(i == 0)) for m in range(5) for i in range(4)],
                                 "mentee_id long, mentor_id long, label int, skill_coverage_score double")
    model = ranker.fit(data, ["skill_coverage_score"])
    artifacts.save_model(model, str(tmp_path / "model"))
    assert list(artifacts.load_model(str(tmp_path / "model")).coefficients) == list(model.coefficients)


def test_stage_tables(spark):
    df = spark.range(10)
    assert cut_lineage(df).count() == materialize(df).count() == 10


def test_engagement_stream_counts_once(spark, tmp_path):
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "kind string, user_id long, post_id long, score int, event_time timestamp"
    posts = spark.createDataFrame([(1, 100), (2, 200)], "post_id long, mentor_id long")

    def feed(data):
        spark.createDataFrame(data, "kind string, user_id long, post_id long, score int, t string").withColumn(
            "event_time", F.col("t").cast("timestamp")).drop("t").write.mode("append").parquet(source)

    def step():
        stream = spark.readStream.schema(schema).parquet(source)
        feeds.stream_engagement(stream, posts, out, ck).awaitTermination(120)

    feed([("like", 1, 1, 1, "2020-01-01 00:00:00"), ("like", 1, 1, 1, "2020-01-01 00:05:00"), ("save", 1, 1, 3, "2020-01-01 00:06:00")])
    step()
    feed([("like", 1, 1, 1, "2020-01-01 00:09:00"), ("share", 2, 2, 4, "2020-01-01 00:10:00")])
    step()
    got = rows(feeds.engagement_totals(spark, out).select("user_id", "mentor_id", "interaction_score", "interaction_count"))
    assert got == [(1, 100, 4, 2), (2, 200, 4, 1)]


def test_daily_counts_and_shown_log(spark, tmp_path):
    source = str(tmp_path / "follows")
    spark.createDataFrame([(1, "2020-01-01 10:00:00"), (1, "2020-01-01 11:00:00"), (1, "2020-01-02 09:00:00"), (2, "2020-01-10 00:00:00")],
                          "mentor_id long, t string").select("mentor_id", F.col("t").cast("timestamp").alias("created_at")).write.parquet(source)
    stream = spark.readStream.schema("mentor_id long, created_at timestamp").parquet(source)
    feeds.stream_daily_counts(stream, "mentor_id", "created_at", str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination(120)
    got = [(r.mentor_id, str(r.day)[:10], r.n, r.total) for r in feeds.running_counts(spark, str(tmp_path / "d"), "mentor_id").orderBy("day").collect()]
    assert got == [(1, "2020-01-01", 2, 2), (1, "2020-01-02", 1, 3)]
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, s, s + 10) for s in range(5)], "mentee_id long, session long, mentor_id long").write.parquet(log)
    shown = spark.readStream.schema("mentee_id long, session long, mentor_id long").parquet(log)
    feeds.stream_shown(shown, str(tmp_path / "s"), str(tmp_path / "sc")).awaitTermination(120)
    assert {r.session for r in feeds.recently_shown(spark, str(tmp_path / "s")).collect()} == {2, 3, 4}


def test_all_days_come_out(spark, tmp_path):
    source = str(tmp_path / "follows")
    spark.createDataFrame([(1, "2020-01-01 10:00:00"), (1, "2020-01-02 09:00:00"), (2, "2020-01-10 00:00:00")], "mentor_id long, t string").select(
        "mentor_id", F.col("t").cast("timestamp").alias("created_at")).write.parquet(source)
    stream = spark.readStream.schema("mentor_id long, created_at timestamp").parquet(source)
    feeds.stream_all_days(stream, "mentor_id", "created_at", str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination(120)
    got = [(r.mentor_id, str(r.day)[:10], r.n, r.total) for r in feeds.running_counts(spark, str(tmp_path / "d"), "mentor_id").orderBy("day").collect()]
    assert got == [(1, "2020-01-01", 1, 1), (1, "2020-01-02", 1, 2), (2, "2020-01-10", 1, 1)]
