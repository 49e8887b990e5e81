"""The pipeline's stages, each on its own input, and the registered names."""

import __spark_entry__ as entry
import corpus_pipeline
from matchspark.llm import bpe, langid, mixing


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixture", "tokens"]
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages_take_effect(spark):
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    words = "the thing with other words that follow here and there in many lines of prose".split()
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 60)), "en", f"s{i % 2}", 0) for i in range(1, 30)]
    rows += [(50, rows[0][1], "en", "s0", 0), (51, None, "en", "s0", 0), (52, "12 34 !!", None, None, 0), (53, f"Some words {secret} here", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, docs, "").cache()
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} == {r[0] for r in rows} - {51, 52}
    single = stage["near_duplicates"](spark, known, "").cache()
    ids = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns and 1 in ids and 50 not in ids
    clean = {r["doc_id"]: r["text"] for r in stage["secrets"](spark, single, "").collect()}
    assert clean[53] == 'Some words token = "[SECRET]" here' and set(clean) == ids
    mixed = stage["mixture"](spark, single, "")
    want = {r["doc_id"]: r["copies"] for r in mixing.mixture(single).select("__row.doc_id", "copies").collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == want and mixed.columns == docs.columns
    tokens = stage["tokens"](spark, mixed, "")
    assert tokens.count() == mixed.count() and tokens.where("n_tokens <> size(ids)").count() == 0
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), "").count() == 0
    assert langid.UNKNOWN == "und" and bpe.REMEMBERED_PIECES > 0
