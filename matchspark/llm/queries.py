"""Registered queries of the operators in this folder and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchspark.llm import (bpe, crosstokens, fingerprint, langid, maintext, mixing, multiindex, pii, repeats, secrets, simhash,
                            tokencounts, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_multi_index_hashing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return multiindex.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query("op2_repeated_bytes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the byte strings of 400 that occur more than once."""
    width = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", width.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return maintext.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op4_edit_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, how alike they are, and the class of near texts."""
    return fingerprint.with_classes(table(spark, sf_dir, "documents"))


@query("op5_simhash_classes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every whole text and its near-duplicate class."""
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


@query("op6_secret_findings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding that the forest keeps: where it is and its share of votes."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # explode() would put size(findings) > 0 into the scan's filter, which is the whole forest once more
    each = found.select(F.col("__row.doc_id").alias("doc_id"), "__text", F.explode_outer("findings").alias("f"))
    return each.where(F.col("f").isNotNull()).select(
        "doc_id", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.kind").alias("kind"),
        F.round("f.score", 6).alias("score"),
        F.sha2(F.substring("__text", (F.col("f.start") + 1).cast("int"), (F.col("f.end") - F.col("f.start")).cast("int")), 256)
        .alias("secret_sha256"))


@query("op7_bpe_round_trip")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text and the bytes they decode to, as digests."""
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op8_source_mixing", oracle=r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
running AS (SELECT *,
    CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap * (10 // w), source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS room,
    CAST(sum(w) OVER (ORDER BY cap * (10 // w), source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM placed),
marked AS (SELECT *, room * w > cap * w_left AS stopped FROM running),
rest AS (SELECT max(room) AS room, max(w_left) AS w_left FROM marked WHERE NOT stopped),
targets AS (SELECT m.source, m.source_size, CASE WHEN m.source_size = 0 THEN 0.0::DOUBLE
    WHEN stopped THEN CAST(cap AS DOUBLE)
    ELSE CAST(w * rest.room AS DOUBLE) / CAST(rest.w_left AS DOUBLE) END AS target FROM marked m, rest),
rated AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rated""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of all sources takes."""
    return mixing.mixture(table(spark, sf_dir, "documents")).select(
        F.col("__row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        F.col("__row.doc_id").alias("doc_id"), "lang_pred", "score").select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base spans as counts and digest, all spans as a list."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select(F.col("__row.doc_id").alias("doc_id"), *counts,
                        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers over every whole text group and link."""
    return crosstokens.align(table(spark, sf_dir, "documents"))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, counted through a digest cache that starts empty."""
    counted = tokencounts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened coordinates of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
