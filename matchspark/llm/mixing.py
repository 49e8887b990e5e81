"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, targets follow from the weights and a cap, and every document is taken
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.

Null texts have size 0; a null source is a source of its own, last in order. Sources without words
have target 0 and keep no copy. Repeated rows and ids share their draw. Results are the same on
every run.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchspark.llm.common import materialize, unit_hash

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: one row per source.

    Sources in order of code points take the weights in turn and share the sum of all sizes. A target
    stops at ``cap`` times its source's size and the excess is shared anew by weight. The sources
    that stop are the first ones by cap over weight, so running sums find them in one pass over the
    table of sources, which has one row per source however many documents there are.
    """
    if any(w < 1 for w in weights):
        raise ValueError("weights must be positive whole numbers")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # byte order of UTF-8 is the order of code points
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    common = lcm(*weights)  # cap over weight, compared in whole numbers
    by_cap = Window.orderBy((F.col("cap") * (F.lit(common) / F.col("w")).cast("long")), F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    stops = per.select("source", "source_size", weight.cast("long").alias("w"),
                       (F.col("source_size") * cap).alias("cap")).select(
        "*", left.alias("left"), F.sum("w").over(onward).alias("w_left"))
    stops = stops.withColumn("stopped", F.col("left") * F.col("w") > F.col("cap") * F.col("w_left"))
    rest = lambda c: F.max(F.when(~F.col("stopped"), F.col(c))).over(everything)
    shared = (F.col("w") * rest("left")).cast("double") / rest("w_left").cast("double")
    return stops.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).when(
        F.col("stopped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` as a struct ``__row`` with size, source_size, target and copies."""
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"),
                        n_words(docs[text_col].cast("string")).alias("size"))
    per_source = docs.select(docs[source_col].alias("source"), n_words(docs[text_col].cast("string")).alias("size"))
    # written first: its file size tells Spark whether it may be sent to all executors
    targets = materialize(source_targets(per_source, weights, cap), "targets")
    met = sized.join(targets, F.col(f"__row.`{source_col}`").eqNullSafe(targets["source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    draw = unit_hash(F.lit(seed), F.coalesce(F.col(f"__row.`{id_col}`").cast("string"), F.lit("")))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return met.withColumn("rate", rate).select("__row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, every document as often as it is taken."""
    taken = mixture(docs, **options).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
