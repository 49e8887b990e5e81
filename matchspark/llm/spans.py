"""Matches of a pattern with their places, as DataFrame expressions.

A text split at a pattern and the list of its matches alternate, so running sums of their lengths give
every match's place in code points. Patterns use possessive repeats: they never go back over a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BLOCK = 256
#: Most characters of a text's neighbourhood that a candidate carries.
NEAR = 48


def running_sums(numbers: Column) -> Column:
    """[0, a, a + b, ...] without the total, in blocks, so that long lists stay near linear."""
    zero = F.array(F.lit(0).cast("long"))
    append = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(numbers) / _BLOCK).cast("int") - 1, F.lit(0)))
    blocks = F.transform(starts, lambda b: F.aggregate(F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)), zero, append))
    return F.flatten(F.transform(
        F.zip_with(blocks, F.slice(F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), zero, append),
                                   F.lit(1), F.size(blocks)), lambda b, s: F.struct(b.alias("b"), s.alias("s"))),
        lambda z: F.transform(F.slice(z["b"], F.lit(1), F.greatest(F.size(z["b"]) - 1, F.lit(0))), lambda x: x + z["s"])))


def with_matches(df, name: str, text: str, pattern: str):
    """Adds ``name``: array of (start, end, value) of the leftmost non-overlapping matches in ``text``."""
    found, gaps, sizes, sums = (f"__{name}_{x}" for x in ("found", "gaps", "sizes", "sums"))
    has = F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumn(f"__{name}_has", has)
    df = df.withColumn(found, F.when(F.col(f"__{name}_has"), F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none))
    df = df.withColumn(gaps, F.when(F.col(f"__{name}_has"), F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(sizes, F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (
        F.length(g) + F.length(m)).cast("long")))
    df = df.withColumn(sums, running_sums(F.col(sizes)))
    spans = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.col(found).alias("m"),
                                     F.slice(sums, F.lit(1), F.size(found)).alias("s")),
                        lambda z: F.struct((z["s"] + F.length(z["g"])).cast("long").alias("start"),
                                           (z["s"] + F.length(z["g"]) + F.length(z["m"])).cast("long").alias("end"),
                                           z["m"].alias("value")))
    kept = [c for c in df.columns if not c.startswith(f"__{name}_")]
    # a text without a match needs none of the above
    empty = F.array().cast("array<struct<start: bigint, end: bigint, value: string>>")
    return df.select(*kept, F.when(F.col(f"__{name}_has"), spans).otherwise(empty).alias(name))


def neighbourhood(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The characters before and after a span."""
    left = F.substring(text, (F.greatest(start - NEAR, F.lit(0)) + 1).cast("int"), F.least(start, F.lit(NEAR)).cast("int"))
    return left, F.substring(text, (end + 1).cast("int"), F.lit(NEAR))


def rewritten(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with each span (start, end, ...) replaced; spans ascend and don't overlap."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                     mark(s)).alias("out"), s["end"].cast("long").alias("at")))
    rest = F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], rest))


def without_overlap(spans: Column) -> Column:
    """Spans by start, then the longer first, without those that overlap an earlier one."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int"))
                           .otherwise(F.signum(b["end"] - a["end"]).cast("int")))
    return F.filter(ordered, lambda s, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda o: o["end"] > s["start"]))
