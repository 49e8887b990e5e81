"""Dates: lenient parsing, day arithmetic, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_time(c: Column) -> Column:
    """Text to a timestamp; ``dd/MM/yyyy`` when slashes occur, ISO otherwise, bad text null."""
    text = F.trim(c.cast("string"))
    iso = text.try_cast("timestamp")
    day_first = F.coalesce(
        F.try_to_timestamp(text, F.lit("d/M/yyyy")),
        F.try_to_timestamp(text, F.lit("d/M/yyyy H:m:s")),
        F.try_to_timestamp(text, F.lit("d/M/yyyy H:m")))
    return F.when(text.contains("/"), day_first).otherwise(iso)


def day(c: Column) -> Column:
    return F.date_trunc("day", c.cast("timestamp"))


def add_days(c: Column, n: int) -> Column:
    return c + F.expr(f"INTERVAL {n} DAYS")


def days_until(deadline: Column, reference: Column, missing: int = -999) -> Column:
    """Whole days from ``reference`` to ``deadline``, rounded down; no deadline gives ``missing``."""
    seconds = F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(reference.cast("timestamp"))
    return F.coalesce(F.floor(seconds / 86_400_000_000), F.lit(missing)).cast("int")


def deadline_passed(deadline: Column, reference: Column) -> Column:
    return F.when(deadline.cast("timestamp") <= reference.cast("timestamp"), 1).otherwise(0)
