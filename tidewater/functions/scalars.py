"""Scalar functions of the feeds and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(c: Column) -> Column:
    """Text to bigint, cut toward zero; NULL where the text is no finite number."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number).try_cast("bigint")


def decimal_number(c: Column) -> Column:
    return c.try_cast("double")


def day_of(c: Column) -> Column:
    """``dd/MM/yyyy`` to a timestamp at midnight; NULL where the text is no such day."""
    return F.try_to_timestamp(c, F.lit("dd/MM/yyyy"))


def day_text(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def iso_to_day_text(c: Column) -> Column:
    return F.date_format(F.to_date(c, "yyyy-MM-dd"), "dd/MM/yyyy")


def utc_text(c: Column, zone: str) -> Column:
    """A local time of ``zone`` as UTC text that ends in Z."""
    return F.date_format(F.to_utc_timestamp(c, zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window_end(start: Column, days: int = 30) -> Column:
    return start + F.make_interval(days=F.lit(days))


def windows(start: str, now: str, days: int = 30) -> Column:
    """Array of window starts from ``start`` while before ``now``."""
    first, end = F.lit(start).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")
    return F.filter(F.sequence(first, end, F.expr(f"interval {days} days")), lambda x: x < end)


def to_second(c: Column) -> Column:
    return F.date_trunc("second", c)


def now_to_second() -> Column:
    return to_second(F.current_timestamp())


def rounded(c: Column, digits: int) -> Column:
    """A double to so many decimals as SQL's doubles round: times a power of ten, to the nearest whole number, divided again.

    ``F.round`` takes a double by its decimal text, where other doubles stand halfway between two results.
    """
    made = F.round(c * 10.0**digits, 0) / 10.0**digits
    return F.when(F.abs(made) == float("inf"), c).otherwise(made)


def pages(rows: Column, size: int) -> Column:
    """Number of pages of ``size`` rows."""
    return F.ceil(rows / size).cast("bigint")


def label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code, upper-cased first; NULL for an unknown code."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.upper(c))


def string_map(columns: list[str]) -> Column:
    """Map of column name to its value as text."""
    return F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))


def number_map(columns: list[str]) -> Column:
    return F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))


def map_value(c: Column, key: str) -> Column:
    """NULL for a missing key."""
    return F.element_at(c, F.lit(key))
