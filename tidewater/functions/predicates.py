"""Predicates as columns, and the predicates that compare with a table."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {"=": eq, "<>": ne, ">": gt, "<": lt, ">=": ge, "<=": le}
UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def predicate(column: str, operator: str, value=None) -> Column:
    """One condition. ``value``: a literal, a list for (NOT) IN, a pair for BETWEEN, a pattern or patterns for LIKE, nothing for IS (NOT) NULL.

    NULL follows SQL's three-valued logic. An unknown operator raises: a condition that is dropped
    would widen a delete to the whole table.
    """
    c, name = F.col(column), operator.upper().strip()
    if name in COMPARISONS:
        return COMPARISONS[name](c, value if isinstance(value, Column) else F.lit(value))
    if name == "IN":
        return c.isin(list(value))
    if name == "NOT IN":
        return ~c.isin(list(value))
    if name == "LIKE":
        return c.like(value) if isinstance(value, str) else any_of(*(c.like(p) for p in value))
    if name == "BETWEEN":
        low, high = value
        return c.between(low, high)
    if name == "IS NULL":
        return c.isNull()
    if name == "IS NOT NULL":
        return c.isNotNull()
    raise ValueError(f"unknown operator: {operator}")


def all_of(*conditions: Column) -> Column:
    """Conjunction; none at all is true."""
    return reduce(and_, conditions, F.lit(True)) if conditions else F.lit(True)


def any_of(*conditions: Column) -> Column:
    """Disjunction; none at all is false."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def where_all(df: DataFrame, conditions: Column | Iterable[Column] | None = None) -> DataFrame:
    """Rows for which every condition holds; no conditions keep all rows, and a single one need not be a list."""
    if conditions is None:
        return df
    return df.where(all_of(*([conditions] if isinstance(conditions, Column) else conditions)))


def _summary(values: DataFrame, column: str) -> DataFrame:
    """One row that tells all that a quantified comparison needs of a set of any size."""
    c = F.col(column)
    return values.agg(F.min(c).alias("_low"), F.max(c).alias("_high"), F.count(F.lit(1)).alias("_rows"), F.count(c).alias("_known"))


def compare_any(df: DataFrame, column: str, operator: str, values: DataFrame, value_column: str) -> DataFrame:
    """Rows with ``column operator ANY (values)``; SOME is the same. An empty set gives no rows."""
    c, low, high = F.col(column), F.col("_low"), F.col("_high")
    if operator == "=":
        return df.join(values.select(F.col(value_column).alias("_v")).distinct(), c == F.col("_v"), "left_semi")
    tests = {">": c > low, ">=": c >= low, "<": c < high, "<=": c <= high, "<>": (c != low) | (c != high)}
    return df.crossJoin(F.broadcast(_summary(values, value_column))).where(tests[operator]).select(df.columns)


def compare_all(df: DataFrame, column: str, operator: str, values: DataFrame, value_column: str) -> DataFrame:
    """Rows with ``column operator ALL (values)``: all rows for an empty set, none where the set has a NULL."""
    c, low, high = F.col(column), F.col("_low"), F.col("_high")
    if operator == "<>":
        return not_in_table(df, column, values, value_column)
    tests = {">": c > high, ">=": c >= high, "<": c < low, "<=": c <= low, "=": (c == low) & (c == high)}
    whole = F.col("_rows") == F.col("_known")
    return df.crossJoin(F.broadcast(_summary(values, value_column))).where((F.col("_rows") == 0) | (whole & tests[operator])).select(df.columns)


def in_table(df: DataFrame, column: str, values: DataFrame, value_column: str) -> DataFrame:
    return compare_any(df, column, "=", values, value_column)


def not_in_table(df: DataFrame, column: str, values: DataFrame, value_column: str) -> DataFrame:
    """Null-aware NOT IN: an empty set keeps every row; a NULL in the set keeps none; a NULL value is not kept."""
    state = F.broadcast(_summary(values, value_column).select("_rows", "_known"))
    known = values.select(F.col(value_column).alias("_v")).where("_v is not null").distinct()
    missing = df.join(known, F.col(column) == F.col("_v"), "left_anti")
    keeps = (F.col("_rows") == 0) | ((F.col("_rows") == F.col("_known")) & F.col(column).isNotNull())
    return missing.crossJoin(state).where(keeps).select(df.columns)


def in_range(column: str, start: datetime | str, end: datetime | str | None = None) -> Column:
    """start <= time < end; no end leaves the range open."""
    c = F.col(column)
    return c >= F.lit(start).cast("timestamp_ntz") if end is None else (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))


def since(column: str, amount: int, unit: str, now: datetime | str) -> Column:
    """time >= now - amount; the sign of the amount is not regarded. ``now`` is an argument, so that a query can be repeated."""
    return F.col(column) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {abs(int(amount))} {UNITS[unit]}")


def dates_between(column: str, first: str, last: str) -> Column:
    """Both days included."""
    return F.to_date(column).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def active(column: str = "DelistDate") -> Column:
    return F.col(column).isNull()
