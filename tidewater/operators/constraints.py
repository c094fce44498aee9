"""Constraints that Spark does not enforce, as splits and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, not_null: list[str] = (), lengths: dict[str, int] | None = None) -> Column:
    """Array of the names of the constraints that a row breaks."""
    tests = [(f"{c} is null", F.col(c).isNull()) for c in not_null] + [(f"{c} is longer than {n}", F.length(c) > n) for c, n in (lengths or {}).items()]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests))) if tests else F.array().cast("array<string>")


def split_valid(df: DataFrame, not_null: list[str] = (), lengths: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with a ``violations`` array)."""
    marked = df.withColumn("violations", violations(df, not_null, lengths))
    return marked.where("size(violations) = 0").drop("violations"), marked.where("size(violations) > 0")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key has no parent; a NULL key refers to nothing and is no orphan."""
    keys = parent.select(F.col(key).alias("_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def report(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(test, n): rows that meet each condition, in one pass; unknown doesn't count."""
    counted = df.agg(*(F.count_if(test).alias(f"_t{i}") for i, test in enumerate(tests.values())))
    rows = F.array(*(F.struct(F.lit(name).alias("test"), F.col(f"_t{i}").alias("n")) for i, name in enumerate(tests)))
    return counted.select(F.inline(rows))


def price_faults() -> dict[str, Column]:
    """What a daily price row must not be."""
    c = F.col
    return {"high below low": c("highest_price") < c("lowest_price"), "close outside": ~c("close_price").between(c("lowest_price"), c("highest_price")), "open outside": ~c("open_price").between(c("lowest_price"), c("highest_price"))}


def any_violation(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    return df.where(F.coalesce(reduce(lambda a, b: a | b, tests.values()), F.lit(False)))
