"""Projection, joins, order, paging and set checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def select(df: DataFrame, columns: list[str] | None = None, condition: Column | None = None, order: list[Column | str] | None = None, limit: int | None = None) -> DataFrame:
    """Columns (all by default) of the rows that meet a condition, at most ``limit`` of them in an order.

    A limit without an order raises, as the rows would be arbitrary; 0 gives none; a negative one raises.
    """
    if limit is not None and (limit < 0 or not order):
        raise ValueError("a limit must not be negative and needs an order")
    df = df if condition is None else df.where(condition)
    df = df.orderBy(*order) if order else df
    df = df if limit is None else df.limit(limit)
    return df.select(*columns) if columns else df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns only, under their new names."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def key_first(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *(c for c in df.columns if c != key))


@dataclass(frozen=True)
class Step:
    """A join of a chain: kind, table, and its key beside a column of what is joined so far."""

    kind: str
    table: DataFrame
    left: str | None = None
    right: str | None = None


def join(left: DataFrame, right: DataFrame, kind: str, on_left: str | None = None, on_right: str | None = None) -> DataFrame:
    """Equi join of one column each; a cross join has none. Column names must not clash but for cross keys."""
    if kind not in JOINS:
        raise ValueError(f"unknown join: {kind}")
    if kind == "cross":
        if on_left or on_right:
            raise ValueError("a cross join has no key")
        return left.crossJoin(right)
    return left.join(right, left[on_left] == right[on_right], JOINS[kind])


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that Spark deals anew on both sides, so that it can split a hot key's partition of the left one."""
    again = F.pmod(F.hash(*keys), F.lit(1024)).alias("_again")
    return left.select("*", again).join(right.select("*", again), [*keys, "_again"], how).drop("_again")


def join_chain(first: DataFrame, steps: list[Step]) -> DataFrame:
    """Joins from left to right; Spark orders and plans them."""
    for s in steps:
        first = join(first, s.table, s.kind, s.left, s.right)
    return first


def lookup(df: DataFrame, code: str, table: DataFrame, table_code: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the dimension's key, rejected rows). Codes match in upper case; unknown and NULL codes are rejected.

    ``table`` is a dimension with one row a code; Spark broadcasts it where its size allows.
    """
    found = df.join(table.select(F.upper(table_code).alias("_code"), F.col(key)), F.upper(code) == F.col("_code"), "left").drop("_code")
    return found.where(F.col(key).isNotNull()), found.where(F.col(key).isNull()).drop(key)


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number``, from 1, of ``size`` rows in a total order; keeps only the rows up to it while sorting."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, order: list[str], last: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows in a total order after the one with the values ``last``; the first page with None.

    Rows up to there are filtered out, not sorted and skipped, so a deep page costs no more than the first.
    Columns of the order must not be NULL.
    """
    if last is not None:
        df = df.where(F.struct(*order) > F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True))))
    return df.orderBy(*order).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.ceil(F.count(F.lit(1)) / size).cast("long").alias("n_pages"))


def set_difference(values: DataFrame, column: str, expected: DataFrame, expected_column: str) -> DataFrame:
    """(value, side) of what only one of two sets has; no rows mean that they are equal."""
    a, b = (x.select(F.col(c).alias("value")).distinct() for x, c in ((values, column), (expected, expected_column)))
    return a.exceptAll(b).withColumn("side", F.lit("actual")).unionByName(b.exceptAll(a).withColumn("side", F.lit("expected")))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def append(pages: list[DataFrame]) -> DataFrame:
    """Rows of all pages, columns matched by name."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out
