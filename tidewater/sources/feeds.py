"""Landed feed pages: read, explode, cast, and split off what can't be cast."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import day_of, decimal_number, whole_number
from . import schemas


def read_pages(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """All pages of a feed, with its fixed schema."""
    return spark.read.schema(schemas.envelope(feed)).json(path)


def parse_pages(df: DataFrame, column: str, feed: str) -> DataFrame:
    """Pages held as JSON text in a column."""
    return df.select(F.from_json(column, schemas.envelope(feed)).alias("_page")).select("_page.*")


def items(pages: DataFrame, feed: str) -> DataFrame:
    """One row an item, of nested feeds one row an inner item with the outer fields; empty pages give none."""
    rows = pages.select(F.explode("data").alias("item")).select("item.*")
    inner = schemas.NESTED.get(feed)
    return rows.withColumn(inner, F.explode(inner)).select(*(c for c in rows.columns if c != inner), f"{inner}.*") if inner else rows


def typed(rows: DataFrame, feed: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows as text with a ``faults`` array of the fields that don't parse).

    Whole numbers are cut toward zero, days are dd/MM/yyyy; an absent value is NULL and no fault.
    """
    casts = [(schemas.WHOLE, whole_number), (schemas.DECIMAL, decimal_number), (schemas.DAYS, day_of)]
    to = {c: cast for table, cast in casts for c in table.get(feed, ())}
    bad = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & cast(F.col(c)).isNull(), F.lit(c)) for c, cast in to.items()))) if to else F.array().cast("array<string>")
    marked = rows.withColumn("faults", bad)
    good = marked.where("size(faults) = 0").drop("faults")
    return good.select(*(to[c](F.col(c)).alias(c) if c in to else F.col(c) for c in good.columns)), marked.where("size(faults) > 0")


def required(rows: DataFrame, feed: str) -> DataFrame:
    """The rows of a feed that must not be empty."""
    if not rows.take(1):
        raise ValueError(f"the {feed} feed is empty")
    return rows


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def price_points(prices: DataFrame, measurement: str = "daily_prices") -> DataFrame:
    """Daily prices as points: measurement, symbol, time (the trading day) and the fields in snake case."""
    return prices.select(F.lit(measurement).alias("measurement"), F.col("Symbol").alias("symbol"), F.col("TradingDate").alias("time"), *(F.col(f).alias(snake(f)) for f in schemas.PRICE_FIELDS))


def staged_securities(rows: DataFrame, markets: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(staging rows with the market's key, rejected rows): markets match in upper case, aliases included."""
    code = F.upper("Market")
    code = reduce(lambda c, kv: F.when(code == kv[0], F.lit(kv[1])).otherwise(c), schemas.MARKET_ALIASES.items(), code)
    keys = markets.select(F.col("Symbol").alias("_market"), F.col("ID").alias("Market_ID"))
    found = rows.withColumn("_code", code).join(keys, F.col("_code") == F.col("_market"), "left")
    staged = found.where("Market_ID is not null").select("Symbol", F.col("StockName").alias("Name"), F.col("StockEnName").alias("EnName"), "Market_ID", now.alias("CreateDate"))
    return staged, found.where("Market_ID is null").select(rows.columns)
