"""Market analytics over trades, daily prices and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intraday_bars(points: DataFrame, series: list[str], time: str, value: str, minutes: int, tie: str) -> DataFrame:
    """Open, high, low, close and count of each series and window of so many minutes."""
    at, w = F.struct(time, tie), F.window(time, f"{int(minutes)} minutes")
    bars = points.groupBy(*series, w.alias("_w")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(value).alias("n")
    )
    return bars.select(*series, F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "n")


def breadth(prices: DataFrame, group: list[str], close: str, reference: str, ceiling: str | None = None, floor: str | None = None) -> DataFrame:
    """Rows above, at and below the reference price, and at the ceiling and the floor, for each group."""
    c, r = F.col(close), F.col(reference)
    tests = {"advances": c > r, "no_changes": c == r, "declines": c < r}
    tests |= {"ceilings": c >= F.col(ceiling)} if ceiling else {}
    tests |= {"floors": c <= F.col(floor)} if floor else {}
    return prices.groupBy(*group).agg(*(F.count_if(t).alias(n) for n, t in tests.items()))


def index_totals(trades: DataFrame, group: list[str], matched: Column, volume: str, value: Column) -> DataFrame:
    """Matched, deal and total volume and value; a trade that is not matched is a deal."""
    part = lambda keep, x: F.coalesce(F.sum(F.when(keep, x)), F.lit(0.0))
    sums = {"match_vol": part(matched, F.col(volume)), "match_val": part(matched, value), "deal_vol": part(~matched, F.col(volume)), "deal_val": part(~matched, value)}
    out = trades.groupBy(*group).agg(*(x.alias(n) for n, x in sums.items()))
    return out.withColumns({"total_vol": F.col("match_vol") + F.col("deal_vol"), "total_val": F.col("match_val") + F.col("deal_val")})


def net_flow(trades: DataFrame, group: list[str], bought: Column, volume: str, value: str) -> DataFrame:
    """Bought less sold volume and value."""
    sign = F.when(bought, 1).otherwise(-1)
    return trades.groupBy(*group).agg(F.sum(sign * F.col(volume)).alias("net_vol"), F.sum(sign * F.col(value)).alias("net_val"))


def price_change(prices: DataFrame, close: str, reference: str) -> DataFrame:
    """Change and percent change against the reference; percent is NULL for a reference of 0."""
    change = F.col(close) - F.col(reference)
    return prices.withColumns({"price_change": change, "per_price_change": 100 * change / F.nullif(F.col(reference), F.lit(0.0))})


def market_cap(securities: DataFrame, prices: DataFrame, key: str, shares: str, close: str, order: list[str]) -> DataFrame:
    """Shares times the last close, as decimals, since the product may exceed a bigint; NULL without a price."""
    last = prices.groupBy(key).agg(F.max_by(close, F.struct(*order)).alias("last_close"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    return securities.join(last, key, "left").withColumn("market_cap", whole(shares) * whole("last_close"))


def per_market(securities: DataFrame, market: str, markets: DataFrame, key: str, name: str, delisted: Column) -> DataFrame:
    """Active and delisted securities of each market, those without any included."""
    counted = securities.groupBy(market).agg(F.count_if(~delisted).alias("n_active"), F.count_if(delisted).alias("n_delisted"))
    joined = markets.join(counted, markets[key] == counted[market], "left")
    return joined.select(name, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_active", "n_delisted")))


def fill_details(securities: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Securities with the details' values where there are any; one detail a key, the largest where it repeats."""
    best = details.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*columns)).alias("_d"))
    joined = securities.join(best, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce(F.col(f"_d.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in securities.columns))
