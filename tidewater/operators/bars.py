"""Price bars from points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(points: DataFrame, series: list[str], time: str, value: str, tie: str) -> DataFrame:
    """Open, high, low, close and count of each series and day; ``tie`` orders points of equal time."""
    at = F.struct(time, tie)
    return points.groupBy(*series, F.to_date(time).alias("day")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(value).alias("n")
    )
