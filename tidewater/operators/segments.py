"""Lags, running sums and places of long series, which are cut into pieces so that many tasks share one series.

Rows are dealt by ranges of (series, order) and written once with the number of their range. So a piece, the rows of one series in
one range, is a run of consecutive rows of that series with a bounded number of rows. Windows run inside pieces; what a piece needs of the earlier
ones (the row before it, what rose and how many rows there were) is carried over by a table of one row a piece.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stash
from .timeseries import micros, rate

#: Rows that a range is meant for.
ROWS = 1_000_000
_OWN = ["_s", "_piece"]


def cut(points: DataFrame, series: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """``points`` with ``_s``, the series, and ``_piece``, the number of the range, written once; ``pieces``: ranges, by default one for each ROWS rows.

    Rows with the same series and order stand in one range, so ties larger than a range are not cut; no table of
    different times has such. NULLs are a series of their own.
    """
    n = pieces or max(1, math.ceil(points.count() / ROWS))
    dealt = points.repartitionByRange(n, *series, *order).withColumn("_piece", F.spark_partition_id())
    return stash(dealt.withColumn("_s", F.struct(*series) if series else F.struct(F.lit(0))), "pieces")


def _inside(order: list[str]):
    return Window.partitionBy(*_OWN).orderBy(*order)


def _carried(rows: DataFrame, columns: list[Column], carry: dict[str, Column]) -> DataFrame:
    """``rows`` with columns made of their piece and the earlier ones of its series.

    ``columns`` are aggregates of a piece; ``carry`` makes of them, over the series' pieces in order, what its rows get.
    Pieces of a series are no more than ranges, so a task holds all of them.
    """
    edges = rows.groupBy(*_OWN).agg(*columns)
    for name, made in carry.items():
        edges = edges.withColumn(name, made)
    last = list(carry)[-1]
    return rows.join(edges.select(*_OWN, last), _OWN, "left")


def _pieces():
    return Window.partitionBy("_s").orderBy("_piece")


def _earlier():
    return _pieces().rowsBetween(Window.unboundedPreceding, -1)


def derivative(cut_points: DataFrame, time: str, value: str, unit_seconds: float = 1.0, nonnegative: bool = False, tie: list[str] = (), alias: str = "derivative", instant: bool = False) -> DataFrame:
    """Like :func:`timeseries.derivative`, of points that are :func:`cut` by time and ``tie``."""
    order, row = [time, *tie], F.struct(F.col(value).alias("v"), F.col(time).alias("t"))
    rows = cut_points.withColumn("_lag", F.lag(row).over(_inside(order)))
    rows = _carried(rows, [F.max_by(row, F.struct(*order)).alias("_last")], {"_row": F.lag("_last").over(_pieces())})
    before = F.coalesce("_lag", "_row")
    made = rate(F.col(value) - before["v"], micros(F.col(time)) - micros(before["t"]), unit_seconds, nonnegative, instant)
    return rows.withColumn(alias, made).drop(*_OWN, "_lag", "_row")


def increase(cut_points: DataFrame, order: list[str], value: str, alias: str = "increase") -> DataFrame:
    """Like :func:`timeseries.increase`, of points that are :func:`cut` by ``order``."""
    zero, w = F.lit(0), _inside(order)
    rows = cut_points.withColumn("_rise", F.greatest(F.col(value) - F.lag(value).over(w), zero))
    ends = [f(F.struct(F.col(value).alias("v")), F.struct(*order)).alias(n) for f, n in ((F.min_by, "_first"), (F.max_by, "_last"))]
    carry = {
        "_between": F.greatest(F.col("_first.v") - F.lag("_last.v").over(_pieces()), zero),
        "_before": F.sum("_between").over(_pieces()) + F.coalesce(F.sum("_risen").over(_earlier()), zero),
    }
    rows = _carried(rows, [*ends, F.sum("_rise").alias("_risen")], carry)
    own = F.sum("_rise").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(alias, F.coalesce(own, zero) + F.coalesce("_before", zero)).drop(*_OWN, "_rise", "_before")


def places(cut_points: DataFrame, order: list[str], alias: str = "place") -> DataFrame:
    """The place of each row in its series, from 1, of points that are :func:`cut` by ``order``."""
    rows = _carried(cut_points, [F.count(F.lit(1)).alias("_n")], {"_before": F.coalesce(F.sum("_n").over(_earlier()), F.lit(0))})
    return rows.withColumn(alias, F.row_number().over(_inside(order)) + F.col("_before")).drop(*_OWN, "_before")
