"""Work lists of (window, symbol), the checkpoint, and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import window_end, windows
from ..operators.changes import merge, source


def work_list(symbols: DataFrame, symbol: str, start: str, now: str, days: int = 30) -> DataFrame:
    """(window_start, window_end, symbol): every symbol in every window from ``start`` while before ``now``; the end is not included."""
    listed = symbols.select(F.col(symbol).alias("symbol"), F.explode(windows(start, now, days)).alias("window_start"))
    return listed.select("window_start", window_end(F.col("window_start"), days).alias("window_end"), "symbol")


def resume(work: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """The work from the checkpoint's (window, symbol) on, that one included; all of it without a checkpoint.

    Work is ordered by window, then symbol. A symbol that is no longer listed leaves the next one in its
    window as the first.
    """
    at = checkpoint.select(F.col("CurrentStartInterval").cast("timestamp_ntz").alias("_w"), F.col("CurrentSymbol").alias("_s"))
    last = F.broadcast(at.agg(F.max(F.struct("_w", "_s")).alias("_at")))
    todo = F.col("_at").isNull() | (F.struct(F.col("window_start").alias("_w"), F.col("symbol").alias("_s")) >= F.col("_at"))
    return work.crossJoin(last).where(todo).drop("_at")


def save_checkpoint(checkpoint: DataFrame, window_start: str, symbol: str) -> DataFrame:
    """The checkpoint table with its one row, ID 1, set."""
    row = checkpoint.sparkSession.createDataFrame([(1, symbol)], "ID int, CurrentSymbol string").select("ID", F.lit(window_start).cast("timestamp").alias("CurrentStartInterval"), "CurrentSymbol")
    values = {c: source(c) for c in ("ID", "CurrentStartInterval", "CurrentSymbol")}
    return merge(checkpoint, row, "ID", matched=values, insert=values)
