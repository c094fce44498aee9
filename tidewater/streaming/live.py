"""Live messages: channels, rejects, windows with late data, and repeat-safe sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeseries import upsert_points
from ..scratch import fresh_path, stash
from ..sources import schemas, snapshots


def messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of JSON lines, oldest files first; a line that doesn't parse is kept in ``_corrupt_record``."""
    reader = spark.readStream.schema(schemas.MESSAGE).option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream, its files in turn."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return stream.parquet(path)


def split_corrupt(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, corrupt lines); also what has no channel, symbol or time is corrupt."""
    bad = F.col("_corrupt_record").isNotNull() | F.col("channel").isNull() | F.col("symbol").isNull() | F.col("ts").isNull()
    return batch.where(~bad).drop("_corrupt_record"), batch.where(bad)


def on_channel(df: DataFrame, channel: str) -> DataFrame:
    return df.where(F.col("channel") == channel)


def subscribed(batch: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages of the channels in a table; read it again in each micro-batch and a switch takes effect with the next."""
    return batch.join(subscriptions.select("channel").distinct(), "channel", "left_semi")


def tumbling(df: DataFrame, time: str, interval: str, late: str, group: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of each group and window; rows later than ``late`` behind the newest are dropped once their window is closed."""
    rows = df.withWatermark(time, late).groupBy(*group, F.window(time, interval).alias("_w")).agg(*aggregates)
    return rows.withColumn("window_start", F.col("_w.start")).drop("_w")


def distinct_within(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; keys are remembered for ``late``."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run ``work`` on every micro-batch of what is there now, from the checkpoint on."""
    df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def into_points(df: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Upsert each micro-batch; a batch that comes twice changes nothing."""

    def work(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            upsert_points(batch, path, keys)

    each_batch(df, work, checkpoint)


def into_table(df: DataFrame, path: str, layout: snapshots.Layout, checkpoint: str, version: str | None = None) -> None:
    """Upsert each micro-batch into a table of whole versions, which is made if it isn't there; only the files of the batch's keys are rewritten, and readers see whole batches."""

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if not snapshots.versions(spark, path):
            snapshots.replace(batch.limit(0), path, layout)
        held = stash(batch, "batch")
        if held.take(1):
            snapshots.upsert(held, path, version)

    each_batch(df, work, checkpoint)


def tumbling_into(df: DataFrame, time: str, interval: str, late: str, group: list[str], aggregates: list[Column], path: str, checkpoint: str, rows: int = 1_000_000) -> None:
    """Keep a table of whole versions at the windows' states so far: open windows are there from their first row on.

    Each micro-batch gives the windows that it changed, which replace their earlier states by group and window; a batch
    that is done again gives the same states. A row later than ``late`` changes its window no more.
    """
    layout = snapshots.Layout((*group, "window_start"), rows=rows)

    def work(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if not snapshots.versions(spark, path):
            snapshots.replace(batch.limit(0), path, layout)
        snapshots.upsert(stash(batch, "bars"), path)  # else each reading would go through the state again

    each_batch(tumbling(df, time, interval, late, group, aggregates), work, checkpoint, "update")


def drain(df: DataFrame) -> DataFrame:
    """What a stream gives, in append mode, for the data that is there now, with the number of its micro-batch in ``_batch``.

    It is read back from a table in the shared scratch folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "stream")

    def work(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b={number}")

    each_batch(df, work, fresh_path(spark, "stream-state"))
    return spark.read.parquet(path).drop("b")
