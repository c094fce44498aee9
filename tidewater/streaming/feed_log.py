"""Growing message logs as a stream, and streams that start again after an error.

A feed's process appends lines to log files, one or more a channel. :class:`FeedLog` is a streaming source over
them: an offset is the length of every file up to its last whole line, so a line that is still being written waits, a
restart goes on at the byte where the last batch ended, and a batch that is done again has the same lines. Long files are cut into spans, which
tasks read side by side. Lines come as text; Spark parses them, and what doesn't parse is kept as a reject.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import schemas, snapshots
from .live import split_corrupt

#: Bytes of a file that one task reads, about, and that it holds at once; bytes after a span's end, for its last line.
SPAN, BLOCK, TAIL = 64 << 20, 1 << 20, 1 << 16
#: So many tasks read a batch, about, before their spans are as long as SPAN.
TASKS = 256


@dataclass
class Span(InputPartition):
    """The lines that begin at ``start`` or later and before ``end``; ``begins`` if a line is known to begin at ``start``."""

    file: str
    start: int
    end: int
    begins: bool


class FeedLog(DataSource):
    """``spark.readStream.format("feed_log").option("path", folder)``: file, at (the byte where the line begins) and line.

    The folder is one that the driver and all executors see, by any scheme that Arrow opens. Files only grow: one that
    got shorter raises, as lines would be lost. Names that begin with a dot or an underscore don't count.
    Option ``span``: bytes that one task reads; more, up to SPAN, in a batch of more than TASKS such spans.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_log"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("span", SPAN)))


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, span: int):
        self.path, self.span = path, span

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = self._open()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        logs = sorted((f for f in found if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.base_name)
        return {f.base_name: _whole_lines(files, f.path, f.size) for f in logs}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        parts = [(file, start.get(file, 0), to) for file, to in end.items()]
        for file, at, to in parts:
            if to < at:
                raise ValueError(f"{file} is shorter than what was read of it")
        span = max(self.span, min(SPAN, sum(to - at for _, at, to in parts) // TASKS))
        return [Span(file, a, min(a + span, to), a == at) for file, at, to in parts for a in range(at, to, span)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        files, root = self._open()
        with files.open_input_file(f"{root}/{span.file}") as log:
            for at, lines in _lines(log, span):
                yield pa.RecordBatch.from_arrays([pa.array([span.file] * len(lines)), pa.array(at, pa.int64()), pa.array(lines)], ["file", "at", "line"])


def _whole_lines(files: fs.FileSystem, path: str, size: int) -> int:
    """The length of a file up to and with its last newline."""
    with files.open_input_file(path) as log:
        to = size
        while to > 0:
            at = max(0, to - BLOCK)
            last = log.read_at(to - at, at).rfind(b"\n")
            if last >= 0:
                return at + last + 1
            to = at
    return 0


def _lines(log, span: Span) -> Iterator[tuple[list[int], list[str]]]:
    """(places, lines) of a span, a block at a time; its last line may go on past its end."""
    at, held = span.start, b""
    if not span.begins:  # the line over the cut belongs to the span before; it ends after the byte before this one at the earliest
        at, held, skip = span.start - 1, b"", True
    else:
        skip = False
    read = at
    while at < span.end:
        block = log.read_at(min(BLOCK, max(TAIL, span.end - read)), read)
        if not block:
            return
        read += len(block)
        held += block
        places, lines = [], []
        cut = held.rfind(b"\n") + 1
        for line in held[:cut].split(b"\n")[:-1]:
            if skip:
                skip = False
            elif at < span.end and line.strip():
                places.append(at)
                lines.append(line.decode(errors="replace"))
            at += len(line) + 1
        held = held[cut:]
        if lines:
            yield places, lines


def feed_log(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """A stream of messages from the logs in a folder, with ``file`` and ``at``; a line that doesn't parse is in ``_corrupt_record``."""
    spark.dataSource.register(FeedLog)
    lines = spark.readStream.format("feed_log").option("path", path).option("span", span).load()
    said = F.from_json("line", schemas.MESSAGE, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("said")
    return lines.select("file", "at", said).select("file", "at", "said.*")


def caught_up(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, on_error: Callable[[Exception], None] | None = None, attempts: int = 3) -> None:
    """Run ``work`` on micro-batches from the checkpoint on until nothing is left to read.

    After an error the stream starts again from its checkpoint; ``on_error`` is told each time, and the one that
    comes ``attempts`` times without a batch between them is raised.
    """
    done, failed = 0, 0

    def counted(batch: DataFrame, number: int) -> None:
        nonlocal done
        work(batch, number)
        done += 1

    while True:
        before = done
        query = df.writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
            return
        except Exception as error:
            failed = 1 if done > before else failed + 1
            if on_error:
                on_error(error)
            if failed >= attempts:
                raise
        finally:
            query.stop()


def into_table(df: DataFrame, path: str, layout: snapshots.Layout, rejects: str, checkpoint: str, **tried) -> None:
    """Upsert a log's messages into a table of whole versions and write what doesn't parse to ``rejects``, by batch; a batch that is done again changes neither."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            good, bad = split_corrupt(batch)
            bad.select("file", "at", "_corrupt_record").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
            if not snapshots.versions(spark, path):
                snapshots.replace(good.limit(0), path, layout)
            snapshots.upsert(good, path, "at")
        finally:
            batch.unpersist()

    caught_up(df, work, checkpoint, **tried)


def reject_counts(spark: SparkSession, rejects: str) -> DataFrame:
    """(batch, file, n): how many lines of each log and batch didn't parse."""
    return spark.read.schema("file string, at long, _corrupt_record string, batch int").parquet(rejects).groupBy("batch", "file").agg(F.count(F.lit(1)).alias("n"))
