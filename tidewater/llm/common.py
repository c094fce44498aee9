"""Helpers shared by the corpus operators: scratch tables, row keys, distributed ranks, text batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import stash

__all__ = ["stash"]

def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row by its id and whole text; equal rows share a key and all their results."""
    return [F.xxhash64(F.col(id_col)).alias("_k1"), F.xxhash64(F.col(text_col)).alias("_k2")]


def plainly(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns renamed by place, and the new names of some of them, so that no name clashes with an operator's own."""
    names = docs.columns
    return docs.toDF(*(f"_c{i}" for i in range(len(names)))), [f"_c{names.index(c)}" for c in named]


def buckets_for(rows: int, per_bucket: int) -> int:
    """How many hash buckets hold about ``per_bucket`` rows each; grows with the input."""
    return max(1, -(-rows // per_bucket))


def running_offsets(counts: DataFrame, keys: list[str], bucket: str, n: str, span: int = 4096) -> DataFrame:
    """Add ``_before``: the sum of ``n`` over smaller buckets of the same keys, without one task over all buckets.

    ``counts`` has a row for each (keys, bucket). Buckets are summed in spans first, so that no
    window sees more than ``span`` rows or the number of spans.
    """
    counts = counts.withColumn("_span", F.expr(f"{bucket} div {span}"))
    top = counts.groupBy(*keys, "_span").agg(F.sum(n).alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*keys, "_span", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_top"))
    inner = Window.partitionBy(*keys, "_span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inner_sum = F.coalesce(F.sum(n).over(inner), F.lit(0))
    return counts.withColumn("_in", inner_sum).join(top, [*keys, "_span"]).select(*keys, bucket, (F.col("_top") + F.col("_in")).alias("_before"))


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list) -> DataFrame:
    """Add ``_rank`` (long, from 0): the place of a row among its keys by (bucket, order).

    Rows are dealt by (keys, bucket), so that a key with a third of all rows is spread over its buckets.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = running_offsets(counts, keys, bucket, "_n")
    within = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return df.withColumn("_within", within).join(before, [*keys, bucket]).withColumn("_rank", (F.col("_before") + F.col("_within") - 1).cast("long")).drop("_within", "_before")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that Spark deals anew on both sides, so that it can split a hot key's partition of the left one.

    Beneath an aggregate on the same keys it would keep the aggregate's partitions, and could split none.
    A further key, derived from the others, makes it deal them again.
    """
    again = F.pmod(F.hash(*keys), F.lit(1024)).alias("_again")
    return left.select("*", again).join(right.select("*", again), [*keys, "_again"], how).drop("_again")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, empty where null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def no_rows(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=schema)


#: Byte table: A-Z to lower case; bytes outside words to a space. Bytes from 0x80 on belong to words.
_WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_WORD_TABLE).split()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, hot: bool = False) -> DataFrame:
    """Connected components of an edge list of longs or strings: (node, root), root the smallest node reached.

    Alternating large-star and small-star steps, each a groupBy and a join, until the edges stop
    changing; every round is written to the scratch folder. Only two numbers a round reach the driver.
    With ``hot``, joins are dealt so that Spark can split the edges of one node that has very many.
    """
    meet = split_join if hot else lambda left, right, keys: left.join(right, keys)
    e = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = meet(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        kept = meet(e, low, ["u"]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e = stash(kept.where("u <> v").distinct(), "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def flat_lists(lists: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list array from one numpy array a row."""
    ends = np.cumsum([0, *map(len, lists)])
    values = np.concatenate(lists) if lists else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let Arrow batches end at ``size`` bytes, so that long texts don't fill a worker; kept where the user has set it."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
