"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank is
(rank - 1/2) / rows of its source. Sorted by fractional rank, any run of rows holds the sources in
the proportions of the whole table, so equal runs give shards that match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, ranked, stash

HASH_BITS = 60


def shard(docs: DataFrame, n_shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", per_bucket: int = 1024) -> DataFrame:
    """One row for each input row: id, size, text_crc32, law ``rows``, shard, slot, grown_shard (null).

    Shard sizes differ by one row at most, and every prefix of the interleaved order matches the
    mixture of sources to within one row a source. A null text has size 1 and crc 0; a null source
    counts as the empty one; rows with null or repeated ids are rows like others; an empty table
    gives an empty result. Ties of the hash go by id, then by text crc and size.

    Ranks come from (source, hash bucket) groups, whose number grows with the table: a source with a
    third of the rows is spread over a third of the groups.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )
    rows = stash(rows, "shard")
    total = rows.count()
    n = buckets_for(total, per_bucket)
    tie = ["doc_id", "text_crc32", "size"]
    rows = rows.withColumn("b", F.expr(f"cast(floor(h / {2.0**HASH_BITS} * {n}) as long)"))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    rows = ranked(rows, ["source"], "b", ["h", *tie]).join(sizes, "source").withColumn("f", (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("of")).cast("double"))
    rows = rows.withColumnRenamed("_rank", "r").withColumn("all", F.lit(0)).withColumn("b", F.expr(f"cast(floor(f * {n}) as long)"))
    placed = ranked(rows, ["all"], "b", ["f", "source", "r"])
    shard_of = F.expr(f"_rank * {n_shards} div {max(1, total)}")
    return placed.withColumn("shard", shard_of.cast("int")).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"_rank - (cast(shard as long) * {total} + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; nulls and repeated rows are rows like others."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 of a text is a fold over its bytes with a table of 256 entries, made here by its rule.
ORACLE = """
with recursive step(i, c, k) as (
    select i, i, 0 from range(256) r(i)
    union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
crc as (select list(c order by i) as t from step where k = 8),
base as (
    select doc_id, coalesce(source, '') as source, strlen(coalesce(text, '')) + 1 as size,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hex(coalesce(text, '')), 2 * i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32,
        ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as h
    from documents, crc),
ranks as (
    select *, row_number() over (partition by source order by h, doc_id, text_crc32, size) - 1 as r, count(*) over (partition by source) as n from base),
places as (
    select *, row_number() over (order by (2 * r + 1)::double / (2 * n)::double, source, r) - 1 as p, count(*) over () as total from ranks)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (p * 16 // total)::int as shard,
    (p - ((p * 16 // total) * total + 15) // 16)::bigint as slot, null::int as grown_shard
from places
"""
