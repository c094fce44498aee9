"""Appends that keep keys: no key twice, no NULL in one, and no reference to a row that isn't there, without a scan of the table.

Each data file of a table of whole versions has a Bloom filter of its keys, kept as rows (file, block, bits). A key belongs
to one block of a filter and sets PROBES of its bits, so a new key meets one row for each file of its bucket. Only
files where all its bits are set are looked into, and only their key columns are read, so a wrong hit costs time and no more. Filters
are written once and count from the moment that a pointer names them; a file that has none is looked into.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest, split_join
from ..scratch import stash
from . import snapshots
from .snapshots import FILE, PLACE, Snapshot

#: Bits of a block, which are those of one of Spark's bitmaps; keys that a block is meant for; bits of a key. Of keys that a file has not, some 5 in 10 000 hit it.
BLOCK, BLOCK_KEYS, PROBES = 32_768, 2_048, 7
#: Sets of filters of a table from which on they are put together.
MANY_SETS = 16


def _bits_of(keys: list[str]) -> tuple[Column, Column]:
    """(a number that chooses the block, the array of places in it) of a key."""
    h = F.xxhash64(F.lit("bits"), *keys)
    start, step = F.pmod(h, F.lit(BLOCK)), F.pmod(F.shiftright(h, 20), F.lit(BLOCK // 2)) * 2 + 1
    return F.xxhash64(F.lit("block"), *keys), F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(start + i * step, F.lit(BLOCK)).cast("int"))


def _blocks() -> Column:
    return F.ceil(F.col("rows") / BLOCK_KEYS)


def _pointers(spark: SparkSession, path: str) -> dict[str, dict]:
    """The sets of filters that count, by name."""
    files, at = snapshots._system(spark, f"{path}/filters/log")
    said = {}
    for s in files.listStatus(at) if files.exists(at) else []:
        if s.getPath().getName().endswith(".json"):
            stream = files.open(s.getPath())
            said[s.getPath().getName()[:-5]] = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
    gone = {name for one in said.values() for name in one["replaces"]}
    return {k: v for k, v in said.items() if k not in gone}


def filters(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, bits) of all filters of a table."""
    sets = [f"{path}/filters/{name}" for name in _pointers(spark, path)]
    schema = "file string, block long, bits binary"
    return spark.read.schema(schema).parquet(*sets) if sets else spark.createDataFrame([], schema)


def _put(made: DataFrame, path: str, replaces: list[str]) -> None:
    spark, name = made.sparkSession, uuid.uuid4().hex
    made.write.parquet(f"{path}/filters/{name}")
    snapshots.put_if_absent(spark, f"{path}/filters/log/{name}.json", json.dumps({"replaces": replaces}))


def index(spark: SparkSession, path: str) -> int:
    """Filters for the files of the newest version that have none, however they came there; how many files got one.

    Sets of filters that have become many are put together, without those of files that are gone.
    """
    snap = snapshots.snapshot(spark, path)
    keys, manifest = list(snap.layout.keys), snap.manifest().select("file", "rows")
    new = snapshots._listed(manifest.join(filters(spark, path).select("file").distinct(), "file", "left_anti"))
    n = new.count()
    if n:
        chosen, places = _bits_of(keys)
        held = snap.read(new).select(F.regexp_extract("_metadata.file_path", FILE, 1).alias("file"), chosen.alias("chosen"), places.alias("places"))
        rows = split_join(held, new, ["file"]).select("file", F.pmod("chosen", _blocks()).alias("block"), F.explode("places").alias("at"))
        _put(rows.groupBy("file", "block").agg(F.bitmap_construct_agg("at").alias("bits")), path, [])
    sets = list(_pointers(spark, path))
    if len(sets) >= MANY_SETS:
        _put(filters(spark, path).join(manifest.select("file"), "file", "left_semi").repartition("file"), path, sets)
    return n


def _set_bits(bits: str, places: str) -> Column:
    """Whether all places of a bitmap are set; a byte's lowest bit comes first."""
    byte = lambda p: F.conv(F.hex(F.substring(F.col(bits), F.expr("1") + F.floor(p / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.forall(places, lambda p: F.call_function("shiftright", byte(p), F.pmod(p, F.lit(8))).bitwiseAND(1) == 1)


@dataclass(frozen=True)
class Found:
    """Keys that a table has, and the files that were looked into for them."""

    keys: DataFrame
    files: list[str]


def present(wanted: DataFrame, snap: Snapshot) -> Found:
    """Those of the distinct keys ``wanted``, named as the table's, that a version has."""
    spark, keys, layout = snap.spark, list(snap.layout.keys), snap.layout
    manifest = snap.manifest().select("file", "rows", *PLACE)
    grouped = wanted.select(*keys).withColumn("_group", layout.group())
    sizes = manifest.select("_group", "_buckets").distinct()
    chosen, places = _bits_of(keys)
    at = snapshots._placed(grouped, layout, sizes).withColumns({"chosen": chosen, "places": places})
    met = split_join(at, manifest, PLACE).withColumn("block", F.pmod("chosen", _blocks()))
    kept = filters(spark, snap.path)
    # a file without a filter is looked into; a block without bits has no key
    known = kept.select("file").distinct().withColumn("known", F.lit(True))
    probed = split_join(split_join(met, known, ["file"], "left"), kept, ["file", "block"], "left")
    may = F.when(F.col("known").isNull(), True).when(F.col("bits").isNull(), False).otherwise(_set_bits("bits", "places"))
    suspects = stash(probed.where(may).select(*keys, "file"), "suspects")
    files = [f"{snap.path}/{r.file}" for r in suspects.select("file").distinct().collect()]
    held = snapshots._read(spark, files, snap.schema).select(*keys)
    return Found(suspects.select(*keys).distinct().join(held, keys, "left_semi"), files)


@dataclass(frozen=True)
class Appended:
    """The version after an append, the rows it refused with a ``reason``, and how many files were looked into."""

    version: int
    rejected: DataFrame
    looked_into: int


def append(rows: DataFrame, path: str, references: dict[str | tuple[str, ...], str] | None = None, times: int = 5) -> Appended:
    """Append the rows whose keys are whole, new and refer to rows that are there; the others come back, each with its first fault.

    Faults, in order: "null key"; "repeated key", for all but the first of rows with one key, by all columns; "key present";
    "no row for <columns>", by ``references``: columns to the table whose key they hold, where a NULL refers to nothing. The
    key that a row repeats is taken even if its first row is refused for a later fault. After a conflict the keys are checked again.
    """
    spark = rows.sparkSession
    layout = snapshots.snapshot(spark, path).layout
    keys = list(layout.keys)
    names = snapshots.snapshot(spark, path).schema.names
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    # a hot key's copies are told apart in 256 parts first, so that no task sorts all of them
    order = [F.col(c).asc_nulls_first() for c in names]
    marked = stash(rows.select(names).withColumns({"_row": F.monotonically_increasing_id(), "_part": F.pmod(F.xxhash64(*names), F.lit(256))}), "appended")
    order.append(F.col("_row").asc())
    firsts = latest(latest(marked.where(whole), [*keys, "_part"], order), keys, order)
    firsts = stash(firsts.drop("_part"), "firsts")
    rest = marked.drop("_part").join(firsts.select("_row"), "_row", "left_anti").withColumn("reason", F.when(whole, "repeated key").otherwise("null key"))
    for left in reversed(range(times)):
        base = snapshots.snapshot(spark, path)
        old = present(firsts, base)
        checked = firsts.join(old.keys.withColumn("_old", F.lit(True)), keys, "left").withColumn("reason", F.when(F.col("_old"), "key present")).drop("_old")
        looked = len(old.files)
        for columns, other in (references or {}).items():
            columns = [columns] if isinstance(columns, str) else list(columns)
            target = snapshots.snapshot(spark, other)
            named = checked.select(*(F.col(c).alias(k) for c, k in zip(columns, target.layout.keys, strict=True))).na.drop().distinct()
            found = present(named, target)
            looked += len(found.files)
            there = found.keys.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(target.layout.keys)), F.lit(True).alias("_there"))
            same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_r{i}") for i, c in enumerate(columns)))
            refers = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
            lost = F.when(refers & F.col("_there").isNull(), f"no row for {', '.join(columns)}")
            checked = checked.join(there, same, "left").withColumn("reason", F.coalesce("reason", lost)).select(firsts.columns + ["reason"])
        checked = stash(checked, "checked")
        try:
            good = checked.where("reason is null").select(names)
            version = base.version if good.isEmpty() else snapshots._changed(base, good, lambda a, b: a.unionByName(b), fresh=True)
            break
        except snapshots.Conflict:
            if not left:
                raise
    index(spark, path)
    return Appended(version, checked.where("reason is not null").unionByName(rest).drop("_row"), looked)
