"""Parquet tables with whole versions: every change writes new files beside the old ones and then commits one pointer.

A version is a manifest, a small Parquet table of the data files with their rows and the span of their sort
columns, and a pointer ``log/<number>.json`` that is put only if there is none yet. So a reader has one whole
version or another, a crash before the pointer leaves the table as it was, and of two writers of one version one
sees that it came second: it commits on top if the other changed other buckets, and else raises :class:`Conflict`.

Rows are dealt into groups (values of some columns, months of a time) and inside a group into buckets by a
hash of the key, as many as its rows ask for. A change looks for its keys in their buckets only, and rewrites only the
files that hold one of them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import changes
from ..operators.timeseries import upserted
from ..scratch import stash

#: A data file's name inside the table, at the end of its whole name.
FILE = r"(data/[0-9a-f]{32}/[^/]+/[^/]+)$"
#: A group's buckets are made anew when they hold so many times the rows they were meant for, and a bucket's files are put together when they are so many.
GROWN, MANY_FILES = 4, 8
PLACE = ["_group", "_buckets", "_bucket"]
#: Rows of a bucket where a layout asks for no others, and so many buckets, about, a table has before these are made larger than asked for, up to as many rows.
ROWS, BUCKETS = 1_000_000, 256


class Conflict(Exception):
    """Another writer changed the same buckets since the version that a change was made from."""


@dataclass(frozen=True)
class Layout:
    """How rows are dealt: by the values of ``by`` and the month of ``month`` into groups, by a hash of ``keys`` into buckets of about ``rows`` rows.

    A table that would have more than BUCKETS of them gets larger ones, up to ROWS, as each costs a file in every change that meets it.
    """

    keys: tuple[str, ...]
    by: tuple[str, ...] = ()
    month: str | None = None
    rows: int = ROWS

    def __post_init__(self):
        if not self.keys or not {*self.by, *([self.month] if self.month else [])} <= set(self.keys):
            raise ValueError("rows are dealt by columns of the key, so that a key has one place")

    def group(self) -> Column:
        month = [F.date_format(self.month, "yyyy-MM").alias("_month")] if self.month else []
        return F.to_json(F.struct(*self.by, *month)) if self.by or month else F.lit("")


@dataclass(frozen=True)
class Snapshot:
    """One version of a table: number, manifest, layout, schema and the last batch of each source. Its files never change."""

    spark: SparkSession
    path: str
    version: int
    manifest_path: str
    layout: Layout
    schema: StructType
    applied: dict[str, int] = field(default_factory=dict)

    def manifest(self) -> DataFrame:
        """file, place of its rows, rows, low and high (of the keys), and the version that it came with."""
        return self.spark.read.parquet(f"{self.path}/{self.manifest_path}")

    def files(self, among: DataFrame | None = None) -> list[str]:
        return [f"{self.path}/{r.file}" for r in (self.manifest() if among is None else among).select("file").collect()]

    def read(self, among: DataFrame | None = None) -> DataFrame:
        """The rows of the version, or of some files of its manifest."""
        return _read(self.spark, self.files(among), self.schema)


def _read(spark: SparkSession, files: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _listed(df: DataFrame) -> DataFrame:
    """A table of groups or files, no longer than the list of files that Spark's driver holds for a scan, computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file was made by this call, whole; of several callers one makes it.

    A file is written under another name and gets its own by a step that fails if the name is taken: a
    link on a local disk, a rename without overwriting on a shared file system.
    """
    files, at = _system(spark, path)
    files.mkdirs(at.getParent())
    taken = f"{path}.{uuid.uuid4().hex}.tmp"
    out = files.create(_system(spark, taken)[1], False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.getScheme() == "file":
        local = lambda p: urlparse(p).path if "://" in p or p.startswith("file:") else p
        try:
            os.link(local(taken), local(path))
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(_system(spark, taken)[1], False)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(_system(spark, taken)[1], at, none)
        return True
    except Exception:
        files.delete(_system(spark, taken)[1], False)
        if files.exists(at):
            return False
        raise


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, rising; none where there is no table."""
    files, at = _system(spark, f"{path}/log")
    return sorted(int(s.getPath().getName()[:-5]) for s in files.listStatus(at) if s.getPath().getName().endswith(".json")) if files.exists(at) else []


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """A version of a table, the last one by default."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version or ''} of {path}")
    files, at = _system(spark, f"{path}/log/{known[-1] if version is None else version:020d}.json")
    stream = files.open(at)
    said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    layout = Layout(**{k: tuple(v) if isinstance(v, list) else v for k, v in said["layout"].items()})
    return Snapshot(spark, path, said["version"], said["manifest"], layout, StructType.fromJson(said["schema"]), said.get("applied", {}))


def _grouped(rows: DataFrame, layout: Layout) -> DataFrame:
    return rows.withColumn("_group", layout.group())


def _aim(layout: Layout, total: int) -> int:
    """Rows of a bucket in a table of so many."""
    return max(layout.rows, min(ROWS, -(-total // BUCKETS)))


def _rows_of(manifest: DataFrame | None) -> int:
    return (manifest.agg(F.sum("rows")).first()[0] or 0) if manifest is not None else 0


def _sizes(grouped: DataFrame, layout: Layout, manifest: DataFrame | None) -> tuple[DataFrame, int]:
    """_group, _buckets (a power of two) and whether it changed, for the groups of new rows; and the rows of a bucket."""
    more = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("more"))
    counts = more.collect()
    more = grouped.sparkSession.createDataFrame(counts, more.schema)
    aim = _aim(layout, _rows_of(manifest) + sum(r.more for r in counts))
    if manifest is None:
        had = more.select("_group", F.lit(None).cast("int").alias("had"), F.lit(0).cast("long").alias("rows"))
    else:
        had = manifest.groupBy("_group").agg(F.max("_buckets").alias("had"), F.sum("rows").alias("rows"))
    both = more.join(had, "_group", "left").withColumn("all", F.col("more") + F.coalesce("rows", F.lit(0)))
    asked = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("all") / aim)))).cast("int")
    buckets = F.when(F.col("had").isNull(), asked).when(F.col("all") > GROWN * aim * F.col("had").cast("long"), F.greatest(asked, "had")).otherwise(F.col("had"))
    return _listed(both.select("_group", buckets.alias("_buckets"), (F.col("had") != buckets).alias("_anew"))), aim


def _placed(grouped: DataFrame, layout: Layout, sizes: DataFrame) -> DataFrame:
    # the sizes are broadcast: Spark makes a product of a join by one group's constant, which does the rows' work again for each partition of the sizes
    rows = grouped.join(F.broadcast(sizes.select("_group", "_buckets")), "_group")
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*layout.keys), F.col("_buckets").cast("long")).cast("int"))


def _written(placed: DataFrame, path: str, layout: Layout, aim: int) -> DataFrame:
    """Write rows, a bucket a file, sorted by key; the manifest of the new files."""
    spark, name = placed.sparkSession, f"data/{uuid.uuid4().hex}"
    unit = F.lower(F.hex(F.xxhash64(*PLACE)))
    columns = [c for c in placed.columns if c not in PLACE]
    rows = placed.select(*columns, *PLACE, unit.alias("unit")).repartition("unit").sortWithinPartitions("unit", *layout.keys)
    rows.write.option("maxRecordsPerFile", GROWN * aim).partitionBy("unit").parquet(f"{path}/{name}")
    held = spark.read.schema(placed.select(*columns, *PLACE).schema).parquet(f"{path}/{name}").select(*layout.keys, *PLACE, F.col("_metadata.file_path").alias("_file"))
    key = F.struct(*layout.keys)
    counted = held.groupBy("_file", *PLACE).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
    return counted.select(F.regexp_extract("_file", FILE, 1).alias("file"), *PLACE, "rows", "low", "high")


def _commit(spark: SparkSession, path: str, layout: Layout, schema: StructType, base: Snapshot | None, added: DataFrame, gone: DataFrame | None, applied: tuple[str, int] | None = None) -> int:
    """Put the next version: the newest manifest without the files of ``gone`` (all, if None) and with those of ``added``.

    If there are versions since ``base``, it goes on top of them, unless one took a file that this change has read or
    wrote into a bucket that it writes to. A change of everything goes on top of none. ``applied``: the
    source and number of the batch that this is, which is left out if the newest version has it.
    """
    seen = base.version if base else 0
    while True:
        last = snapshot(spark, path) if versions(spark, path) else None
        if last and applied and last.applied.get(applied[0], -1) >= applied[1]:
            return last.version
        if last and last.version > seen and (gone is None or last.layout != layout or last.schema != schema or _overlap(last, seen, added, gone)):
            raise Conflict(f"version {last.version} of {path} changed the same buckets")
        number = (last.version if last else 0) + 1
        new = added.withColumn("version", F.lit(number))
        whole = new if gone is None or last is None else last.manifest().join(gone.select("file"), "file", "left_anti").unionByName(new)
        name = f"manifest/{uuid.uuid4().hex}"
        whole.write.parquet(f"{path}/{name}")
        said = {"version": number, "manifest": name, "layout": asdict(layout), "schema": schema.jsonValue(), "applied": (last.applied if last else {}) | dict([applied] if applied else [])}
        if put_if_absent(spark, f"{path}/log/{number:020d}.json", json.dumps(said)):
            return number


def _overlap(last: Snapshot, seen: int, added: DataFrame, gone: DataFrame) -> bool:
    """Whether files of ``gone`` have gone since version ``seen``, or others came into the same buckets; buckets made anew meet all of their group."""
    now = last.manifest()
    if not gone.join(now, "file", "left_anti").isEmpty():
        return True
    mine = added.select(*PLACE).unionByName(gone.select(*PLACE)).distinct().select(*(F.col(c).alias(f"o{c}") for c in PLACE))
    met = (F.col("_group") == F.col("o_group")) & ((F.col("_buckets") != F.col("o_buckets")) | (F.col("_bucket") == F.col("o_bucket")))
    return not now.where(F.col("version") > seen).join(mine, met, "left_semi").isEmpty()


def replace(rows: DataFrame, path: str, layout: Layout) -> int:
    """The table becomes ``rows``, which may come from the table itself; the number of the version.

    A table is made so, too. Two replacements from the same version conflict.
    """
    spark = rows.sparkSession
    base = snapshot(spark, path) if versions(spark, path) else None
    return _commit(spark, path, layout, rows.schema, base, _filled(rows, path, layout), None)


def _filled(rows: DataFrame, path: str, layout: Layout) -> DataFrame:
    grouped = _grouped(rows, layout)
    sizes, aim = _sizes(grouped, layout, None)
    return _written(_placed(grouped, layout, sizes), path, layout, aim)


def _touched(base: Snapshot, placed: DataFrame, sizes: DataFrame, fresh: bool) -> DataFrame:
    """Names and places of the files that hold a key of ``placed``, that belong to groups made anew, or that are many in a bucket which gets rows.

    ``fresh``: no file holds one of the keys, so none is looked into.
    """
    keys = list(base.layout.keys)
    manifest = base.manifest().select("file", *PLACE)
    anew = manifest.join(sizes.where("_anew").select("_group"), "_group", "left_semi")
    near = manifest.join(placed.select(*PLACE).distinct(), PLACE, "left_semi").unionByName(anew).distinct().select("file", *PLACE).collect()
    if not near:
        return base.spark.createDataFrame([], manifest.schema)
    whole = {r._group for r in sizes.where("_anew").collect()}
    files_of = Counter((r._group, r._bucket) for r in near)
    sure = [r for r in near if r._group in whole or files_of[r._group, r._bucket] >= MANY_FILES]
    found = [f"{base.path}/{r.file}" for r in set(near) - set(sure)]
    if not found or fresh:
        return base.spark.createDataFrame(sure, manifest.schema)
    held = _read(base.spark, found, base.schema).select(*keys, F.regexp_extract("_metadata.file_path", FILE, 1).alias("file"))
    wanted = placed.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    hit = {r.file for r in held.join(wanted, same, "left_semi").select("file").distinct().collect()}
    return base.spark.createDataFrame([*sure, *(r for r in near if r.file in hit and r not in sure)], manifest.schema)


def _changed(base: Snapshot, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], fresh: bool = False, applied: tuple[str, int] | None = None) -> int:
    """Commit what ``combine`` makes of the touched files' rows and the new ones."""
    layout = base.layout
    grouped = _grouped(new, layout)
    sizes, aim = _sizes(grouped, layout, base.manifest())
    placed = stash(_placed(grouped, layout, sizes), "placed")
    touched = _touched(base, placed, sizes, fresh)
    old = base.read(touched)
    result = _grouped(combine(old, placed.drop(*PLACE)).select(base.schema.names), layout)
    # a group that is only touched keeps its buckets: sizes has all groups of the new rows, and touched files have no others
    added = _written(_placed(result, layout, sizes), base.path, layout, aim)
    return _commit(base.spark, base.path, layout, base.schema, base, added, touched, applied)


def _tried(work: Callable[[], int], times: int) -> int:
    for left in reversed(range(times)):
        try:
            return work()
        except Conflict:
            if not left:
                raise
    raise ValueError("a change must be tried once at least")


def upsert(rows: DataFrame, path: str, version: str | None = None, times: int = 5) -> int:
    """Rows replace those of the same keys, and are added otherwise; of several, the one of the largest ``version`` counts.

    After a conflict it is done again from the newest version, ``times`` times at most. Upserting the same rows again changes no row.
    """
    spark = rows.sparkSession
    return _tried(lambda: _changed(base := snapshot(spark, path), rows.select(base.schema.names), lambda old, new: upserted(old, new, list(base.layout.keys), version)), times)


def combine(rows: DataFrame, path: str, how: Callable[[DataFrame, DataFrame], DataFrame], applied: tuple[str, int] | None = None, times: int = 5) -> int:
    """Commit ``how`` of the rows of all files with a key of ``rows`` and of ``rows`` themselves.

    ``applied``: a source and the number of its batch; a batch at or below the source's last one changes nothing.
    """
    spark = rows.sparkSession

    def work() -> int:
        base = snapshot(spark, path)
        if applied and base.applied.get(applied[0], -1) >= applied[1]:
            return base.version
        return _changed(base, rows.select(base.schema.names), how, applied=applied)

    return _tried(work, times)


def merge_into(rows: DataFrame, path: str, key: str, matched=None, insert=None, missing=None, identity: str | None = None, times: int = 5) -> int:
    """Commit :func:`changes.merge` of ``rows`` into a table whose layout has ``key`` as its only key and no groups.

    Without a ``missing`` branch and an ``identity``, which need all rows, only files with a key of the source are rewritten. Columns of ``rows`` besides the key are the source's own.
    """
    spark = rows.sparkSession

    def work() -> int:
        base = snapshot(spark, path)
        if base.layout.keys != (key,) or base.layout.by or base.layout.month:
            raise ValueError("a merge goes by the layout's one key")
        if missing is None and identity is None:
            return _changed(base, rows, lambda old, new: changes.merge(old, new, key, matched=matched, insert=insert))
        after = changes.merge(base.read(), rows, key, matched=matched, insert=insert, missing=missing, identity=identity)
        return _commit(spark, path, base.layout, base.schema, base, _filled(after, path, base.layout), None)

    return _tried(work, times)


def _rewritten(spark: SparkSession, path: str, condition: Column, change: Callable[[DataFrame], DataFrame], times: int) -> int:
    """Commit ``change`` of the files with a row that meets the condition; the others stay."""

    def work() -> int:
        base = snapshot(spark, path)
        if not base.files():
            return base.version
        hit = base.read().where(condition).select(F.regexp_extract("_metadata.file_path", FILE, 1).alias("file")).distinct()
        touched = _listed(base.manifest().select("file", *PLACE).join(hit, "file", "left_semi"))
        if touched.isEmpty():
            return base.version
        sizes = touched.select("_group", "_buckets").distinct()
        result = _grouped(change(base.read(touched)), base.layout)
        added = _written(_placed(result, base.layout, sizes), path, base.layout, _aim(base.layout, _rows_of(base.manifest())))
        return _commit(spark, path, base.layout, base.schema, base, added, touched)

    return _tried(work, times)


def update_where(spark: SparkSession, path: str, values: dict[str, Column], condition: Column, times: int = 5) -> int:
    """Rows that meet the condition get new values; columns by which rows are dealt can't be set. The version after it."""
    layout = snapshot(spark, path).layout
    if set(values) & {*layout.keys, *layout.by, layout.month}:
        raise ValueError("the values by which rows are dealt can't be updated")
    return _rewritten(spark, path, condition, lambda df: changes.update(df, values, condition), times)


def delete_where(spark: SparkSession, path: str, condition: Column, times: int = 5) -> int:
    return _rewritten(spark, path, condition, lambda df: changes.delete(df, condition), times)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the pointers of all but the last ``keep`` versions and the files that none of the kept ones has; how many data files went.

    Readers of older versions lose their files, and so does a writer that has not yet committed: run it when neither is about.
    """
    if keep < 1:
        raise ValueError("the last version stays")
    known = versions(spark, path)
    kept = [snapshot(spark, path, v) for v in known[-keep:]]
    needed = {f for k in kept for f in k.files()}
    live = {f"{path}/{k.manifest_path}" for k in kept}
    for v in known[:-keep]:
        files, at = _system(spark, f"{path}/log/{v:020d}.json")
        files.delete(at, False)
    gone, tail = 0, lambda p: unquote(p.toString()).split(path.split("://", 1)[-1].removeprefix("file:"), 1)[-1]
    files, at = _system(spark, f"{path}/manifest")
    for m in files.listStatus(at):
        if f"{path}{tail(m.getPath())}" not in live:
            files.delete(m.getPath(), True)
    files, at = _system(spark, f"{path}/data")
    walk = files.listFiles(at, True)
    while walk.hasNext():
        p = walk.next().getPath()
        if p.getName().endswith(".parquet") and f"{path}{tail(p)}" not in needed:
            files.delete(p, False)
            gone += 1
    return gone
