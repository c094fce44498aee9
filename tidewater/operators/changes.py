"""Row changes: update, delete, merge and identity keys as functions from a table's state to its next.

Spark's own tables have no UPDATE, DELETE or MERGE, so each operator returns the new state, and
:func:`replace_table` swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stash

#: Rows that one range numbers, about.
PER_RANGE = 500_000


def update(df: DataFrame, values: dict[str, Column], condition: Column | None = None) -> DataFrame:
    """Rows that meet the condition (all, without one) with new values; unknown leaves a row as it is."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    return df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns))


def update_joined(df: DataFrame, other: DataFrame, key: str, other_key: str, values: dict[str, Column]) -> DataFrame:
    """Rows with a match in ``other`` get new values, once however many matches there are."""
    matches = other.select(F.col(other_key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(matches, F.col(key) == F.col("_key"), "left").drop("_key")
    return update(joined, values, F.col("_hit")).drop("_hit")


def delete(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """What is left; unknown keeps a row, and no condition deletes all."""
    return df.limit(0) if condition is None else df.where(~F.coalesce(condition, F.lit(False)))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_identity(df: DataFrame, key: str, order: list[str], start: Column | int) -> DataFrame:
    """``key`` = start + 1, start + 2 ... in the order of some columns.

    The rows are dealt into ranges of all these columns, as many as their number asks for, and written
    with their range. Each range is numbered by itself, after the counts of the ranges before. Only rows
    that are equal in all columns of the order can't be dealt out.
    """
    ranges = max(1, -(-df.count() // PER_RANGE))
    held = stash(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "identity")
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    start = start if isinstance(start, Column) else F.lit(start)
    return held.withColumn("_number", number).join(before, "_range").withColumn(key, start + F.col("_before") + F.col("_number")).drop("_range", "_before", "_number")


def source(column: str) -> Column:
    """A column of the source, in a merge's actions."""
    return F.col(f"s.{column}")


def target(column: str) -> Column:
    return F.col(f"t.{column}")


DELETE = "delete"


def merge(
    table: DataFrame,
    rows: DataFrame,
    key: str,
    matched: dict[str, Column] | str | None = None,
    insert: dict[str, Column] | None = None,
    missing: dict[str, Column] | str | None = None,
    identity: str | None = None,
    repeats: str = "raise",
    latest_by: str | None = None,
) -> DataFrame:
    """The table after a merge by one equality key.

    ``matched``, ``missing``: new values of rows with and without a match in the source, or DELETE;
    ``insert``: values of source rows without a match; ``identity``: a key column that inserted rows
    get numbers in, after the largest so far. A branch that is not given does nothing, and at least one
    must be. NULL keys match nothing. A key that the source repeats raises, or with ``repeats='latest'``
    only its row of the largest ``latest_by`` counts.
    """
    if matched is None and insert is None and missing is None:
        raise ValueError("a merge needs at least one action")
    if repeats == "latest":
        place = Window.partitionBy(key).orderBy(F.desc_nulls_last(latest_by))
        rows = rows.withColumn("_n", F.when(F.col(key).isNull(), 1).otherwise(F.row_number().over(place))).where("_n = 1").drop("_n")
    elif repeated_keys(rows, key).limit(1).count():
        raise ValueError(f"the source repeats values of {key}")
    t, s = table.withColumn("_t", F.lit(True)).alias("t"), rows.withColumn("_s", F.lit(True)).alias("s")
    both = t.join(s, target(key) == source(key), "full")
    in_t, in_s = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    for action, hit in ((matched, in_t & in_s), (missing, in_t & ~in_s)):
        both = both.where(~hit) if action == DELETE else both
    both = both if insert is not None else both.where(in_t)
    branches = [(in_t & in_s, matched), (in_t & ~in_s, missing), (~in_t, insert)]

    def value(c: str) -> Column:
        out = target(c)
        for hit, action in branches:
            if isinstance(action, dict) and c in action:
                out = F.when(hit, action[c]).otherwise(out)
        return out.cast(table.schema[c].dataType).alias(c)

    state = both.select(*map(value, table.columns), (~in_t).alias("_new"))
    if identity and insert is not None:
        state = stash(state, "merge")
        last = table.agg(F.coalesce(F.max(identity), F.lit(0)).alias("last")).first()["last"]
        new = with_identity(state.where("_new"), identity, [key], last)
        state = state.where("not _new").unionByName(new.withColumn(identity, F.col(identity).cast(table.schema[identity].dataType)))
    return state.select(table.columns)


def refresh_securities(table: DataFrame, staged: DataFrame, now: Column, delist_once: bool = False) -> DataFrame:
    """Merge of a fresh listing: copies of what is listed, inserts with keys, a delisting date for what is absent.

    Every absent row is stamped at each run; with ``delist_once`` only rows without a date are, and a
    symbol that comes back loses its date.
    """
    copied = {c: source(c) for c in ("Name", "EnName", "Market_ID")}
    back = {"DelistDate": F.lit(None)} if delist_once else {}
    stamp = F.coalesce(target("DelistDate"), now) if delist_once else now
    return merge(
        table, staged, "Symbol", matched=copied | back | {"UpdateDate": source("CreateDate")}, insert=copied | {"Symbol": source("Symbol"), "CreateDate": source("CreateDate")},
        missing={"DelistDate": stamp}, identity="ID",
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path``, then swap it in; ``df`` may read from ``path``.

    The swap is two renames, so it is not atomic: a reader between them finds nothing, and a crash
    leaves the old state in ``path.old``.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark._jvm
    new, now, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path, f"{path}.old"))
    files = now.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if files.exists(now):
        files.rename(now, old)
    if not files.rename(new, now):
        raise OSError(f"could not swap in {path}")
    files.delete(old, True)
