"""Pages of a sorted table that open only the files they lie in.

The table is written once in the order of its pages, and beside it a zone map: of each file the rows, the rows
before it, and its first and last key. A page by number or after a key is found in the zone map; a scan opens the
one or two files that hold it, however deep the page is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, order: list[str], rows_per_file: int = 1_000_000) -> None:
    """Write ``df`` in the order of some columns, which must not be NULL, with its zone map; a path that is taken raises.

    The order should tell all rows apart: of equal ones, any may come first, in every page the same.
    """
    parts = max(1, -(-df.count() // rows_per_file))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    spark, key = df.sparkSession, F.struct(*order)
    held = spark.read.schema(df.schema).parquet(f"{path}/rows").select(key.alias("_key"), F.col("_metadata.file_name").alias("file"))
    zones = held.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("_key").alias("low"), F.max("_key").alias("high"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    zones.withColumn("before", before).write.parquet(f"{path}/zones")


def zones(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, low, high and before (rows of the files before) of a sorted table."""
    return spark.read.parquet(f"{path}/zones")


def _opened(spark: SparkSession, path: str, among: DataFrame) -> tuple[DataFrame, list[str], int | None]:
    """The rows of some zones, their order, and how many rows stand before them (None without zones)."""
    found = among.select("file", "before", "low").orderBy("before").collect()
    order = among.schema["low"].dataType.names
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*(f"{path}/rows/{r.file}" for r in found)) if found else spark.createDataFrame([], schema)
    return rows, order, found[0].before if found else None


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page ``number``, from 1, of ``size`` rows; a page behind the last has none."""
    if number < 1 or size < 1:
        raise ValueError("pages and their rows are counted from 1")
    start = (number - 1) * size
    rows, order, before = _opened(spark, path, zones(spark, path).where((F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)))
    return rows if before is None else rows.orderBy(*order).offset(start - before).limit(size)


def page_after(spark: SparkSession, path: str, last: tuple, size: int) -> DataFrame:
    """The next ``size`` rows after the one with the key ``last``, which need not be there."""
    known = zones(spark, path)
    kinds = known.schema["low"].dataType

    def key() -> Column:
        return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kinds, last, strict=True)))

    behind = known.where(F.col("high") > key())
    first = behind.orderBy("before").limit(1).select("before", "rows").collect()
    if not first:
        return _opened(spark, path, behind)[0]
    # the first file may hold none but its last row behind the key, so rows are counted from its end
    rows, order, _ = _opened(spark, path, behind.where(F.col("before") < first[0].before + first[0].rows + size - 1))
    return rows.where(F.struct(*order) > key()).orderBy(*order).limit(size)
