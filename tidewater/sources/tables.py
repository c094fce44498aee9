"""Tables and databases of the catalog, seeds and external SQL tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a Parquet path if the name has a slash."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def external(spark: SparkSession, url: str, table: str, user: str, password: str, driver: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table of another SQL server; with a key and its bounds it is read in parts. The driver's jar must be there."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password, driver=driver, loginTimeout=10)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def database_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create_database(spark: SparkSession, name: str, path: str | None = None) -> bool:
    """Whether it was made, at ``path`` or in the warehouse; a database that is there stays as it is."""
    made = not database_exists(spark, name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`" + (f" LOCATION '{path}'" if path else ""))
    return made


def use_database(spark: SparkSession, name: str) -> str:
    """Set the current database and return the one before."""
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(name)
    return before


def create_table(spark: SparkSession, name: str, columns: str, key: str, foreign: dict[str, tuple[str, str]] | None = None) -> None:
    """An empty Parquet table with its key first; ``foreign``: column to (table, column).

    An existing table, a key that is no column and a reference to nothing raise. Spark does not
    enforce keys: see the constraints module.
    """
    schema = StructType.fromDDL(columns)
    if table_exists(spark, name):
        raise ValueError(f"{name} exists")
    if key not in schema.names:
        raise ValueError(f"no column {key}")
    for column, (table, other) in (foreign or {}).items():
        if column not in schema.names or not table_exists(spark, table) or other not in spark.table(table).columns:
            raise ValueError(f"{column} refers to nothing")
    ordered = StructType([schema[key], *(f for f in schema if f.name != key)])
    spark.createDataFrame([], ordered).write.format("parquet").saveAsTable(name)


def append(df: DataFrame, name: str) -> None:
    """Insert by column name; a column that is missing, too many or of another type raises."""
    have = df.sparkSession.table(name)
    if set(have.columns) != set(df.columns):
        raise ValueError(f"columns differ from {name}: {set(have.columns) ^ set(df.columns)}")
    df.select(have.columns).write.mode("append").insertInto(name)


def append_counted(df: DataFrame, name: str) -> int:
    """Append and tell how many rows were written; they are counted on their way."""
    seen = Observation()
    append(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return seen.get["rows"]


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE {name}")


def purge(spark: SparkSession, names: list[str], references: dict[str, list[str]]) -> list[str]:
    """Truncate tables, each before those that it refers to; returns the order."""
    left, order = list(names), []
    while left:
        free = [n for n in left if not any(n in references.get(other, ()) for other in left if other != n)]
        if not free:
            raise ValueError(f"tables refer to each other: {left}")
        for n in free:
            truncate(spark, n)
        order += free
        left = [n for n in left if n not in free]
    return order


def seed(spark: SparkSession, rows: tuple[tuple[str, str, str], ...], now) -> DataFrame:
    """A dimension's seed rows with keys from 1; ``now``: the column of the create date."""
    listed = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "ID int, Symbol string, Name string, EnName string")
    none = F.lit(None).cast("timestamp")
    return listed.select("*", now.cast("timestamp").alias("CreateDate"), none.alias("UpdateDate"), none.alias("DeleteDate"))


def seed_markets(spark: SparkSession, now) -> DataFrame:
    return seed(spark, schemas.MARKETS, now)


def seed_security_types(spark: SparkSession, now) -> DataFrame:
    return seed(spark, schemas.SECURITY_TYPES, now)
