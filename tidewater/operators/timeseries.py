"""Time series: points, upsert, long and wide form, and the aggregates over series and windows.

A series is named by columns; inside it rows are ordered by time, then by tie-breakers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import fresh_path
from .relational import latest


def _at(order: list[str]) -> Column:
    return F.struct(*order)


#: One value a series or window: name to (value column, order) -> Column.
AGGREGATES = {
    "mean": lambda v, o: F.avg(v),
    "max": lambda v, o: F.max(v),
    "min": lambda v, o: F.min(v),
    "sum": lambda v, o: F.sum(v),
    "count": lambda v, o: F.count(v),
    "skew": lambda v, o: F.skewness(v),
    "spread": lambda v, o: F.max(v) - F.min(v),
    "stddev": lambda v, o: F.stddev_samp(v),
    "first": lambda v, o: F.min_by(v, _at(o)),
    "last": lambda v, o: F.max_by(v, _at(o)),
    "median_approx": lambda v, o: F.percentile_approx(v, 0.5),
}


def aggregate(points: DataFrame, series: list[str], value: str, function: str, order: list[str] = (), alias: str | None = None) -> DataFrame:
    """One row a series. first and last need an order; NULL values count in none."""
    if function == "median":
        return median(points, series, value, alias or function)
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {function}")
    known = points.where(F.col(value).isNotNull()) if function in ("first", "last") else points
    return known.groupBy(*series).agg(AGGREGATES[function](value, list(order)).alias(alias or function))


#: Values of a series up to which one task holds them for its median.
SMALL_SERIES = 1 << 17
#: Shares of a series' values between which the median lies, and the accuracy with which Spark tells them.
BRACKET, ACCURACY = (0.499, 0.501), 10_000


def median(points: DataFrame, series: list[str], value: str, alias: str = "median") -> DataFrame:
    """The exact median of each series, with no more than SMALL_SERIES of its values in a task's memory.

    Series are counted first. If none is larger, each is a group of its own. Otherwise, approximate shares around
    the half bracket it; what lies below is counted, and only the distinct values inside the bracket, a few
    thousandths of a large series, are ranked. A series of NULLs has a NULL.
    """
    most = points.groupBy(*series).agg(F.count(value).alias("_n")).agg(F.max("_n").alias("most")).first()["most"]
    if (most or 0) <= SMALL_SERIES:
        return points.groupBy(*series).agg(F.median(F.col(value).cast("double")).alias(alias))
    keys = [f"_s{i}" for i in range(len(series))]
    rows = points.select(*(F.col(c).alias(k) for c, k in zip(series, keys, strict=True)), F.col(value).cast("double").alias("_v"))
    held = rows.groupBy(*keys).agg(F.percentile_approx("_v", list(BRACKET), ACCURACY).alias("_b"), F.count("_v").alias("_of"))
    side = held.select(*(F.col(k).alias(f"{k}h") for k in keys), "_b", "_of")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys), F.lit(True))
    joined = rows.where("_v is not null").join(side, same).where(F.col("_v") <= F.col("_b")[1])
    place = F.when(F.col("_v") >= F.col("_b")[0], F.col("_v"))  # NULL: below the bracket
    counted = joined.groupBy(*keys, place.alias("_v"), "_of").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
    middle = [F.expr("(_of + 1) div 2"), F.expr("_of div 2 + 1")]
    at = [F.min(F.when(F.col("_upto") >= m, F.col("_v"))) for m in middle]
    found = counted.withColumn("_upto", upto).groupBy(*keys).agg(((at[0] + at[1]) / 2).alias(alias))
    other = found.select(*(F.col(k).alias(f"{k}h") for k in keys), alias)
    return held.join(other, same, "left").select(*(F.col(k).alias(c) for c, k in zip(series, keys, strict=True)), alias)


def windowed(points: DataFrame, series: list[str], time: str, value: str, functions: list[str], interval: str, offset: str | None = None, order: list[str] = ()) -> DataFrame:
    """One row for each series and tumbling window, with the window's start and a column a function."""
    w = F.window(time, interval, interval, offset) if offset else F.window(time, interval)
    plain = [f for f in functions if f != "median"]
    out = points.groupBy(*series, w.alias("_w")).agg(F.count(F.lit(1)).alias("_n"), *(AGGREGATES[f](value, list(order) or [time]).alias(f) for f in plain)).select(*series, F.col("_w.start").alias("window_start"), *plain)
    if len(plain) < len(functions):
        keys = [*series, "window_start"]
        found = median(points.withColumn("window_start", w["start"]), keys, value).toDF(*(f"_k{i}" for i in range(len(keys))), "median")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)))
        out = out.join(found, same, "left")
    return out.select(*series, "window_start", *functions)


def _series(series: list[str], order: list[str]):
    return Window.partitionBy(*series).orderBy(*order)


def rate(rise: Column, micros: Column, unit_seconds: float, nonnegative: bool, instant: bool) -> Column:
    """What a rise is per unit of time, from the microseconds that it took; see :func:`derivative`."""
    # whole microseconds are subtracted: as seconds since 1970 in doubles, close times would lose their last digits
    made = rise / F.nullif(micros / 1e6, F.lit(0.0)) * unit_seconds
    if instant:
        made = F.when(micros == 0, rise * float("inf")).otherwise(made)
    return F.when(made >= 0, made) if nonnegative else made


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def derivative(
    points: DataFrame, series: list[str], time: str, value: str, unit_seconds: float = 1.0, nonnegative: bool = False, tie: list[str] = (), alias: str = "derivative", instant: bool = False
) -> DataFrame:
    """Change per unit of time against the row before; NULL for a series' first row, and below 0 if ``nonnegative``.

    Between equal times it is NULL, or with ``instant`` what floating-point division by zero gives: infinite, and NaN without a change.
    """
    w = _series(series, [time, *tie])
    took = micros(F.col(time)) - micros(F.lag(time).over(w))
    return points.withColumn(alias, rate(F.col(value) - F.lag(value).over(w), took, unit_seconds, nonnegative, instant))


def increase(points: DataFrame, series: list[str], order: list[str], value: str, alias: str = "increase") -> DataFrame:
    """Running sum of the rises; falls add nothing, as after a counter's reset. A series starts at 0."""
    w = _series(series, order)
    risen = points.withColumn("_rise", F.greatest(F.col(value) - F.lag(value).over(w), F.lit(0)))
    return risen.withColumn(alias, F.coalesce(F.sum("_rise").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))).drop("_rise")


def distinct_values(points: DataFrame, series: list[str], value: str) -> DataFrame:
    return points.select(*series, value).distinct()


def first_of_values(points: DataFrame, series: list[str], value: str, order: list[str]) -> DataFrame:
    """The first row for each distinct value of a series."""
    return latest(points, [*series, value], [F.col(c).asc() for c in order])


def sorted_places(points: DataFrame, series: list[str], value: str, tie: list[str], alias: str = "place") -> DataFrame:
    """The place of each row, from 1, among its series' values in rising order."""
    return points.withColumn(alias, F.row_number().over(_series(series, [value, *tie])))


def to_long(points: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, value): a row for each field that is not NULL."""
    wide = points.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields))
    return wide.unpivot(keys, fields, "field", "value").where("value is not null")


def to_wide(points: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return points.groupBy(*keys).pivot("field", fields).agg(F.max("value"))


def from_maps(points: DataFrame, tags: list[str], fields: list[str]) -> DataFrame:
    """Generic points (measurement, tags map, fields map, time) with a column for each named tag and field."""
    return points.select("measurement", *(F.col("tags")[t].alias(t) for t in tags), "time", *(F.col("fields")[f].alias(f) for f in fields))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Old and new points, one for each key: the one of the largest ``version``, or else a new one before an old one.

    Writing the same points again changes nothing.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = ([F.desc_nulls_last(version)] if version else []) + [F.desc("_new")]
    rest = [F.desc_nulls_last(c) for c in old.columns if c not in keys and c != version]
    return latest(both, keys, order + rest).drop("_new")


def points_exist(spark, path: str) -> bool:
    """Whether there is a points table at the path."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    return files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def upsert_points(new: DataFrame, path: str, keys: list[str], time: str = "time", measurement: str = "measurement") -> None:
    """Upsert into a table partitioned by measurement and month; only months that the new points touch are read and rewritten.

    The rewritten months are staged first, as a table can't be read and overwritten at once.
    """
    if not new.take(1):
        raise ValueError("no points to write")
    spark = new.sparkSession
    new = new.withColumn("month", F.date_format(time, "yyyy-MM"))
    if points_exist(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select(measurement, "month").distinct()
        new = upserted(old.join(touched, [measurement, "month"], "left_semi").select(new.columns), new, keys)
    else:
        new = upserted(new.limit(0), new, keys)
    staged = fresh_path(spark, "points")
    new.write.parquet(staged)
    rows = spark.read.schema(new.schema).parquet(staged).repartition(measurement, "month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(measurement, "month").parquet(path)


def read_points(spark, path: str, measurement: str, fields: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """All series of a measurement, by partition; ``fields`` and the condition reach the scan."""
    points = spark.read.parquet(path).where(F.col("measurement") == measurement)
    points = points if condition is None else points.where(condition)
    return points.select(*fields) if fields else points.drop("month")


def regular_times(spark, start: str, end: str, step: str, column: str = "time") -> DataFrame:
    """A row for each step from start to end, both included."""
    return spark.sql(f"select explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval {step})) as {column}")
