"""Series in pieces, kept rollups and appends that keep keys."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.operators import rollups, segments, timeseries
from tidewater.plans import registry
from tidewater.sources import keyed, snapshots
from tidewater.sources.snapshots import Layout


@pytest.fixture
def points(spark):
    """Series of 700, 90, 1 and 3 rows, one of which is NULL; values fall, rise and are missing."""
    rows = [(s, i, float((i * 37) % 11) if i % 13 else None) for s, n in (("a", 700), (None, 90), ("b", 1), ("c", 3)) for i in range(n)]
    return spark.createDataFrame(rows, "s string, i long, v double").withColumn("t", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, i * 90 + i % 3)"))


def same(a, b):
    order = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert order(a) == order(b) and a.count()


@pytest.mark.parametrize("pieces", [1, 9])
@pytest.mark.parametrize("series", [["s"], []])
def test_pieces_give_what_whole_series_give(points, pieces, series):
    points = points if series else points.where("s = 'a'")
    cut = segments.cut(points, series, ["t", "i"], pieces)
    if pieces == 9:
        assert cut.where("s = 'a'").select("_piece").distinct().count() > 5
    by = series or ["one"]
    whole = points if series else points.withColumn("one", F.lit(1))
    same(segments.derivative(cut, "t", "v", tie=["i"]), timeseries.derivative(whole, by, "t", "v", tie=["i"]).drop("one"))
    same(segments.derivative(cut, "t", "v", 60.0, True, ["i"], "r"), timeseries.derivative(whole, by, "t", "v", 60.0, True, ["i"], "r").drop("one"))
    same(segments.increase(cut, ["t", "i"], "v"), timeseries.increase(whole, by, ["t", "i"], "v").drop("one"))
    same(segments.places(cut, ["t", "i"]).withColumn("place", F.col("place").cast("int")), timeseries.sorted_places(whole, by, "t", ["i"]).drop("one"))


def test_rates_of_close_times_are_exact(spark):
    """Three microseconds apart: seconds since 1970 as doubles would be a fifth of a microsecond off."""
    rows = spark.createDataFrame([("a", 0, 1.0, "2024-01-31 23:59:59.123457"), ("a", 1, 4.0, "2024-01-31 23:59:59.123460")], "s string, i long, v double, t string").withColumn("t", F.col("t").cast("timestamp"))
    cut = segments.cut(rows, ["s"], ["t", "i"], 2)
    for made in (segments.derivative(cut, "t", "v", tie=["i"]), timeseries.derivative(rows, ["s"], "t", "v", tie=["i"])):
        assert [r.derivative for r in made.orderBy("i").collect()] == [None, 3.0 / (3 / 1e6)]


def test_rates_between_equal_times_as_numbers(spark):
    """As SQL divides doubles by zero: events of one time that stay, rise and fall."""
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate((2.0, 2.0, 5.0, 1.0))], "s string, i long, v double").withColumn("t", F.expr("timestamp'2024-01-01'"))
    cut = segments.cut(rows, ["s"], ["t", "i"], 3)
    for made in (segments.derivative(cut, "t", "v", tie=["i"], instant=True), timeseries.derivative(rows, ["s"], "t", "v", tie=["i"], instant=True)):
        assert [repr(r.d) for r in made.orderBy("i").select(F.round("derivative", 6).alias("d")).collect()] == ["None", "nan", "inf", "-inf"]
    assert segments.derivative(cut, "t", "v", tie=["i"]).where("derivative is null").count() == 4


def test_rates_halfway_between_decimals_round_as_in_sql(spark, tmp_path):
    """16.1846875 in doubles, times a million, lies below its half; the others are what rounding must leave as it is."""
    steps = [(517.91, 32_000_000), (-517.91, 32_000_000), (0.0, 7), (133.01, 32_000_000), (9.0, 0), (-4.0, 0), (0.0, 0), (1e305, 1), (-1e305, 3), (0.01, 10**12), (123.45, 1)]
    values, times = [0.0], [0]
    for rise, took in steps:
        values.append(values[-1] + rise)
        times.append(times[-1] + took)
    start = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, us / 1e6)"
    rows = spark.createDataFrame([(i, 1, "a", v, t) for i, (v, t) in enumerate(zip(values, times, strict=True))], "event_id long, user_id long, event_type string, value double, us long")
    rows.withColumn("ts", F.expr(start)).drop("us").write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("pieces_derivative", "agg_derivative", "agg_nonnegative_derivative"):
        expected = sorted(duck.execute(registry.ORACLE_SQL[name]).fetchall())
        assert [repr(r[1]) for r in expected[1:3]] == ["16.184687", "None" if "nonnegative" in name else "-16.184687"]
        assert repr(sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))) == repr(expected)


def test_pieces_of_an_empty_table(points):
    assert segments.increase(segments.cut(points.limit(0), ["s"], ["t", "i"]), ["t", "i"], "v").count() == 0


def of(points):
    return rollups.states(points, ["s"], "t", "v", ["i"], "i")


def test_rollups_change_only_touched_hours_and_take_a_batch_once(spark, points, tmp_path):
    path = str(tmp_path / "rollup")
    rollups.create(of(points.where("i % 2 = 0")), path, ["s"], rows=4)
    before = set(snapshots.snapshot(spark, path).files())
    odd = points.where("i % 2 = 1")
    assert rollups.add(of(odd.where("i < 40")), path, "feed", 0) == 2
    after = set(snapshots.snapshot(spark, path).files())
    assert before & after  # files of other hours stay
    assert rollups.add(of(odd.where("i < 40")), path, "feed", 0) == 2  # again: no new version
    rollups.add(of(odd.where("i >= 40")), path, "feed", 1)
    rollups.add(of(odd.where("i >= 40")), path, "feed", 1)
    assert snapshots.snapshot(spark, path).applied == {"feed": 1}
    names = ["count", "sum", "min", "max", "first", "last", "distinct_approx", "median_approx"]
    kept = rollups.finished(rollups.read(spark, path), ["s"], "1 day", names)
    again = rollups.finished(of(points), ["s"], "1 day", names)
    same(kept.drop("median_approx"), again.drop("median_approx"))
    exact = points.groupBy("s", F.window("t", "1 day")["start"].alias("window_start")).agg(F.count("v").alias("n"), F.sort_array(F.collect_list("v")).alias("vs"))
    for r in kept.join(exact, [kept.s.eqNullSafe(exact.s), kept.window_start == exact.window_start]).collect():
        if r.n:
            below, upto = sum(x < r.median_approx for x in r.vs), sum(x <= r.median_approx for x in r.vs)
            assert below <= 0.52 * r.n and upto >= 0.48 * r.n
        else:
            assert r.median_approx is None and r.first is None and r["sum"] is None


def test_distinct_values_beyond_a_sketch_are_exact(spark, tmp_path):
    """Nine thousand users, more than a theta sketch holds, in two batches that share some; NULLs count as none, a NULL series is one."""
    path = str(tmp_path / "rollup")
    rows = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, "a").alias("s"), F.col("id").alias("i"), F.lit(1.0).alias("v"), F.when(F.col("id") % 7 > 0, F.col("id") % 9_000).alias("user"))
    rows = rows.withColumn("t", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, i * 4)"))
    state = lambda df: rollups.states(df, ["s"], "t", "v", ["i"], "user")
    rollups.create(state(rows.where("i % 2 = 0")), path, ["s"])
    rollups.add(state(rows.where("i % 3 > 0")), path, "feed", 0)
    got = rollups.finished(rollups.read(spark, path), ["s"], "7 days", ["count", "distinct"], "4 days")
    want = {r.s: r.n for r in rows.where("i % 2 = 0 or i % 3 > 0").groupBy("s").agg(F.countDistinct("user").alias("n")).collect()}
    assert {r.s: r.distinct for r in got.collect()} == want and max(want.values()) > 4096


def test_rebuilt_hours_forget_what_was_deleted(spark, points, tmp_path):
    path = str(tmp_path / "rollup")
    rollups.create(of(points), path, ["s"])
    left = points.where("not (s = 'a' and v = 10)")
    rollups.rebuild(of(left), path)
    same(rollups.finished(rollups.read(spark, path), ["s"], "1 hour", ["count", "max"]), rollups.finished(of(left), ["s"], "1 hour", ["count", "max"]))


def numbers(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))


def test_appends_look_into_few_files(spark, tmp_path):
    path = str(tmp_path / "keyed")
    snapshots.replace(numbers(spark, 0, 8_000), path, Layout(("k",), rows=1000))
    assert keyed.index(spark, path) == len(snapshots.snapshot(spark, path).files()) >= 8
    assert keyed.index(spark, path) == 0
    before = set(snapshots.snapshot(spark, path).files())
    done = keyed.append(numbers(spark, 7_999, 8_101), path)
    assert done.looked_into <= 3 and [(r.k, r.reason) for r in done.rejected.collect()] == [(7_999, "key present")]
    assert before < set(snapshots.snapshot(spark, path).files())  # nothing is rewritten
    read = snapshots.snapshot(spark, path).read()
    assert read.count() == read.select("k").distinct().count() == 8_101
    snapshots.upsert(numbers(spark, 30_000, 30_010), path)  # its file has no filter yet, so it is looked into
    done = keyed.append(numbers(spark, 30_005, 30_012), path)
    assert sorted(r.k for r in done.rejected.collect()) == list(range(30_005, 30_010))


def test_filters_hit_few_keys_that_are_not_there(spark, tmp_path):
    path = str(tmp_path / "keyed")
    snapshots.replace(numbers(spark, 0, 30_000), path, Layout(("k",), rows=40_000))
    keyed.index(spark, path)
    snap = snapshots.snapshot(spark, path)
    assert keyed.present(numbers(spark, 0, 30_000), snap).keys.count() == 30_000
    chosen, places = keyed._bits_of(["k"])
    other = numbers(spark, 100_000, 120_000).withColumn("block", F.pmod(chosen, F.lit(15))).withColumn("places", places)
    hits = other.join(keyed.filters(spark, path), "block").where(keyed._set_bits("bits", "places")).count()
    assert hits < 20_000 * 0.003


def test_faults_of_appended_rows(spark, tmp_path):
    table, parents = str(tmp_path / "t"), str(tmp_path / "p")
    snapshots.replace(spark.createDataFrame([(1, "x"), (2, None)], "g int, h string"), parents, Layout(("g",)))
    rows = lambda *r: spark.createDataFrame(r, "a string, b int, g int")
    snapshots.replace(rows(("old", 1, 1)), table, Layout(("a", "b")))
    new = rows(("old", 1, 2), ("old", 2, 2), ("new", 1, None), ("new", 1, 2), ("far", 1, 9), ("far", 1, 9), (None, 1, 1), ("n", None, 1), ("old", 2, 2))
    done = keyed.append(new, table, {"g": parents})
    assert sorted(((r.a or "", r.b, r.g, r.reason) for r in done.rejected.collect()), key=repr) == sorted(
        [("old", 1, 2, "key present"), ("old", 2, 2, "repeated key"), ("new", 1, 2, "repeated key"), ("far", 1, 9, "no row for g"), ("far", 1, 9, "repeated key"), ("", 1, 1, "null key"), ("n", None, 1, "null key")], key=repr
    )
    assert sorted((r.a, r.b) for r in snapshots.snapshot(spark, table).read().collect()) == [("new", 1), ("old", 1), ("old", 2)]
    version = snapshots.snapshot(spark, table).version
    assert keyed.append(new, table, {"g": parents}).version == version  # nothing is new
    assert keyed.append(new.limit(0), table).rejected.count() == 0


def test_sets_of_filters_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MANY_SETS", 3)
    path = str(tmp_path / "keyed")
    snapshots.replace(numbers(spark, 0, 10), path, Layout(("k",)))
    for i in range(1, 4):
        keyed.append(numbers(spark, 10 * i - 1, 10 * i + 10), path)
    assert len(keyed._pointers(spark, path)) < 3
    assert keyed.present(numbers(spark, 0, 100), snapshots.snapshot(spark, path)).keys.count() == 40
