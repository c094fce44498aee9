"""Tables of whole versions: what is rewritten, what readers see, and writers at once."""

import threading

import pytest
from pyspark.sql import functions as F

from tidewater.operators import changes
from tidewater.sources import snapshots
from tidewater.sources.snapshots import Conflict, Layout
from tidewater.streaming import live


def numbers(spark, low, high, value=0.0):
    return spark.range(low, high).select(F.col("id").alias("k"), F.lit(value).alias("v"))


def state(spark, path, version=None):
    return {r.k: r.v for r in snapshots.snapshot(spark, path, version).read().collect()}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "data" / "table")  # a folder named like the table's own


def test_only_files_with_touched_keys_are_rewritten(spark, path):
    snapshots.replace(numbers(spark, 0, 4000), path, Layout(("k",), rows=500))
    before = set(snapshots.snapshot(spark, path).files())
    assert len(before) == 8 and max(r.rows for r in snapshots.snapshot(spark, path).manifest().collect()) < 2 * 500
    assert snapshots.upsert(spark.createDataFrame([(5, 1.0), (5, 0.5), (9, 2.0)], "k long, v double"), path, "v") == 2
    after = set(snapshots.snapshot(spark, path).files())
    assert 1 <= len(before - after) <= 2 and len(after) == 8
    assert state(spark, path) == {k: {5: 1.0, 9: 2.0}.get(k, 0.0) for k in range(4000)}
    snapshots.upsert(spark.createDataFrame([(-1, 7.0)], "k long, v double"), path)  # a new key rewrites nothing
    assert after < set(snapshots.snapshot(spark, path).files()) and len(state(spark, path)) == 4001
    assert state(spark, path, 1) == dict.fromkeys(range(4000), 0.0)  # older versions stay


def test_a_group_that_grows_gets_more_buckets(spark, path):
    rows = lambda g, low, high: numbers(spark, low, high).withColumn("g", F.lit(g))
    snapshots.replace(rows("a", 0, 100).unionByName(rows("b", 0, 900)), path, Layout(("g", "k"), ("g",), rows=100))
    buckets = lambda: {r._group: r._buckets for r in snapshots.snapshot(spark, path).manifest().select("_group", "_buckets").distinct().collect()}
    assert buckets() == {'{"g":"a"}': 1, '{"g":"b"}': 16}
    snapshots.upsert(rows("a", 50, 2000), path)
    assert buckets() == {'{"g":"a"}': 32, '{"g":"b"}': 16}
    read = snapshots.snapshot(spark, path).read()
    assert read.count() == 2900 and read.distinct().count() == 2900


def test_a_large_table_has_larger_buckets_instead_of_ever_more_files(spark, path, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKETS", 8, raising=False)
    snapshots.replace(numbers(spark, 0, 4000), path, Layout(("k",), rows=10))
    count = lambda: len(snapshots.snapshot(spark, path).files())
    assert 8 <= count() <= 16
    snapshots.upsert(numbers(spark, 3900, 4100, 1.0), path)
    snapshots.update_where(spark, path, {"v": F.col("v") + 5}, F.col("k") % 2 == 0)
    snapshots.delete_where(spark, path, F.col("k") < 10)
    values = {"v": changes.source("v")}
    snapshots.merge_into(numbers(spark, 4099, 4101, 9.0), path, "k", matched=values, insert=values | {"k": changes.source("k")})
    assert state(spark, path) == {k: 9.0 if k >= 4099 else (k >= 3900) + 5.0 * (k % 2 == 0) for k in range(10, 4101)} and count() <= 32
    monkeypatch.setattr(snapshots, "ROWS", 20, raising=False)
    snapshots.replace(numbers(spark, 0, 4000), path, Layout(("k",), rows=10))
    assert count() > 200  # buckets are not made larger than that


def test_a_table_without_groups_is_dealt_without_a_product(spark):
    sizes = spark.createDataFrame([("", 4)], "_group string, _buckets int")
    placed = snapshots._placed(snapshots._grouped(numbers(spark, 0, 100), Layout(("k",))), Layout(("k",)), sizes)
    assert placed.count() == 100 and "CartesianProduct" not in placed._jdf.queryExecution().executedPlan().toString()


def test_many_small_files_of_a_bucket_are_put_together(spark, path, monkeypatch):
    monkeypatch.setattr(snapshots, "MANY_FILES", 3)
    snapshots.replace(numbers(spark, 0, 10), path, Layout(("k",)))
    for i in range(1, snapshots.MANY_FILES + 1):
        snapshots.upsert(numbers(spark, 10 * i, 10 * i + 10), path)
    assert len(snapshots.snapshot(spark, path).files()) < snapshots.MANY_FILES and len(state(spark, path)) == 10 * snapshots.MANY_FILES + 10


def test_null_keys_and_odd_groups(spark, path):
    rows = [(None, "x", 1.0), (1, None, 2.0), (None, None, 3.0), (1, 'q"/=x€', 4.0), (2, "", 5.0)]
    table = spark.createDataFrame(rows, "k long, g string, v double")
    snapshots.replace(table, path, Layout(("g", "k"), ("g",)))
    snapshots.upsert(table.withColumn("v", F.col("v") + 10), path)
    got = {(r.k, r.g): r.v for r in snapshots.snapshot(spark, path).read().collect()}
    assert got == {(k, g): v + 10 for k, g, v in rows} and snapshots.snapshot(spark, path).read().count() == 5


def test_merge_update_and_delete(spark, path):
    snapshots.replace(numbers(spark, 0, 1000), path, Layout(("k",), rows=100))
    source = numbers(spark, 995, 1005, 3.0)
    values = {"v": changes.source("v")}
    snapshots.merge_into(source, path, "k", matched=values, insert=values | {"k": changes.source("k")})
    assert state(spark, path) == {k: 3.0 * (k >= 995) for k in range(1005)}
    files = set(snapshots.snapshot(spark, path).files())
    snapshots.update_where(spark, path, {"v": F.col("v") + 1}, F.col("k") == 3)
    assert len(files - set(snapshots.snapshot(spark, path).files())) == 1
    assert snapshots.delete_where(spark, path, F.col("k") > 10_000) == snapshots.versions(spark, path)[-1]  # nothing to do, no version
    snapshots.delete_where(spark, path, F.col("k") >= 500)
    snapshots.merge_into(source, path, "k", insert=values | {"k": changes.source("k")}, missing=changes.DELETE)
    assert state(spark, path) == dict.fromkeys(range(995, 1005), 3.0)
    with pytest.raises(ValueError):
        snapshots.update_where(spark, path, {"k": F.lit(1)}, F.lit(True))
    with pytest.raises(ValueError):
        Layout(("k",), ("g",))


def test_one_of_many_puts_a_file(spark, tmp_path):
    made, start = [], threading.Barrier(8)

    def put(i):
        start.wait()
        made.append((snapshots.put_if_absent(spark, f"{tmp_path}/log/1.json", str(i)), i))

    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winner = [i for ok, i in made if ok]
    assert len(made) == 8 and len(winner) == 1 and (tmp_path / "log/1.json").read_text() == str(winner[0])
    assert not list((tmp_path / "log").glob("*.tmp"))


def test_writers_of_other_buckets_both_commit_and_of_the_same_one_conflicts(spark, path, monkeypatch):
    layout = Layout(("g", "k"), ("g",))
    rows = lambda g, v: numbers(spark, 0, 10, v).withColumn("g", F.lit(g))
    snapshots.replace(rows("a", 0.0).unionByName(rows("b", 0.0)), path, layout)
    real, others = snapshots._commit, []

    def late(*args):  # another writer commits between this one's reading and committing
        if others:
            monkeypatch.setattr(snapshots, "_commit", real)
            snapshots.upsert(others.pop(), path)
            monkeypatch.setattr(snapshots, "_commit", late)
        return real(*args)

    monkeypatch.setattr(snapshots, "_commit", late)
    others.append(rows("b", 1.0))
    assert snapshots.upsert(rows("a", 2.0), path, times=1) == 3  # on top of the other
    others.append(rows("a", 3.0))
    with pytest.raises(Conflict):
        snapshots.upsert(rows("a", 4.0), path, times=1)
    others.append(rows("a", 5.0))
    snapshots.upsert(rows("a", 6.0).where("k < 5"), path)  # done again from the newest
    got = {(r.g, r.k): r.v for r in snapshots.snapshot(spark, path).read().collect()}
    assert got == {("a", k): 6.0 if k < 5 else 5.0 for k in range(10)} | {("b", k): 1.0 for k in range(10)}


def test_readers_see_whole_versions_while_writers_write(spark, path):
    snapshots.replace(numbers(spark, 0, 200, 0.0), path, Layout(("k",), rows=50))
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            seen.append({(r.n, r.least, r.most) for r in snapshots.snapshot(spark, path).read().agg(F.count("k").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()})

    reader = threading.Thread(target=look)
    reader.start()
    for i in range(1, 3):
        snapshots.upsert(numbers(spark, 0, 200, float(i)), path)
    stop.set()
    reader.join()
    assert seen and all(len(s) == 1 and n == 200 and least == most for s in seen for n, least, most in s)


def test_a_crash_before_the_pointer_changes_nothing(spark, path, monkeypatch):
    snapshots.replace(numbers(spark, 0, 10), path, Layout(("k",)))

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(snapshots, "put_if_absent", crash)
    with pytest.raises(OSError, match="lost"):
        snapshots.upsert(numbers(spark, 0, 10, 1.0), path)
    monkeypatch.undo()
    assert state(spark, path) == dict.fromkeys(range(10), 0.0) and snapshots.versions(spark, path) == [1]
    assert snapshots.vacuum(spark, path) == 1 and state(spark, path) == dict.fromkeys(range(10), 0.0)  # the lost writer's file
    with pytest.raises(ValueError):
        snapshots.snapshot(spark, path, 7)
    with pytest.raises(ValueError):
        snapshots.snapshot(spark, path + "-none")


def test_empty_tables(spark, path):
    snapshots.replace(numbers(spark, 0, 0), path, Layout(("k",)))
    assert state(spark, path) == {}
    snapshots.upsert(numbers(spark, 0, 3), path)
    snapshots.delete_where(spark, path, F.lit(True))
    assert state(spark, path) == {} and len(snapshots.versions(spark, path)) == 3


def test_batches_of_a_stream_are_upserted(spark, tmp_path, path):
    source = str(tmp_path / "in")
    for i in range(3):
        numbers(spark, 50 * i, 50 * i + 100, float(i)).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 2).parquet(source)
        live.into_table(stream, path, Layout(("k",), rows=50), str(tmp_path / "state"))
    assert state(spark, path) == {k: float(min(k // 50, 2)) for k in range(200)}
