"""Operators on small tables: NULLs, empty input, ties, every merge branch, feeds, streams, resuming."""

import itertools
import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import predicates as P
from tidewater.functions import scalars as S
from tidewater.operators import changes, constraints, relational, timeseries
from tidewater.sources import feeds, schemas, tables
from tidewater.streaming import incremental, live


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# predicates


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")


@pytest.mark.parametrize(
    "operator,value,kept",
    [("=", 2, [2]), ("<>", 2, [1, 3]), (">", 1, [2, 3]), ("<", 2, [1]), (">=", 2, [2, 3]), ("<=", 2, [1, 2]), ("IN", [1, 3], [1, 3]), ("NOT IN", [1, 3], [2]), ("BETWEEN", (2, 3), [2, 3]), ("IS NULL", None, [None]), ("is not null", None, [1, 2, 3])],
)
def test_predicates(numbers, operator, value, kept):
    assert [r.v for r in P.where_all(numbers, P.predicate("v", operator, value)).collect()] == kept


def test_unknown_operator_raises(numbers):
    with pytest.raises(ValueError, match="unknown operator"):
        P.predicate("v", "~=", 1)
    assert P.where_all(numbers).count() == 4 and P.where_all(numbers, []).count() == 4


@pytest.mark.parametrize("values", [[], [2], [1, 2], [2, None], [None]])
@pytest.mark.parametrize("operator", ["=", "<>", ">", ">=", "<", "<="])
def test_quantified(spark, numbers, values, operator):
    import operator as o

    test = {"=": o.eq, "<>": o.ne, ">": o.gt, ">=": o.ge, "<": o.lt, "<=": o.le}[operator]
    table = spark.createDataFrame([(v,) for v in values], "x int")
    truth = lambda v, x: None if v is None or x is None else test(v, x)
    some = [v for v in (1, 2, 3, None) if any(truth(v, x) for x in values)]
    every = [v for v in (1, 2, 3, None) if all(truth(v, x) for x in values)]
    assert sorted(map(repr, (r.v for r in P.compare_any(numbers, "v", operator, table, "x").collect()))) == sorted(map(repr, some))
    assert sorted(map(repr, (r.v for r in P.compare_all(numbers, "v", operator, table, "x").collect()))) == sorted(map(repr, every))


def test_limits(numbers):
    assert relational.select(numbers, order=["v"], limit=0).count() == 0
    for bad in ({"limit": -1, "order": ["v"]}, {"limit": 1}):
        with pytest.raises(ValueError, match="limit"):
            relational.select(numbers, **bad)
    with pytest.raises(ValueError, match="cross"):
        relational.join(numbers, numbers, "cross", "v", "v")


# changes


@pytest.mark.parametrize("matched,insert,missing", list(itertools.product((None, "update", "delete"), (None, "insert"), (None, "update", "delete"))))
def test_merge_branches(spark, matched, insert, missing):
    target, source = {"a": 1, "b": 2, None: 3}, {"b": 20, "c": 30, None: 40}
    t = spark.createDataFrame(list(target.items()), "k string, v int")
    s = spark.createDataFrame(list(source.items()), "k string, w int")
    action = {None: None, "update": {"v": changes.source("w")}, "delete": changes.DELETE}
    last = {None: None, "update": {"v": F.lit(-1)}, "delete": changes.DELETE}[missing]
    new = {"k": changes.source("k"), "v": changes.source("w")} if insert else None
    if not (matched or insert or missing):
        with pytest.raises(ValueError, match="action"):
            changes.merge(t, s, "k", action[matched], new, last)
        return
    expected = []
    for k, v in target.items():
        hit = k is not None and k in source
        how = matched if hit else missing
        if how != "delete":
            expected.append((k, v if how is None else source[k] if hit else -1))
    expected += [(k, w) for k, w in source.items() if insert and (k is None or k not in target)]
    assert rows(changes.merge(t, s, "k", action[matched], new, last), "k", "v") == sorted(expected, key=repr)


def test_merge_refuses_or_reduces_repeated_keys(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    s = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("b", 7, 1)], "k string, w int, at int")
    with pytest.raises(ValueError, match="repeats"):
        changes.merge(t, s, "k", matched={"v": changes.source("w")})
    merged = changes.merge(t, s, "k", {"v": changes.source("w")}, {"k": changes.source("k"), "v": changes.source("w")}, repeats="latest", latest_by="at")
    assert rows(merged, "k", "v") == [("a", 6), ("b", 7)]


@pytest.mark.parametrize("once", [False, True])
def test_refresh_of_securities(spark, once):
    now, old = datetime(2024, 5, 1), datetime(2024, 1, 1)
    base = lambda i, s, gone: (i, s, s.lower(), s.lower(), None, None, 1, None, old, None, gone)
    table = spark.createDataFrame([base(1, "AAA", None), base(2, "CCC", None), base(3, "DDD", old), base(7, "EEE", old)], schemas.SECURITY)
    staged = spark.createDataFrame([(None, s, "new " + s, "n", 2, now) for s in ("AAA", "BBB", "EEE")], schemas.STAGED_SECURITY)
    after = {r.Symbol: r for r in changes.refresh_securities(table, staged, F.lit(now), once).collect()}
    assert after["AAA"].Name == "new AAA" and after["AAA"].UpdateDate == now and after["AAA"].CreateDate == old
    assert (after["BBB"].ID, after["BBB"].CreateDate, after["BBB"].Market_ID) == (8, now, 2)
    assert after["CCC"].DelistDate == now and after["DDD"].DelistDate == (old if once else now)
    assert after["EEE"].DelistDate == (None if once else old)


def test_identity_follows_the_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).cast("string").alias("name"), "id")
    numbered = changes.with_identity(df, "key", ["name", "id"], 10).collect()
    assert [r.key for r in sorted(numbered, key=lambda r: (r["name"], r.id))] == list(range(11, 511))


def test_update_delete_and_swap(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    assert rows(changes.update(df, {"name": F.lit("y")}, F.col("name") == "x"), "id", "name") == [(1, "y"), (2, None)]
    assert rows(changes.delete(df, F.col("name") == "x"), "id") == [(2,)] and changes.delete(df).count() == 0
    path = f"file://{tmp_path}/t"
    changes.replace_table(df, path)
    changes.replace_table(changes.delete(spark.read.parquet(path), F.col("id") == 1), path)
    assert rows(spark.read.parquet(path), "id") == [(2,)]


# constraints and tables


def test_constraints(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcdef"), (3, None)], "id int, s string")
    good, bad = constraints.split_valid(df, ["s"], {"s": 5})
    assert rows(good, "id") == [(1,)] and rows(bad, "id", F.concat_ws(",", "violations")) == [(2, "s is longer than 5"), (3, "s is null")]
    parent = spark.createDataFrame([(1,)], "k int")
    assert rows(constraints.orphans(df.select(F.nullif("id", F.lit(3)).alias("id")), "id", parent, "k"), "id") == [(2,)]


def test_catalog_tables(spark):
    made = tables.create_database(spark, "tide_test")
    before = tables.use_database(spark, "tide_test")
    try:
        for name in ("security", "market"):
            spark.sql(f"drop table if exists {name}")
        tables.create_table(spark, "market", schemas.MARKET, "ID")
        with pytest.raises(ValueError, match="exists"):
            tables.create_table(spark, "market", schemas.MARKET, "ID")
        with pytest.raises(ValueError, match="refers"):
            tables.create_table(spark, "security", schemas.SECURITY, "ID", {"Market_ID": ("nothing", "ID")})
        tables.create_table(spark, "security", schemas.SECURITY, "ID", {"Market_ID": ("market", "ID")})
        now = F.lit("2024-01-01").cast("timestamp")
        assert tables.append_counted(tables.seed_markets(spark, now).select("Symbol", "ID", "Name", "EnName", "CreateDate", "UpdateDate", "DeleteDate"), "market") == 5
        assert rows(tables.scan(spark, "market"), "ID", "Symbol")[0] == (1, "HNX") and tables.seed_security_types(spark, now).count() == 7
        with pytest.raises(ValueError, match="differ"):
            tables.append(spark.range(1), "market")
        assert tables.purge(spark, ["market", "security"], {"security": ["market"]}) == ["security", "market"]
        assert tables.scan(spark, "market").count() == 0
    finally:
        for name in ("security", "market"):
            if tables.table_exists(spark, name):
                tables.drop(spark, name)
        tables.use_database(spark, before)
        spark.sql("drop database tide_test")
    assert made


# series

SERIES = [1, 2, 8, 10, 0, 4]


@pytest.fixture(scope="module")
def points(spark):
    listed = [("m", i, v) for i, v in enumerate(SERIES)]
    return spark.createDataFrame(listed, "name string, i int, v int").withColumn("time", (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_interval(secs=10 * F.col("i"))))


@pytest.mark.parametrize("function,value", [("mean", 25 / 6), ("sum", 25), ("count", 6), ("median", 3.0), ("min", 0), ("max", 10), ("spread", 10), ("first", 1), ("last", 4)])
def test_aggregates(points, function, value):
    assert timeseries.aggregate(points, ["name"], "v", function, ["time"], "x").first().x == pytest.approx(value)
    nothing = timeseries.aggregate(points.limit(0), ["name"], "v", function, ["time"])
    assert nothing.count() == 0


def test_changes_of_a_series(points):
    rate = timeseries.derivative(points, ["name"], "time", "v").orderBy("i").collect()
    assert [r.derivative for r in rate] == [None, *map(pytest.approx, (0.1, 0.6, 0.2, -1.0, 0.4))]
    assert timeseries.derivative(points, ["name"], "time", "v", nonnegative=True).orderBy("i").collect()[4].derivative is None
    assert [r.increase for r in timeseries.increase(points, ["name"], ["time"], "v").orderBy("i").collect()] == [0, 1, 7, 9, 9, 13]
    assert [r.v for r in timeseries.sorted_places(points, ["name"], "v", ["i"]).orderBy("place").collect()] == sorted(SERIES)
    same = points.unionByName(points)
    assert timeseries.derivative(same, ["name"], "time", "v", tie=["i"]).where("derivative is null").count() == 7  # no rate between equal times


def test_long_and_wide(points):
    long = timeseries.to_long(points, ["i"], ["v"])
    assert rows(timeseries.to_wide(long, ["i"], ["v"]), "i", "v") == rows(points.select("i", F.col("v").cast("double")), "i", "v")


def test_regular_times(spark):
    assert timeseries.regular_times(spark, "2025-01-01 00:00:00", "2025-01-01 01:00:00", "5 minutes").count() == 13


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9))), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9))))
def test_upsert_is_idempotent(spark, a, b):
    old = timeseries.upserted(spark.createDataFrame([], "k int, v int"), spark.createDataFrame(a, "k int, v int"), ["k"])
    new = spark.createDataFrame(b, "k int, v int")
    once = timeseries.upserted(old, new, ["k"])
    assert rows(once, "k", "v") == rows(timeseries.upserted(once, new, ["k"]), "k", "v")
    assert {r.k for r in once.collect()} == {k for k, _ in a + b}


def test_points_are_upserted_by_month(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    make = lambda xs: spark.createDataFrame([("p", s, datetime(2024, m, 1), v) for s, m, v in xs], "measurement string, symbol string, time timestamp, close int")
    keys = ["measurement", "symbol", "time"]
    assert not timeseries.points_exist(spark, path)
    timeseries.upsert_points(make([("a", 1, 1), ("b", 1, 2), ("a", 2, 3)]), path, keys)
    for _ in range(2):
        timeseries.upsert_points(make([("a", 1, 10), ("c", 1, 4)]), path, keys)
    assert rows(timeseries.read_points(spark, path, "p"), "symbol", F.month("time"), "close") == [("a", 1, 10), ("a", 2, 3), ("b", 1, 2), ("c", 1, 4)]
    with pytest.raises(ValueError, match="no points"):
        timeseries.upsert_points(make([]), path, keys)


# feeds


def test_feeds(spark, tmp_path):
    item = lambda **x: {"Symbol": "FPT", "TradingDate": "24/12/2024", "ClosePrice": "12.9", **x}
    pages = [{"message": "ok", "status": 200, "totalRecord": 0, "data": None}, {"data": [item(), item(ClosePrice="-12.9"), item(ClosePrice="abc"), item(TradingDate="2024-12-31"), item(OpenPrice="NaN"), item(PerPriceChange="1.25", OpenPrice=None)]}]
    for i, p in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps(p))
    good, bad = feeds.typed(feeds.items(feeds.read_pages(spark, f"file://{tmp_path}", "daily_prices"), "daily_prices"), "daily_prices")
    assert sorted(r.ClosePrice for r in good.collect()) == [-12, 12, 12] and sorted(r.faults[0] for r in bad.collect()) == ["ClosePrice", "OpenPrice", "TradingDate"]
    points = feeds.price_points(good)
    assert len(points.columns) == 31 and points.where("per_price_change = 1.25").first().time == datetime(2024, 12, 24)
    with pytest.raises(ValueError, match="empty"):
        feeds.required(bad.limit(0), "securities")


@pytest.mark.parametrize("feed", sorted(schemas.ITEMS))
def test_every_feed_reads_its_page(spark, tmp_path, feed):
    inner = {"details": {"RepeatedinfoList": [{"Isin": "i", "Symbol": "A", "ListedShare": "5"}, {"Symbol": "B"}]}, "index_components": {"IndexComponent": [{"Isin": "i", "StockSymbol": "A"}, {"StockSymbol": "B"}]}}.get(feed, {})
    item = {"Symbol": "A", "TradingDate": "01/02/2024", "Exchange": "X", **inner}
    (tmp_path / "p.json").write_text(json.dumps({"totalRecord": 1, "data": [{k: v for k, v in item.items() if not inner or k != "Symbol"}]}))
    (tmp_path / "q.json").write_text(json.dumps({"totalRecord": 0, "data": []}))
    read = feeds.items(feeds.read_pages(spark, f"file://{tmp_path}", feed), feed)
    good, bad = feeds.typed(read, feed)
    assert good.count() == (2 if inner else 1) and bad.count() == 0
    if "TradingDate" in good.columns:
        assert good.first().TradingDate == datetime(2024, 2, 1)


def test_markets_of_a_feed(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    listed = spark.createDataFrame([(m, f"S{i}", "n", "e") for i, m in enumerate(("hose", "DERIVATIVES", "DER", "XYZ", None))], "Market string, Symbol string, StockName string, StockEnName string")
    staged, rejected = feeds.staged_securities(listed, tables.seed_markets(spark, now), now)
    assert rows(staged, "Symbol", "Market_ID") == [("S0", 2), ("S1", 4), ("S2", 4)] and rows(rejected, "Symbol") == [("S3",), ("S4",)]


def test_scalars(spark):
    row = spark.sql("select timestamp'2025-01-01 12:00:00.5' as t, '2024-12-31' as d").select(
        S.to_second(F.col("t")).alias("second"), S.iso_to_day_text(F.col("d")).alias("day"), S.utc_text(F.col("t"), "Asia/Ho_Chi_Minh").alias("utc"), S.pages(F.lit(101), 50).alias("pages"), S.label(F.lit("ato"), schemas.SESSIONS).alias("label")
    ).first()
    assert tuple(row) == (datetime(2025, 1, 1, 12), "31/12/2024", "2025-01-01T05:00:00Z", 3, "Opening Call Auction")


# incremental work and streams


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 4), st.integers(0, 3))
def test_resume_covers_the_rest(spark, window, symbol):
    work = incremental.work_list(spark.createDataFrame([(f"s{i}",) for i in range(4)], "s string"), "s", "2020-02-01", "2020-06-10")
    listed = sorted((r.window_start, r.symbol) for r in work.collect())
    assert len(listed) == 20 and [w for w, _ in listed[::4]][:4] == [datetime(2020, 2, 1), datetime(2020, 3, 2), datetime(2020, 4, 1), datetime(2020, 5, 1)]
    at = listed[4 * window + symbol]
    empty = spark.createDataFrame([], schemas.CHECKPOINT)
    checkpoint = incremental.save_checkpoint(incremental.save_checkpoint(empty, "2020-02-01", "s0"), str(at[0]), at[1])
    assert checkpoint.count() == 1
    assert sorted((r.window_start, r.symbol) for r in incremental.resume(work, checkpoint).collect()) == listed[4 * window + symbol :]
    assert incremental.resume(work, empty).count() == 20


def test_messages(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    line = lambda c, s, t, p: json.dumps({"channel": c, "symbol": s, "ts": f"2024-01-01T{t}Z", "price": p, "volume": 1})
    (source / "a.json").write_text("\n".join([line("X", "a", "00:00:01", 1.0), line("X", "a", "00:00:01", 1.0), "{broken", line("Y", "b", "00:00:02", 2.0)]))
    channels, rejected = ["X"], []

    def work(batch, _):
        good, bad = live.split_corrupt(batch)
        rejected.extend(r._corrupt_record for r in bad.collect())
        wanted = live.subscribed(good, spark.createDataFrame([(c,) for c in channels], "channel string"))
        points = wanted.select(F.lit("tick").alias("measurement"), "symbol", F.col("ts").alias("time"), "price")
        timeseries.upsert_points(points, out, ["measurement", "symbol", "time"])

    run = lambda: live.each_batch(live.messages(spark, f"file://{source}"), work, f"file://{tmp_path}/state")
    run()
    channels[:] = ["Y"]
    (source / "b.json").write_text("\n".join([line("X", "c", "00:00:03", 3.0), line("Y", "b", "00:00:04", 4.0)]))
    run()
    assert rows(spark.read.parquet(out), "symbol", "price") == [("a", 1.0), ("b", 4.0)] and rejected == ["{broken"]


def test_late_rows_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda t: json.dumps({"channel": "X", "symbol": "a", "ts": f"2024-01-01T{t}Z", "price": 1.0, "volume": 1})
    closed = []
    for i, times in enumerate((["00:01:00", "01:30:00"], ["00:02:00", "03:00:00"], ["05:00:00"])):
        (source / f"{i}.json").write_text("\n".join(map(line, times)))
        counted = live.tumbling(live.on_channel(live.messages(spark, f"file://{source}"), "X"), "ts", "1 hour", "10 minutes", ["symbol"], [F.count(F.lit(1)).alias("n")])
        live.each_batch(counted, lambda batch, _: closed.extend((r.window_start.hour, r.n) for r in batch.collect()), f"file://{tmp_path}/state")
    assert sorted(closed) == [(0, 1), (1, 1), (3, 1)]


# what the registered queries name too, on small tables with NULLs, ties and empty input


def test_records_and_pages(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, None, 1.0), (3, "c", 1.0)], "id int, s string, v double")
    assert relational.key_first(df, "v").columns == ["v", "id", "s"]
    assert relational.renamed(df, {"s": "name", "id": "key"}).collect()[1].asDict() == {"name": None, "key": 2}
    assert df.limit(0).transform(lambda d: relational.renamed(d, {"s": "name"})).columns == ["name"]
    first = relational.page_after(df, ["v", "id"], None, 2).collect()
    assert [r.id for r in first] == [2, 3] and [r.id for r in relational.page_after(df, ["v", "id"], (1.0, 3), 2).collect()] == [1]
    assert relational.page_after(df, ["v", "id"], (3.0, 1), 2).count() == 0


def test_active_and_now(spark):
    df = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 1))], "id int, DelistDate timestamp")
    assert rows(df.where(P.active()), "id") == [(1,)] and df.limit(0).where(P.active()).count() == 0
    now = spark.range(1).select(S.now_to_second().alias("now")).first().now
    assert now.microsecond == 0 and abs((datetime.now() - now).total_seconds()) < 86400 * 2


def test_points_from_maps(spark):
    listed = [("m", {"user": "u"}, {"v": 1.5}, datetime(2024, 1, 1)), ("m", {}, {"w": 2.0}, None), ("m", None, None, None)]
    points = spark.createDataFrame(listed, "measurement string, tags map<string, string>, fields map<string, double>, time timestamp")
    assert rows(timeseries.from_maps(points, ["user"], ["v"]), "user", "v") == sorted([("u", 1.5), (None, None), (None, None)], key=repr)
    assert timeseries.from_maps(points.limit(0), ["user"], ["v"]).columns == ["measurement", "user", "time", "v"]


def test_price_faults(spark):
    price = lambda i, h, lo, o, c: (i, h, lo, o, c)
    df = spark.createDataFrame([price(1, 5, 1, 2, 3), price(2, 1, 5, 2, 3), price(3, 5, 1, 9, 3), price(4, 5, 1, 2, None)], "id int, highest_price int, lowest_price int, open_price int, close_price int")
    assert {r.test: r.n for r in constraints.report(df, constraints.price_faults()).collect()} == {"high below low": 1, "close outside": 1, "open outside": 2}
    assert rows(constraints.any_violation(df, constraints.price_faults()), "id") == [(2,), (3,)]
    assert {r.n for r in constraints.report(df.limit(0), constraints.price_faults()).collect()} == {0}


def test_sinks_of_messages(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda s, p: json.dumps({"channel": "X", "symbol": s, "ts": "2024-01-01T00:00:01Z", "price": p, "volume": 1})
    (source / "a.json").write_text("\n".join([line("a", 1.0), line("a", 1.0), line("b", 2.0), "{"]))
    stream = lambda: live.messages(spark, f"file://{source}")
    assert sorted((r.symbol or "", r._batch) for r in live.drain(stream().select("symbol")).collect()) == [("", 0), ("a", 0), ("a", 0), ("b", 0)]
    out, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    for again in range(2):
        points = live.on_channel(stream(), "X").select(F.lit("tick").alias("measurement"), "symbol", F.col("ts").alias("time"), "price")
        live.into_points(points, out, ["measurement", "symbol", "time"], f"{state}{again}")
    assert rows(spark.read.parquet(out), "symbol", "price") == [("a", 1.0), ("b", 2.0)]


@pytest.mark.parametrize("small", [0, 1 << 17], ids=["bracketed", "grouped"])
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=40))
def test_medians_of_small_series(spark, monkeypatch, small, listed):
    import statistics

    monkeypatch.setattr(timeseries, "SMALL_SERIES", small)

    df = spark.createDataFrame(listed, "k string, v int")
    got = {r.k: r.m for r in timeseries.median(df, ["k"], "v", "m").collect()}
    known = {k: [v for x, v in listed if x == k and v is not None] for k, _ in listed}
    assert got == {k: statistics.median(v) if v else None for k, v in known.items()}


def test_median_of_a_large_series(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "SMALL_SERIES", 1000)
    df = spark.range(100_001).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    assert timeseries.median(df, ["k"], "v").first().median == df.select(F.median("v")).first()[0]
    assert timeseries.median(df, [], "v").first().median == timeseries.median(df, ["k"], "v").first().median


def test_identity_of_keys_with_one_prefix_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(changes, "PER_RANGE", 50)
    df = spark.range(1000).select(F.format_string("Supplier#%09d", F.col("id") * 7919 % 1000).alias("name"), "id")
    numbered = changes.with_identity(df, "key", ["name"], 0)
    assert [r.key for r in numbered.orderBy("name").collect()] == list(range(1, 1001))
    assert changes.with_identity(df.limit(0), "key", ["name"], 5).count() == 0


def test_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from tidewater import scratch

    session = lambda master, shared: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: shared), sparkContext=SimpleNamespace(master=master, applicationId=master))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_dir(session(master, None))
        assert scratch.scratch_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch.scratch_dir(session("local[4]", None)).startswith("file://")
