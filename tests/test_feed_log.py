"""Growing logs as a stream: offsets, spans, rejects, restarts; bars before their window is closed."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewater.sources import snapshots
from tidewater.streaming import feed_log, live


def read_all(reader, start, end):
    return [(b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()) for s in reader.partitions(start, end) for b in reader.read(s) for i in range(b.num_rows)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("span,block", [(1, 3), (7, 4), (64, 1 << 20), (10**6, 16)])
def test_every_whole_line_is_read_once(tmp_path, monkeypatch, seed, span, block):
    monkeypatch.setattr(feed_log, "BLOCK", block)
    rng, reader, at, got, written = random.Random(seed), feed_log.LogReader(str(tmp_path), span), {}, [], {"a.log": b"", "b.log": b""}
    (tmp_path / ".hidden").write_text("x\n")
    (tmp_path / "_part").write_text("x\n")
    for _ in range(6):
        for name in written:
            more = "".join(rng.choice(["é", "ab", "{", "\n", "\n", "x" * 9]) for _ in range(rng.randrange(0, 12))).encode()
            written[name] += more
            (tmp_path / name).write_bytes(written[name])
        end = reader.latestOffset()
        assert end == {n: t.rfind(b"\n") + 1 for n, t in written.items()}
        got += read_all(reader, at, end)
        assert read_all(reader, end, end) == []
        at = end
    expected = []
    for name, text in written.items():
        place = 0
        for line in text.split(b"\n")[:-1]:
            if line.strip():
                expected.append((name, place, line.decode()))
            place += len(line) + 1
    assert sorted(got) == sorted(expected)


def test_a_large_batch_has_longer_spans_and_the_same_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(feed_log, "TASKS", 8, raising=False)
    text = {n: "".join(f"{n}{i}\n" for i in range(k)) for n, k in (("a.log", 3000), ("b.log", 50))}
    for name, lines in text.items():
        (tmp_path / name).write_text(lines)
    reader = feed_log.LogReader(str(tmp_path), 64)
    end = reader.latestOffset()
    spans = reader.partitions({}, end)
    assert len(spans) <= 8 + 2 and max(s.end - s.start for s in spans) == sum(end.values()) // 8  # one more a file
    assert [(f, x) for f, _, x in read_all(reader, {}, end)] == [(n, x) for n, lines in text.items() for x in lines.split()]
    late = {"a.log": end["a.log"] - 100, "b.log": end["b.log"]}
    assert {s.end - s.start for s in reader.partitions(late, end)} == {64, 36}  # a small batch keeps what was asked for
    monkeypatch.setattr(feed_log, "SPAN", 128)
    assert max(s.end - s.start for s in reader.partitions({}, end)) == 128


def test_a_short_span_reads_little_of_its_file(tmp_path):
    log, asked = io.BytesIO(b"0123456\n" * (1 << 18)), []

    def read_at(n, at):
        asked.append(n)
        log.seek(at)
        return log.read(n)

    log.read_at = read_at
    got = [x for _, lines in feed_log._lines(log, feed_log.Span("x", 1 << 10, 1 << 11, False)) for x in lines]
    assert got == ["0123456"] * 128 and sum(asked) <= 1 << 17


def test_logs_that_got_shorter_raise_and_no_folder_has_no_lines(tmp_path):
    reader = feed_log.LogReader(str(tmp_path / "none"), 10)
    assert reader.initialOffset() == {} and reader.latestOffset() == {}
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions({"a": 10}, {"a": 5})


def line(channel, symbol, price):
    return json.dumps({"channel": channel, "symbol": symbol, "ts": "2024-01-01T00:00:00Z", "price": price, "volume": 1}) + "\n"


def test_a_stream_goes_on_at_its_byte(spark, tmp_path):
    logs, out, rejects, state = (str(tmp_path / n) for n in ("logs", "out", "rejects", "state"))
    (tmp_path / "logs").mkdir()
    layout, said, tries = snapshots.Layout(("channel", "symbol"), ("channel",)), [], []
    x = tmp_path / "logs" / "x.log"
    run = lambda **kw: feed_log.into_table(feed_log.feed_log(spark, f"file://{logs}", 40), out, layout, f"file://{rejects}", state, **kw)
    ticks = lambda: {(r.channel, r.symbol): r.price for r in snapshots.snapshot(spark, out).read().collect()}
    x.write_text(line("X", "a", 1.0) + "{broken\n" + line("X", "b", 2.0) + line("X", "c", 3.0)[:20])  # the last one is still being written
    run()
    assert ticks() == {("X", "a"): 1.0, ("X", "b"): 2.0}
    with x.open("a") as log:
        log.write(line("X", "c", 3.0)[20:] + line("X", "a", 9.0) + "[]\n\n")
    (tmp_path / "logs" / "y.log").write_text(line("Y", "a", 5.0) + '{"channel": null}\n')

    def once(batch, number, real=snapshots.upsert):
        tries.append(number)
        if len(tries) == 1:
            raise OSError("broke off")

    feed_log.caught_up(feed_log.feed_log(spark, f"file://{logs}", 40), once, str(tmp_path / "other"), on_error=lambda e: said.append("broke off" in str(e)))
    assert said == [True] and len(tries) >= 2 and tries[0] == tries[1]  # the same batch again
    run()
    run()
    assert ticks() == {("X", "a"): 9.0, ("X", "b"): 2.0, ("X", "c"): 3.0, ("Y", "a"): 5.0}
    counts = {}
    for r in feed_log.reject_counts(spark, rejects).collect():
        counts[r.file] = counts.get(r.file, 0) + r.n
    assert counts == {"x.log": 2, "y.log": 1}

    def always(batch, _):
        raise OSError("down")

    with pytest.raises(Exception, match="down"):
        feed_log.caught_up(feed_log.feed_log(spark, f"file://{logs}"), always, str(tmp_path / "third"), on_error=said.append, attempts=2)
    assert len(said) == 3


def test_bars_before_their_window_is_closed(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add = lambda rows: spark.createDataFrame(rows, "s string, ts string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    bars = lambda: {(r.s, r.window_start.hour): (r.n, r.most) for r in snapshots.snapshot(spark, out).read().collect()}

    def run():
        rows = spark.readStream.schema("s string, ts timestamp, v double").parquet(source)
        live.tumbling_into(rows, "ts", "1 hour", "2 hours", ["s"], [F.count("v").alias("n"), F.max("v").alias("most")], out, state)

    add([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 01:00:00", 5.0)])
    run()
    assert bars() == {("a", 0): (1, 1.0), ("a", 1): (1, 5.0)}  # nothing is closed yet
    add([("a", "2024-01-01 00:20:00", 3.0), ("a", "2024-01-01 09:00:00", 2.0)])  # a late row, and one that closes windows
    run()
    add([("a", "2024-01-01 00:30:00", 9.0)])  # too late
    run()
    assert bars() == {("a", 0): (2, 3.0), ("a", 1): (1, 5.0), ("a", 9): (1, 2.0)}
