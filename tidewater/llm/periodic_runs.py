"""Periodic runs of words: maximal stretches that repeat a short stretch of words several times.

A sparse dynamic program over diagonals. A word that stands ``q`` words after an equal one lengthens the
match of lag ``q`` (its diagonal) by one; where the next word doesn't, the diagonal ends, and if its match
is long enough, the matched words and the ``q`` before them are a run. Earlier occurrences of a frequent
word are many, so an occurrence counts by what follows: at width ``g`` (1, 2, 4 ...) a word's one earlier
occurrence is the nearest with the same ``g`` words from it on, and it speaks for lags above g/2 up to g.

That loses no run. Let a run have smallest period q, g/2 < q <= g, and at least 4q words. Wherever g words of it
begin q words or more after its start, the same words begin q before. They can't begin nearer, as the q words
of one period don't stand in their own repetition at another place than a multiple of q. So the nearest
lag is q at exactly those places, of which there is one at least, and the diagonal's consecutive increments end where the run
ends. It also makes q the smallest period. A text of n words takes n log n steps, whatever repeats in it;
only words whose g words stand twice in the text are looked at with 2g.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, plainly

#: Widths whose lags are told by comparing words directly; a wider one is told by sorting.
NARROW = (1, 2, 4)
#: Words of several texts that are searched at once.
TOGETHER = 1 << 17

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_DDL = "struct<start:bigint,length:bigint,period:bigint>"


def _ended(at: np.ndarray, lag: np.ndarray, g: int) -> list[np.ndarray]:
    """(start, length, period) of the diagonals that places ``at`` with nearest lags between g/2 and g lengthen."""
    held = (lag > g // 2) & (lag <= g) if g > 1 else lag == 1
    at, lag = at[held], lag[held]
    if not len(at):
        return [np.zeros(0, np.int64)] * 3
    begins = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(lag) != 0)])
    last = np.r_[begins[1:], len(at)] - 1
    q = lag[begins]
    return [at[begins] - q, at[last] - at[begins] + g + q, q]


def _nearest_directly(ids: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    lag = np.zeros(len(ids), np.int64)
    for q in range(g, 0, -1):
        same = np.zeros(len(ids), bool)
        same[q:] = ids[q:] == ids[:-q]
        step = 1
        while step < g:  # the g words from here on
            same[: len(ids) - step] &= same[step:]
            same[len(ids) - step :] = False
            step *= 2
        lag[same] = q
    at = np.flatnonzero(lag)
    return at, lag[at]


def _wider(rank: np.ndarray, g: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the 2g words from each place on, given those of g (-1: they stand once); places of the repeated ones in order, and their nearest lags."""
    at = np.flatnonzero(rank >= 0)
    at = at[at + 2 * g <= ends[at]]
    at = at[rank[at + g] >= 0]
    out = np.full(len(rank), -1, np.int64)
    if not len(at):
        return out, at, at
    key = rank[at] * (rank.max() + 1) + rank[at + g]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    place = at[order]
    lag = np.r_[0, np.where(same, np.diff(place), 0)]
    repeated = np.r_[False, same] | np.r_[same, False]
    out[place[repeated]] = np.cumsum(~np.r_[False, same])[repeated] - 1
    full = np.zeros(len(rank), np.int64)
    full[place] = lag
    at = np.flatnonzero(full)
    return out, at, full[at]


def runs_of(ids: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (text, start, length, period), in order, of the runs of ``times`` (2 or more) periods and ``least`` words or more.

    ``ids``: numbers of the words of several texts, one text after the other, none of which shares a number with another.
    """
    if times < 3:
        raise ValueError("a run of fewer than three periods may have no place at the widths looked at")
    found, ends = [], np.repeat(np.cumsum(sizes), sizes)
    longest = int(max(sizes, default=0))
    for g in NARROW:
        found.append(_ended(*_nearest_directly(ids, g), g))
    rank, g = np.where(np.bincount(ids)[ids] > 1, ids, -1) if len(ids) else ids, 1
    while g * times <= longest and (rank >= 0).any():
        rank, at, lag = _wider(rank, g, ends)
        g *= 2
        if g > NARROW[-1]:
            found.append(_ended(at, lag, g))
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = (length >= times * period) & (length >= least)
    start, length, period = start[kept], length[kept], period[kept]
    first = np.cumsum(sizes) - sizes
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    rows = np.stack([text, start - first[text] if len(first) else start, length, period], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def strongest(runs: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) in order the first of the greatest length to period, compared exactly."""
    best = runs[0]
    for r in runs[1:]:
        if int(r[1]) * int(best[2]) > int(best[1]) * int(r[2]):
            best = r
    return best


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    ids, base = np.empty(sum(map(len, texts)), np.int64), 0
    at = 0
    for words in texts:
        own: dict[bytes, int] = {}
        ids[at : at + len(words)] = [own.setdefault(w, len(own)) for w in words]
        ids[at : at + len(words)] += base
        base, at = base + len(own), at + len(words)
    return ids


def _searched(texts: list[list[bytes]], least: int, times: int) -> list[dict]:
    sizes = np.array([len(w) for w in texts], np.int64)
    found = runs_of(_numbered(texts), sizes, least, times)
    bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    out = []
    for words, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        rows, best = found[a:b, 1:], None
        if len(rows):
            best = dict(zip(("start", "length", "period"), strongest(rows).tolist(), strict=True))
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 0] + rows[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        out.append({"runs": [{"start": s, "length": n, "period": q} for s, n, q in rows.tolist()], "strongest": best, "collapsed": b" ".join(words).decode()})
    return out


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``runs`` (start, length, period: words from 0; by start, then period), ``strongest`` (the run of the greatest length to period, then of the smallest start; null without runs), ``collapsed``.

    A run is a stretch of words with smallest period q, ``times`` * q (3 or more times) and ``least`` words or more, that
    no neighbouring word extends. ``collapsed`` is the text with the words of each run after its first q left
    out, joined by one space. Null and empty texts have no runs and an empty ``collapsed``; rows with equal or null
    ids are rows like others; an empty table gives no rows. Each text is searched in one task, without a shuffle,
    in time n log n and memory linear in its words.
    """
    plain, (own, text) = plainly(docs, id_col, text_col)

    def scan(batches):
        for batch in batches:
            ids, pending, held = [], [], 0
            for i, t in zip(batch.column(0), as_bytes(batch.column(1)), strict=True):
                ids.append(i)
                pending.append(t.split())
                held += len(pending[-1])
                if held >= TOGETHER:
                    yield part(ids, pending, batch.column(0).type)
                    ids, pending, held = [], [], 0
            if ids:
                yield part(ids, pending, batch.column(0).type)

    def part(ids, texts, kind):
        found = _searched(texts, least, times)
        columns = [pa.array([i.as_py() for i in ids], kind), pa.array([f["runs"] for f in found], pa.list_(_RUN)), pa.array([f["strongest"] for f in found], _RUN), pa.array([f["collapsed"] for f in found], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "runs", "strongest", "collapsed"])

    bounded_batches(docs.sparkSession)
    kind = plain.schema[own].dataType.simpleString()
    found = plain.select(own, text).mapInArrow(scan, f"id {kind}, runs array<{_RUN_DDL}>, strongest {_RUN_DDL}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, the text of each tenth document by its id's hash made periodic from some word on, as the query asks for.

    Of h = crc32 of the decimal id and g = h div 10, words from a = g % n on repeat the first 1 + (n - a) div (3 + g % 8) of them.
    A null id leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    repeated = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, every tenth of them made periodic; digests of the operator's runs and collapsed texts. Null texts have none."""
    found = periodic_runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.*", F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )  # fmt: skip


#: Every run holds five words that stand ``q`` words after the same five; stretches of these are the runs.
ORACLE = r"""
with recursive step(i, c, k) as (
    select i, i, 0 from range(256) r(i)
    union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
crc as (select list(c order by i) as t from step where k = 8),
hashed as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as w,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i + 1, 1))::bigint)),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h
    from documents, crc),
sized as (select r, doc_id, w, len(w)::bigint as n, h % 10 = 0 and len(w) > 0 as chosen, h // 10 as g from hashed),
placed as (select *, case when chosen then g % n end as a from sized),
d as materialized (
    select r, doc_id, n, case when chosen then w[1 : a] || list_transform(range(0, n - a), lambda i: w[a + i % (1 + (n - a) // (3 + g % 8)) + 1]) else w end as w from placed),
grams as materialized (select r, n, i, hash(w[i : i + 4]) as x, w[i : i + 4] as five from (select r, n, w, unnest(range(1, n - 3)) as i from d where n > 4)),
met as (select b.r, b.i, b.i - a.i as q from grams a join grams b on a.r = b.r and a.x = b.x and a.i < b.i and a.five = b.five where 4 * (b.i - a.i) <= b.n),
islands as (select r, q, min(i) - q - 1 as start, count(*) + 4 + q as length from (select *, i - row_number() over (partition by r, q order by i) as island from met) group by r, q, island),
runs as materialized (select r, start, length, min(q) as q from islands where length >= greatest(6, 4 * q) group by 1, 2, 3),
dropped as (select distinct r, unnest(range(start + q, start + length)) as i from runs),
kept as (
    select r, string_agg(word, ' ' order by i) as text from (select r, unnest(w) as word, unnest(range(0, n)) as i from d) left join (select *, true as gone from dropped) using (r, i) where gone is null group by 1),
best as (select * from runs qualify row_number() over (partition by r order by length::double / q desc, start, q) = 1),
listed as (select r, count(*)::bigint as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as lines from runs group by 1)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.q::bigint as period, (1000 * best.length // best.q)::bigint as exponent_milli,
    sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join listed using (r) left join best using (r) left join kept using (r)
"""
