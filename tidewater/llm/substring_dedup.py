"""Removal of long repeated passages over a compacted De Bruijn graph of word k-mers.

A window of k consecutive words is an edge of the graph. Writing every edge would shuffle as many rows
as the corpus has words, so edges are kept compacted: all consecutive windows of a document with the
same minimizer (the smallest hash of their m-word runs, leftmost) form one path. Equal windows have
equal minimizers, so a Spark join by minimizer brings together all paths that can share an edge:

* paths that are equal word for word are one nonbranching path with several places; all its windows repeat;
* where one minimizer has several different paths, the path branches there; one copy of each is
  opened into its windows, and the windows that stand in two paths repeat.

A second hash, of other word values and another base, taken from the words at a path's own place in
its source, verifies every match of a path or a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, row_key, split_join, stash

#: Odd multipliers of the rolling hashes and of the mixing step, modulo 2^64.
ROLL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = 0xBF58476D1CE4E5B9
#: Windows of a path that a mask can mark.
MASK_BITS = 62
#: Words whose hashes a task holds at once.
BATCH_WORDS = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def _upper(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Rolling:
    """Hashes of any run of a list of words, from prefix sums of word hashes times powers of an odd number."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        one = np.ones(1, np.uint64)
        self.inverse = np.cumprod(np.concatenate([one, np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
        powers = np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words ^ np.uint64(base)) * powers[:n])])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def paths_of(words: np.ndarray, doc: np.ndarray, k: int, m: int):
    """(document, start, windows, minimizer, content, check) of the compacted paths of several documents.

    ``words``: word hashes of the documents one after another; ``doc``: each word's document, not
    falling. start counts from the document's first word; content and check are hashes of all words
    of the path's windows.
    """
    n, width = len(words), k - m + 1
    first = np.searchsorted(doc, doc)
    if n < k:
        return (np.zeros(0, np.int64),) * 6
    a, b = Rolling(words, ROLL[0]), Rolling(words, ROLL[1])
    at = np.arange(n - m + 1)
    low, place, have = a.runs(at, at + m), at, 1
    while have < width:  # the least of twice as many neighbours, or of the rest
        step = min(have, width - have)
        size = len(low) - step
        take = low[:size] <= low[step:]
        low, place = np.where(take, low[:size], low[step:]), np.where(take, place[:size], place[step:])
        have += step
    low, place = low[: n - k + 1], place[: n - k + 1]
    whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 6
    new = np.ones(len(whole), bool)
    new[1:] = (place[whole[1:]] != place[whole[:-1]]) | (doc[whole[1:]] != doc[whole[:-1]])
    start = whole[new]
    windows = np.diff(np.append(np.flatnonzero(new), len(whole)))
    end = start + windows + k - 1
    return doc[start], start - first[start], windows, low[start], a.runs(start, end), b.runs(start, end)


def _parts(batch, column: int):
    """(first row, texts' words) over slices of a batch with a bounded number of words."""
    first, part, held = 0, [], 0
    for i, t in enumerate(as_bytes(batch.column(column))):
        part.append(t.split())
        held += len(part[-1])
        if held >= BATCH_WORDS:
            yield first, part
            first, part, held = i + 1, [], 0
    if part:
        yield first, part


def _joined(part: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    words = np.concatenate([_word_hashes(w) for w in part]) if part else np.zeros(0, np.uint64)
    return words, np.repeat(np.arange(len(part)), [len(w) for w in part])


def compact_paths(docs: DataFrame, k: int, m: int, text_col: str) -> DataFrame:
    """(_k1, _k2, start, windows, minimizer, content, check) for every path of ``docs`` (columns _k1, _k2, text)."""

    def scan(batches):
        for batch in batches:
            keys = [batch.column(0).to_numpy(), batch.column(1).to_numpy()]
            for first, part in _parts(batch, 2):
                doc, start, windows, *hashes = paths_of(*_joined(part), k, m)
                row = doc + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[0][row]), pa.array(keys[1][row]), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), *(pa.array(h.astype(np.uint64).view(np.int64)) for h in hashes[:2]), pa.array(_upper(hashes[2].astype(np.uint64)))],
                    ["_k1", "_k2", "start", "windows", "minimizer", "content", "check"],
                )

    kinds = "_k1 long, _k2 long, start int, windows int, minimizer long, content long, check int"
    return docs.select("_k1", "_k2", text_col).mapInArrow(scan, kinds)


def open_paths(docs: DataFrame, k: int) -> DataFrame:
    """(content, check, offset, edge, edge_check) for each window of the listed paths.

    ``docs``: doc_id, text and ``paths``, an array of structs (content, check, start, windows).
    """

    def scan(batches):
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for first, part in _parts(batch, 1):
                words, _ = _joined(part)
                a, b = Rolling(words, ROLL[0]), Rolling(words, ROLL[1])
                base = np.cumsum([0, *map(len, part)])
                paths = [(int(base[i]), p) for i in range(len(part)) for p in lists[first + i]]
                if not paths:
                    continue
                n = np.array([p["windows"] for _, p in paths])
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.array([x + p["start"] for x, p in paths]), n) + offset
                named = [np.repeat(np.array([p[c] for _, p in paths], t), n) for c, t in (("content", np.int64), ("check", np.int32))]
                edges = [a.runs(at, at + k).view(np.int64), _upper(b.runs(at, at + k))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, named), pa.array(offset, pa.int32()), *map(pa.array, edges)], ["content", "check", "offset", "edge", "edge_check"])

    return docs.select("doc_id", "text", "paths").mapInArrow(scan, "content long, check int, offset int, edge long, edge_check int")


def remove_repeats(docs: DataFrame, k: int = 35, m: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (the kept words joined by one space), spans (start, end of what was removed).

    A word goes if some window of ``k`` words over it also starts at another place in any document.
    A null, empty or short text has no windows; equal rows are each other's repeats; null and repeated
    ids are allowed; an empty table gives no rows. ``m``: words of a minimizer; more are taken where a
    path could have more windows than a mask has bits.
    """
    m = max(m, k - MASK_BITS + 1)
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    paths = compact_paths(keyed, k, m, "text")
    again = paths.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("minimizer")
    paths = stash(split_join(paths, again, ["minimizer"], "left_semi"), "paths")
    path = ["content", "check"]
    distinct = stash(paths.groupBy(*path).agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("_k1", "_k2", "start", "windows")).alias("one"), F.first("minimizer").alias("minimizer")), "distinct")
    branching = distinct.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("minimizer")
    opened = split_join(distinct, branching, ["minimizer"], "left_semi").select(*path, "one.*")
    by_row = opened.groupBy("_k1", "_k2").agg(F.collect_list(F.struct(*path, "start", "windows")).alias("paths"))
    # The same columns of the documents go into both joins, so that Spark deals out the texts once and reuses them.
    edges = open_paths(keyed.join(by_row, ["_k1", "_k2"]), k)
    repeated = edges.groupBy("edge", "edge_check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("edge", "edge_check")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("offset"))
    marks = split_join(edges, repeated, ["edge", "edge_check"], "left_semi").groupBy(*path).agg(F.bit_or(bit).alias("mask"))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("one.windows")) - 1
    marked = distinct.join(marks, path, "left").select(*path, F.when(F.col("places") > 1, full).otherwise(F.col("mask")).alias("mask")).where("mask is not null")
    found = split_join(paths.select("_k1", "_k2", "start", *path), marked, path).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))  # a set: equal rows bring equal marks
    return _without(keyed.join(found, ["_k1", "_k2"], "left"), k, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("doc_id", id_col)


def _without(docs: DataFrame, k: int, id_type: str) -> DataFrame:
    """Texts without the words under the marked windows."""

    def cut(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, marks in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                depth = np.zeros(len(words) + 1, np.int64)
                if marks:
                    start = np.array([x["start"] for x in marks], np.int64)
                    bits = np.array([x["mask"] for x in marks], np.int64)[:, None] >> np.arange(63) & 1
                    at = np.unique((start[:, None] + np.arange(63))[bits == 1])
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + k, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                kept, last = [], 0
                for a, b in [*spans, (len(words), 0)]:
                    kept += words[last:a]
                    last = b
                for x, v in zip(out, (len(words), int(gone.sum()), b" ".join(kept).decode(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3], span)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return docs.select("doc_id", "text", "marks").mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept string, spans array<struct<start: bigint, end: bigint>>")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without repeats of 35 words; nulls and short texts stay as they are."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with d as (
    select doc_id as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
s as materialized (select r, i, sha256(array_to_string(w[i : i + 34], ' ')) as h from places),
twice as materialized (select h from s group by h having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as p from s where h in (from twice)),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as materialized (
    select r, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join gone using (r, p) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
"""
