"""Packing of tokenized documents into sequences by linear grouping.

Pieces longer than ``large`` are sorted by length and cut into groups of equal cardinality; every
length is rounded up to its group's largest. Configurations of these few sizes are chosen by
knapsack and repeated as often as their counts allow; then the actual pieces take the places of the
rounded sizes, and the small pieces go by best fit into what is left of each sequence.

The plan needs only how many pieces there are of each length, at most ``size`` numbers, so the
driver's work does not grow with the corpus. Spark ranks the pieces of each length, and the plan maps
an interval of ranks to sequences and an offset.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import as_bytes, bounded_batches, buckets_for, ranked, stash

#: Words whose ids a worker keeps.
CACHE_WORDS = 1_000_000

#: A space at which a text is not cut.
_INNER_SPACE = re.compile(r" (?=\s|$)")


class _Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes; the ids of words seen before are kept.

    The tokenizer's pattern always ends a piece before a space that another character than white
    space follows, so a text's ids are those of its parts cut there, one after another. New words are
    encoded as one text and told apart by the tokens that begin with a space. A text with one of the
    tokenizer's added tokens in it, such as an end mark, is encoded as a whole, as these cut it first.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        space = self.tokenizer.id_to_token(self.tokenizer.encode(" ", add_special_tokens=False).ids[0])
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(space)]] = True
        self.kept: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        """Ids without the offsets that a plain encoding works out beside them."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def alone(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes() if text else b""

    def learn(self, words: list[str]) -> None:
        if len(self.kept) > CACHE_WORDS:  # what was met first is what is met often
            self.kept = dict(islice(self.kept.items(), CACHE_WORDS // 2))
        plain = [w for w in words if " " not in w]
        ids = np.array(self.encode("".join(" " + w for w in plain)), "<u4")
        at = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
        if len(at) != len(plain) + 1:
            raise ValueError("the tokenizer doesn't cut before spaces")
        self.kept.update((w, ids[a:b].tobytes()) for w, a, b in zip(plain, at, at[1:], strict=False))
        self.kept.update((w, self.alone(" " + w)) for w in words if " " in w)

    def __call__(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self.alone(text)
        first, *rest = text.split(" ")
        if _INNER_SPACE.search(text):
            joined: list[str] = []
            for p in rest:
                if p and not p[0].isspace():
                    joined.append(p)
                elif joined:
                    joined[-1] += " " + p
                else:
                    first += " " + p
            rest = joined
        out = list(map(self.kept.get, rest))
        if None in out:
            self.learn(list(dict.fromkeys(p for p, x in zip(rest, out, strict=True) if x is None)))
            out = [self.kept[p] if x is None else x for p, x in zip(rest, out, strict=True)]
        return self.alone(first) + b"".join(out)


@cache
def _encoder(path: str) -> _Encoder:
    """One for each worker, so that the next task finds the words of the last. Spark has the cores, so the library takes no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and its end id, cut from the back into ``size`` ids.

    Only the first piece may be shorter. A null or empty text is the end id alone. Ids may be null or repeat.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = _encoder(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = encode(text.decode()) + end
                n = len(ids) // 4
                ends = range(n % size or size, n + 1, size)
                for i, to in enumerate(ends):
                    start = max(0, to - size) if i else 0
                    for x, v in zip(rows, (doc_id, i, start, to - start, zlib.crc32(ids[4 * start : 4 * to])), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _configurations(sizes: list[int], counts: list[int], size: int) -> list[tuple[list[int], int]]:
    """(groups of a configuration, how often): the largest size left opens a sequence, a knapsack over the sizes left fills it."""
    counts, made = list(counts), []
    for first in range(len(sizes)):
        while counts[first]:
            left = size - sizes[first]
            counts[first] -= 1
            best = np.zeros(left + 1, np.int64)
            took: list[np.ndarray] = []
            open_ = [g for g in range(first, len(sizes)) if counts[g] and sizes[g] <= left]
            for g in open_:
                s, n = sizes[g], min(counts[g], left // sizes[g])
                use = np.zeros(left + 1, np.int8)
                base = best
                for k in range(1, n + 1):
                    more = np.concatenate([np.full(min(k * s, left + 1), -1), base[: left + 1 - k * s] + k * s])[: left + 1]
                    better = more > best
                    best = np.where(better, more, best)
                    use[better] = k
                took.append(use)
            at, uses = left, {}
            for g, use in zip(reversed(open_), reversed(took), strict=True):
                if k := int(use[at]):
                    uses[g] = k
                    at -= k * sizes[g]
            counts[first] += 1
            uses[first] = uses.get(first, 0) + 1
            times = min(counts[g] // k for g, k in uses.items())
            for g, k in uses.items():
                counts[g] -= k * times
            made.append(([g for g in sorted(uses) for _ in range(uses[g])], times))
    return made


def plan(histogram: dict[int, int], size: int = 2048, groups: int = 400, large: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the pieces of each length go.

    ``groups`` is the number of linear groups and so of sizes in a configuration; ``large`` the least
    length that is grouped, an eighth of ``size`` by default.
    """
    large = large or max(1, size // 8)
    rows: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    next_sequence = 0
    big = sorted((n for n in histogram if n >= large and histogram[n]), reverse=True)
    total = sum(histogram[n] for n in big)
    per_group = max(1, -(-total // groups))
    queues: list[list[list[int]]] = []  # by group: [length, first rank, how many]
    room = 0
    for n in big:
        rank = 0
        while rank < histogram[n]:
            if not room:
                queues.append([])
                room = per_group
            m = min(room, histogram[n] - rank)
            queues[-1].append([n, rank, m])
            rank, room = rank + m, room - m
    sizes, counts = [q[0][0] for q in queues], [sum(x[2] for x in q) for q in queues]
    for config, times in _configurations(sizes, counts, size):
        slots = []
        for g in config:
            runs, need = [], times
            while need:
                n, rank, m = queues[g][0]
                k = min(m, need)
                runs.append((n, rank, k))
                need -= k
                if k == m:
                    queues[g].pop(0)
                else:
                    queues[g][0] = [n, rank + k, m - k]
            slots.append(runs)
        cuts = sorted({0, times, *(int(x) for runs in slots for x in np.cumsum([k for _, _, k in runs]))})
        at = [[0, 0] for _ in slots]  # run of each slot, place in it
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for runs, p in zip(slots, at, strict=True):
                n, rank, k = runs[p[0]]
                rows.append((n, rank + p[1], hi - lo, next_sequence + lo, offset))
                offset += n
                p[1] += hi - lo
                if p[1] == k:
                    p[:] = [p[0] + 1, 0]
            if offset < size:
                free.setdefault(size - offset, []).append((next_sequence + lo, hi - lo))
        next_sequence += times
    spaces = sorted(free)

    def put(space: int, run: tuple[int, int]) -> None:
        if space and run[1]:
            if space not in free:
                insort(spaces, space)
            free.setdefault(space, []).append(run)

    for n in sorted((n for n in histogram if n < large and histogram[n]), reverse=True):
        rank, left = 0, histogram[n]
        while left:
            i = bisect_left(spaces, n)
            if i == len(spaces):
                fresh = -(-left // (size // n))
                put(size, (next_sequence, fresh))
                next_sequence += fresh
                i = bisect_left(spaces, n)
            space = spaces[i]
            sequence, m = free[space].pop()
            if not free[space]:
                del free[space]
                spaces.pop(i)
            fit = space // n
            whole = min(m, left // fit)
            for j in range(fit if whole else 0):
                rows.append((n, rank, whole, sequence, size - space + j * n))
                rank += whole
            left -= whole * fit
            put(space - fit * n, (sequence, whole))
            if whole < m and left:
                for j in range(left):
                    rows.append((n, rank + j, 1, sequence + whole, size - space + j * n))
                put(space - left * n, (sequence + whole, 1))
                rank, left, whole = rank + left, 0, whole + 1
            put(space, (sequence + whole, m - whole))
    return rows


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, groups: int = 400, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 2048) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; see :func:`pieces` and :func:`plan`.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Every piece is placed once,
    offsets are gapless from 0 and no sequence is longer than ``size``. Rows with equal ids and texts
    are placed one by one; an empty table gives no rows. The broadcast plan is bounded by the number
    of lengths and configurations.
    """
    spark = docs.sparkSession
    # The row's number is written with it, so it stays the same and deals equal rows out like others.
    cut = stash(pieces(docs, tokenizer_path, size, end_id, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "pack")
    histogram = {int(n): int(k) for n, k in cut.groupBy("length").count().collect()}
    n_buckets = buckets_for(sum(histogram.values()), per_bucket)
    rows = sorted(plan(histogram, size, groups))
    starts = np.array([(n << 44) + rank for n, rank, *_ in rows], np.int64)
    sequences, offsets = (np.array([x[i] for x in rows], np.int64) for i in (3, 4))
    shared = spark.sparkContext.broadcast((starts, sequences, offsets))
    by_rank = ranked(cut.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(n_buckets))), ["length"], "b", ["doc_id", "piece", "_row"])

    def place(batches):
        starts, sequences, offsets = shared.value
        for batch in batches:
            key = (batch.column("length").to_numpy() << 44) + batch.column("_rank").to_numpy()
            at = np.searchsorted(starts, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[at] + key - starts[at]), pa.array(offsets[at])], [*batch.schema.names[:5], "sequence_id", "offset"])

    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    placed = by_rank.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    return placed.withColumnRenamed("doc_id", id_col)


def op2_grouped_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; nulls and empty texts are their end id, repeated rows are packed each."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
