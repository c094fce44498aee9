"""Language-model scores from a class-based bigram model with exchange clustering.

The probability of a word is that of its class after the class before, times that of the word in its
class. Every word that makes up a given share of the training tokens is assigned to a class by exchange:
it moves to the class in which the class bigrams are likeliest, in rounds over the bigram counts that
Spark gathers from the whole training part. A share of the tokens bounds the number of such words, and
their letters too, at any corpus size; the number itself follows the data. All other words are one
class of their own, the unknown one, which counts as a neighbour like the rest. A document's end is a
word and a class of its own, and the context of the first word.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, stash

#: Distinct words or pairs that a task counts before it hands on.
HELD = 250_000


@dataclass(frozen=True)
class Settings:
    """The model's size, the same for every corpus.

    ``known``: share of the training tokens from which every task holds a word's count, so that it holds
    1 / known words at most; ``clustered``: share from which exchange assigns a word; a word that occurs
    once is in neither; ``classes`` of exchange and ``rounds``; ``emission``, ``transition``: smoothing
    added to a word in its class and to a class after a class.
    """

    known: float = 1e-6
    clustered: float = 4e-6
    classes: int = 64
    rounds: int = 6
    emission: float = 0.5
    transition: float = 16.0

    @property
    def all_classes(self) -> int:
        return 2 + self.classes


#: Classes of a text's end and of all words that exchange doesn't assign; its own follow.
END, UNKNOWN = 0, 1


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves remainder ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over one text column."""

    def count(batches):
        seen: Counter = Counter()
        part = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                seen.update(text.lower().split())
                if len(seen) > HELD:
                    yield part()
                    seen.clear()
        yield part()

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, least: int) -> list[tuple[bytes, int]]:
    """The words that occur ``least`` times or more with their counts, in falling order."""
    found = counts.where(F.col("n") >= least).toArrow()
    return sorted(zip(as_bytes(found.column("word")), found.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _coded_counts(codes_of):
    """mapInArrow function: counts of the codes that ``codes_of(text)`` gives, as (code, n)."""

    def count(batches):
        held: list[np.ndarray] = []

        def part():
            codes, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])

        size = 0
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.append(codes_of(text))
                size += len(held[-1])
                if size > 8 * HELD:
                    yield part()
                    size = 0
        yield part()

    return count


def neighbours(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """(w, o, n): of each listed word the words beside it with their counts, o those after it and -o - 1 those before it.

    Words are numbered from 2, END and UNKNOWN stand for themselves. A row is a word, whose lists are
    bounded by the number of listed words.
    """
    shared = texts.sparkSession.sparkContext.broadcast({w: i + 2 for i, w in enumerate(words)})
    size = len(words) + 2

    def codes(text):
        tokens = text.lower().split()
        at = np.zeros(len(tokens) + 2, np.int64)
        at[1:-1] = np.fromiter(map(shared.value.get, tokens, repeat(UNKNOWN)), np.int64, len(tokens))
        return at[:-1] * size + at[1:]

    return listed(texts.mapInArrow(_coded_counts(codes), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), size)


def listed(counted: DataFrame, size: int) -> DataFrame:
    """Lists of :func:`neighbours` from counts by code; a count that an int can't hold stands in several parts, whose sum it is."""
    most = (1 << 31) - 1
    parts = F.expr(f"transform(sequence(0, (n - 1) div {most}), i -> cast(least(n - i * {most}, {most}) as int))")
    a, b = F.expr(f"cast(code div {size} as int)"), F.expr(f"cast(code % {size} as int)")
    sides = F.array(F.struct(a.alias("w"), b.alias("o")), F.struct(b.alias("w"), (-a - 1).cast("int").alias("o")))
    rows = counted.select("code", F.explode(parts).alias("n")).select(F.explode(sides).alias("x"), "n").select("x.w", F.struct("x.o", "n").alias("y"))
    return rows.groupBy("w").agg(F.collect_list("y").alias("y")).select("w", F.col("y.o").alias("o"), F.col("y.n").alias("n"))


def _g(x: np.ndarray) -> np.ndarray:
    """x log x."""
    return x * np.log(np.maximum(x, 1))


def move_gains(matrix: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: float) -> np.ndarray:
    """What the log-likelihood of class bigrams gains if a word goes from class ``own`` to each class.

    ``after``, ``before``: the word's counts with the class that follows and precedes it; ``itself``:
    how often it follows itself.
    """
    s, p = after.astype(float), before.astype(float)
    m = matrix.astype(float)
    m[own] -= s
    m[:, own] -= p
    m[own, own] += itself
    s[own] -= itself
    p[own] -= itself
    k = np.arange(len(m))
    rows, columns = _g(m + s) - _g(m), _g(m.T + p) - _g(m.T)
    corner = np.diag(m)
    gain = rows.sum(1) - rows[k, k] + columns.sum(1) - columns[k, k] + _g(corner + s + p + itself) - _g(corner)
    left, right = m.sum(1) + p, m.sum(0) + s  # what the word takes along stays in its neighbours' rows
    gain -= _g(left + s.sum() + itself) - _g(left) + _g(right + p.sum() + itself) - _g(right)
    return gain - gain[own]


def _by_class(batch, classes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of :func:`neighbours`: words, their counts by side (after, before) and class, and with themselves."""
    w, o, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
    row = np.repeat(np.arange(len(w)), np.diff(o.offsets.to_numpy()))
    o, n = o.flatten().to_numpy(), n.flatten().to_numpy()
    before = o < 0
    other = np.where(before, -o - 1, o)
    counts = np.bincount((row * 2 + before) * size + classes[other], n, len(w) * 2 * size).reshape(len(w), 2, size)
    itself = np.bincount(row, n * ((other == w[row]) & ~before), len(w))
    return w, counts, itself


def exchange(lists: DataFrame, words: int, settings: Settings) -> np.ndarray:
    """The class of each of ``words`` words, numbered from 2; places 0 and 1 are END and UNKNOWN.

    ``lists``: as of :func:`neighbours`, written. Each round sums the lists by class, weighs the moves of
    half of the words by turns and moves them, all in parallel by word; nothing is shuffled but the class
    matrix. The driver holds the classes and the matrix. The likeliest assignment seen is returned.
    """
    spark, size = lists.sparkSession, settings.all_classes
    classes = np.concatenate([[END, UNKNOWN], 2 + np.arange(words) % settings.classes]).astype(np.int64)
    best, best_score = classes, -np.inf
    for turn in range(settings.rounds + 1):
        shared = spark.sparkContext.broadcast(classes)

        def sums(batches, shared=shared):
            total = np.zeros((size, size))
            for batch in batches:
                w, counts, _ = _by_class(batch, shared.value, size)
                np.add.at(total, shared.value[w], counts[:, 0])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["code", "n"])

        matrix = np.zeros(size * size)
        for r in lists.mapInArrow(sums, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
            matrix[r.code] = r.n
        matrix = matrix.reshape(size, size)
        score = _g(matrix).sum() - _g(matrix.sum(0)).sum() - _g(matrix.sum(1)).sum()
        if score > best_score:
            best, best_score = classes, score
        if turn == settings.rounds:
            break
        base = spark.sparkContext.broadcast((matrix, classes))

        def choose(batches, base=base):
            matrix, classes = base.value
            for batch in batches:
                w, counts, itself = _by_class(batch, classes, size)
                moved, to = [], []
                for i, x in enumerate(w):
                    gain = move_gains(matrix, classes[x], *counts[i], itself[i])
                    gain[[END, UNKNOWN]] = -np.inf
                    if gain.max() > 1e-6:
                        moved.append(x)
                        to.append(gain.argmax())
                yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), pa.array(to, pa.int32())], ["w", "to"])

        turns = lists.where((F.col("w") > UNKNOWN) & (F.col("w") % 2 == turn % 2))
        moves = turns.mapInArrow(choose, "w int, to int").toArrow()
        classes = classes.copy()
        classes[moves.column("w").to_numpy()] = moves.column("to").to_numpy()
    return best


@dataclass
class Model:
    """What scoring needs, none of it larger than :class:`Settings` allows, and the table of all word counts."""

    settings: Settings
    counts: DataFrame
    tokens: int
    types: int
    ends: int
    known: dict[bytes, tuple[int, int]]  # class, count
    log_transition: np.ndarray
    log_class: np.ndarray  # of each class: log10 of what an emission is divided by


def _class_ids(tokens: list[bytes], known: dict) -> np.ndarray:
    """Classes of the tokens between two ends."""
    at = np.zeros(len(tokens) + 2, np.int64)
    at[1:-1] = [x[0] if x else UNKNOWN for x in map(known.get, tokens)]
    return at


def train(texts: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of the texts in one column; counts cover every word of all of them. Null texts count as empty."""
    bounded_batches(texts.sparkSession)
    spark, s = texts.sparkSession, settings
    counts = stash(word_counts(texts), "words")
    ends = texts.count()
    words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = lambda share: max(2, math.ceil(share * words))
    top = frequent_words(counts, least(s.known))
    clustered = [w for w, n in top if n >= least(s.clustered)]
    classes = exchange(stash(neighbours(texts, clustered), "neighbours"), len(clustered), s).tolist()
    own = dict(zip(clustered, classes[2:], strict=True))
    known = {w: (own.get(w, UNKNOWN), n) for w, n in top}
    shared, size = spark.sparkContext.broadcast(known), s.all_classes

    def codes(text):
        at = _class_ids(text.lower().split(), shared.value)
        return at[:-1] * size + at[1:]

    matrix = np.zeros(size * size)
    for r in texts.mapInArrow(_coded_counts(codes), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        matrix[r.code] = r.n
    matrix = matrix.reshape(size, size)
    total = matrix.sum(0)
    share = (total + 1) / (total.sum() + size)
    transition = (matrix + s.transition * share) / (matrix.sum(1, keepdims=True) + s.transition)
    kinds = np.bincount(np.array(list(own.values()), np.int64), minlength=size).astype(float)
    kinds[UNKNOWN] = types - len(own)
    divisor = total + s.emission * (kinds + 1)
    divisor[END] = 1
    return Model(s, counts, int(words) + ends, int(types) + (ends > 0), ends, known, np.log10(transition), np.log10(divisor))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score (add-one unigram) and score (the class model), log10 of the whole text.

    Words that every task knows are scored in one pass; the counts of the others are joined by word.
    These are rare, so no word is a hot key. A null or empty text is its end alone. Null and repeated
    ids are rows like others; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    s = model.settings
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.log_transition, model.log_class))
    base = float(np.log10(model.tokens + model.types + 1))
    end_base, end_known = float(np.log10(model.ends + 1)) - base, int(model.ends > 0)

    def scan(batches):
        known, transition, log_class = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            rare_at, rare_words, rare_n = [0], [], []
            for text in as_bytes(batch.column(2)):
                tokens = text.lower().split()
                at = _class_ids(tokens, known)
                found = list(map(known.get, tokens))
                n = np.array([x[1] for x in found if x], float)
                classes = np.array([x[0] for x in found if x], np.int64)
                rare = Counter(w for w, x in zip(tokens, found, strict=True) if not x)
                own = float(transition[at[:-1], at[1:]].sum() + (np.log10(n + s.emission) - log_class[classes]).sum())
                for x, v in zip(out, (len(tokens) + 1, len(n) + end_known, float((np.log10(n + 1) - base).sum()) + end_base, own), strict=True):
                    x.append(v)
                rare_words += [w.decode() for w in rare]
                rare_n += rare.values()
                rare_at.append(len(rare_words))
            rare = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.string()), pa.array(rare_n, pa.int64())], ["word", "k"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3]), rare], ["_row", "id", "n_tokens", "n_known", "base_score", "score", "rare"])

    kinds = f"_row long, id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: string, k: bigint>>"
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), id_col, text_col)
    rows = stash(numbered.mapInArrow(scan, kinds), "scored")  # written, so a row's number is the same from here on
    c = F.coalesce("n", F.lit(0))
    divisor = float(model.log_class[UNKNOWN])
    rare = rows.select("_row", F.inline("rare")).join(model.counts, "word", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * (F.log10(c + 1) - base)).alias("more_base"),
        F.sum(F.col("k") * (F.log10(c + s.emission) - divisor)).alias("more_score"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return rows.drop("rare").join(rare, "_row", "left").select(F.col("id").alias(id_col), "n_tokens", plus("n_known", "more_known"), plus("base_score", "more_base"), plus("score", "more_score"))


def op10_class_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; null and empty texts are their end alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bounded_batches(spark)
    model = train(docs.where(~held_out()).select("text"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
