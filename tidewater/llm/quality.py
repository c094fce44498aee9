"""Quality rules with suffix-array repetition.

The suffixes of each document's words are sorted by prefix doubling; the longest common prefixes of
neighbours tell how far the words from any place also stand elsewhere in the document, which gives
the maximal repeated substrings. The union of their spans and the longest of them are limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, plainly

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words of the documents whose suffixes are sorted together; bounds a task's memory.
SORT_WORDS = 400_000


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run from it that also starts elsewhere in its document.

    ``words``: ids of the words of several documents, one document after another; ``doc``: the
    document's number for each word, not falling.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    key = doc * (int(words.max()) + 1) + words
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the place of the first of equal prefixes
    end = np.searchsorted(doc, doc, "right")
    levels, h = [rank], 1
    while not new.all():
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        open_ = sa[~(new & last)]
        then = open_ + h
        second = np.where(then < end[open_], rank[np.minimum(then, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        open_, second, first = open_[order], second[order], rank[open_][order]
        head = np.ones(len(open_), bool)
        head[1:] = first[1:] != first[:-1]
        differs = head.copy()
        differs[1:] |= second[1:] != second[:-1]
        i = np.arange(len(open_))
        place = first + i - np.maximum.accumulate(np.where(head, i, 0))
        sa[place] = open_
        new[place] = differs
        rank = rank.copy()
        rank[open_] = np.maximum.accumulate(np.where(differs, place, 0))
        levels.append(rank)
        h *= 2
    a, b = sa[:-1].copy(), sa[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        same = (a < n) & (b < n)
        same[same] = level[a[same]] == level[b[same]]
        step = same * (1 << k)
        common += step
        a += step
        b += step
    longest = np.zeros(n, np.int64)
    longest[sa[1:]] = common
    longest[sa[:-1]] = np.maximum(longest[sa[:-1]], common)
    return longest


def covered(longest: np.ndarray, at_least: int, span: int | None = None) -> np.ndarray:
    """Which words are in a repeated run of ``at_least`` words (``span``: or count only so many words of each)."""
    i = np.arange(len(longest))
    reach = np.where(longest >= at_least, i + (span if span else longest), 0)
    return np.maximum.accumulate(reach) > i if len(i) else np.zeros(0, bool)


def _measures(texts: list[bytes], min_repeat: int) -> list[list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat: a list for each."""
    n_words, chars, symbols, dup_lines, ids, docs = [], [], [], [], [], []
    known: dict[bytes, int] = {}
    for k, text in enumerate(texts):
        words = text.split()
        n_words.append(len(words))
        chars.append(len(b"".join(words).decode()))
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
        ids.extend([known.setdefault(w, len(known)) for w in words])
        docs.append(np.full(len(words), k, np.int64))
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    longest = repeat_lengths(np.array(ids, np.int64), doc)
    count = lambda marks: np.bincount(doc[marks], minlength=len(texts)).tolist()
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc, longest)
    return [n_words, chars, symbols, dup_lines, count(covered(longest, 3, 3)), count(covered(longest, min_repeat)), most.tolist()]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def measure(docs: DataFrame, min_repeat: int = 10, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_quality`` of the measures, all long.

    n_covered: words inside maximal repeated substrings of ``min_repeat`` words or more;
    longest_repeat: words of the longest repeated substring, overlapping ones included. A null or
    empty text has zeros. Rows stand for themselves, repeated ones and null ids too; all other columns
    stay as they are, whatever their names; an empty table stays empty. The time for a text is its length
    times the logarithm of its longest repeat.
    """
    names = docs.columns

    def scan(batches):
        for batch in batches:
            texts, out, part, held = as_bytes(batch.column(0)), [[] for _ in MEASURES], [], 0
            for t in [*texts, None]:
                if part and (t is None or held + len(t) > 4 * SORT_WORDS):
                    for x, y in zip(out, _measures(part, min_repeat), strict=True):
                        x += y
                    part, held = [], 0
                if t is not None:
                    part.append(t)
                    held += len(t)
            struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in out], list(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], struct], [*batch.schema.names[1:], "_quality"])

    bounded_batches(docs.sparkSession)
    kinds = ", ".join(f"_c{i} {t.dataType.simpleString()}" for i, t in enumerate(docs.schema))
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    text = plain[f"_c{names.index(text_col)}"].alias("_text")
    done = plain.select(text, *plain.columns).mapInArrow(scan, f"{kinds}, _quality struct<{', '.join(f'{m}: bigint' for m in MEASURES)}>")
    return done.toDF(*names, "_quality")


def verdict(quality, min_words: int = 50, max_repeat_words: float = 0.5, max_covered: float = 0.3, max_longest: float = 0.2):
    """(base_failed, kept) from the struct of :func:`measure`.

    A document fails the base for too few words or too many in repeated 3-word windows; beyond that
    it is rejected if repeats cover more than ``max_covered`` of its words or the longest repeat is
    more than ``max_longest`` of them.
    """
    n = quality["n_words"]
    failed = (n < min_words) | (100 * quality["n_repeat_words"] > round(100 * max_repeat_words) * n)
    return failed, ~failed & (quality["n_covered"] <= max_covered * n) & (quality["longest_repeat"] <= max_longest * n)


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; null and empty texts go, repeated rows go or stay together."""
    plain, (text,) = plainly(docs, text_col)
    return measure(plain, text_col=text).where(verdict(F.col("_quality"))[1]).drop("_quality").toDF(*docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; nulls and empty texts have zeros and fail, repeated rows have a row each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    failed, kept = verdict(F.col("_quality"))
    return measure(docs).select("doc_id", *(f"_quality.{m}" for m in MEASURES if m != "longest_repeat"), failed.alias("base_failed"), kept.alias("kept"))


#: A repeat is longer than a share of the text if some run of one word more than the share allows stands twice.
ORACLE = r"""
with d as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
b as materialized (
    select doc_id, w, len(w) as n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l, floor(0.2::double * len(w))::bigint + 1 as long from d),
kinds as (select doc_id, n, w, long, unnest(['r', 'c', 'l']) as k, unnest([3, 10, long]) as s from b),
places as (select doc_id, k, s, w, unnest(range(1, n - s + 2)) as i from kinds where n >= s),
named as (select doc_id, k, s, i, md5(array_to_string(w[i : i + s - 1], ' ')) as h from places),
twice as materialized (select doc_id, k, s, i from named qualify count(*) over (partition by doc_id, k, h) > 1),
marks as (select distinct doc_id, k, unnest(range(i, i + s)) as p from twice where k <> 'l'),
counts as (select doc_id, count(*) filter (k = 'r') as r, count(*) filter (k = 'c') as c from marks group by doc_id),
longer as (select distinct doc_id, true as yes from twice where k = 'l')
select doc_id, n::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words,
    coalesce(c, 0)::bigint as n_covered, n < 50 or 100 * coalesce(r, 0) > 50 * n as base_failed,
    not (n < 50 or 100 * coalesce(r, 0) > 50 * n) and coalesce(c, 0) <= 0.3::double * n and not coalesce(yes, false) as kept
from b left join counts using (doc_id) left join longer using (doc_id)
"""
