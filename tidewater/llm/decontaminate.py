"""Benchmark decontamination with a distributed positional inverted index.

The words of the test items are counted over all documents; of each window of an item the two rarest
are its terms. The index holds, by document, the positions of these terms. A posting at position p of
a term at offset q of an item says that the item may begin at p - q; the lists are intersected on
(document, item, p - q), and what has two terms of a window in place is compared word for word.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, flat_lists, plain_words, plainly, row_key, stash

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms that go to the tasks at once; more are taken in as many blocks as it needs.
BLOCK_TERMS = 500_000
#: Words that a task counts before it hands on.
COUNT_WORDS = 200_000


def item_table(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_no, item_id (text), words and span (a window's words) of the items that have words."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where("size(words) > 0").distinct()
    return rows.select(F.xxhash64("item_id", "words").alias("item_no"), "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("span"))


def _blocks(terms: DataFrame):
    """The distinct terms in lists of about BLOCK_TERMS at most."""
    n = max(1, -(-terms.count() // BLOCK_TERMS))
    for i in range(n):
        yield [r[0].encode() for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).collect()]


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(term, n): how often each of the terms stands in the documents; absent terms have no row."""
    spark, out = docs.sparkSession, None
    for block in _blocks(terms):
        shared = spark.sparkContext.broadcast(frozenset(block))

        def count(batches, shared=shared):
            wanted, seen, held = shared.value, Counter(), 0

            def part():
                found = [(w.decode(), n) for w, n in seen.items() if w in wanted]
                return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["term", "n"])

            for batch in batches:
                for text in as_bytes(batch.column(0)):
                    seen.update(plain_words(text))
                    if len(seen) > COUNT_WORDS:
                        yield part()
                        seen.clear()
            yield part()

        counted = docs.select(text_col).mapInArrow(count, "term string, n long")
        out = counted if out is None else out.unionByName(counted)
    return out.groupBy("term").agg(F.sum("n").alias("n"))


def rarest_slots(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_no, q, term): the offsets that are among the two rarest words of a window of their item; ties go to the first."""
    word = items.select("item_no", "span", F.posexplode("words").alias("q", "term"))
    listed = word.join(counts, "term", "left").groupBy("item_no", "span").agg(F.array_sort(F.collect_list(F.struct("q", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("w"))

    def pick(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for no, span, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                order = [(w["n"], w["q"]) for w in words]
                for q in sorted({q for j in range(len(words) - span + 1) for _, q in sorted(order[j : j + span])[:2]}):
                    for x, v in zip(out, (no, q, words[q]["term"]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["item_no", "q", "term"])

    return listed.mapInArrow(pick, "item_no long, q int, term string")


def positional_index(docs: DataFrame, slots: DataFrame, text_col: str) -> DataFrame:
    """(_k1, _k2, term, positions): where the slots' terms stand in each document (columns _k1, _k2, text)."""
    spark, out = docs.sparkSession, None
    for block in _blocks(slots.select("term").distinct()):
        shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(block)})

        def post(batches, shared=shared, names=None):
            ids = shared.value
            names = [t.decode() for t in ids]
            for batch in batches:
                row, term, places = [], [], []
                for r, text in enumerate(as_bytes(batch.column(2))):
                    words = plain_words(text)
                    known = np.fromiter(map(ids.get, words, repeat(-1)), np.int32, len(words))
                    at = np.flatnonzero(known >= 0)
                    order = np.argsort(known[at], kind="stable")
                    at = at[order]
                    for group in np.split(at, np.flatnonzero(np.diff(known[at])) + 1) if len(at) else []:
                        row.append(r)
                        term.append(names[known[group[0]]])
                        places.append(group)
                keys = [batch.column(i).take(pa.array(row, pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(term, pa.string()), flat_lists(places, pa.int32())], ["_k1", "_k2", "term", "positions"])

        made = docs.select("_k1", "_k2", text_col).mapInArrow(post, "_k1 long, _k2 long, term string, positions array<int>")
        out = made if out is None else out.unionByName(made)
    return out


def postings_by_item(index: DataFrame, slots: DataFrame) -> DataFrame:
    """(_k1, _k2, item_no, posts): of each document and item the positions of the item's terms, and the terms' offsets in the item.

    A position stands once, however many offsets its term has, so what a row holds is bounded by the words of the
    document; equal rows bring equal posts, which count once.
    """
    offsets = slots.groupBy("term", "item_no").agg(F.array_sort(F.collect_list("q")).alias("offsets"))
    return index.join(offsets, "term").groupBy("_k1", "_k2", "item_no").agg(F.collect_set(F.struct("positions", "offsets")).alias("posts"))


#: Postings of one document and item from which they are counted by place, and postings that are met at once.
MANY_POSTINGS, TOGETHER = 1 << 16, 1 << 20


def _counted(positions: list[np.ndarray], offsets: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(begin, terms in place there), rising, and the number of pairs whose begins are 1 to ``slop`` apart: one counter a place."""
    shift = max(int(q[-1]) for q in offsets)
    counts = np.zeros(max(int(p[-1]) for p in positions) + shift + 1 + slop, np.int64)
    for p, of in zip(positions, offsets, strict=True):
        for q in of:
            counts[p - int(q) + shift] += 1
    at = np.flatnonzero(counts)
    return at - shift, counts[at], sum(int(counts[:-d] @ counts[d:]) for d in range(1, slop + 1))


def _sorted(row: np.ndarray, begin: np.ndarray, rows: int, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of many rows at once, by sorting: (row, begin, terms in place) and the pairs of each row."""
    key, n = np.unique((row << 33) + begin + (1 << 31), return_counts=True)
    pairs = np.zeros(rows, np.int64)
    for d in range(1, slop + 1):
        other = np.minimum(np.searchsorted(key, key + d), len(key) - 1)
        pairs += np.bincount(key >> 33, (n * n[other]) * (key[other] == key + d), rows).astype(np.int64)
    return key >> 33, (key & ((1 << 33) - 1)) - (1 << 31), n, pairs


def intersected(posts: DataFrame, slop: int) -> DataFrame:
    """(_k1, _k2, item_no, begins, near) from rows of :func:`postings_by_item` with a column ``need``.

    begins: where ``need`` terms of the item stand in place; near: the number of pairs of postings of two of
    its terms that are 1 to ``slop`` words off their distance in the item, as of :func:`proximity_matches`.
    No pair is made: at a begin stand as many terms as have a posting there, and the products of these numbers, less
    the pairs of a term with itself, are the number of pairs.
    """

    def meet(batches):
        for batch in batches:
            need, rows = batch.column(3).to_numpy(), batch.num_rows
            row_of = np.repeat(np.arange(rows), np.diff(batch.column(4).offsets.to_numpy()))
            positions, offsets = batch.column(4).flatten().flatten()
            p, q = (c.flatten().to_numpy().astype(np.int64) for c in (positions, offsets))
            np_, nq = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in (positions, offsets))
            p_at, q_at = np.cumsum(np_) - np_, np.cumsum(nq) - nq
            key = (np.repeat(np.arange(len(np_)), np_) << 33) + p  # positions of a term rise
            near = np.zeros(rows, np.int64)
            for d in range(1, slop + 1):  # a term with itself
                same = key[np.minimum(np.searchsorted(key, key + d), len(key) - 1)] == key + d
                own = np.bincount(key >> 33, same, len(np_)).astype(np.int64) * nq
                near -= np.bincount(row_of, own, rows).astype(np.int64)
            total = np.bincount(row_of, np_ * nq, rows).astype(np.int64)
            found_row, found_begin = [], []
            for r in np.flatnonzero(total > MANY_POSTINGS):
                of = np.flatnonzero(row_of == r)
                begin, n, pairs = _counted([p[p_at[i] : p_at[i] + np_[i]] for i in of], [q[q_at[i] : q_at[i] + nq[i]] for i in of], slop)
                near[r] += pairs
                found_begin.append(begin[n >= need[r]])
                found_row.append(np.full(len(found_begin[-1]), r))
            few = np.flatnonzero(total[row_of] <= MANY_POSTINGS)
            part = (np.cumsum(np_[few] * nq[few]) - 1) // TOGETHER
            ends = np.flatnonzero(np.diff(part)) + 1 if len(few) else []
            bounds = [0, *np.unique(np.searchsorted(row_of[few], row_of[few][ends])), len(few)] if len(few) else [0]  # a row stays whole
            for a, b in zip(bounds, bounds[1:], strict=False):
                of = few[a:b]
                size = np_[of] * nq[of]
                if not size.sum():
                    continue
                each = np.repeat(of, size)
                within = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                begin = p[p_at[each] + within // nq[each]] - q[q_at[each] + within % nq[each]]
                row, begin, n, pairs = _sorted(row_of[each], begin, rows, slop)
                near += pairs
                held = n >= need[row]
                found_row.append(row[held])
                found_begin.append(begin[held])
            row, begin = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found_row, found_begin))
            order = np.argsort(row, kind="stable")
            begins = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32()), pa.array(begin[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], begins, pa.array(near)], ["_k1", "_k2", "item_no", "begins", "near"])

    rows = posts.select("_k1", "_k2", "item_no", "need", "posts")
    return rows.mapInArrow(meet, "_k1 long, _k2 long, item_no long, begins array<int>, near long")


def _posts(row: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and offsets of each term, from a list of structs."""
    columns = row.flatten()
    return [tuple(c[i].values.to_numpy().astype(np.int64) for c in columns) for i in range(len(row))]


def proximity_matches(index: DataFrame, slots: DataFrame, slop: int) -> DataFrame:
    """(_k1, _k2, item_no, begin, apart): all pairs of postings of two terms of an item that are 1 to ``slop`` words off their distance there.

    One row a pair: a text that repeats a few words has very many. Their number alone is in :func:`intersected`.
    """

    def pairs(batches):
        for batch in batches:
            for key, row in zip(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), batch.column(3), strict=True):
                held = [(p - int(q), int(q)) for p, offsets in _posts(row.values) for q in offsets]
                begin = np.concatenate([b for b, _ in held])
                offset = np.repeat([q for _, q in held], [len(b) for b, _ in held])
                order = np.argsort(begin, kind="stable")
                begin, offset = begin[order], offset[order]
                for at in range(0, len(begin), 1 << 12):
                    mine = begin[at : at + (1 << 12)]
                    low, high = np.searchsorted(begin, mine + 1), np.searchsorted(begin, mine + slop, "right")
                    i = np.repeat(np.arange(len(mine)), high - low) + at
                    j = np.arange(len(i)) - np.repeat(np.cumsum(high - low) - high, high - low)
                    i, j = (x[offset[i] != offset[j]] for x in (i, j))
                    columns = [*(pa.array([k] * len(i), pa.int64()) for k in key), pa.array(begin[i], pa.int32()), pa.array(begin[j] - begin[i], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["_k1", "_k2", "item_no", "begin", "apart"])

    posts = postings_by_item(index, slots).select("_k1", "_k2", "item_no", "posts")
    return posts.mapInArrow(pairs, "_k1 long, _k2 long, item_no long, begin int, apart int")


def phrase_index(keyed: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, slots, index) of documents with columns _k1, _k2 and the text, each written to the scratch folder."""
    bounded_batches(keyed.sparkSession)
    items = stash(item_table(benchmark, window, item_col), "items")
    counts = term_counts(keyed, items.select(F.explode("words").alias("term")).distinct(), text_col)
    slots = stash(rarest_slots(items, counts), "slots")
    return items, slots, stash(positional_index(keyed, slots, text_col), "index")


#: Places of an item in a document above which they are compared all at once, word by word of the item.
MANY_BEGINS = 64


def _covered(words: list[bytes], theirs: list[bytes], begins: np.ndarray, span: int) -> np.ndarray:
    """Which words lie in ``span`` or more consecutive words of the item that stand in place for one of its begins."""
    known = {w: i for i, w in enumerate(dict.fromkeys(theirs))}
    own = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
    run, change = np.zeros(len(begins), np.int32), np.zeros(len(words) + 1, np.int64)
    for x, w in enumerate(theirs):
        at = begins.astype(np.int64) + x
        inside = (at >= 0) & (at < len(words))
        run = np.where(inside & (own[np.where(inside, at, 0)] == known[w]), run + 1, 0)
        ends = at[run >= span]
        np.add.at(change, ends - span + 1, 1)
        np.add.at(change, ends + 1, -1)
    return np.cumsum(change[:-1]) > 0


def find_near(docs: DataFrame, benchmark: DataFrame, slop: int = 3, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, n_near): proximity matches of items in documents, pairs of an item's terms 1 to ``slop`` words off their distance.

    The terms are the two rarest of each of the item's windows. Documents with equal ids and texts count
    once; null and empty texts, and empty tables, have no matches.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    items, slots, index = phrase_index(keyed, benchmark, window, "text", item_col)
    near = intersected(postings_by_item(index, slots).withColumn("need", F.lit(2)), slop).where("near > 0").select("_k1", "_k2", "item_no", F.col("near").alias("n_near"))
    ids = keyed.select("_k1", "_k2", "doc_id").distinct()
    return near.join(items, "item_no").join(ids, ["_k1", "_k2"]).select(F.col("doc_id").alias(id_col), "item_id", "n_near")


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` with a struct column ``_found``: n_words, n_hit, items (distinct item ids as text), n_near (proximity matches of all items).

    A document word is hit if it lies in an occurrence of ``window`` consecutive words of an item; an
    item of fewer words is one window. A proximity match is one of :func:`proximity_matches`. Null and
    empty texts have no words, items without words no windows; a null item id counts as the empty one,
    and equal items count once. Equal rows have equal results; other columns stay as they are, whatever
    their names; an empty table stays empty, and an empty benchmark hits nothing.
    """
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    own_id, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    keyed = plain.select("*", *row_key(own_id, text))
    items, slots, index = phrase_index(keyed, benchmark, window, text, item_col)
    enough = F.aggregate("posts", F.lit(0).cast("long"), lambda n, p: n + F.size(p["positions"]).cast("long") * F.size(p["offsets"])) >= F.col("need")
    posts = postings_by_item(index, slots).join(items.select("item_no", F.least(F.lit(2), "span").alias("need")), "item_no").where(enough)
    met = intersected(posts, slop).where("size(begins) > 0 or near > 0").join(items, "item_no")
    one = F.struct("item_id", "span", "words", "begins")  # an item's words stand once by document
    listed = met.groupBy("_k1", "_k2").agg(F.collect_list(F.when(F.size("begins") > 0, one)).alias("_candidates"), F.sum("near").alias("_near"))

    def compare(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for body, candidates in zip(as_bytes(batch.column(0)), batch.column(1), strict=True):
                words, hit, items, many = plain_words(body), set(), set(), None
                for c in candidates.values or ():
                    span, theirs, begins = c["span"].as_py(), [w.encode() for w in c["words"].as_py()], c["begins"].values
                    if len(begins) > MANY_BEGINS:
                        many = np.zeros(len(words), bool) if many is None else many
                        covered = _covered(words, theirs, begins.to_numpy(), span)
                        many |= covered
                        if covered.any():
                            items.add(c["item_id"].as_py())
                        continue
                    for begin in begins.to_pylist():
                        run = 0
                        for x, w in enumerate(theirs):
                            at = begin + x
                            run = run + 1 if 0 <= at < len(words) and words[at] == w else 0
                            if run >= span:
                                hit.update(range(at - span + 1, at + 1))
                                items.add(c["item_id"].as_py())
                if many is not None:
                    hit.update(np.flatnonzero(many).tolist())
                for x, v in zip(out, (len(words), len(hit), sorted(items)), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()))
            found = pa.StructArray.from_arrays([*map(pa.array, out, kinds), batch.column(2).fill_null(0)], ["n_words", "n_hit", "items", "n_near"])
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], found], [*batch.schema.names[3:], "_found"])

    joined = keyed.join(listed, ["_k1", "_k2"], "left").select(F.col(text).alias("_text"), "_candidates", "_near", *plain.columns)
    kinds = ", ".join(f"_c{i} {t.dataType.simpleString()}" for i, t in enumerate(docs.schema))
    return joined.mapInArrow(compare, f"{kinds}, _found struct<n_words: bigint, n_hit: bigint, items: array<string>, n_near: bigint>").toDF(*names, "_found")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a word inside an occurrence of a benchmark window; null texts and repeated rows stay."""
    plain, (own_id, text) = plainly(docs, "doc_id", "text")
    return find_phrases(plain, benchmark, id_col=own_id, text_col=text).where("_found.n_hit = 0").drop("_found").toDF(*docs.columns)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Exact phrase matches of the benchmark in all documents, and how many proximity matches stand in each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "_found.n_words", "_found.n_hit", F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_found.items").cast("binary"), 256).alias("items_sha256"), (F.col("_found.n_hit") > 0).alias("contaminated"), "_found.n_near",
    )


ORACLE = r"""
with w as materialized (
    select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    union all
    select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
spans as (select distinct least(10, len(w)) as n from w where kind = 'b' and len(w) > 0),
item_at as (select id, least(10, len(w)) as n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from w where kind = 'b' and len(w) > 0),
windows as materialized (select distinct id as item_id, n, array_to_string(w[i : i + n - 1], ' ') as t from item_at),
doc_at as (select id, n, w, unnest(range(1, len(w) - n + 2)) as i from w, spans where kind = 'd' and len(w) >= n),
hits as materialized (
    select d.id, d.i, d.n, item_id from (select id, i, n, array_to_string(w[i : i + n - 1], ' ') as t from doc_at) d join windows on d.n = windows.n and d.t = windows.t),
words as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from hits) group by id),
item as (select distinct id as item_id, w, least(10, len(w)) as n from w where kind = 'b' and len(w) > 0),
item_words as (select item_id, w, n, unnest(w) as term, unnest(range(len(w))) as q from item),
doc_words as materialized (select id, unnest(w) as term, unnest(range(len(w))) as p from w where kind = 'd'),
counts as (select term, count(*) as c from doc_words where term in (select term from item_words) group by 1),
ranks as (select item_id, w, n, q, term, coalesce(c, 0) as c from item_words left join counts using (term)),
starts as (select item_id, w, n, unnest(range(len(w) - n + 1)) as j from item),
slots as (
    select distinct item_id, w, q, term from (
        select s.item_id, s.w, s.j, q, term, row_number() over (partition by s.item_id, s.w, s.j order by c, q) as r
        from starts s join ranks k on s.item_id is not distinct from k.item_id and s.w = k.w and q between j and j + s.n - 1) where r <= 2),
aligned as materialized (select id, item_id, slots.w, q, p - q as b from doc_words join slots using (term)),
near as (
    select x.id, count(*) as n_near from aligned x join aligned y
    on x.id = y.id and x.item_id is not distinct from y.item_id and x.w = y.w and x.q <> y.q and y.b - x.b between 1 and 3 group by 1),
items as (select id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct id, item_id::varchar as item_id from hits) group by id)
select w.id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from w left join words on w.id = words.id left join items on w.id = items.id left join near on w.id = near.id where kind = 'd'
"""
