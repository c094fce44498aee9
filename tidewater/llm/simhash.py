"""SimHash near-duplicates found through Golay codewords.

The perfect Golay code of length 23 turned round: a 23-bit vector takes as keys the codeword within
3 bits of it and, if that is 3 away, the five codewords 4 away. Two vectors at 2 or fewer differing
bits always share a key, as the vector between them is within 3 of one codeword. A fingerprint is cut
into three segments of at most 23 bits; of 2 errors, one segment has none (pigeonhole), and the next
segment has at most 2. So each fingerprint has three times up to six keys (exact segment, codeword).
Fingerprints that share a key are compared, and the links' components give the groups.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, components, flat_lists, row_key, split_join, stash

#: Generator polynomial of the binary Golay code of length 23, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: Segments of a fingerprint: first bit, bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _remainder(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= GOLAY << (i - 11)
    return x


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and the high bits of a vector, and for each remainder its six error patterns.

    A pattern of weight 3 or less is the only one of its remainder; then it fills all six places.
    """
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int32)
    one = [_remainder(1 << i) for i in range(23)]
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            r = 0
            for b in bits:
                r ^= one[b]
            if weight < 4 or errors[r][0].bit_count() == 3:
                errors[r].append(sum(1 << b for b in bits))
    return low, high, np.array([(x * 6)[:6] for x in errors], np.int32)


def codeword_keys(vectors: np.ndarray) -> np.ndarray:
    """Rows of six codeword indices (12 bits) for 23-bit vectors; repeated where there is one."""
    low, high, errors = golay_tables()
    v = vectors.astype(np.int64)
    r = low[v & 0xFFF] ^ high[v >> 12]
    return (v[:, None] ^ errors[r]) >> 11


def fingerprint_keys(prints: np.ndarray) -> np.ndarray:
    """Rows of 18 keys for unsigned 64-bit fingerprints: which segment is exact, its bits, the next segment's codeword."""
    parts = [(prints >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
    out = []
    for i in range(3):
        exact = (parts[i] << 14) | i
        out.append((exact[:, None] << 12) | codeword_keys(parts[(i + 1) % 3]))
    return np.concatenate(out, axis=1)


def text_fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats counted; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    h = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return _majority(np.fromiter((h(s, 42) for s in shingles), "<u8", len(words) - width + 1))


def _fingerprints_of(docs: DataFrame, width: int) -> DataFrame:
    """The first column of ``docs`` and ``fp``, the fingerprint of the second as a signed long."""
    first = docs.columns[0]

    def scan(batches):
        for batch in batches:
            prints = np.array([text_fingerprint(t, width) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [first, "fp"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(scan, f"{first} {docs.schema[first].dataType.simpleString()}, fp long")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long. A null or wordless text has fingerprint 0."""
    return _fingerprints_of(docs.select(F.col(id_col).alias("doc_id"), text_col), width)


def near_links(prints: DataFrame, bits: int = 2, in_bucket: int = 48) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints at ``bits`` (2) or fewer differing bits.

    ``prints`` has one column fp without repeats. Buckets of one key with up to ``in_bucket`` members
    are compared pair by pair. The members of larger buckets are linked exactly another way, in work
    linear in their number: each is listed under itself and its 64 one-bit neighbours, all that are
    listed under one value are at most 2 bits apart, and any two that are 2 apart share a value; so
    each list links to its smallest member.
    """
    if bits != 2:
        raise ValueError("the codeword keys cover exactly 2 differing bits")

    def keys(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            rows = [np.unique(x) for x in fingerprint_keys(fp.view(np.uint64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), flat_lists(rows, pa.int64())], ["fp", "keys"])

    listed = prints.mapInArrow(keys, "fp long, keys array<long>").select("fp", F.explode("keys").alias("key"))
    counts = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = split_join(listed, counts, ["key"])
    before = F.collect_list("fp").over(Window.partitionBy("key").orderBy("fp").rowsBetween(-in_bucket, -1))
    near = F.filter("before", lambda x: F.bit_count(x.bitwiseXOR(F.col("fp"))) <= bits)
    small = found.where(F.col("n") <= in_bucket).withColumn("before", before).select(F.col("fp").alias("a"), F.explode(near).alias("b"))
    large = found.where(F.col("n") > in_bucket).select("fp").distinct()
    values = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    shared = large.select("fp", F.explode(values).alias("value")).groupBy("value").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where("size(all) > 1")
    return small.unionByName(shared.select(F.explode("all").alias("a"), "b").where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, in_bucket: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable over links).

    Rows with equal fingerprints are one node, so large groups of copies make no pairs. Rows with null
    ids get a component like others; a null id is never the smallest, and a component with null ids
    only has a null id. An empty table gives no rows.
    """
    rows = stash(fingerprints(docs, width, id_col, text_col), "prints")
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp"), in_bucket=in_bucket))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = linked.join(least, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Members up to which all pairs of a prefix key are compared without a look at what is linked already.
IN_BUCKET = 48
#: One of so many texts tells which shingles are frequent, and the most of them that all tasks hold (4 MB).
SAMPLED, FREQUENT = 12, 1 << 19
#: Ratio of the sizes of sets that are told apart in large buckets.
SIZE_STEP = 1.004
#: Keys of a node in large buckets by which a pair is taken once.
FIRST_KEYS = 32
#: Most rows of a table of hash buckets that is broadcast to keep rows out of a shuffle.
BUCKETS = 1 << 20


def _shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, h = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    return np.fromiter((h(b" ".join(words[i : i + width]), 42) for i in range(n)), "<u8", n)


def _mixed(shingles: np.ndarray) -> np.ndarray:
    """The set of a text's shingles as sorted hashes."""
    return np.unique(shingles * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _ordered_keys(values: np.ndarray, held: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Sorted ``values`` by their rank, 0 for those that the sorted ``held`` has not, and then as they are; by binary search, as ``held`` may be far the longer."""
    if not len(held):
        return values
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return values[np.argsort(np.where(held[at] == values, ranks[at], 0), kind="stable")]


def _prefixes(texts: DataFrame, width: int, similarity: float, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``texts`` (_k1, _k2, text) as distinct nodes: node, _k1, fp (the SimHash fingerprint, as of :func:`text_fingerprint`), n (shingles of the set) and keys, the first of the set.

    The order of shingles is that of their hashes with those in ``last`` (sorted hashes, ranks) behind all others by
    rank, the same for all texts. So what a near copy shares with other copies comes before what all of its group have. Sets of ``similarity`` share at least ceil(similarity * n) shingles, so the least
    of these is among the first n - ceil(similarity * n) + 1 of both. A text without words has the key 0.
    """
    shared = texts.sparkSession.sparkContext.broadcast(last)

    def scan(batches):
        last = shared.value
        for batch in batches:
            prints, sizes, keys = [], [], []
            for text in as_bytes(batch.column(2)):
                shingles = _shingles(text, width)
                h = _mixed(shingles)
                n = len(h)
                prints.append(_majority(shingles))
                sizes.append(n)
                keys.append(_ordered_keys(h, *last)[: n - math.ceil(similarity * n - 1e-9) + 1] if n else np.zeros(1, np.int64))
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], fp, pa.array(sizes, pa.int32()), flat_lists(keys, pa.int64())], ["_k1", "_k2", "fp", "n", "keys"])

    bounded_batches(texts.sparkSession)
    found = texts.mapInArrow(scan, "_k1 long, _k2 long, fp long, n int, keys array<long>")
    return found.groupBy(F.col("_k2").alias("node")).agg(F.min("_k1").alias("_k1"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("keys").alias("keys"))


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of many distinct texts, at most FREQUENT, and their ranks by how many, told from a sample; any choice gives the same links, at another cost."""
    sampled = texts.where(F.pmod("_k2", F.lit(SAMPLED)) == 0).dropDuplicates(["_k2"]).select("text")

    def count(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.append(_mixed(_shingles(text, width)))
                if sum(map(len, held)) > 1 << 20:
                    yield part(held)
        yield part(held)

    def part(held):
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32))], ["key", "n"])

    bounded_batches(texts.sparkSession)
    counts = sampled.mapInArrow(count, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stash(counts.where(F.col("n") > IN_BUCKET // SAMPLED), "frequent")
    step = F.floor(16 * F.log2("n")).cast("int")
    least, room = None, FREQUENT
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room -= r.n
        if room < 0:
            break
        least = r.step
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    found = counts.where(step >= least).select("key", step.cast("short").alias("rank")).toArrow()
    keys, ranks = (found.column(i).to_numpy() for i in range(2))
    order = np.argsort(keys)
    return keys[order], ranks[order]


def prefix_nodes(keyed: DataFrame, width: int, similarity: float) -> DataFrame:
    """The distinct texts of ``keyed`` as of :func:`_prefixes`, with frequent shingles last."""
    return stash(_prefixes(keyed, width, similarity, _frequent(keyed, width)), "prefixes")


def prefix_buckets(nodes: DataFrame) -> DataFrame:
    """(node, n, p, pos, key, members): the keys that several nodes have, with the number of these; p is the length of a node's keys, pos a key's place."""
    listed = nodes.select("node", "n", F.size("keys").alias("p"), F.posexplode("keys").alias("pos", "key"))
    counts = listed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return split_join(listed, counts, ["key"])


def _reach(n: Column, other: Column, similarity: float) -> Column:
    """Among how many first keys of a set of ``n`` the first key is that it shares with a set of ``other`` of that similarity."""
    return n - F.ceil(F.lit(similarity / (1 + similarity)) * (n + other) - 1e-6) + 1


def _places_fit(x: Column, y: Column, similarity: float) -> Column:
    """Whether a key shared by structs (n, pos, ...) can be the first that they share."""
    return (x["pos"] < _reach(x["n"], y["n"], similarity)) & (y["pos"] < _reach(y["n"], x["n"], similarity))


def in_reach(large: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``large`` whose key can be the first that the node shares with one of a size that the bucket has.

    Of each bucket the sizes are told by their logarithms in steps of SIZE_STEP, three thousand numbers at most.
    A near copy with many shingles of its own has these first, so it leaves the buckets of its group's
    shingles where it can't be alike to texts of the group's lengths.
    """
    step = F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(SIZE_STEP)).cast("int")
    sizes = large.groupBy("key").agg(F.collect_set(step).alias("sizes"))
    least = lambda c: F.pow(F.lit(SIZE_STEP), c.cast("double"))
    n = F.col("n")
    fits = lambda c: (least(c) * similarity <= n + 1e-3) & (least(c + 1) >= similarity * n - 1e-3) & (F.col("pos") < _reach(n, F.greatest(least(c) - 1e-3, similarity * n - 1e-3), similarity))
    return split_join(large, sizes, ["key"]).where((n == 0) | F.exists("sizes", fits)).drop("sizes")


def _size_fits(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6


def _enough(both: DataFrame, common: Column, similarity: float) -> DataFrame:
    """Pairs that may be alike if they have at most ``common`` keys in common.

    Of one of the two, whose last key comes no later than the other's, all keys are told: those not in
    common aren't in the other set either. So the sets share at most ``common`` and what is outside the keys.
    """
    outside = F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return both.where(common + outside >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b")


_BOTH = ("a", "b", "na", "nb", "pa", "pb")


def _ordered(x: Column, y: Column) -> list[Column]:
    """The columns of _BOTH from structs (node, n, p, ...)."""
    low, high = F.when(x["node"] < y["node"], x).otherwise(y), F.when(x["node"] < y["node"], y).otherwise(x)
    return [low["node"].alias("a"), high["node"].alias("b"), low["n"].alias("na"), high["n"].alias("nb"), low["p"].alias("pa"), high["p"].alias("pb")]


def print_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose fingerprints are alike by :func:`near_links`: each node with the least of its fingerprint, and of two linked fingerprints their least nodes.

    They are no more than nodes and links. Near copies of few changes are joined here, so that they needn't meet in large buckets.
    """
    me = F.struct("node", "n")
    least = stash(nodes.groupBy("fp").agg(F.min(me).alias("least")), "fp")
    same = split_join(nodes.select("fp", me.alias("x")), least, ["fp"]).select("x", F.col("least").alias("y"))
    end = lambda c, n: least.select(F.col("fp").alias(c), F.col("least").alias(n))
    near = near_links(least.select("fp")).join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    both = same.unionByName(near).where("x.node <> y.node").where(_size_fits(F.col("x.n"), F.col("y.n"), similarity))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def small_pairs(found: DataFrame, in_bucket: int, similarity: float) -> DataFrame:
    """_BOTH and ``common``: the pairs of nodes of a fitting size that share keys of up to ``in_bucket`` members, and how many of these."""
    me = F.struct("node", "n", "p")
    before = F.collect_list(me).over(Window.partitionBy("key").orderBy("node").rowsBetween(-in_bucket, -1))
    met = found.where(F.col("members") <= in_bucket).select(me.alias("x"), before.alias("before"))
    met = met.select("x", F.explode(F.filter("before", lambda y: _size_fits(y["n"], F.col("x.n"), similarity))).alias("y"))
    return met.select(*_ordered(F.col("x"), F.col("y"))).groupBy(*_BOTH).agg(F.count(F.lit(1)).alias("common"))


def hub_pairs(large: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the members of ``large`` buckets with four of them: least, greatest, one by chance, and that whose keys have most members on the average.

    In a group of near copies of one text, which are less like each other than like it, the last is meant to be that text, as it has none of the keys that a change makes.
    """
    mask = F.xxhash64("key")
    me = F.struct("node", "n", "p")
    shared = F.struct(-F.col("met") / F.col("p"), -F.col("n"), "node")
    hubs = large.groupBy("key").agg(F.min(me).alias("least"), F.max(me).alias("most"), F.min_by(me, F.col("node").bitwiseXOR(mask)).alias("chance"), F.min_by(me, shared).alias("centre"))
    met = split_join(large, hubs.select("key", F.array_distinct(F.array("least", "most", "chance", "centre")).alias("hubs")), ["key"])
    met = met.select(me.alias("x"), F.explode("hubs").alias("y")).where("x.node <> y.node").where(_size_fits(F.col("x.n"), F.col("y.n"), similarity))
    return met.select(*_ordered(F.col("x"), F.col("y"))).select("a", "b").distinct()


def other_pairs(large: DataFrame, roots: DataFrame, small: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of ``large`` buckets that may be alike and that ``roots`` (node, root) do not join.

    In each bucket, all members outside its greatest component meet all members of another component at
    whose keys' places they can be alike; those inside one need no pair. ``small`` has the pairs' other
    common keys, and ``large`` how many keys of large buckets a node has.
    """
    firsts = F.array_sort(F.collect_list(F.struct("pos", "key")))
    firsts = large.groupBy("node").agg(F.slice(F.transform(firsts, lambda x: x["key"]), 1, FIRST_KEYS).alias("firsts"))
    held = stash(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "held")
    parts = held.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    held = split_join(held, main.select("key", F.col("main.root").alias("main")), ["key"])
    held = stash(split_join(held, firsts, ["node"]), "open")
    me = F.struct("node", "n", "p", "pos", "large", "root", "main", "firsts")
    x, y = F.col("x"), F.col("y")
    met = split_join(held.select("key", me.alias("x")), held.where("root <> main").select("key", me.alias("y")), ["key"])
    met = met.where("x.root <> y.root and (x.root = x.main or x.node < y.node)").where(_size_fits(x["n"], y["n"], similarity) & _places_fit(x, y, similarity))
    shared = F.array_intersect(x["firsts"], y["firsts"])  # in the order of keys; a pair is taken where it meets first
    met = met.where((F.size(shared) == 0) | (F.get(shared, F.lit(0)) == F.col("key")))
    pairs = met.select(*_ordered(x, y), F.least(x["large"], y["large"]).alias("more")).distinct()
    beside = small.select("a", "b", F.col("common").alias("beside"))
    return _enough(pairs.join(beside, ["a", "b"], "left"), F.col("more") + F.coalesce("beside", F.lit(0)), similarity)


def _in_buckets(rows: DataFrame, some: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows that share a hash bucket with ``some`` (or with left_anti none do), told without a shuffle.

    The broadcast table has BUCKETS rows at most, whatever the input. It spares the texts of most other
    rows a shuffle as long as ``some`` fills few buckets, and passes all on when it fills them.
    """
    bucket = F.pmod("_k2", F.lit(BUCKETS)).alias("_bucket")
    hit = some.select(bucket).distinct()
    return rows.select("*", bucket).join(F.broadcast(hit), "_bucket", how).drop("_bucket")


def verified(keyed: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose whole texts' shingles (as 32-bit hashes) are that similar; two texts without words are alike."""
    pairs = stash(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stash(nodes.select("node", "_k1").join(ends, "node", "left_semi").select("_k1", F.col("node").alias("_k2")), "wanted")

    def sets(batches):
        for batch in batches:
            out = [np.unique(_shingles(t, width).astype(np.uint32)).view(np.int32) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), flat_lists(out, pa.int32())], ["node", "set"])

    texts = _in_buckets(keyed, wanted).join(wanted, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k2"]).select(F.col("_k2").alias("node"), "text")
    known = stash(texts.mapInArrow(sets, "node long, set array<int>"), "sets")

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    side = lambda c: known.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    both = split_join(split_join(pairs, side("b"), ["b"]), side("a"), ["a"])
    return stash(both.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long"), "alike")


def similar_links(keyed: DataFrame, width: int = 5, similarity: float = 0.8, in_bucket: int = IN_BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of texts with a Jaccard similarity of ``similarity`` or more.

    ``keyed``: columns _k1, _k2 and text; a node is a distinct text, named by _k2. SimHash fingerprints alike to 2 bits
    give the first candidates. Sets of that similarity may differ in more bits, so prefix keys find the rest, and no pair is
    missed: two such texts share one (see :func:`_prefixes`). Keys of up to ``in_bucket`` members give
    all their pairs. Of others, members leave that can't be alike to any of the sizes there; the rest meet
    four of them first, then all that are not yet joined meet each other. Every link is verified.
    """
    keyed = keyed.select("_k1", "_k2", "text")
    nodes = prefix_nodes(keyed, width, similarity)
    found = stash(prefix_buckets(nodes), "buckets")
    large = found.where(F.col("members") > in_bucket)
    per_node = large.groupBy("node").agg(F.count(F.lit(1)).alias("large"), F.sum("members").alias("met"))
    large = stash(in_reach(large.join(per_node, "node"), similarity), "large")
    small = stash(small_pairs(found, in_bucket, similarity), "small")
    held = lambda c: per_node.select(F.col("node").alias(c), F.col("large").alias(f"l{c}"))
    near = small.join(held("a"), "a", "left").join(held("b"), "b", "left")
    near = _enough(near, F.col("common") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))), similarity)
    first = near.unionByName(hub_pairs(large, similarity)).unionByName(print_pairs(nodes, similarity))
    links = verified(keyed, nodes, first.distinct(), width, similarity)
    if large.isEmpty():
        return links
    more = stash(other_pairs(large, components(links), small, similarity), "more")
    return links if more.isEmpty() else links.unionByName(verified(keyed, nodes, more, width, similarity)).distinct()


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near duplicates, with its columns: that of the smallest id, then of the smallest text hash.

    Equal texts and verified links make the groups. A null id is larger than any other. Of several
    equal rows one stays. All texts without words, nulls too, are one group; an empty table stays empty.
    """
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    own_id, text = (f"_c{names.index(c)}" for c in (id_col, text_col))
    keys = dict(zip(("_k1", "_k2"), row_key(own_id, text), strict=True))
    keyed = plain.withColumns(keys)
    roots = components(similar_links(keyed.select("_k1", "_k2", F.col(text).alias("text")), width, similarity))
    me = F.struct(F.col(own_id).isNull().alias("none"), F.col(own_id).alias("id"), "_k1", "_k2")
    nodes = keyed.groupBy(F.col("_k2").alias("node")).agg(F.min(me).alias("least"), F.count(F.lit(1)).alias("rows"))
    linked = nodes.join(roots, "node", "left").select("least", "rows", F.coalesce("root", "node").alias("root"), F.col("node").alias("_k2"))
    linked = stash(linked, "linked")
    groups = linked.groupBy("root").agg(F.min("least").alias("least"), F.sum("rows").alias("n")).where("n > 1")
    chosen = stash(groups.select("root", "least._k1", "least._k2"), "chosen")
    grouped = linked.join(chosen.select("root"), "root", "left_semi").select("_k2")
    single = linked.join(chosen.select("root"), "root", "left_anti").select("least._k1", "_k2")
    stay = _in_buckets(single, grouped).unionByName(chosen.select("_k1", "_k2"))
    kept = _in_buckets(keyed, grouped).join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(keyed.columns)
    return _in_buckets(keyed, grouped, "left_anti").unionByName(kept).select(*plain.columns).toDF(*names)


def op7_golay_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; nulls and wordless texts have fingerprint 0 and are linked like others."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The five primes of XXH64.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def _oracle(seed: int = 42, bits: int = 2) -> str:
    """The query in SQL: XXH64 as published, in 128-bit numbers modulo 2^64, over the bytes of every distinct shingle."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in PRIMES)
    whole = f"{1 << 64}::uhugeint"
    cut = lambda x: f"(({x}) % {whole})"
    turn = lambda x, r: f"({cut(f'({x}) * {1 << r}::uhugeint')} + ({x}) // {1 << (64 - r)}::uhugeint)"
    number = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {i}) + 1, 2)" for i in reversed(range(n))) + ")::ubigint::uhugeint"
    lane = lambda v, at: cut(turn(cut(f"{v} + {number(f'p + {at}', 8)} * {p2}"), 31) + f" * {p1}")
    merge = lambda h, v: cut(f"{cut(f'xor({h}, ' + cut(turn(cut(f'{v} * {p2}'), 31) + f' * {p1}') + ')')} * {p1} + {p4}")
    shift = lambda h, r, p: cut(f"xor({h}, {h} // {1 << r}::uhugeint) * {p}")
    start = [(seed + PRIMES[0] + PRIMES[1]) % (1 << 64), (seed + PRIMES[1]) % (1 << 64), seed, (seed - PRIMES[0]) % (1 << 64)]
    ones = ", ".join(f"2 * sum(h // {1 << i}::uhugeint % 2::uhugeint) > count(h) as b{i}" for i in range(64))
    print_ = " + ".join(f"case when b{i} then {1 << i}::uhugeint else 0::uhugeint end" for i in range(64))
    return rf"""
with recursive d as materialized (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0),
shingles as materialized (select doc_id, array_to_string(w[i : i + 2], ' ') as s from places),
texts as materialized (select s, hex(encode(s)) as x, octet_length(encode(s)) as n from (select distinct s from shingles)),
striped(s, x, n, p, v1, v2, v3, v4) as (
    select s, x, n, 0, {", ".join(f"{v}::uhugeint" for v in start)} from texts where n >= 32
    union all select s, x, n, p + 32, {lane("v1", 0)}, {lane("v2", 8)}, {lane("v3", 16)}, {lane("v4", 24)} from striped where p + 32 <= n),
joined as (select s, x, n, p, v1, v2, v3, v4, {cut(" + ".join(turn(v, r) for v, r in (("v1", 1), ("v2", 7), ("v3", 12), ("v4", 18))))} as h from striped where p + 32 > n),
first as (select s, x, n, p, v2, v3, v4, {merge("h", "v1")} as h from joined),
second as (select s, x, n, p, v3, v4, {merge("h", "v2")} as h from first),
third as (select s, x, n, p, v4, {merge("h", "v3")} as h from second),
fourth as (select s, x, n, p, {merge("h", "v4")} as h from third),
opened as (select s, x, n, p, {cut("h + n::uhugeint")} as h from fourth union all select s, x, n, 0, {cut(f"{seed}::uhugeint + {p5} + n::uhugeint")} from texts where n < 32),
walked(s, x, n, p, h) as (
    select s, x, n, p, h from opened
    union all select s, x, n, case when p + 8 <= n then p + 8 when p + 4 <= n then p + 4 else p + 1 end,
        case when p + 8 <= n then {cut(turn("xor(h, " + cut(turn(cut(number("p", 8) + f" * {p2}"), 31) + f" * {p1}") + ")", 27) + f" * {p1} + {p4}")}
        when p + 4 <= n then {cut(turn("xor(h, " + cut(number("p", 4) + f" * {p1}") + ")", 23) + f" * {p2} + {p3}")}
        else {cut(turn("xor(h, " + cut(number("p", 1) + f" * {p5}") + ")", 11) + f" * {p1}")} end from walked where p < n),
mixed as (select s, {shift("h", 33, p2)} as h from walked where p = n),
again as (select s, {shift("h", 29, p3)} as h from mixed),
hashed as materialized (select s, xor(h, h // {1 << 32}::uhugeint) as h from again),
counted as (select doc_id, {ones} from shingles join hashed using (s) group by 1),
prints as materialized (select d.doc_id, coalesce({print_}, 0::uhugeint) as f from d left join counted using (doc_id)),
nodes as materialized (select distinct f::hugeint as f from prints),
links as materialized (select a.f as a, b.f as b from nodes a join nodes b on bit_count(xor(a.f, b.f)) <= {bits}),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
least as (select a, min(doc_id) as component_id from reached join prints on reached.b = prints.f::hugeint group by 1)
select doc_id, lpad(lower(to_hex(f::ubigint)), 16, '0') as fingerprint, component_id from prints join least on prints.f::hugeint = least.a
"""


ORACLE = _oracle()
