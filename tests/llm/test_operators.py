"""Corpus operators against brute force, with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import decontaminate, html_text, license_scan, lm_score, packing, quality, secrets, sharding, simhash, substring_dedup

SCHEMA = "doc_id long, text string, source string, _k1 string, n int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["über", "naïve", "日本", "x,"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared, texts = prose(50), []
    for i in range(40):
        texts.append(prose(rng.randrange(1, 140)) + (" " + shared + "\n" if i % 5 == 0 else "") + prose(20))
    texts += [None, "", " \n ", texts[3], texts[3] + " end", prose(9000), "a " * 300, "same line here\n" * 40]
    out = [(i, t, "hot" if i % 3 else None, "clash", i) for i, t in enumerate(texts)]
    return [*out, out[3], (None, texts[5], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def lowered(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def same(got, expected):
    assert Counter(map(tuple, got)) == Counter(map(tuple, expected))


# sharding


def test_shards_are_even_gapless_and_mixed(docs, rows, nothing):
    got = sharding.shard(docs, n_shards=4, per_bucket=5).collect()
    assert len(got) == len(rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    hot = {r[0] for r in rows if r[2] == "hot"}
    counts = [sum(r.doc_id in hot for r in got if r.shard == s) for s in range(4)]
    assert max(counts) - min(counts) <= 2
    same([(r.doc_id, r["size"], r.text_crc32) for r in got], [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows])
    assert sharding.shard(nothing).count() == 0


# packing


def test_packing_places_every_piece_once(docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        expected += [(r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packing.pack(docs, path, size=256, per_bucket=10).collect()
    same([r[:5] for r in got], expected)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(nothing, path).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_covers_all_ranks_near_the_bound(seed):
    rng = random.Random(seed)
    lengths = [min(2048, 1 + int(rng.paretovariate(0.7) * 40)) for _ in range(rng.choice([1, 40, 5000]))]
    counts = Counter(lengths)
    used, sequences = {n: [] for n in counts}, {}
    for n, rank, many, sequence, offset in packing.plan(counts):
        used[n] += range(rank, rank + many)
        for i in range(many):
            sequences.setdefault(sequence + i, []).append((offset, n))
    assert all(sorted(v) == list(range(counts[n])) for n, v in used.items())
    for v in sequences.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    if len(lengths) == 5000:
        assert len(sequences) <= 1.02 * -(-sum(lengths) // 2048) + 1


@pytest.mark.parametrize("text", ["a  b", "  a", "a \n b", "a\n b ", "   ", "", "a b  \n\n c", "it's 12,3  ok\t z", "x  y　 z", "<|endoftext|> a"])
def test_cached_encoder_gives_the_tokenizers_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing._Encoder(path)(text) == np.array(ids, "<u4").tobytes()


# simhash


def test_codewords_meet_within_two_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for x in a:
        for bits in ((), (3,), (22, 23), (0, 63), (45, 50)):
            y = np.uint64(int(x) ^ sum(1 << b for b in bits))
            keys = simhash.fingerprint_keys(np.array([x, y]))
            assert set(keys[0]) & set(keys[1])


def test_near_duplicates_are_the_components_of_all_pairs(spark, docs, rows, nothing):
    got = simhash.near_duplicates(docs, in_bucket=2).collect()
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    same([(i, f) for i, f in prints], [(r[0], simhash.text_fingerprint((r[1] or "").encode())) for r in rows])
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}
    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = {f: new if r == old else r for f, r in root.items()}
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    same([(r.doc_id, r.fingerprint, r.component_id) for r in got], [(i, f"{f:016x}", least.get(root[f])) for i, f in prints])
    assert simhash.near_duplicates(nothing).count() == simhash.keep_one(nothing).count() == 0


def groups_of(rows, width=5, similarity=0.8):
    """Lists of rows whose shingle sets are linked by similarity."""
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if (w := (r[1] or "").encode().lower().split()) else set() for r in rows]
    groups = []
    for r, s in zip(rows, sets, strict=True):
        near = [g for g in groups if any(len(s & x) >= similarity * len(s | x) for x, _ in g)]
        groups = [g for g in groups if g not in near] + [[(s, r), *(m for g in near for m in g)]]
    return [[r for _, r in g] for g in groups]


def test_one_of_each_group_stays(spark, docs, rows, nothing):
    kept = simhash.keep_one(docs)
    expected = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups_of(rows)]
    assert kept.columns == docs.columns
    same([(r.doc_id, (r.text or "").strip()) for r in kept.collect()], [(r[0], (r[1] or "").strip()) for r in expected])
    assert simhash.keep_one(nothing).count() == 0


def test_near_copies_are_found(spark):
    """Held against all pairs: nine tenths of the pairs at 0.8 or more at least, and no other."""
    rng, rows = random.Random(9), []
    for i in range(60):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 6))) for _ in range(rng.randrange(60, 400))]
        rows.append((2 * i, " ".join(words)))
        rate = rng.choice([0.002, 0.005, 0.01, 0.015, 0.02, 0.04, 0.08])
        rows.append((2 * i + 1, " ".join("changed" if rng.random() < rate else w for w in words)))
    links = simhash.similar_links(spark.createDataFrame([(i, i, t) for i, t in rows], "_k1 long, _k2 long, text string")).collect()
    true = {tuple(sorted(r[0] for r in g)) for g in groups_of(rows) if len(g) == 2 and len({t for _, t in g}) == 2} | {(2 * i, 2 * i + 1) for i in range(60) if rows[2 * i][1] == rows[2 * i + 1][1]}
    found = {tuple(sorted(x)) for x in links}
    assert found <= true and len(true) > 25 and len(found) >= 0.9 * len(true)


def same_components(spark, texts, **settings):
    links = simhash.similar_links(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_k1 long, _k2 long, text string"), **settings).collect()
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := t.split()) else frozenset() for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert {tuple(sorted(x, reverse=True)) for x in links} <= set(alike)

    def groups(pairs):
        root = list(range(len(texts)))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i, r in enumerate(root) if r == x) for x in root}

    assert groups(links) == groups(alike)
    return len(alike)


def test_appended_cut_and_replaced_passages_are_found(spark):
    rng, texts = random.Random(4), []
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    for i in range(150):
        words = [word() for _ in range(rng.randrange(80, 400))]
        n = int(len(words) * rng.choice([0.06, 0.1]) if i % 3 == 2 else len(words) * rng.choice([0.15, 0.2, 0.23]))
        at = rng.randrange(len(words) - n)
        passage = [word() for _ in range(n)]
        other = (words + passage, words[: len(words) - int(n * 0.8)], words[:at] + passage + words[at + n :])[i % 3]
        texts += [" ".join(words), " ".join(other)]
    assert same_components(spark, texts) > 100


@pytest.mark.parametrize("in_bucket", [3, 48])
def test_large_buckets_lose_no_links(spark, in_bucket):
    """A group of copies that are near the original alone, a chain of versions, and pairs in a crowd with one passage."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    words = [word() for _ in range(200)]
    change = lambda w, at, n: w[:at] + [word() for _ in range(n)] + w[at + n :]
    texts = [" ".join(change(words, rng.randrange(180), 16)) for _ in range(60)]
    texts.insert(25, " ".join(words))
    chain = [word() for _ in range(120)]
    for _ in range(60):
        texts.append(" ".join(chain))
        chain = chain[6:] + [word() for _ in range(6)]
    shared = [word() for _ in range(90)]
    for _ in range(60):
        own = [word() for _ in range(15)]
        texts += [" ".join(shared + own), " ".join(shared[:-1] + own + [word()])] if rng.random() < 0.3 else [" ".join(shared[:70] + own + [word() for _ in range(10)])]
    assert same_components(spark, texts, in_bucket=in_bucket) > 100


@pytest.mark.parametrize("in_bucket", [2, 100])
def test_links_give_the_components_of_planted_neighbours(spark, in_bucket):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(15):
            x ^= 1 << rng.randrange(64) ^ (1 << rng.randrange(64) if rng.random() < 0.7 else 0)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), in_bucket=in_bucket).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    root = {x: x for x in signed}
    other = dict(root)

    def join(r, a, b):
        old, new = r[a], r[b]
        for x in r:
            if r[x] == old:
                r[x] = new

    for a, b in links:
        join(root, a, b)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                join(other, a, b)
    assert len(set(root.values())) == len(set(other.values()))


# quality


def brute_repeats(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_repeat_lengths(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [[rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 5))]
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        assert quality.repeat_lengths(np.array(sum(docs, []), np.int64), doc).tolist() == sum(map(brute_repeats, docs), [])


def test_quality_measures(docs, rows, nothing):
    got = quality.measure(docs).collect()
    expected = []
    for r in rows:
        words, text = words_of(r[1]), r[1] or ""
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        marked = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.strip()]
        expected.append((r[0], len(words), sum(len(w.decode()) for w in words), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)))
    same([(r.doc_id, *r._quality[:5]) for r in got], expected)
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 45 in ids and not ids & {40, 41, 42, 46, 47}
    assert quality.filter_quality(nothing).count() == 0


# licenses


def test_automaton_matches():
    rng = random.Random(2)
    for _ in range(150):
        templates = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        automaton, x = license_scan.SuffixAutomaton(templates), [rng.randrange(3) for _ in range(12)]
        stands = lambda r: {(t, i + len(r)) for t, w in enumerate(templates) for i in range(len(w) - len(r) + 1) if w[i : i + len(r)] == r}  # noqa: B023, E731
        expected = {(j, j - i) for i in range(12) for j in range(i + 2, 13) if stands(x[i:j]) and (j == 12 or not stands(x[i : j + 1])) and (i == 0 or not stands(x[i - 1 : j]))}
        got = automaton.matches(x, 2)
        assert {(e, n) for e, n, _ in got} == expected and all(automaton.ends[s] == stands(x[e - n : e]) for e, n, s in got)


def test_license_scan(spark, nothing):
    mit = license_scan.TEMPLATES["mit"]
    texts = ["Under the MIT License. mit license", "x " + mit.upper() + " y", None, "", "general public GENERAL public license", mit.replace("without limitation", "changed words")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert [tuple(p) for p in got[0].places] == [(2, "mit"), (4, "mit")]
    assert [(s.label, s.start, s.share) for s in got[1].spans if s.share > 0.5] == [("mit", 1, 1.0)]
    assert got[2].n_words == got[3].n_words == 0 and [tuple(p) for p in got[4].places] == [(2, "gpl")]
    assert max(s.share for s in got[5].spans) > 0.9
    assert license_scan.scan_licenses(nothing).count() == 0


# decontamination


def test_decontamination_against_all_windows(spark, docs, rows, nothing):
    texts = [r[1] for r in rows if r[1]]
    items = [(0, " ".join(texts[0].split()[-40:-10]).upper()), (1, "W3, w9"), (2, None), (3, "..."), (4, "nowhere to be found in any of all these texts at all"), (5, " ".join(texts[45].split()[:25])), (5, "w1"), (None, "w2 w2")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.find_phrases(docs, bench).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t).decode())
    expected = []
    for r in rows:
        words, hit, found = split(r[1]), set(), set()
        for i, t in items:
            item = split(t)
            n = min(10, len(item))
            windows = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)} if n else set()
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    found.add("" if i is None else str(i))
        expected.append((r[0], len(words), len(hit), ",".join(sorted(found))))
    same([(r.doc_id, r._found.n_words, r._found.n_hit, ",".join(r._found["items"])) for r in got], expected)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(e[2] == 0 for e in expected)
    assert decontaminate.find_phrases(nothing, bench).count() == 0
    assert {r._found.n_hit for r in decontaminate.find_phrases(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, 1, "a red b c fox"), (2, 2, "a red b fox"), (3, 3, "red x x x x x x fox")], "_k1 long, _k2 long, text string")
    slots = spark.createDataFrame([(9, 0, "red"), (9, 2, "fox")], "item_no long, q int, term string")
    near = decontaminate.proximity_matches(decontaminate.positional_index(docs, slots, "text"), slots, 3).collect()
    assert [(r._k1, r.apart) for r in near] == [(1, 1)]


def test_near_matches_of_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, item), (2, item.replace("epsilon", "epsilon and more")), (3, "alpha only"), (None, None)], "doc_id int, text string")
    bench = spark.createDataFrame([(7, item)], "item_id int, text string")
    assert [tuple(r) for r in decontaminate.find_near(docs, bench).collect()] == []  # its two rarest terms stand before what is put in
    wide = spark.createDataFrame([(7, "zeta one two three four kappa")], "item_id int, text string")
    moved = spark.createDataFrame([(1, "x zeta one two three inserted four kappa one two three four one two three four")], "doc_id int, text string")
    assert [tuple(r) for r in decontaminate.find_near(moved, wide).collect()] == [(1, "7", 1)]


def test_repetitive_texts_and_items(spark):
    """A long text of one word has more pairs of postings than can be held; their number is told without them."""
    docs = spark.createDataFrame([(1, "a " * 300_000), (2, "b a " * 20), (3, "a " * 39 + "b"), (4, None)], "doc_id int, text string")
    items = spark.createDataFrame([("x", "a " * 40)], "item_id string, text string")
    began = time.perf_counter()
    got = {r.doc_id: r._found for r in decontaminate.find_phrases(docs, items).collect()}
    assert time.perf_counter() - began < 60
    assert [(got[i].n_words, got[i].n_hit, got[i]["items"]) for i in (1, 2, 3, 4)] == [(300_000, 300_000, ["x"]), (40, 0, []), (40, 39, ["x"]), (0, 0, [])]
    terms = 32  # of each window of x, the first two of its equal words
    begins = Counter(p - q for p in range(300_000) for q in range(terms))
    met = sum(n * begins[b + d] for b, n in begins.items() for d in (1, 2, 3)) - terms * sum(300_000 - d for d in (1, 2, 3))
    assert got[1].n_near == met


def test_many_begins_are_compared_like_few(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices("ab", weights=(5, 1), k=n))
    docs = spark.createDataFrame([(i, text(rng.randrange(0, 400))) for i in range(30)], "doc_id int, text string").coalesce(1)
    items = spark.createDataFrame([(f"i{i}", text(rng.randrange(1, 30))) for i in range(6)], "item_id string, text string")
    words = [plain.split() for _, plain in docs.collect()]
    got = {r.doc_id: r._found for r in decontaminate.find_phrases(docs, items).collect()}
    listed = [(r.item_id, r.text.split()) for r in items.collect()]
    for i, w in enumerate(words):
        hit, found = set(), set()
        for name, t in listed:
            n = min(10, len(t))
            windows = {tuple(t[j : j + n]) for j in range(len(t) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(name)
            begins = np.arange(-len(t), len(w) + 1)
            covered = decontaminate._covered([x.encode() for x in w], [x.encode() for x in t], begins, n)
            assert set(np.flatnonzero(covered)) == {p for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows for p in range(j, j + n)}
        assert got[i].n_hit == len(hit) and got[i]["items"] == sorted(found)


@pytest.mark.parametrize("seed,slop", [(1, 3), (2, 1), (3, 5)])
def test_all_proximity_matches_are_found(spark, seed, slop):
    rng = random.Random(seed)
    terms = ["a", "b", "c", "d"]
    texts = [" ".join(rng.choices([*terms, "x", "y"], k=rng.randrange(1, 60))) for _ in range(25)]
    slots = [(i, q, rng.choice(terms)) for i in range(3) for q in range(0, 9, 2)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_k1 long, _k2 long, text string")
    slot_table = spark.createDataFrame(slots, "item_no long, q int, term string")
    near = decontaminate.proximity_matches(decontaminate.positional_index(docs, slot_table, "text"), slot_table, slop).collect()
    expected = []
    for i, t in enumerate(texts):
        for item in range(3):
            at = [(p - q, q) for p, w in enumerate(t.split()) for no, q, term in slots if no == item and w == term]
            expected += [(i, i, item, b, c - b) for b, q in at for c, r in at if q != r and 1 <= c - b <= slop]
    assert len(expected) > 50
    same(near, expected)


# secrets


def test_secret_patterns_and_redaction(spark, rows, nothing):
    hexes = hashlib.sha256(b"x").hexdigest()
    texts = ["Token = 'abc'; token : abc token= abcdef", f"😀 {hexes} PASSWD:\"{hexes[:30]}\"", "AKIA" + "A1" * 9 + " AKIAAKIAX", None, "", "tokentoken==abcdef api-key api_key:x.y.z-1", "no secret"]
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        expected = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        expected += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(s) for s in got[i]._spans if s.kind < 3] == sorted(expected)
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert clean[1] == "😀 [SECRET] [SECRET]\"" and clean[3] is None and clean[6] == "no secret" and hexes not in str(clean)
    assert secrets.find_secrets(nothing).columns == [*nothing.columns, "_spans"] and secrets.redact(nothing).count() == 0


def test_random_tokens_are_told_from_words(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(60)]
    plain = ["internationalizationsandmore", "this-is-a-long-slug-of-words-in-a-url", "path/to/some/long/file/name/here", "=" * 40, "ababababababababababababababab", "20240101202401012024"] * 10
    found = {r.text: [s for s in r._spans if s.kind == 3] for r in secrets.find_secrets(spark.createDataFrame([(t,) for t in keys + plain], "text string")).collect()}
    assert sum(bool(found[k]) for k in keys) >= 55 and not any(found[p] for p in plain)


# pages


def test_a_strong_token_passes_in_a_crowd(spark):
    """Its deviation is beyond what two million ordinary candidates of its band have."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=120))
    found = spark.createDataFrame([(token,)], "text string").select(secrets._places(F.col("text"), secrets.TOKEN, 3).alias("tokens"))
    found = found.select(secrets._battery(F.col("tokens"), 1e-4).alias("random"))
    (own,) = found.first().random
    plain = F.struct(F.lit(0).cast("long").alias("start"), F.lit(3).alias("kind"), F.lit(0).cast("long").alias("end"), F.lit(own.band).alias("band"), F.lit(0).alias("x"))
    crowd = spark.range(200).select(F.array_repeat(plain, 10_000).alias("random"))
    assert secrets.thresholds(found.unionByName(crowd), 0.05) == {own.band: own.x}



def test_main_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy now <b>x</b></div>"
        "<article><h1>A &amp; B</h1><p>One\n two<br>three<p>Short.</p><script>var t = '</p>';</script><section class='comments'><p>Reader says a lot of things here and there.</p></section></article>"
        "<!-- <p>not this</p> --><aside>More to read</aside><footer>&copy; us</footer></body></html>"
    )
    plain = "<div><p>" + "word " * 60 + "</p></div><div><a href=x>one</a> <a href=y>two</a></div>"
    rows = [(1, "u", page), (2, "u", None), (None, None, ""), (4, "u", plain), (5, "u", "<article><h1>Cut &am"), (6, "u", "<article><p>x < y</p"), (6, "u", "<article><p>x < y</p")]
    got = [(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()]
    same(got, [(1, "A & B One two three Short."), (2, ""), (None, ""), (4, ("word " * 60).strip()), (5, "Cut &am"), (6, "x < y"), (6, "x < y")])


def test_tree_knows_its_table():
    x, y = html_text.labelled_blocks()
    assert ((html_text.decide(html_text.trained_tree(), x) >= 0.5) == (y == 1)).all()


# substring dedup


def test_equal_rows_take_linear_time(spark):
    text = " ".join(str(i * i) for i in range(300))
    rows = spark.range(4000).selectExpr("1 as doc_id", f"'{text}' as text").repartition(4)
    began = time.perf_counter()
    got = substring_dedup.remove_repeats(rows).selectExpr("sum(n_removed) as gone", "count(*) as n").first()
    assert tuple(got) == (300 * 4000, 4000) and time.perf_counter() - began < 60


@pytest.mark.parametrize("k,m", [(35, 8), (6, 2), (3, 3), (80, 8), (110, 4)])
def test_repeats_against_all_windows(docs, rows, nothing, k, m):
    got = substring_dedup.remove_repeats(docs, k, m).collect()
    count = Counter(tuple(words_of(r[1])[i : i + k]) for r in rows for i in range(len(words_of(r[1])) - k + 1))
    expected = []
    for r in rows:
        words = words_of(r[1])
        gone = {p for i in range(len(words) - k + 1) if count[tuple(words[i : i + k])] > 1 for p in range(i, i + k)}
        expected.append((r[0], len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    same([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], expected)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(nothing, k, m).count() == 0


# language model


def test_class_model(docs, rows, nothing):
    settings = lm_score.Settings(known=0.002, clustered=0.01, classes=3, rounds=3)
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    model = lm_score.train(docs.where(~lm_score.held_out()).select("text"), settings)
    tokens = lambda t: [*lowered(t).split(), None]
    count = Counter(w for r in train for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.types) == (n, v)
    all_words = n - count[None]
    assert {w: k for w, (_, k) in model.known.items()} == {w: k for w, k in count.items() if w is not None and k >= max(2, 0.002 * all_words)}
    classes = {w: c for w, (c, _) in model.known.items()}
    assert {w for w, c in classes.items() if c > 1} == {w for w, k in count.items() if w is not None and k >= max(2, 0.01 * all_words)}
    of = lambda w: 0 if w is None else classes.get(w, 1)
    pairs, of_class, kinds = Counter(), Counter(), Counter(of(w) for w in count if w is not None)
    for r in train:
        before = 0
        for w in tokens(r[1]):
            pairs[before, of(w)] += 1
            of_class[of(w)] += 1
            before = of(w)
    size, total = settings.all_classes, sum(of_class.values())

    def probability(before, w):
        c = of(w)
        share = (of_class[c] + 1) / (total + size)
        step = (pairs[before, c] + settings.transition * share) / (sum(pairs[before, x] for x in range(size)) + settings.transition)
        return step * (1 if w is None else (count[w] + settings.emission) / (of_class[c] + settings.emission * (kinds[c] + 1)))

    expected = Counter()
    for r in rows:
        base = own = before = 0
        for w in tokens(r[1]):
            base += np.log10((count[w] + 1) / (n + v + 1))
            own += np.log10(probability(before, w))
            before = of(w)
        expected[r[0], len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), round(base, 6), round(own, 6)] += 1
    got = lm_score.score(docs, model).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == expected
    empty = lm_score.train(nothing.select("text"), settings)
    assert lm_score.score(nothing, empty).count() == 0 and all(np.isfinite(r.score) for r in lm_score.score(docs, empty).collect())


def test_exchange_moves_gain_what_they_say():
    rng = np.random.default_rng(4)
    words, size = 12, 4
    pairs = rng.integers(0, 9, (words, words))
    classes = np.array([0, *rng.integers(1, size, words - 1)])

    def matrix(classes):
        m = np.zeros((size, size))
        np.add.at(m, (classes[:, None], classes[None, :]), pairs)
        return m

    score = lambda m: lm_score._g(m).sum() - lm_score._g(m.sum(0)).sum() - lm_score._g(m.sum(1)).sum()
    for w in range(1, words):
        after, before = (np.bincount(classes, weights=x, minlength=size) for x in (pairs[w], pairs[:, w]))
        gain = lm_score.move_gains(matrix(classes), classes[w], after, before, pairs[w, w])
        for c in range(size):
            moved = classes.copy()
            moved[w] = c
            assert np.isclose(gain[c], score(matrix(moved)) - score(matrix(classes)))


def test_exchange_finds_alternating_classes(spark):
    rng = random.Random(1)
    texts = [(" ".join(w for _ in range(30) for w in (rng.choice("abcd"), rng.choice("wxyz"))),) for _ in range(60)]
    model = lm_score.train(spark.createDataFrame(texts, "text string"), lm_score.Settings(known=0.001, clustered=0.001, classes=2, rounds=8))
    classes = {w: c for w, (c, _) in model.known.items()}
    assert len({classes[w] for w in (b"a", b"b", b"c", b"d")}) == 1 and len(set(classes.values())) == 2


def test_neighbours_of_words(spark):
    texts = ["b a b", "", None, "a rare b a"]
    got = {r.w: sorted(zip(r.o, r.n, strict=True)) for r in lm_score.neighbours(spark.createDataFrame([(t,) for t in texts], "text string"), [b"a", b"b"]).collect()}
    ids = {"a": 2, "b": 3}
    expected = {}
    for t in texts:
        at = [0, *(ids.get(x, 1) for x in (t or "").split()), 0]
        for x, y in zip(at, at[1:], strict=False):
            expected.setdefault(x, Counter())[y] += 1
            expected.setdefault(y, Counter())[-x - 1] += 1
    assert got == {w: sorted(c.items()) for w, c in expected.items()}


def test_counts_beyond_an_int(spark):
    n = {2 * 4 + 3: 3 << 31, 2 * 4 + 2: (1 << 31) - 1, 3 * 4 + 2: 1 << 31}
    lists = lm_score.listed(spark.createDataFrame(list(n.items()), "code long, n long"), 4).coalesce(1)
    classes = np.array([0, 1, 2, 3])
    w, counts, itself = lm_score._by_class(lists.toArrow().combine_chunks().to_batches()[0], classes, 4)
    at = {x: i for i, x in enumerate(w.tolist())}
    assert counts[at[2], 0].tolist() == [0, 0, (1 << 31) - 1, 3 << 31] and counts[at[2], 1].tolist() == [0, 0, (1 << 31) - 1, 1 << 31]
    assert itself[at[2]] == (1 << 31) - 1 and counts[at[3], 0].tolist() == [0, 0, 1 << 31, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_held_out_perplexity_is_below_the_unigrams(spark, seed):
    """Sentences of a small grammar, whose word order the classes have to find."""
    rng = random.Random(seed)
    parts = [[f"{k}{i}" for i in range(40)] for k in ("det", "adj", "noun", "verb")]
    text = lambda: " ".join(rng.choice(p) for _ in range(rng.randrange(2, 8)) for p in parts)
    train = [(text(),) for _ in range(300)]
    model = lm_score.train(spark.createDataFrame(train, "text string"), lm_score.Settings(classes=6))
    held = lm_score.score(spark.createDataFrame([(i, text()) for i in range(50)], "doc_id int, text string"), model).agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert held["sum(score)"] / held["sum(n_tokens)"] > held["sum(base_score)"] / held["sum(n_tokens)"] + 0.4


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>no</title><script>var x = '<p>'</script><meta charset=utf-8><body><nav><a>no</a></nav>{}</body></html>",
        "<html><head><title>no</title></head><body><div class='content-sidebar-wrap'>{}</div></body></html>",
        "<div class='has-sidebar'><div class='page-with-comments'>{}</div></div>",
        "<form id='page'><main>{}</main></form>",
    ],
)
def test_wrappers_and_open_heads_keep_the_article(page):
    words = " ".join(["word"] * 60)
    article = f"<article><header class='entry-header'><h1>A headline here</h1></header><p>{words}</p><p>{words}</p></article>"
    assert html_text.main_text(page.format(article), html_text.trained_tree()) == f"A headline here {words} {words}"


WORDS = "the market of rivers and stones was open when a boat with grain came up from old town".split()


def held_out_pages():
    """(html, main text) of pages with other mark-up and other texts than the labelled ones of the module."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    out = []

    def page(*parts):
        """Parts are mark-up; a pair is mark-up with {} and main text for it."""
        out.append(("".join(p if isinstance(p, str) else p[0].format(p[1]) for p in parts), " ".join(p[1] for p in parts if not isinstance(p, str))))

    for _ in range(6):
        h, a, b, c = text(rng.randrange(3, 12)), text(rng.randrange(20, 120)), text(rng.randrange(1, 60)), text(rng.randrange(15, 200))
        menu = "<ul class='menu'>" + "".join(f"<li><a href='/x{i}'>{text(2)}</a></li>" for i in range(5)) + "</ul>"
        notes = "".join(f"<div class='comment'><b>{text(1)}</b><p>{text(rng.randrange(5, 90))}</p></div>" for _ in range(3))
        script = "<script>if (a < b && c > d) { document.write('<p>no</p>'); } for(i=0;i<n;i++){}</script>"
        page("<!doctype html><html><head><title>", text(4), "</title>", script, "</head><body><div id=top>", menu, "</div>", ("<article><h1>{}</h1>", h), ("<p>{}</p>", a), ("<p>{}", b), ("<p>{}</p></article>", c), f"<section id='comments'>{notes}</section><footer>{text(9)}</footer></body></html>")
        page(f"<div class='page has-sidebar'><nav>{menu}</nav><div class=post>", ("<h1>{}</h1>", h), ("<p>{}</p>", a), ("<p>{}</p>", c), f"</div><div class='sidebar'><h3>{text(2)}</h3><p>{text(20)}</p></div><div class='footer'>{text(6)}</div></div>")
        page(f"<header><a href=/>{text(2)}</a></header><form id=aspnetForm action=x>{menu}<main>", ("<h1>{}</h1>", h), ("<div>{}</div>", a), ("<blockquote>{}</blockquote>", c), f"</main><input name=q></form><div class='reader-feedback'><p>{text(50)}</p></div>")
        page(f"<div class='cookie-banner'>{text(12)} <button>{text(1)}</button></div>{menu}", ("<h1>{}</h1>", h), ("<p title=don't>{}</p>", a), ("<ul><li>{}", b), ("<li>{}</ul>", text(8)), ("<p>{}</p>", c), f"<div id='disqus_thread'>{notes}</div><div><a>{text(2)}</a> | <a>{text(3)}</a></div>")
        page("<table><tr><td>", menu, ("<td><p>{}</p>", c), ("<p>{}</p>", a), "</table>", f"<div class='adv'><p>{text(25)}</p></div>")
        page(("<article><header><h2>{}</h2></header>", h), f"<div class='social-share'><a>{text(1)}</a></div>", ("<p>{}</p>", a), f"<div class='newsletter'><p>{text(14)}</p><form><input></form></div>", ("<p>{}</p>", c), "</article>", f"<div><h4>{text(2)}</h4><p>{text(30)}</p><p>{text(18)}</p></div>")
    return out


def test_words_of_held_out_pages(spark):
    pages = held_out_pages()
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "page_id int, html string"), ("page_id",)).collect()}
    found = wanted = both = 0
    for i, (_, main) in enumerate(pages):
        a, b = Counter(got[i].split()), Counter(main.split())
        found, wanted, both = found + a.total(), wanted + b.total(), both + (a & b).total()
    assert both >= 0.98 * wanted and both >= 0.98 * found


ARTICLE = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "page",
    [
        "<script>for(var i=0;i<n;i++){{go(i)}}</script><article><p>{}</p></article>",
        "<div class='layout with-sidebar'><article><p>{}</p></article></div>",
        "<div class='notice-free'><article><p>{}</p></article></div>",
        "<form id='aspnetForm'><article><p>{}</p></article></form>",
        "<article><p title=don't>{}</p></article>",
        "<article><p>{}</p></article><div class='user-feedback'><p>readers say a lot</p></div>",
        "<title>no</title><SCRIPT>var x = '<article>'</SCRIPT\n><article><p>{}</article>",
        "<style>p > a < b<body><article><p>{}</p></article>",
        "<article><p data-x='>' class=\"a>b\">{}</p></article>",
        "<article><svg><title>no</title><text>no</text></svg><p>{}</p><textarea>no <p>no</textarea></article>",
        "<noscript>no<div><article><p>{}</p></article>".replace("<div>", "</noscript><div>"),
        "<!-- <article> --><!DOCTYPE x><?xml no?><article><p>{}</p></article></span></b>",
    ],
)
def test_pages_as_they_occur(page):
    assert html_text.main_text(page.format(ARTICLE), html_text.trained_tree()) == ARTICLE


@pytest.mark.parametrize("part", ["<a", "<a =\">\" ", "<a x='", "<div>", "<p></i>", "<script>", "<!--", "</", "< ", "&amp", "<h1>", "<article>", "<a href=x>b "])
def test_long_broken_pages_take_linear_time(part):
    began = time.perf_counter()
    html_text.main_text(part * (400_000 // len(part)), html_text.trained_tree())
    html_text.main_text("<div>" * 20_000 + part * 20_000 + "</p></a></div>" * 20_000, html_text.trained_tree())
    assert time.perf_counter() - began < 40


def test_pages_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, "u", f"<p>{ARTICLE}</p>", "x", 2)] * 2 + [(None, None, None, None, None), (2, "v", "", "y", 3), (3, "w", " <p> ", "", 1)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string, n int")
    got = [tuple(r) for r in html_text.extract(pages).collect()]
    same(got, [(1, "u", ARTICLE)] * 2 + [(None, None, ""), (2, "v", ""), (3, "w", "")])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_comments_as_articles_stay_asides():
    words = " ".join(["word"] * 60)
    page = f"<article><h1>A headline here</h1><p>{words}</p></article><div class='comments'><article class='comment'><p>{words} no</p></article></div>"
    assert "no" not in html_text.main_text(page, html_text.trained_tree()).split()


TEXT = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("h", 6), ("a", 50), ("b", 54))]
BODY = "<h1>{}</h1><p>{}</p><p>{}</p>".format(*TEXT)
CARD = "<article><h3><a href=x>no no no</a></h3><p>" + "no " * 20 + "</p></article>"
SAID = "<div><b>no no</b><p>" + "no " * 15 + "</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<main><div>{BODY}</div><div>{CARD * 2}</div></main>",
        f"<main><div>{BODY}</div><div>{CARD}</div></main>",
        f"<div>{CARD * 4}</div><div class=story>{BODY}</div>",
        f"<body><div class=wrap>{BODY}<div class=more>{CARD * 3}</div></div></body>",
        f"<div>{BODY}</div><div class=reviews>{SAID * 3}</div>",
        f"<article>{BODY}<section id=user-thoughts><h3>no</h3>{SAID * 2}</section></article>",
        f"<article>{BODY}<section id=q17>{SAID * 2}<form>no</form></section></article>",
        f"<main>{BODY}<ol>{SAID.replace('div', 'li') * 4}</ol></main>",
        f"<article>{BODY}<div class=author-bio><p>no no no no</p></div></article>",
    ],
)
def test_cards_and_threads_are_no_main_text(page):
    assert html_text.main_text(page, html_text.trained_tree()) == " ".join(TEXT)


@pytest.mark.parametrize(
    "page",
    [
        "<article><h1>{0}</h1><p>{1}</p></article><div><p>no</p></div>",
        "<article><p>{0}</p></article><article><p>{1}</p></article>",
        "<h1>{0}</h1><article><p>{1}</p></article>",
    ],
)
def test_articles_that_are_no_cards_stay(page):
    assert html_text.main_text(page.format(*TEXT), html_text.trained_tree()).endswith(TEXT[1])


def test_entries_that_are_the_page_stay():
    steps = [f"s{i} x" for i in range(4)], [" ".join(f"w{i}_{j}" for j in range(30)) for i in range(4)]
    page = "<article><h1>how to do it</h1><p>in four steps</p>" + "".join(f"<div><div>{a}</div><p>{b}</p></div>" for a, b in zip(*steps, strict=True)) + "</article>"
    assert html_text.main_text(page, html_text.trained_tree()) == "how to do it in four steps " + " ".join(f"{a} {b}" for a, b in zip(*steps, strict=True))
