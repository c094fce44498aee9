"""Operators against plain calculations of the same definitions, and against SQL for their base columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tidewater.llm import decontaminate, html_text, license_scan, lm_score, packing, quality, queries, secrets, sharding, simhash, substring_dedup

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


# secrets: the battery and the thresholds


def log_tail(z):
    if z < 30:
        return math.log(0.5 * math.erfc(z / math.sqrt(2)))
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / z**2 + 3 / z**4)


def fisher(*logs):
    """Of the chi-squared distribution with six degrees of freedom, at twice the sum."""
    x = -sum(logs)
    return math.log(math.fsum([1, x, x * x / 2])) - x


def evidence(token):
    """(passes the battery, logarithm of the p-value against ordinary text) by the definitions."""
    alphabet = next(a for p, a in secrets.ENCODINGS if re.search(p, token))
    s = token.translate(str.maketrans("-_", "+/"))
    n, k = len(s), len(alphabet)
    at = [alphabet.index(c) + 1 for c in s]
    counts = Counter(at)
    chi = (sum((counts[i] - n / k) ** 2 / (n / k) for i in range(1, k + 1)) - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    halves = [x > (k + 1) / 2 for x in at]
    runs = (sum(a != b for a, b in zip(halves, halves[1:], strict=False)) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    serial = sum((a - (k + 1) / 2) * (b - (k + 1) / 2) for a, b in zip(at, at[1:], strict=False)) * 12 / (k * k - 1) / math.sqrt(n - 1)
    random_p = fisher(log_tail(chi), math.log(2) + log_tail(abs(runs)), math.log(2) + log_tail(abs(serial)))
    q2, q3 = secrets.NUMBER_SHARES if k == 16 else secrets.WORD_SHARES
    same = sum(c * (c - 1) for c in counts.values())
    spread = math.sqrt(2 * n * (n - 1) * (q2 - q2 * q2) + 4 * n * (n - 1) * (n - 2) * (q3 - q2 * q2))
    within = lambda z, step: math.log(1 - 2 * math.exp(log_tail(z + step)))
    ordinary = fisher(log_tail((n * (n - 1) * q2 - same) / spread), within(abs(runs), 0.5 / math.sqrt((n - 1) / 4)), within(abs(serial), 3 / (k * k - 1) / math.sqrt(n - 1)))
    return not s.isdigit() and random_p >= math.log(1e-4), ordinary


def random_spans(texts, rate=0.05):
    """Spans of the random tokens of each text by Benjamini-Hochberg within the bands."""
    found, tests = [], defaultdict(list)
    for i, t in enumerate(texts):
        base = [(m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t)]
        base += [(m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t):
            if not any(a <= m.start() and m.end() <= b for a, b in base):
                ok, p = evidence(m[0])
                band = sum(len(m[0]) >= b for b in secrets.BANDS)
                tests[band].append(p if ok else 0.0)
                found.append((i, m.start(), m.end(), band, p if ok else 0.0))
    limit = {}
    for band, ps in tests.items():
        ps.sort()
        limit[band] = max((p for r, p in enumerate(ps, 1) if p + math.log(len(ps)) <= math.log(rate) + math.log(r)), default=-math.inf)
    return {(i, a, b) for i, a, b, band, p in found if p < 0 and p <= limit[band]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_tokens_are_those_of_the_plain_calculation(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("etaoinshrdlucmwfgypbvkjxqz", weights=range(26, 0, -1), k=rng.randrange(3, 12)))
    makers = [
        lambda: "".join(rng.choices(ALPHABET, k=rng.choice([20, 24, 32, 40, 64, 90, 200]))),
        lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randrange(20, 60))),
        lambda: "-".join(word() for _ in range(rng.randrange(3, 9))),
        lambda: "/".join(word().capitalize() for _ in range(rng.randrange(3, 9))),
        lambda: "ab" * rng.randrange(10, 40), lambda: ALPHABET[: rng.randrange(20, 64)], lambda: "".join(rng.choices("0123456789", k=30)),
        lambda: "token = " + "".join(rng.choices(ALPHABET, k=30)), lambda: "".join(rng.choices("0123456789abcdef", k=40)), word,
    ]
    texts = [" ".join(["é", *(rng.choice(makers)() for _ in range(rng.randrange(1, 7)))]) for _ in range(300)]
    got = secrets.find_secrets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()
    own = {(r.doc_id, s.start, s.end) for r in got for s in r._spans if s.kind == 3}
    expected = random_spans(texts)
    assert len(expected) > 40 and own == expected


def test_redaction_is_that_of_plain_slices(spark):
    rng = random.Random(4)
    piece = lambda: rng.choice(["word ", "ünïcödé ", "token=abcdefgh0123456789abcdef01234567 ", "AKIA" + "B7" * 9 + " ", "0" * 30 + "\n", "secret: tokentoken=abcdefg "])
    texts = ["".join(piece() for _ in range(rng.randrange(0, 12))) for _ in range(80)] + ["", None]
    table = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id int, text string, n_chars int")
    spans = {r.doc_id: [(s.start, s.end) for s in r._spans] for r in secrets.find_secrets(table).collect()}
    for r in secrets.redact(table, length_col="n_chars").collect():
        text, out, at = texts[r.doc_id], "", 0
        for a, b in spans[r.doc_id]:
            if b > at:
                out += text[at:a] + "[SECRET]" if a >= at else ""
                at = b
        assert r.text == (None if text is None else out + text[at:]) and r.n_chars == len(r.text or "")


def test_secrets_of_very_long_texts(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choices(ALPHABET, k=n))
    texts = [key(1_000_000), " ".join(f"token=abcdef{i}" for i in range(40_000)), " ".join(key(24) for _ in range(10_000))]
    got = {r.doc_id: r for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got[0].text == "[SECRET]" and got[1].text == " ".join(["[SECRET]"] * 40_000)


# licenses: matches, chains and phrases


def plain_template_spans(words, templates, at_least, gap):
    """Maximal runs that stand in some template, found by comparing all places, chained by template in order."""
    places = lambda run: [(t, i + len(run)) for t, (_, w) in enumerate(templates) for i in range(len(w) - len(run) + 1) if w[i : i + len(run)] == run]
    matches, reach = [], 0
    for i in range(len(words)):
        j = i
        while j < len(words) and places(words[i : j + 1]):
            j += 1
        if j > reach and j - i >= at_least:
            matches.append((i, j))
        reach = max(reach, j)
    spans, open_ = [], {}
    for i, j in matches:
        for t, to in sorted(places(words[i:j])):
            at = open_.get(t)
            if at and i - at[1] <= gap and at[2] < to:
                more = min(j - i, to - at[2], j - at[1])
                if more > 0:
                    open_[t] = (at[0], j, to, at[3] + more)
            elif not at or i >= at[1]:
                if at:
                    spans.append((t, at))
                open_[t] = (i, j, to, j - i)
    spans += open_.items()
    return sorted((a, b, templates[t][0], n / len(templates[t][1])) for t, (a, b, _, n) in spans)


@pytest.mark.parametrize("seed", range(4))
def test_license_spans_are_those_of_a_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = tuple((f"l{k}", " ".join(rng.choices("abcdef", k=rng.randrange(3, 25)))) for k in range(rng.randrange(1, 4)))
        split = [(label, t.split()) for label, t in texts]
        words = []
        for _ in range(rng.randrange(0, 6)):
            w = rng.choice(split)[1]
            i = rng.randrange(len(w))
            words += w[i : i + rng.randrange(1, 15)] + rng.choices(["a", "b", "zz"], k=rng.randrange(0, 4))
        got = license_scan.template_spans([w.encode() for w in words], texts, 3, 4)
        assert [(a, b, label, share) for label, a, b, share, _ in got] == plain_template_spans(words, split, 3, 4)
        for label, a, b, share, best in got:
            assert best == all(share >= y[3] for y in got if y[1] < b and a < y[2]), (label, a, b)


def test_license_scan_of_long_and_odd_rows(spark):
    mit = license_scan.TEMPLATES["mit"]
    rows = [(1, mit + " word" * 300_000 + " MIT license", "x"), (1, mit, None), (1, mit, None), (None, None, None), (2, " \n", "y"), (3, license_scan.TEMPLATES["gpl"], "agpl")]
    table = spark.createDataFrame(rows, "doc_id int, text string, spans string")
    got = license_scan.scan_licenses(table).collect()
    assert len(got) == len(rows) and sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 1, 2, 3]
    assert max(r.n_words for r in got) == len(re.findall("[A-Za-z0-9]+", mit)) + 300_002
    assert all(any(s.label == "mit" and s.share == 1 for s in r.spans) for r in got if r.doc_id == 1)
    assert [s.label for r in got if r.doc_id == 3 for s in r.spans if s.best and s.share > 0.4] == ["gpl"]
    assert license_scan.scan_licenses(table.limit(0)).count() == 0


# base columns in SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def test_license_base_is_that_of_sql(spark, sf_dir, duck):
    sql = rf"""
    with d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    starts as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
    found as (select doc_id, i - 1 as place, label from starts join (values ('mit license', 'mit', 2), ('apache license', 'apache', 2), ('general public license', 'gpl', 3)) v(phrase, label, n)
        on array_to_string(w[i : i + n - 1], ' ') = phrase)
    select d.doc_id, any_value(len(w)), count(place), min(place), max(place), coalesce(string_agg(distinct label, ',' order by label), '') from d left join found using (doc_id) group by 1 order by 1"""
    got = license_scan.op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").orderBy("doc_id").collect()
    expected = duck.execute(sql).fetchall()
    assert [tuple(r) for r in got] == expected and any(r[2] for r in expected)


def test_unigram_base_is_that_of_sql(spark, sf_dir, duck):
    sql = rf"""
    with recursive step(i, c, k) as (select i, i, 0 from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
    crc as (select list(c order by i) as t from step where k = 8),
    d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 2 as held from documents, crc),
    tokens as (select doc_id, held, unnest(list_append(w, chr(0))) as token from d),
    counts as (select token, count(*) as c from tokens where not held group by 1),
    total as (select sum(c) as n, count(*) as v from counts)
    select doc_id, held, count(*), count(c), any_value(n)::bigint, sum(log10((coalesce(c, 0) + 1) / (n * 1.0 + v + 1))) from tokens left join counts using (token), total group by 1, 2 order by 1"""
    got = lm_score.op10_class_lm(spark, sf_dir).orderBy("doc_id").collect()
    expected = duck.execute(sql).fetchall()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [r[:5] for r in expected]
    assert all(math.isclose(r.base_score, e[5], rel_tol=1e-9) for r, e in zip(got, expected, strict=True))
    assert 0 < sum(r.held_out for r in got) < len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_that_of_its_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == expected and expected


# clashing names, nulls, repeats and empty tables, for every operator


CLASHING = "doc_id bigint, text string, source string, n_chars int, _k1 bigint, _k2 string, _spans string, _found int, _quality int, _row int, node int, key int, n int, kept string, w int, o int, `a b` string"


@pytest.mark.parametrize(
    "run",
    [
        license_scan.scan_licenses, lambda d: packing.pack(d, packing.public_tokenizers.path("byte_bpe_50k.json")), lambda d: secrets.find_secrets(d, keep_text=False), secrets.redact, sharding.shard,
        simhash.near_duplicates, quality.measure, substring_dedup.remove_repeats, lambda d: lm_score.score(d, lm_score.train(d.select("text"))), lambda d: html_text.extract(d, ("doc_id", "source"), "text"),
    ],
    ids=["licenses", "packing", "secrets", "redact", "shards", "simhash", "quality", "substrings", "model", "pages"],
)
def test_odd_tables(spark, run):
    extra = (None,) * 13
    rows = [(1, "some words here and there", "x", 3, *extra)] * 3 + [(None, None, None, None, *extra)] * 2 + [(None, "some words here and there", None, None, *extra), (2, "", "x", 0, *extra), (3, "\n \t", "y", 3, *extra)]
    table = spark.createDataFrame(rows, CLASHING)
    assert run(table).count() == len(rows)
    assert run(table.limit(0)).count() == 0




@pytest.mark.parametrize("keep", [simhash.keep_one, quality.filter_quality, lambda d: decontaminate.drop_contaminated(d, d.select(d.doc_id.alias("item_id"), "text").where("text > 'z'"))], ids=["near", "quality", "benchmark"])
def test_filters_of_odd_tables(spark, keep):
    extra = (None,) * 13
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "x", 3, *extra)] * 2 + [(None, None, None, None, *extra), (2, "", "x", 0, *extra)]
    table = spark.createDataFrame(rows, CLASHING)
    kept = keep(table)
    assert kept.columns == table.columns and 1 in {r.doc_id for r in kept.collect()}
    assert keep(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def long_table(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(4000)}" for _ in range(250_000)]
    texts = [" ".join(words), " ".join(words[:200_000]) + " end", "x" * 1_500_000, "short text here"]
    return spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, n_chars bigint")


@pytest.mark.parametrize(
    "run",
    [
        license_scan.scan_licenses, lambda d: packing.pack(d, packing.public_tokenizers.path("byte_bpe_50k.json")), secrets.redact, sharding.shard, simhash.near_duplicates, quality.measure,
        substring_dedup.remove_repeats, lambda d: lm_score.score(d, lm_score.train(d.select("text"))), lambda d: html_text.extract(d, ("doc_id", "source"), "text"), simhash.keep_one,
        lambda d: decontaminate.find_phrases(d, d.select(d.doc_id.alias("item_id"), "text").where("doc_id = 3")),
    ],
    ids=["licenses", "packing", "redact", "shards", "simhash", "quality", "substrings", "model", "pages", "near", "phrases"],
)
def test_very_long_texts(long_table, run):
    rows = run(long_table)
    ids = [r[0] for r in rows.select("doc_id").collect()]
    assert set(ids) <= {0, 1, 2, 3} and {0, 2, 3} <= set(ids)
    if "kept" in rows.columns:
        assert {r.doc_id: r.n_removed for r in rows.collect()} == {0: 200_000, 1: 200_000, 2: 0, 3: 0}
