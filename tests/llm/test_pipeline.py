"""The pipeline's stages on a small table against plain Python, and its registered queries."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline

from .test_operators import groups_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("aeioubcdfglmnprst", k=rng.randrange(2, 9))) for _ in range(n))
    item = prose(30)
    texts = [prose(rng.randrange(60, 400)) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), texts[2] + " and some more",  texts[1] + "\n", "short", None, "", "dup line of words here\n" * 60, prose(100) + " " + item + " " + prose(20), prose(80) + " token = 0123456789abcdef0123456789abcdef " + prose(3)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, prose(70), None, None, None)]
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def words_in_repeats(words, k):
    """Places of the words in runs of k words that start at two places or more."""
    runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    count = Counter(runs)
    return {p for i, run in enumerate(runs) if count[run] > 1 for p in range(i, i + k)}


def expected(rows, item):
    kept = []
    for r in rows:
        words = (r[1] or "").split()
        n = len(words)
        repeated, covered = (len(words_in_repeats(words, k)) for k in (3, 10))
        longest = max((k for k in range(1, n) if words_in_repeats(words, k)), default=0)
        if n >= 50 and 100 * repeated <= 50 * n and covered <= 0.3 * n and longest <= 0.2 * n:
            kept.append(r)
    single = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups_of(kept)]
    clean = [r for r in single if item.split()[5:15] != next((r[1].split()[i : i + 10] for i in range(len(r[1].split())) if r[1].split()[i : i + 10] == item.split()[5:15]), None)]
    return kept, single, clean


def test_stages(spark, tables):
    path, rows, item = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, single, clean = expected(rows, item)
    assert len(kept) > len(single) > len(clean) > 25
    for (_, stage), want in zip(corpus_pipeline.STAGES, (kept, single, clean), strict=False):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
        docs = spark.createDataFrame(out.collect(), docs.schema)
    redacted = corpus_pipeline.secret_scan(spark, docs, path)
    assert redacted.schema.names == docs.columns
    change = {r[0]: re.sub(r"token = [0-9a-f]{32}", "[SECRET]", r[1]) for r in clean}
    assert {r.doc_id: r.text for r in redacted.collect()} == change and any("[SECRET]" in t for t in change.values())
    assert all(r.n_chars in (None, len(r.text)) for r in redacted.collect())


def test_run_packs_what_is_kept(spark, tables):
    path, rows, item = tables
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in expected(rows, item)[2]:
        ids = np.array([*encoder.encode(re.sub(r"token = [0-9a-f]{32}", "[SECRET]", r[1]), add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert len(ids) <= 4 * 2048
        want.append((r[0], 0, 0, len(ids) // 4, zlib.crc32(ids)))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert sum(r.length for r in got) <= 2048 * len({r.sequence_id for r in got})


def test_run_on_empty_tables(spark, tmp_path):
    for name, kinds in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_fingerprints_give_near_dedup_its_first_pairs(spark):
    """Equal fingerprints meet their least node, those within two bits their least nodes; sizes that can't be alike don't."""
    from tidewater.llm import simhash

    nodes = spark.createDataFrame([(1, 0b1011, 10), (2, 0b1011, 10), (3, 0b1000, 11), (4, 0b111 << 40, 10), (5, 0b1011, 90)], "node long, fp long, n int")
    assert {tuple(r) for r in simhash.print_pairs(nodes, 0.8).collect()} == {(1, 2), (1, 3)}


def test_frequent_shingles_come_last_by_their_number():
    from tidewater.llm import simhash

    held, ranks = np.array([2, 5, 9]), np.array([40, 7, 20])
    assert simhash._ordered_keys(np.array([1, 2, 5, 7, 9, 11]), held, ranks).tolist() == [1, 7, 11, 5, 9, 2]
    assert simhash._ordered_keys(np.array([1, 2]), held[:0], ranks[:0]).tolist() == [1, 2]
