"""Periodic runs against all stretches of small texts."""

import random
import time

import numpy as np
import pytest

from tidewater.llm import periodic_runs


def plain_runs(words, least, times):
    n, found = len(words), []
    smallest = lambda s: next(q for q in range(1, len(s) + 1) if all(s[i] == s[i - q] for i in range(q, len(s))))
    for a in range(n):
        for b in range(a + least, n + 1):
            q = smallest(words[a:b])
            if b - a < times * q or a and words[a - 1] == words[a - 1 + q] or b < n and words[b] == words[b - q]:
                continue
            found.append((a, b - a, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least,times", [(6, 4), (1, 3)])
def test_runs_are_those_of_all_stretches(spark, seed, least, times):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        words = [rng.choice("ab") for _ in range(rng.randrange(0, 9))]
        for _ in range(rng.randrange(0, 3)):
            root = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
            words += (root * 6)[: rng.randrange(0, 6 * len(root))] + [rng.choice("abcd") for _ in range(rng.randrange(0, 4))]
        texts.append(words[:60])
    table = spark.createDataFrame([(i, " \n".join(w)) for i, w in enumerate(texts)], "doc_id int, text string").repartition(2)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(table, least, times).collect()}
    for i, words in enumerate(texts):
        expected = plain_runs(words, least, times)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == expected
        gone = {j for a, n, q in expected for j in range(a + q, a + n)}
        assert got[i].collapsed == " ".join(w for j, w in enumerate(words) if j not in gone)
        best = min(expected, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (got[i].strongest and tuple(got[i].strongest)) == best


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "a a a a a a", None), (2, "a a a a a a", None), (None, " \t", "z"), (3, "ü " * 7 + "x", "")]
    table = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = sorted((r.doc_id or 0, len(r.runs), r.collapsed) for r in periodic_runs.periodic_runs(table).collect())
    assert got == [(0, 0, ""), (0, 0, ""), (1, 0, ""), (2, 1, "a"), (2, 1, "a"), (3, 1, "ü x")]
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0


@pytest.mark.parametrize("words", [["a"] * 1_000_000, ["a", "b", "c", "a", "d"] * 100_000, [str(i % 70_000) for i in range(400_000)]], ids=["one", "five", "long"])
def test_long_repetitive_texts_take_little_time(words):
    numbers = np.unique(words, return_inverse=True)[1].astype(np.int64)
    began = time.perf_counter()
    runs = periodic_runs.runs_of(numbers, np.array([len(words)]))
    assert len(runs) == 1 and runs[0, 2] == len(words) and time.perf_counter() - began < 20


def test_the_strongest_run_is_told_exactly():
    big = 10**9
    assert periodic_runs.strongest(np.array([[0, 4 * big + 1, big], [1, 4 * big + 6, big + 1], [9, 4 * big + 1, big]])).tolist() == [1, 4 * big + 6, big + 1]
