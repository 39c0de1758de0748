"""Periodic runs against a plain search, and the cases that the docstring defines."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from corpusmill.llm import periodic, queries
from tests import oracle
from tests.llm.test_operators import collected, frame


def plain_runs(words, least=6, times=4):
    """Every stretch by definition: for each period, the places that agree one period on."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and not any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def some_words(rng, n, letters):
    words = []
    while len(words) < n:
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 7))]
        words += unit * rng.randint(1, 8) + unit[: rng.randint(0, len(unit))]
    return words[:n]


@pytest.mark.parametrize("rule", [periodic.Rule(), periodic.Rule(5, 3), periodic.Rule(9, 5)])
def test_runs_equal_plain_search(rule):
    rng = random.Random(rule.times)
    for _ in range(1500):
        words = some_words(rng, rng.randint(0, 70), rng.choice([1, 2, 3, 5, 30]))
        assert periodic.runs(np.array(words, np.int64), rule) == plain_runs(words, rule.least, rule.times), words
    nested = ([1, 1, 1, 1, 1, 1, 1, 2, 3] * 5 + [4]) * 4 + [1] * 6  # runs inside runs
    assert periodic.runs(np.array(nested), rule) == plain_runs(nested, rule.least, rule.times)


def test_least_overlap():
    assert periodic.Rule().gram == 5 and periodic.Rule(9, 5).gram == 8 and periodic.Rule(5, 3).gram == 4
    assert periodic.segments(periodic.distances(periodic._grams(np.arange(50), 5)), periodic.Rule()) == []


def test_long_periodic_sequences_are_no_trap():
    for words in ([0] * 300_000, list(range(70_000)) * 4, [0, 1] * 100_000 + [2] * 50_000):
        began = time.time()
        found = periodic.runs(np.array(words))
        assert found and time.time() - began < 20


def told(doc, words):
    found = plain_runs(words)
    top = min(found, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2])) if found else (None, None, None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {"doc_id": doc, "n_runs": len(found), "start": top[0], "length": top[1], "period": top[2], "exponent_milli": top[0] is not None and 1000 * top[1] // top[2] or None, "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), "collapsed_sha256": sha(rest)}


def test_digests_and_defined_cases(spark):
    texts = [(1, "a b " * 9 + "c " + "D d é " * 7 + "x x x x x x", None), (2, None, None), (3, "", None), (4, " \t\n ", None), (5, "one two three", None), (5, "one two three", None), (None, "y " * 6, None), (6, "    " * 6, None), (7, "a a a a a a b b b b b b", None)]
    got = collected(periodic.digested(periodic.scan(frame(spark, texts))), "doc_id", "n_runs")
    expect = sorted((told(d, [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for d, t, _ in texts), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_runs"]))
    assert got == expect
    assert periodic.scan(frame(spark, texts).limit(0)).count() == 0
    full = {r["doc_id"]: r for r in periodic.scan(frame(spark, texts)).collect()}
    assert full[7]["collapsed"] == "a b" and [tuple(r) for r in full[7]["runs"]] == [(0, 6, 1), (6, 6, 1)] and full[2]["n_words"] == 0


@pytest.mark.skipif(not __import__("os").path.isdir(oracle.FOLDER), reason="no tables here")
def test_query_equals_plain_search(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").collect()}
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op12_periodic"](spark, oracle.FOLDER).collect()}
    assert set(got) == set(docs)
    for doc, text in docs.items():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n <= 1500:
            assert got[doc] == told(doc, [w.decode() for w in words]), doc
    assert sum(r["n_runs"] > 0 for r in got.values()) >= 10
