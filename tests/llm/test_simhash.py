"""SimHash groups against a plain search, and the cases that the docstring defines."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import queries, simhash
from tests import oracle
from tests.llm.test_operators import collected, frame


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    """The smallest id reachable, by rows (id, fingerprint); compares all pairs."""
    top = dict.fromkeys({p for _, p in prints})
    for p in top:
        if top[p] is None:
            group, todo = {p}, [p]
            while todo:
                a = todo.pop()
                near = [b for b in top if b not in group and (a ^ b).bit_count() <= distance]
                group |= set(near)
                todo += near
            least = min(i for i, q in prints if q in group)
            for q in group:
                top[q] = least
    return [top[p] for _, p in prints]


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("alpha Beta GAMMA é \U0001f600 delta".split()) for _ in range(rng.randint(0, 40))), None) for i in range(80)]
    texts += [(100, None, None), (101, " \t\n", None), (None, "one", None), (None, None, None), (102, "One  two\x0bthree", None), (102, "One two three", None), (103, "word " * 200_000, None)]
    got = collected(simhash.classes(frame(spark, texts)), "doc_id", "fingerprint")
    expect = sorted(((d, f"{plain_print(t):016x}") for d, t, _ in texts), key=lambda r: (r[0] is None, r[0], r[1]))
    assert [(r["doc_id"], r["fingerprint"]) for r in got] == expect
    own = [(d, plain_print(t)) for d, t, _ in texts if d is not None]
    assert sorted(r["component_id"] for r in got if r["doc_id"] is not None) == sorted(plain_components(own))
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert simhash.classes(frame(spark, texts).limit(0)).count() == 0


def test_hash_is_the_engine_s_too(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def some_prints(rng, n):
    """Fingerprints around a few centres, so that segments are crowded and distances are around the limit; and lone ones."""
    out = set()
    for _ in range(6):
        centre, loose = rng.getrandbits(64), rng.sample(range(64), 12)
        for _ in range(n // 8):
            own = centre
            for b in rng.sample(loose, rng.randint(0, 7)):
                own ^= 1 << b
            out.add(own)
    return sorted(out | {rng.getrandbits(64) for _ in range(n // 4)} | {0, (1 << 64) - 1, 1 << 63})


@pytest.mark.parametrize(("crowd", "distance"), [(4096, 3), (40, 3), (4, 3), (1, 3), (4, 2), (3, 1), (2, 0)])
def test_links_equal_plain_search(spark, crowd, distance):
    prints = some_prints(random.Random(crowd), 600)
    signed = [p - (p >> 63 << 64) for p in prints]
    sets = spark.createDataFrame([(p,) for p in signed], "print long")
    edges = [(r["u"], r["v"]) for r in simhash.links(sets, simhash.Rule(crowd=crowd, distance=distance)).collect()]
    assert all(0 < ((u ^ v) % (1 << 64)).bit_count() for u, v in edges)
    top = {p: p for p in signed}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        top[b] = a
    expect = plain_components(list(zip(signed, [p % (1 << 64) for p in signed], strict=True)), distance)
    assert [root(p) for p in signed] == expect


def test_groups_of_near_copies_do_not_multiply(spark):
    """Edges follow the number of fingerprints, not that of their pairs."""
    rng = random.Random(9)
    centre, loose = rng.getrandbits(63), rng.sample(range(63), 16)
    prints = set()
    while len(prints) < 6000:
        prints.add(centre ^ sum(1 << b for b in rng.sample(loose, rng.randint(0, 5))))
    sets = spark.createDataFrame([(p,) for p in prints], "print long")
    assert simhash.links(sets, simhash.Rule(crowd=500)).count() < 66 * len(prints)


@pytest.mark.skipif(not __import__("os").path.isdir(oracle.FOLDER), reason="no tables here")
def test_query_equals_plain_search(spark):
    docs = spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").collect()
    own = [(r["doc_id"], plain_print(r["text"])) for r in docs]
    expect = {d: (f"{p:016x}", c) for (d, p), c in zip(own, plain_components(own), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op13_simhash"](spark, oracle.FOLDER).collect()}
    assert got == expect and len({c for _, c in got.values()}) < len(got)
