"""Hard negatives against a plain search, the bounds' work, and the cases that the docstring defines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import negatives
from corpusmill.llm.negatives import Rule

DDL = "vec_id long, embedding array<float>, label int, score string, rank int"


def plain(rows, every=10, rule=Rule()):
    """anchor, positive, rank, negative, scores; rows (id, vector, label) by the contract's own words."""
    taken = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(rule.scale * float(np.float32(x)))) for x in v]
            taken[i] = min(taken.get(i, (label, whole)), (label, whole))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i in sorted(taken):
        if i % every == 0:
            label, own = taken[i]
            scored = sorted((-dot(own, v), j, other) for j, (other, v) in taken.items() if j != i)
            for top, pos, _ in [s for s in scored if s[2] == label][: rule.positives]:
                fits = [s for s in scored if s[2] != label and rule.part * -top <= rule.of * -s[0] <= rule.of * -top]
                out += [(i, pos, r, s[1], -top, -s[0]) for r, s in enumerate(fits[: rule.negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=10, rule=Rule()):
    df = spark.createDataFrame([(i, v, label, "x", 9) for i, v, label in rows], DDL)
    got = negatives.mine(df, F.col("vec_id") % every == 0, rule=rule)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def clustered(rng, n, dims=8, centres=6, labels=3):
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middles)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("rule", [Rule(), Rule(pivots=5, sample=20, block=16, group=4), Rule(pivots=1, sample=1, block=7, group=3), Rule(positives=2, negatives=3, part=95, pivots=9, sample=60, block=10, group=5)])
def test_equals_plain_search(spark, rule):
    rng = random.Random(rule.pivots)
    rows = clustered(rng, 260)
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)] + [(2000 + i, rows[3][1], 0) for i in range(9)]  # many equal vectors, anchors among them
    rows += [(3000 + i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(8)], rng.randrange(3)) for i in range(60)]  # ties
    expect = plain(rows, rule=rule)
    assert expect and mined(spark, rows, rule=rule) == expect


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.75, 0.5], 2), (3, [0.75, 0.5, 0.0], 2), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [], 1)]
    rows += [(10, [-1.0, 0.0], 3), (11, [1.0, 0.0], 3), (12, [1.0, 0.5], 2), (1, [1.0, 0.5], 5), (1, [1.0, 0.25], 1)]  # 10: negative positive; 1: three rows, one counts
    rows += [(20, [0.0, 0.0], 4), (21, [3.0, 4.0], 4), (30, [1.0], 9)]  # zero scores; an anchor without positives
    expect = plain(rows)
    assert {a for a, *_ in expect} == {0, 20} and mined(spark, rows) == expect
    df = spark.createDataFrame([], DDL)
    assert negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, -1e30], 1), (2, [3e30, 2.0], 2)]  # held to 32 and 64 bits
    assert [r[:4] for r in mined(spark, huge)] == [] or all(r[0] == 0 for r in mined(spark, huge))


def test_scores_are_exact():
    a = np.array([[2**31 - 1, 2**31 - 1, -(2**31)]])
    assert negatives.scores(a, a[:, :2])[0, 0] == 2 * (2**31 - 1) ** 2
    assert negatives.scores(np.repeat(a, 2, axis=1), np.repeat(a, 2, axis=1))[0, 0] == 2**63 - 1


def test_bounds_hold_and_exclude(spark):
    """No ring outside the windows holds a row within the limits; on clustered rows most rings are outside."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 40, (30, 6))
    vectors = np.floor(np.repeat(middles, 40, axis=0) + rng.normal(0, 3, (1200, 6))).astype(np.int64)
    top = float((vectors**2).sum(axis=1).max())
    at = negatives.Space(np.arange(1200), np.zeros(1200, np.int64), vectors, np.zeros((0, 7)), top)
    at = negatives.Space(at.ids, at.labels, vectors, at.augmented(vectors[::40]), top)
    far = at.to_pivots(vectors, False)
    cell = far.argmin(axis=1)
    score = vectors @ vectors.T
    between = np.sqrt(((at.pivots[:, None] - at.pivots[None]) ** 2).sum(axis=2))
    excluded = 0
    for a in range(0, 1200, 37):
        low, high = np.sort(score[a])[-20], np.sort(score[a])[-2]
        square = float((vectors[a] ** 2).sum()) + top
        most, near = np.sqrt(max(square - 2 * low, 0)), np.sqrt(max(square - 2 * high, 0))
        may, first, last = negatives.rings(at.to_pivots(vectors[a : a + 1], True), between, np.array([near]), np.array([most]))
        inside = may[cell] & (far[np.arange(1200), cell] >= first[cell]) & (far[np.arange(1200), cell] <= last[cell])
        assert inside[(score[a] >= low) & (score[a] <= high)].all()
        excluded += (~inside).mean()
    assert excluded / 33 > 0.5
