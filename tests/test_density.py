"""Exact neighbours, spanning trees and density clusters against plain versions."""

import random

import numpy as np
import pytest

from corpusmill.operators import density, vectors, voronoi


def frame(spark, own):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in own.items()], "id long, embedding array<double>")


def groups(rng, sizes, dims=3, spread=0.1, noise=40):
    own = []
    for n in sizes:
        centre = rng.normal(0, 2, dims)
        own += list(centre + rng.normal(0, spread * rng.uniform(0.5, 2), (n, dims)))
    own += list(rng.uniform(-4, 4, (noise, dims)))
    ids = rng.permutation(len(own) * 3)[: len(own)] - len(own)
    return {int(i): v for i, v in zip(ids, own, strict=True)}


def plain_neighbours(own, k):
    ids = np.array(sorted(own))
    points = np.array([own[i] for i in ids])
    out = set()
    for i, p in zip(ids, points, strict=True):
        far = np.sqrt(((points - p) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, np.round(far, 9))) if ids[j] != i][:k]
        out |= {(int(i), int(ids[j]), rank) for rank, j in enumerate(order, 1)}
    return out


@pytest.mark.parametrize(("block", "pivots"), [(10, 8), (25, 3), (1000, 64)])
def test_neighbours_equal_plain_search(spark, block, pivots):
    own = groups(np.random.default_rng(block), [40, 30], noise=20)
    own[10_000] = own[next(iter(own))]
    got = voronoi.neighbours(frame(spark, own), 4, block, pivots)
    assert {(r["source"], r["target"], r["rank"]) for r in got.collect()} == plain_neighbours(own, 4)


def test_neighbours_of_nothing_and_of_few(spark):
    assert voronoi.neighbours(frame(spark, {}), 3).count() == 0
    assert [(r["source"], r["target"], r["rank"]) for r in voronoi.neighbours(frame(spark, {1: [0.0], 2: [1.0]}), 3).orderBy("source").collect()] == [(1, 2, 1), (2, 1, 1)]
    some = spark.createDataFrame([(1, [0.0, 1.0]), (None, [0.0, 1.0]), (2, None), (3, [0.0, 3.0])], "id long, embedding array<float>")
    assert voronoi.neighbours(some, 3).count() == 2


def test_share_of_distances_falls(spark):
    rng = np.random.default_rng(3)
    shares = []
    for n in (400, 1600):
        own = {i: v for i, v in enumerate(rng.uniform(0, 1, (n, 2)))}
        shares.append(voronoi.share(frame(spark, own), 3, block=25, pivots=40))
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.4


def reaches(own, k=5):
    ids = sorted(own)
    points = np.array([own[i] for i in ids])
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    core = np.sort(far, axis=1)[:, min(k, len(ids) - 1)]
    return ids, np.maximum(np.maximum(far, core[:, None]), core)


def plain_weights(own, k=5):
    """Prim's algorithm."""
    ids, reach = reaches(own, k)
    inside, best, out = np.zeros(len(ids), bool), reach[0].copy(), []
    inside[0] = True
    while not inside.all():
        i = int(np.where(inside, np.inf, best).argmin())
        out.append(best[i])
        inside[i] = True
        best = np.minimum(best, reach[i])
    return sorted(out)


def plain_clusters(own, tree, least):
    """The usual sequence: dendrogram, condensed tree from the top, stability, selection; all in plain recursion."""
    parent, size, kids, level = {i: i for i in own}, {i: 1 for i in own}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (w, u, v) in enumerate(sorted((w, u, v) for u, v, w in tree)):
        a, b, node = find(u), find(v), ("n", k)
        parent[a] = parent[b] = parent[node] = node
        size[node], kids[node], level[node] = size[a] + size[b], (a, b), 1 / max(w, 1e-9)
    root = find(next(iter(own)))

    def points(x):
        todo, out = [x], []
        while todo:
            y = todo.pop()
            if y in kids:
                todo += kids[y]
            else:
                out.append(y)
        return out

    clusters, todo = [], [(root, None, 0.0)]  # [falls, children, birth, all points]
    if len(own) < least:
        return {i: (-1, 0.0) for i in own}
    while todo:
        node, above, birth = todo.pop()
        here = {"falls": {}, "kids": [], "birth": birth, "deep": 0.0, "above": above, "mass": 0.0}
        clusters.append(here)
        if above:
            above["kids"].append(here)
        while node is not None:
            a, b = kids[node]
            lam = level[node]
            big = [x for x in (a, b) if size[x] >= least]
            for x in (a, b):
                if size[x] < least:
                    here["falls"] |= {p: lam for p in points(x)}
            if len(big) == 2:
                todo += [(x, here, lam) for x in big]
                here["mass"] += sum(size[x] * (lam - birth) for x in big)
                here["deep"] = max(here["deep"], lam)
            node = big[0] if len(big) == 1 else None
        here["mass"] += sum(lam - birth for lam in here["falls"].values())
        here["deep"] = max([here["deep"], *here["falls"].values()])
    for c in reversed(clusters):
        below = sum(k["best"] for k in c["kids"])
        c["kept"] = c["above"] is not None and (not c["kids"] or c["mass"] >= below)
        c["best"] = max(c["mass"], below) if c["kids"] else c["mass"]
    out = {i: (-1, 0.0) for i in own}
    for c in clusters:
        top, x = None, c
        while x:
            top = x if x["kept"] else top
            x = x["above"]
        for p, lam in c["falls"].items():
            if top:
                top.setdefault("members", []).append(p)
                out[p] = (top, min(lam, top["deep"]) / top["deep"])
    return {p: (t if t == -1 else min(t["members"]), f) for p, (t, f) in out.items()}


def found(df):
    return {r["id"]: (r["cluster"], r["probability"]) for r in df.collect()}


def same(got, expect):
    assert got.keys() == expect.keys()
    for i in got:
        assert got[i][0] == expect[i][0] and got[i][1] == pytest.approx(expect[i][1], abs=1e-9), i


@pytest.mark.parametrize(("block", "most", "sizes"), [(30, 40, [40, 60, 25, 30]), (4096, 1 << 20, [50, 20, 90]), (60, 7, [30, 30, 30, 30])])
def test_clusters_equal_plain_ones(spark, block, most, sizes):
    rng = np.random.default_rng(most % 97)
    own = groups(rng, sizes)
    df = frame(spark, own)
    near = voronoi.neighbours(df, 5, block)
    tree = density.spanning_tree(df, near, block, 16)
    edges = [(r["u"], r["v"], r["w"]) for r in tree.collect()]
    assert len(edges) == len(own) - 1 and sorted(w for *_, w in edges) == pytest.approx(plain_weights(own), abs=1e-9)
    points = df.select("id")
    expect = plain_clusters(own, edges, 10)
    same(found(density.labelled(points, *density.condensed(tree, points, 10, most))), expect)
    assert len({c for c, _ in expect.values()}) >= 4


def test_deep_trees_of_clusters(spark):
    """Clusters nested like a caterpillar, and trees cut into many sets."""
    rng, edges, n = random.Random(4), [], 0
    for group in range(30):
        for i in range(6):
            edges.append((n, n + 1, 0.1 + 0.001 * rng.random())) if i < 5 else None
            n += 1
        if group:
            edges.append((n - 6 - rng.randint(1, 5), n - 1, 1.0 + 0.1 * group))
    own = dict.fromkeys(range(n), 0)
    tree = spark.createDataFrame([(min(u, v), max(u, v), w) for u, v, w in edges], "u long, v long, w double")
    points = tree.sparkSession.createDataFrame([(i,) for i in own], "id long")
    for most in (5, 1 << 20):
        same(found(density.labelled(points, *density.condensed(tree, points, 5, most))), plain_clusters(own, edges, 5))


def test_few_and_equal_vectors(spark):
    few = {i: [float(i)] for i in range(6)}
    assert set(found(density.clusters(frame(spark, few), least=15)).values()) == {(-1, 0.0)}
    assert density.clusters(frame(spark, {})).count() == 0
    equal = {i: [0.0 if i < 20 else 5.0 + i % 3 * 1e-3, 1.0] for i in range(45)}
    got = found(density.clusters(frame(spark, equal), least=10))
    assert {got[i][0] for i in range(20)} == {0} and {got[i][0] for i in range(20, 45)} != {0}


def test_topology_has_probabilities(spark):
    own = groups(np.random.default_rng(8), [30, 30], noise=5)
    df = frame(spark, own)
    near = voronoi.neighbours(df, 5)
    node, _, count = vectors.topology(near, density.clusters(df, least=10), vectors.projected(df))
    got = node.collect()
    assert {"id", "x", "y", "cluster", "probability"} <= set(node.columns) and count.first()["clusters"] >= 2
    assert all((r["cluster"] == -1) == (r["probability"] == 0) and 0 <= r["probability"] <= 1 for r in got)


def test_cut_is_the_exact_quantile_of_many(spark):
    rng = np.random.default_rng(7)
    core = sorted(float(x) for x in rng.uniform(0, 1, 40_000))
    near = spark.createDataFrame([(i, i + 1, d, 5) for i, d in enumerate(rng.permutation(core).tolist())], "source long, target long, distance double, rank int")
    for share in (0.1, 0.9, 0.99985):
        assert vectors.cut(near, share) == core[-(-int(round(share * 1e5)) * len(core) // 100_000) - 1]
    assert vectors.cut(near.limit(1)) == near.first()["distance"] and vectors.cut(near.limit(0)) == 0.0


def shuffled(spark):
    """Bytes that shuffles have written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    every = context.statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_blocks_are_shuffled_once_however_many_meet(spark):
    """On vectors without structure all pairs of blocks meet; what is shuffled follows the vectors, not the pairs."""
    rng = np.random.default_rng(12)
    df = frame(spark, {i: v for i, v in enumerate(rng.normal(0, 1, (600, 200)))})
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond it
    try:
        before = shuffled(spark)
        near = voronoi.neighbours(df, 4, 20, 8)
        assert near.count() == 600 * 4
        assert shuffled(spark) - before < 6 * 600 * 200 * 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert voronoi.share(df, 4, 20, 8) > 0.9
