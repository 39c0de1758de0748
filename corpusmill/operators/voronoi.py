"""Blocks of near vectors, and which blocks have to meet: exact search without comparing all pairs.

Pivots are a bounded sample. Each vector belongs to the Voronoi cell of its nearest pivot; in the order of cell and distance to
the pivot, vectors are cut into blocks of bounded size, each a few rings of neighbouring cells. For vectors that search within
a radius, the triangle inequality and the planes between pivots say which rings of which cells may hold an answer; rings and
blocks meet by a join on the cell. What the bounds can't exclude is compared, two blocks a task at a time, each read where it was
written, so memory is bounded, no vector is shuffled once a pair, and none but the sample reaches the driver. On data without
structure nothing is excluded, and all pairs of blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.shipping import ship
from corpusmill.storage import scope, written

#: Vectors sampled as pivots, vectors of a block, and vectors compared with a block at once.
PIVOTS, BLOCK, QUERIES = 64, 4096, 256
BLOCKS = "block long, ids binary, vectors binary, rings array<struct<cell: int, low: double, high: double>>"
#: Relative and absolute slack of fast distances against exact ones; distances are compared to nine digits.
SLACK, DIGITS, MOST = 1e-9, 9, np.finfo(np.float64).max


@dataclass(frozen=True)
class Space:
    """The pivots and the distances between them."""

    ids: np.ndarray
    pivots: np.ndarray
    between: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fast distances, rounded by cancellation."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def exact(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(((others - one) ** 2).sum(axis=1))


def loose(limit):
    """What a fast distance may be if the exact one is at most limit."""
    return limit * (1 + SLACK) + 1e-7


def matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, -1)


def bounded(df: DataFrame) -> DataFrame:
    """Ships the package and bounds the bytes of Arrow batches: a row holds blocks."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def space(vectors: DataFrame, pivots: int = PIVOTS) -> Space | None:
    """Pivots: the vectors (id, embedding) with the smallest hashes of their ids, each neighbour of the last."""
    taken = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # a bounded sample
    if not taken:
        return None
    ids, points = np.array([r["id"] for r in taken]), np.array([r["embedding"] for r in taken], np.float64)
    far = distances(points, points)
    chain, left = [0], set(range(1, len(points)))
    while left:
        chain.append(min(left, key=lambda i: far[chain[-1], i]))
        left.remove(chain[-1])
    points = points[chain]
    return Space(ids[chain], points, np.array([exact(p, points) for p in points]))


def blocks(vectors: DataFrame, sent, block: int = BLOCK) -> DataFrame:
    """BLOCKS of vectors (id, embedding: array<double>); sent is the broadcast Space."""
    packed = "id long, vector binary, cell int, far double"
    schema = pa.schema([("id", pa.int64()), ("vector", pa.binary()), ("cell", pa.int32()), ("far", pa.float64())])
    made = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("rings", pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])))])

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for batch in batches:
            own = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(batch.num_rows, -1)
            far = distances(own, at.pivots)
            cell = far.argmin(axis=1)
            yield record(schema, batch.column(0), [v.tobytes() for v in own], cell, far[np.arange(len(own)), cell])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block:
                yield one(number, held[:block])
                number, held = number + 1, held[block:]
        if held:
            yield one(number, held)

    def one(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, vectors, cells, far = zip(*held, strict=True)
        cells, far = np.array(cells), np.array(far)
        rings = [{"cell": int(c), "low": float(far[cells == c].min()), "high": float(far[cells == c].max())} for c in np.unique(cells)]
        return record(made, [number], [np.array(ids, "<i8").tobytes()], [b"".join(vectors)], [rings])

    found = bounded(vectors).select("id", "embedding").mapInArrow(locate, packed)
    found = written(found, "located")
    parts = max(1, -(-found.count() // block))
    return written(found.repartitionByRange(parts, "cell", "far", "id").sortWithinPartitions("cell", "far", "id").mapInArrow(cut, BLOCKS), "blocks")


def rings(far: np.ndarray, between: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For vectors by their distances to pivots, each searching within a radius: by pivot, whether its cell may hold an answer
    for any, and the least and greatest distance of an answer to the pivot."""
    home = far.argmin(axis=1)
    apart = between[home]
    # An answer in a cell is nearer to its pivot than to the searcher's: it lies beyond the plane between them.
    beyond = np.where(apart > 0, (far**2 - (far[np.arange(len(far)), home] ** 2)[:, None]) / np.where(apart > 0, 2 * apart, 1), 0)
    reach = loose(radius)[:, None] + 1e-6
    open_ = beyond <= reach
    return open_.any(axis=0), np.where(open_, far - reach, np.inf).min(axis=0), np.where(open_, far + reach, -np.inf).max(axis=0)


def meetings(searching: DataFrame, base: DataFrame, sent) -> DataFrame:
    """a, b (a <= b): the pairs of blocks that have to meet. searching: BLOCKS with radii (binary, a double a vector; NaN: none)."""

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for row in rows_of(batches):
            radius = np.frombuffer(row["radii"], "<f8")
            active = ~np.isnan(radius)
            if active.any():
                far = distances(matrix(row["vectors"], len(radius))[active], at.pivots)
                may, low, high = rings(far, at.between, radius[active])
                cells = np.flatnonzero(may)
                yield record(schema, [row["block"]] * len(cells), cells, low[cells], high[cells])

    schema = pa.schema([("own", pa.int64()), ("cell", pa.int32()), ("w_low", pa.float64()), ("w_high", pa.float64())])
    asked = bounded(searching).select("block", "vectors", "radii").mapInArrow(windows, "own long, cell int, w_low double, w_high double")
    offered = base.select("block", F.explode("rings").alias("r")).select("block", "r.*")
    pairs = offered.join(asked, "cell").filter("high >= w_low and low <= w_high")
    return written(pairs.select(F.least("own", "block").alias("a"), F.greatest("own", "block").alias("b")).distinct(), "meetings")


def paired(pairs: DataFrame, base: DataFrame, here: tuple[str, ...], there: tuple[str, ...]) -> DataFrame:
    """Each pair (a, b) of blocks with columns of both, as a_... and b_...; a block's pairs come one after the other.

    A product of the table's partitions with themselves, of which a block keeps those it meets: tasks read both sides where they
    were written, so blocks are shuffled and written once, however many pairs there are.
    """
    meets = pairs.groupBy(F.col("a").alias("block")).agg(F.collect_list("b").alias("meets"))  # at most as many as there are blocks
    parts = max(1, min(base.count(), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    table = written(base.select("block", *dict.fromkeys(here + there)).join(meets, "block", "left").repartition(parts), "dealt")
    own = table.filter("meets is not null").select("meets", *(F.col(c).alias(f"a_{c}") for c in here))
    other = table.select(F.col("block").alias("b"), *(F.col(c).alias(f"b_{c}") for c in there))
    return own.hint("shuffle_replicate_nl").join(other, F.array_contains("meets", F.col("b"))).select(*(f"a_{c}" for c in here), *(f"b_{c}" for c in there))


def nearest(own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """place, target ids and distances of the k nearest of base for every vector of own, none farther than limit; ties by id."""
    for at in range(0, len(own), QUERIES):
        far = distances(vectors[at : at + QUERIES], base)
        far[own[at : at + QUERIES, None] == ids] = np.inf
        cap = np.minimum(loose(limit[at : at + QUERIES]), MOST)
        for i in np.flatnonzero(far.min(axis=1, initial=np.inf) <= cap).tolist():
            some = np.flatnonzero(far[i] <= cap[i])
            if len(some) > 4 * k:
                some = some[far[i, some] <= loose(np.partition(far[i, some], k - 1)[k - 1])]
            true = exact(vectors[at + i], base[some])
            best = np.lexsort((ids[some], np.round(true, DIGITS)))[:k]
            yield at + i, ids[some[best]], true[best]


FOUND = "source long, target long, distance double"


def _flat(found: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return record(pa.schema([("source", pa.int64()), ("target", pa.int64()), ("distance", pa.float64())]), *columns)


def _first(base: DataFrame, k: int) -> DataFrame:
    """base with each vector's nearest of its own block (targets, found: k a vector, NaN where there are fewer) and their last
    distance as its radius (infinite where there are fewer)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids = np.frombuffer(row["ids"], "<i8")
            vectors = matrix(row["vectors"], len(ids))
            targets, found = np.zeros((len(ids), k), "<i8"), np.full((len(ids), k), np.nan)
            for i, near, far in nearest(ids, vectors, ids, vectors, k, np.full(len(ids), np.inf)):
                targets[i, : len(near)], found[i, : len(near)] = near, far
            radii = np.nan_to_num(found[:, -1], nan=np.inf)
            yield record(schema, [row["block"]], [row["ids"]], [row["vectors"]], [row["rings"]], [radii.astype("<f8").tobytes()], [targets.tobytes()], [found.astype("<f8").tobytes()])

    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("rings", pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))), *((c, pa.binary()) for c in ("radii", "targets", "found"))])
    return written(bounded(base).mapInArrow(run, f"{BLOCKS}, radii binary, targets binary, found binary"), "first")


def _own(first: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, found = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["found"], "<f8")
            there = ~np.isnan(found)
            yield _flat([(np.repeat(ids, k)[there], np.frombuffer(row["targets"], "<i8")[there], found[there])])

    return first.select("ids", "targets", "found").mapInArrow(run, FOUND)


def _others(pairs: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Nearest ones of other blocks, no farther than a vector's radius.

    The blocks of a task that a block meets come one after the other, so what it has found so far bounds the search in the next,
    and each vector's few best leave the task once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, vectors, limit, held = None, None, None, None, {}
        for row in rows_of(batches):
            if row["a_block"] != now:
                if held:
                    yield _flat([(np.full(len(t), own[i]), t, d) for i, (t, d) in held.items()])
                now, own, held = row["a_block"], np.frombuffer(row["a_ids"], "<i8"), {}
                vectors, limit = matrix(row["a_vectors"], len(own)), np.frombuffer(row["a_radii"], "<f8").copy()
            ids = np.frombuffer(row["b_ids"], "<i8")
            for i, targets, far in nearest(own, vectors, ids, matrix(row["b_vectors"], len(ids)), k, limit):
                if i in held:
                    targets, far = np.concatenate([held[i][0], targets]), np.concatenate([held[i][1], far])
                    best = np.lexsort((targets, np.round(far, DIGITS)))[:k]
                    targets, far = targets[best], far[best]
                held[i] = targets, far
                if len(far) == k:
                    limit[i] = min(limit[i], far[-1])
        if held:
            yield _flat([(np.full(len(t), own[i]), t, d) for i, (t, d) in held.items()])

    both = pairs.union(pairs.select("b", "a"))
    return paired(both, first, ("block", "ids", "vectors", "radii"), ("ids", "vectors")).mapInArrow(run, FOUND)


def neighbours(vectors: DataFrame, k: int, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """source, target, distance, rank: the k nearest others of each vector (id, embedding); ties by id. Vectors have one length;
    null ids and vectors take no part, vectors that share an id aren't neighbours."""
    with scope() as own:
        return own.keep(written(_neighbours(vectors, k, block, pivots)[0], "neighbours"))[0]


def share(vectors: DataFrame, k: int, block: int = BLOCK, pivots: int = PIVOTS) -> float:
    """Distances that neighbours() computes, as a share of all pairs of vectors."""
    with scope():
        _, pairs, first = _neighbours(vectors, k, block, pivots)
        sizes = first.select("block", (F.octet_length("ids") / 8).alias("n"))
        both = pairs.join(sizes.withColumnsRenamed({"block": "a", "n": "x"}), "a").join(sizes.withColumnsRenamed({"block": "b", "n": "y"}), "b")
        n, inside = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        return (inside + 2 * (both.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0)) / n**2


def taking_part(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("id is not null and embedding is not null")


def _neighbours(vectors: DataFrame, k: int, block: int, pivots: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    own = taking_part(vectors)
    at = space(own, pivots)
    if at is None:
        return own.sparkSession.createDataFrame([], f"{FOUND}, rank int"), None, None
    sent = own.sparkSession.sparkContext.broadcast(at)
    first = _first(blocks(own, sent, block), k)
    pairs = meetings(first, first, sent).filter("a <> b")
    found = _own(first, k).union(_others(pairs, first, k))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.round("distance", DIGITS), "target"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k), pairs, first
