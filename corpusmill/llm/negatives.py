"""Hard negatives by a Voronoi-partition nearest-neighbour join.

Vectors become whole numbers, floor(scale * x); a row's score for an anchor is the inner product. An anchor's positives are its
first rows of the same label; a positive's hard negatives are the first rows of another label whose score is at least
part / of of the positive's and at most the positive's. Higher scores come first, ties by smaller vec_id.

Norm augmentation turns scores into distances: with M the greatest norm, a row x gets the coordinate sqrt(M^2 - |x|^2) and an
anchor zero, so |a - x|^2 = |a|^2 + M^2 - 2 <a, x>. Then:

1. Pivots are a bounded sample of rows. Every row goes to its nearest pivot's Voronoi cell; the rows of a cell, ordered by
   their distance to the pivot, are cut into blocks, each a ring of a cell. Of rows with equal label and vector only the first
   few by vec_id can ever be returned; the others leave before that. Anchors are cut into groups of neighbouring cells likewise.
2. An anchor searches for scores between two limits. The lower one for positives is that of the last of its first rows in a
   bounded sample; the limits for negatives follow from the positives, the lower one raised by what the sample has. Limits are
   distances, and the triangle inequality and the cells' bisecting planes say which rings of which cells can hold a row for
   any anchor of a group. A block is sent to those groups only.
3. A task compares a block with a group, by exact products of whole numbers, and keeps each anchor's first rows; these are
   merged by anchor.

Every bound has slack for rounding, and scores alone decide, so the result is exact whatever the pivots and the sample are. On
data without structure the bounds exclude little, and the work is all anchors against all rows, in blocks.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component take no part; rows that share a
vec_id are one row, that with the smallest label, then vector; of vectors of different lengths the shorter ones are filled up
with zeros, an empty one is zero; scaled components are held to 32 bits and scores to 64; an anchor without positives, or a
positive without negatives, gives no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROW = "vec_id long, label long, vector binary, cell int, far double"
BLOCK = "block long, cell int, low double, high double, ids binary, labels binary, vectors binary, width int"
GROUP = "group long, members binary, labels binary, vectors binary, width int, lows binary, highs binary, wanted int"
WINDOW = "group long, cell int, low double, high double"
#: The limits of scores, and anchors compared with the sample at a time.
LEAST, MOST, FEW = -(1 << 63), (1 << 63) - 1, 256


@dataclass(frozen=True)
class Rule:
    """What is searched for, and sizes: pivots and sampled rows (bounds on samples), rows a block, anchors a group."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    part: int = 80
    of: int = 100
    pivots: int = 64
    sample: int = 4096
    block: int = 4096
    group: int = 512


@dataclass(frozen=True)
class Space:
    """The sample, the first rows of which are pivots, and the square of the greatest norm."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    pivots: np.ndarray
    top: float

    def augmented(self, vectors: np.ndarray) -> np.ndarray:
        own = vectors.astype(np.float64)
        return np.hstack([own, np.sqrt(np.maximum(self.top - (own * own).sum(axis=1), 0))[:, None]])

    def to_pivots(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        """Distances to every pivot; anchors have no coordinate of their own for the norm."""
        own = fitted(vectors, self.pivots.shape[1] - 1).astype(np.float64)
        extra = np.zeros(len(own)) if anchors else np.sqrt(np.maximum(self.top - (own * own).sum(axis=1), 0))
        own = np.hstack([own, extra[:, None]])
        square = (own * own).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * own @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    """With zeros up to width."""
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, a row an anchor; held to 64 bits."""
    width = max(a.shape[1], b.shape[1], 1)
    a, b = fitted(a, width), fitted(b, width)
    most = width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, LEAST, MOST).astype(np.int64)


def matrix(vectors: list[bytes]) -> np.ndarray:
    width = max((len(v) // 4 for v in vectors), default=0)
    return np.array([np.pad(np.frombuffer(v, "<i4"), (0, width - len(v) // 4)) for v in vectors], np.int64).reshape(len(vectors), width)


def prepared(df: DataFrame, rule: Rule, label: Column) -> DataFrame:
    """vec_id, label, vector (whole numbers): the rows that take part, once an id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x.cast("double") * rule.scale, F.lit(-3e9)), F.lit(3e9))), F.lit((1 << 31) - 1)), F.lit(-(1 << 31))).cast("int")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").alias("vector"))
    rows = rows.filter("vec_id is not null and label is not null and vector is not null").filter(F.forall("vector", lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))))
    rows = rows.select("vec_id", "label", F.transform("vector", whole).alias("vector"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")


def first_of_equals(rows: DataFrame, most: int) -> DataFrame:
    """Of rows with equal label and vector the first most; an anchor meets at most one of them as itself."""
    place = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def space(rows: DataFrame, rule: Rule) -> Space | None:
    """From the rows with the smallest hashes of their ids, a bounded number, and the greatest norm."""
    square = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    top, width = rows.agg(F.max(square), F.max(F.size("vector"))).first()
    if top is None:
        return None
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rule.sample).collect()  # a bounded sample
    vectors = np.array([[*r["vector"], *[0] * (width - len(r["vector"]))] for r in taken], np.int64).reshape(len(taken), width)
    made = Space(np.array([r["vec_id"] for r in taken]), np.array([r["label"] for r in taken]), vectors, np.zeros((0, width + 1)), float(top))
    pivots = np.unique(made.augmented(vectors[: rule.pivots]), axis=0)
    chain, left = [0], set(range(1, len(pivots)))
    while left:  # neighbouring cells get neighbouring numbers
        near = min(left, key=lambda i: float(((pivots[i] - pivots[chain[-1]]) ** 2).sum()))
        chain.append(near)
        left.remove(near)
    return Space(made.ids, made.labels, vectors, pivots[chain], made.top)


def located(rows: DataFrame, sent, anchors: bool, more: str = "") -> DataFrame:
    """ROW (and the columns named in more) of vec_id, label, vector: nearest pivot and the distance to it."""
    names = [c.split()[0] for c in more.split(",") if c.strip()]

    def start():
        own = sent.value

        def step(batch):
            listed = batch.column(2).to_pylist()
            packed = [np.array(v, "<i4").tobytes() for v in listed]
            far = own.to_pivots(matrix(packed), anchors)
            cell = far.argmin(axis=1).astype(np.int32)
            return [batch.column(0), batch.column(1), packed, pa.array(cell), pa.array(far[np.arange(len(far)), cell]), *(batch.column(3 + i) for i in range(len(names)))]

        return step

    return common.arrow_map(rows.select("vec_id", "label", "vector", *names), ROW + (f", {more}" if more else ""), start, None)


def _cut(rows: DataFrame, parts: int, ddl: str, most: int, by_cell: bool, made: Callable) -> DataFrame:
    """Runs of at most most rows in the order of cell, distance and id, by made(number, rows' columns), streamed by task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        number = TaskContext.get().partitionId() << 32

        def out():
            nonlocal held, number
            row, held, number = made(number, held), [], number + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= most or by_cell and row["cell"] != held[-1]["cell"]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    schema = common.arrow_schema(ddl)
    common.bounded_batches(rows.sparkSession)
    return rows.repartitionByRange(max(parts, 1), "cell", "far", "vec_id").sortWithinPartitions("cell", "far", "vec_id").mapInArrow(run, ddl)


def _packed(rows: list[dict]) -> dict:
    own = matrix([r["vector"] for r in rows])
    return {"labels": np.array([r["label"] for r in rows], "<i8").tobytes(), "vectors": own.astype("<i4").tobytes(), "width": own.shape[1]}


def _unpacked(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(rows, width).astype(np.int64)


def blocks(rows: DataFrame, n: int, sent, rule: Rule) -> DataFrame:
    """BLOCK: rings of cells."""

    def made(number: int, held: list[dict]) -> dict:
        return {"block": number, "cell": held[0]["cell"], "low": held[0]["far"], "high": held[-1]["far"], "ids": np.array([r["vec_id"] for r in held], "<i8").tobytes(), **_packed(held)}

    return common.written(_cut(located(rows, sent, False), -(-n // rule.block), BLOCK, rule.block, True, made), "blocks")


def groups(anchors: DataFrame, n: int, sent, rule: Rule) -> DataFrame:
    """GROUP of anchors with lows, highs (limits of scores, as many ranges an anchor as any has; an empty range has low > high)."""

    def made(number: int, held: list[dict]) -> dict:
        wanted = max(len(r["lows"]) for r in held)
        limits = {c: np.array([[*r[c], *[fill] * (wanted - len(r[c]))] for r in held], "<i8").tobytes() for c, fill in (("lows", 1), ("highs", 0))}
        return {"group": number, "members": np.array([r["vec_id"] for r in held], "<i8").tobytes(), **_packed(held), **limits, "wanted": wanted}

    return common.written(_cut(located(anchors, sent, True, "lows array<long>, highs array<long>"), -(-n // rule.group), GROUP, rule.group, False, made), "groups")


def _limits(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """members, labels, vectors, lows, highs of a group."""
    members = np.frombuffer(row["members"], "<i8")
    lows, highs = (np.frombuffer(row[c], "<i8").reshape(len(members), row["wanted"]) for c in ("lows", "highs"))
    return members, np.frombuffer(row["labels"], "<i8"), _unpacked(row["vectors"], row["width"], len(members)), lows, highs


def rings(far: np.ndarray, between: np.ndarray, near: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For anchors by their distances to pivots, and the least and greatest distance of what they search: by pivot, whether
    its cell may hold a row for any of them, and the least and greatest distance to the pivot of such a row."""
    home = far.argmin(axis=1)
    slack = 1e-6 * (1 + far.max(initial=0) + most.max(initial=0))
    # A row of a cell is nearer to its pivot than to the anchor's: it lies beyond the plane between them.
    apart = between[home]
    beyond = np.where(apart > 0, (far**2 - (far[np.arange(len(far)), home] ** 2)[:, None]) / np.where(apart > 0, 2 * apart, 1), 0)
    low = np.maximum(np.maximum(far - most[:, None], near[:, None] - far), 0) - slack
    high = far + most[:, None] + slack
    open_ = (beyond <= most[:, None] + slack) & (near <= most)[:, None]
    return open_.any(axis=0), np.where(open_, low, np.inf).min(axis=0), np.where(open_, high, -np.inf).max(axis=0)


def windows(own: DataFrame, sent) -> DataFrame:
    """WINDOW: the rings that may hold a row for a group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        between = np.sqrt(((at.pivots[:, None] - at.pivots[None]) ** 2).sum(axis=2))
        for batch in batches:
            for row in batch.to_pylist():
                _, _, vectors, lows, highs = _limits(row)
                some = lows <= highs
                keep = some.any(axis=1)
                if not keep.any():
                    continue
                square = (vectors.astype(np.float64) ** 2).sum(axis=1) + at.top
                low, high = np.where(some, lows, MOST).min(axis=1), np.where(some, highs, LEAST).max(axis=1)
                most, near = (np.sqrt(np.maximum(square - 2 * s.astype(np.float64), 0)) for s in (low, high))
                may, first, last = rings(at.to_pivots(vectors, True)[keep], between, near[keep], most[keep])
                cells = np.flatnonzero(may)
                yield pa.RecordBatch.from_arrays([pa.array([row["group"]] * len(cells), pa.int64()), pa.array(cells.astype(np.int32)), pa.array(first[cells]), pa.array(last[cells])], ["group", "cell", "low", "high"])

    common.bounded_batches(own.sparkSession)
    return own.mapInArrow(run, WINDOW)


def best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first most by score, highest first, then id."""
    if len(score) > 4 * most:
        edge = np.partition(score, len(score) - most)[len(score) - most]
        kept = np.flatnonzero(score >= edge)
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], -score[kept]))][:most]


def search(own: DataFrame, rows: DataFrame, sent, same: bool, most: int) -> DataFrame:
    """anchor_id, wanted (the place of the range), id, score: each range's first most rows of the same, or of another, label."""
    meet = windows(own, sent).withColumnsRenamed({"low": "w_low", "high": "w_high"})
    pairs = rows.select("block", "cell", "low", "high").join(meet, "cell").filter("high >= w_low and low <= w_high").select("block", "group")
    pairs = common.written(pairs, "pairs")
    left = rows.select("block", F.col("ids"), F.col("labels").alias("r_labels"), F.col("vectors").alias("r_vectors"), F.col("width").alias("r_width"))
    both = left.join(pairs.join(own, "group"), "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                members, labels, vectors, lows, highs = _limits(row)
                ids, r_labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["r_labels"], "<i8")
                score = scores(vectors, _unpacked(row["r_vectors"], row["r_width"], len(ids)))
                out: list[list] = [[], [], [], []]
                allowed = (labels[:, None] == r_labels) & (members[:, None] != ids) if same else labels[:, None] != r_labels
                inside = allowed & (score >= lows.min(axis=1)[:, None]) & (score <= highs.max(axis=1)[:, None])
                for a in np.flatnonzero(inside.any(axis=1)).tolist():
                    some = np.flatnonzero(inside[a])
                    for w in np.flatnonzero(lows[a] <= highs[a]).tolist():
                        fits = some[(score[a, some] >= lows[a, w]) & (score[a, some] <= highs[a, w])]
                        fits = fits[best(score[a, fits], ids[fits], most)]
                        for column, value in zip(out, ([members[a]] * len(fits), [w] * len(fits), ids[fits].tolist(), score[a, fits].tolist()), strict=True):
                            column += value
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "wanted", "id", "score"])

    found = both.mapInArrow(run, "anchor_id long, wanted int, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "wanted").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= most)


def _limited(anchors: DataFrame, sent, limits: Callable, *more: str) -> DataFrame:
    """anchors with lows and highs: limits(space, scores in the sample, ids, labels, columns named in more), a few anchors at a time."""

    def start():
        at = sent.value

        def step(batch):
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = matrix([np.array(v, "<i4").tobytes() for v in batch.column(2).to_pylist()])
            rest = [batch.column(3 + i).to_pylist() for i in range(len(more))]
            lows, highs = [], []
            for k in range(0, len(ids), FEW):
                few = slice(k, k + FEW)
                low, high = limits(at, scores(vectors[few], at.vectors), ids[few], labels[few], *(r[few] for r in rest))
                lows += low
                highs += high
            return [batch.column(0), batch.column(1), batch.column(2).cast(pa.list_(pa.int32())), lows, highs]

        return step

    return common.arrow_map(anchors.select("vec_id", "label", "vector", *more), "vec_id long, label long, vector array<int>, lows array<long>, highs array<long>", start, None)


def _for_positives(rule: Rule) -> Callable:
    """From the score that the sample alone assures for the last positive; no upper limit."""

    def limits(at: Space, score, ids, labels):
        score = np.where((labels[:, None] == at.labels) & (ids[:, None] != at.ids), score, LEAST)
        enough = score.shape[1] >= rule.positives
        low = np.partition(score, -rule.positives, axis=1)[:, -rule.positives] if enough else np.full(len(ids), LEAST)
        return [[x] for x in low.tolist()], [[MOST]] * len(ids)

    return limits


def _for_negatives(rule: Rule) -> Callable:
    """For each of an anchor's positives (tops, their scores): part / of its score, or what the sample assures for the last, to its score."""

    def limits(at: Space, score, ids, labels, tops):
        lows = []
        for own, label, highs in zip(score, labels, tops, strict=True):
            others = np.sort(own[at.labels != label])
            low = []
            for top in highs:
                n = int(np.searchsorted(others, top, side="right"))
                least = -(-rule.part * top // rule.of)
                low.append(max(least, int(others[n - rule.negatives])) if n >= rule.negatives else least)
            lows.append(low)
        return lows, tops

    return limits


def mine(df: DataFrame, anchor: Column, label: Column | None = None, rule: Rule = Rule()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of df (vec_id, embedding, label)
    for which anchor, an expression of vec_id, holds. Tables between are removed."""
    with common.scope() as own:
        (found,) = own.keep(common.written(_mined(df, anchor, F.col("label") if label is None else label, rule), "negatives"))
    return found


def _mined(df: DataFrame, anchor: Column, label: Column, rule: Rule) -> DataFrame:
    spark = df.sparkSession
    every = common.written(prepared(df, rule, label), "vectors")
    at = space(every, rule)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if at is None:
        return empty
    sent = spark.sparkContext.broadcast(at)
    anchors = every.filter(anchor)
    counts = every.agg(F.count(F.lit(1)).alias("n"), F.count_if(anchor).alias("anchors")).first()
    rows = blocks(first_of_equals(every, 1 + max(rule.positives, rule.negatives)), counts["n"], sent, rule)

    positives = common.written(search(groups(_limited(anchors, sent, _for_positives(rule)), counts["anchors"], sent, rule), rows, sent, True, rule.positives), "positives")
    tops = positives.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("tops"))
    again = anchors.join(tops.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = search(groups(_limited(again, sent, _for_negatives(rule), "tops"), counts["anchors"], sent, rule), rows, sent, False, rule.negatives)
    found = found.select("anchor_id", (F.col("wanted") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(of, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
