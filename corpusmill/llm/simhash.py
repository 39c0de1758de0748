"""SimHash near duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set: XXH64 with seed 42 of the shingles of
three words (repeats included, joined by spaces, A-Z lower-cased; fewer words: the whole sequence; none: zero). Fingerprints
link at three or fewer differing bits, and components of links are the groups of near duplicates.

Equal fingerprints are one fingerprint from here on. It is cut into two segments of 32 bits. Of two linked fingerprints one
segment differs in one bit at most, so each fingerprint looks, for either segment, under the 33 values of the ball of radius
one around its own. What is found under a value are the fingerprints that have it exactly (the table). Table and probes meet
by a shuffle on segment and value; a task compares those of one value, whole distances, and keeps of the links a spanning
forest, so that a group of near copies sends as many edges as it has members, not as many as it has pairs.

A value that more than `crowd` fingerprints have is split: of segments that differ in at most three bits, one of four parts is
equal. Those of crowded values, and of the values around them, meet by value and part, and again by parts of what is left while
a bucket is larger than `crowd`. What meets in one bucket is bounded that way, with no link lost.

Defined cases: null, empty and wordless texts have the fingerprint zero and link like any other; rows are documents of their
own, also those that share a doc_id, and repeated rows have repeated results; a null doc_id has a fingerprint, links with
nothing and has a null component; the component is the smallest doc_id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.components import components

from . import common

#: Shingles hashed, pairs compared and rows kept at a time.
SHINGLES, PAIRS, ROWS = 1 << 16, 1 << 21, 1 << 18
#: Bits of a segment, and the bits that are left of one when buckets are small whatever they hold.
SEGMENT, FEW = 32, 6
MASK = (1 << SEGMENT) - 1


@dataclass(frozen=True)
class Rule:
    """Links at distance or fewer differing bits (3 at most: one of two segments differs in one); seed and words of the shingles' hashes."""

    words: int = 3
    seed: int = 42
    distance: int = 3
    crowd: int = 4096

    def __post_init__(self) -> None:
        if not 0 <= self.distance <= 3:
            raise ValueError("balls of radius one in two segments find distances up to 3")


def fingerprint(text: bytes | None, rule: Rule = Rule()) -> int:
    """The 64 bits, unsigned."""
    own = (text or b"").lower().split()
    k = min(rule.words, len(own))
    n = len(own) - k + 1 if k else 0
    total = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        here = own[at : at + SHINGLES + k - 1]
        joined = map(b" ".join, zip(*(here[i:] for i in range(k)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, rule.seed) for s in joined), np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long)."""

    def start():
        def step(batch):
            return [batch.column(0), np.array([fingerprint(t, rule) for t in common.raw(batch, "text")], np.uint64).view(np.int64).tolist()]

        return step

    return common.arrow_map(common.id_and_text(docs), "doc_id long, print long", start)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest that it reaches over u, v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        np.minimum.at(least, before, least)
        least = least[least]
        if (least == before).all():
            moved = least != np.arange(len(nodes))
            return nodes[moved], nodes[least[moved]]


def near(prints: np.ndarray, table: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the fingerprints of buckets (of so many rows, one after the other): those of its table with all others."""
    ends = np.cumsum(sizes)
    rows = np.flatnonzero(table)
    bucket = np.searchsorted(ends, rows, side="right")
    first, count = (ends - sizes)[bucket], sizes[bucket]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    edges = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + PAIRS, PAIRS))
    edges[-1] = len(rows)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if high > low:
            n = count[low:high]
            one = np.repeat(rows[low:high], n)
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[low:high], n)
            u, v = prints[one], prints[other]
            far = np.bitwise_count((u ^ v).view(np.uint64))
            linked = (far <= distance) & (far > 0)
            out.append(forest(u[linked], v[linked]))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _linked(entries: DataFrame, distance: int) -> DataFrame:
    """u, v: edges found in the buckets of entries (key, print, exact). Sorted by key, a task holds whole buckets, ROWS at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for last, batch in _with_end(batches):
            if batch is not None:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
                n += batch.num_rows
            if not n or (not last and n < ROWS):
                continue
            key, prints, exact = (np.concatenate(c) for c in zip(*held, strict=True))
            whole = len(key) if last else int(np.searchsorted(key, key[-1], side="left"))  # the last bucket may go on
            held, n = [[c[whole:] for c in (key, prints, exact)]], len(key) - whole
            starts = np.flatnonzero(np.concatenate([[True], key[1:whole] != key[: whole - 1]])) if whole else np.zeros(0, np.int64)
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, whole))
            worth = (sizes > 1) & np.logical_or.reduceat(exact[:whole], starts)
            rows = np.repeat(worth, sizes)
            u, v = near(prints[:whole][rows], exact[:whole][rows], sizes[worth], distance)
            if len(u):
                u, v = forest(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    common.bounded_batches(entries.sparkSession)
    return entries.select("key", "print", "exact").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


def ball(value: Column) -> Column:
    """value and the 32 values that differ from it in one bit."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def _halves(sets: DataFrame) -> DataFrame:
    """print, segment, own (its value there), rest (the other one's)."""
    low, high = F.col("print").bitwiseAND(F.lit(MASK)), F.shiftrightunsigned("print", SEGMENT)
    parts = F.array(F.struct(F.lit(0).cast("long").alias("segment"), low.alias("own"), high.alias("rest")), F.struct(F.lit(1).cast("long").alias("segment"), high.alias("own"), low.alias("rest")))
    return sets.select("print", F.explode(parts).alias("p")).select("print", "p.*")


def _probes(halves: DataFrame, *more: str) -> DataFrame:
    """key, print, exact: the entries of a ball; exact ones are the table."""
    return halves.select("print", *more, "segment", F.posexplode(ball(F.col("own")))).select(F.shiftleft("segment", SEGMENT).bitwiseOR(F.col("col")).alias("key"), "print", (F.col("pos") == 0).alias("exact"), *more)


def _split(entries: DataFrame) -> DataFrame:
    """Entries (key, print, exact, rest, free) by key and each of four parts of the free bits of rest, which leaves the others."""
    cut = lambda k: F.floor(F.col("free") * k / 4).cast("int")
    call = F.call_function

    def part(k: int) -> Column:
        at, wide = cut(k), cut(k + 1) - cut(k)
        low = call("shiftleft", F.lit(1).cast("long"), at) - 1
        above = call("shiftright", F.col("rest"), at)
        value = above.bitwiseAND(call("shiftleft", F.lit(1).cast("long"), wide) - 1)
        left = call("shiftleft", call("shiftright", above, wide), at).bitwiseOR(F.col("rest").bitwiseAND(low))
        return F.struct(F.xxhash64("key", F.lit(k), value).alias("key"), left.alias("rest"), (F.col("free") - wide).alias("free"))

    return entries.select("print", "exact", F.explode(F.array(*(part(k) for k in range(4)))).alias("p")).select("p.key", "print", "exact", "p.rest", "p.free")


def _crowded(entries: DataFrame, rule: Rule) -> list[DataFrame]:
    """Edges of the entries (with rest, free) of crowded values: buckets are split until all are small."""
    found = []
    entries = common.written(_split(entries), "split")
    while True:
        sizes = common.written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("exact").alias("any"), F.max("free").alias("most")).filter("n > 1 and any"), "buckets")
        large = f"n > {rule.crowd} and most > {FEW}"
        found.append(common.written(_linked(entries.join(sizes.filter(f"not ({large})").select("key"), "key"), rule.distance), "links"))
        open_ = common.written(sizes.filter(large).select("key"), "open")
        if open_.isEmpty():
            return found
        entries = common.written(_split(entries.join(open_, "key")), "split")


def links(sets: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """u, v: edges that connect what links of the distinct fingerprints (print) connect."""
    halves = _halves(sets.select("print"))
    hot = common.written(halves.groupBy("segment", "own").count().filter(f"count > {rule.crowd}").select("segment", "own"), "hot")
    if hot.isEmpty():
        return common.written(_linked(_probes(halves), rule.distance), "links")
    # hot: the value itself is crowded; around: it or a neighbour is.
    around = common.written(hot.select("segment", F.posexplode(ball(F.col("own")))).groupBy("segment", F.col("col").alias("own")).agg(F.min("pos").alias("pos")), "around")
    marked = common.written(halves.join(around, ["segment", "own"], "left"), "halves")
    plain = common.written(_linked(_probes(marked.filter("pos is null or pos > 0")), rule.distance), "links")
    crowded = _probes(marked.filter("pos is not null").withColumn("free", F.lit(SEGMENT)), "rest", "free")
    out = plain
    for more in _crowded(crowded, rule):
        out = out.union(more)
    return out


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: a row a row of docs. Tables between are removed."""
    with common.scope() as own:
        prints, first = own.keep(*_classes(docs, rule))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(first, "print", "left").select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("top")).alias("component_id"))


def _classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    prints = common.written(fingerprints(docs, rule), "prints")
    sets = common.written(prints.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("first")), "sets")
    found = common.written(components(links(sets, rule)), "components")
    members = common.written(sets.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print")), "members")
    tops = common.written(members.groupBy("component").agg(F.min("first").alias("top")), "tops")
    return prints, common.written(members.join(tops, "component").select("print", "top"), "first")
