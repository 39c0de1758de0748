"""Stupid-backoff scores (Brants et al., 2007) from n-gram counts of the whole corpus, computed relationally.

S(w | context) = count(context w) / count(context) where the n-gram was seen often enough, else 0.4 times the score with a
context shorter by a word; a single word scores its share of all words. N-grams rarer than least_count are not in the
model, as is usual for models of this size; rarer words score as if seen once.

Texts are packed into units of bounded size. Every unit sends its distinct n-grams with their counts, once each, to count
tables partitioned by hash (exchange). A partition adds the counts of an n-gram over all units - joining the units' n-grams
with the count table - and answers each unit with the counts of what it sent. Units meet their answers, score each word, and sum
per document. An n-gram that fills a third of the corpus is one entry a unit: no partition gets hot. Partitions follow the
input's size, counts have 64 bits.

A text longer than a unit is cut between words; each piece takes along the words before it that its first words need as
context, which it neither counts nor scores. Hashes have 56 bits: among 10 ** 12 distinct n-grams, one in 70,000 shares its hash.

Words are those of hashing.words(). Contexts don't cross documents.

Defined cases: null or wordless text has no words, score null and log score 0; a null doc_id is kept; repeated rows are
scored each and counted each; an empty table gives an empty result; other columns are ignored. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange, hashing

BITS = 56
PACKED = "unit long, rows array<long>, docs array<long>, skips array<int>, lengths array<long>, texts binary"
SENT = "unit long, part long, grams int, buckets binary, rest binary, counts binary"
ANSWERED = "unit long, part long, grams int, counts binary"
SCORED = "row long, doc_id long, n_words long, log double, alone long"


@dataclass(frozen=True)
class Rule:
    order: int = 3
    least_count: int = 2
    backoff: float = 0.4


def places(text: bytes, order: int) -> list[np.ndarray]:
    """The hashes of a text's n-grams for n from 1 to order, shortened to BITS."""
    own = hashing.words(text)
    return [hashing.ngrams(own, n) >> np.uint64(64 - BITS) for n in range(1, order + 1)]


def words_before(text: bytes, end: int, n: int) -> tuple[int, int]:
    """Where the n words before end begin (end is between words), and how many there are."""
    at, found = end, 0
    while found < n:
        stop = at
        while stop and text[stop - 1 : stop] in hashing.SPACES:
            stop -= 1
        if not stop:
            break
        width = 256
        while (space := max(text.rfind(c, max(0, stop - width), stop) for c in hashing.SPACES)) < 0 and width < stop:
            width *= 4
        at, found = space + 1, found + 1
    return at, found


def pieces(text: bytes, order: int, most: int) -> Iterator[tuple[int, bytes]]:
    """text cut between words into pieces of about most bytes: the number of words that are context only, and the piece."""
    at = 0
    while at < len(text) or not at:
        end = len(text)
        if end - at > most and (found := hashing.SPACE.search(text, at + most)):
            end = found.end()
        first, skip = words_before(text, at, order - 1) if at else (0, 0)
        yield skip, text[first:end]
        at = end
        if not text:
            return


def packed(docs: DataFrame, order: int) -> DataFrame:
    """PACKED: units of texts, compressed. A row of docs has a number, which its pieces share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = row = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(1)
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows, docs, skips, texts = map(list, zip(*held, strict=True))
            values = [unit, rows, docs, skips, [len(t) for t in texts], squeeze.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in common.units(batches, "text"):
            for doc, text in zip(common.strings(batch, "doc_id"), common.raw(batch, "text"), strict=True):
                for skip, piece in pieces(text or b"", order, exchange.UNIT_BYTES):
                    if held and (sum_bytes + len(piece) > exchange.UNIT_BYTES or len(held) >= exchange.UNIT_ROWS):
                        yield out()
                        unit, held = unit + 1, []
                    sum_bytes = len(piece) + (sum_bytes if held else 0)
                    held.append((row, doc, skip, piece))
                row += 1
        if held:
            yield out()

    schema = common.arrow_schema(PACKED)
    common.bounded_batches(docs.sparkSession)
    return common.id_and_text(docs).mapInArrow(run, PACKED)


def _texts(unit: pa.Table) -> Iterator[tuple[int, int | None, int, bytes]]:
    """row, doc_id, skip and text of a unit's pieces."""
    row = unit.to_pylist()[0]
    whole, at = zstandard.ZstdDecompressor().decompress(row["texts"]), 0
    for number, doc, skip, n in zip(row["rows"], row["docs"], row["skips"], row["lengths"], strict=True):
        yield number, doc, skip, whole[at : at + n]
        at += n


def _sent(order: int, parts: int):
    schema = common.arrow_schema(SENT)

    def send(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[] for _ in range(order)]
        once: list[list[np.ndarray]] = [[] for _ in range(order)]
        for _, _, skip, text in _texts(pa.Table.from_batches(list(batches))):
            for n, own in enumerate(places(text, order)):
                found[n].append(own)
                once[n].append(np.arange(n, n + len(own)) >= skip)  # n-grams that end in the context are counted before
        for n in range(order):
            values, which = np.unique(np.concatenate(found[n]), return_inverse=True)
            counts = np.bincount(which, np.concatenate(once[n]), minlength=len(values)).astype(np.int64)
            found[n], once[n] = [], []
            rows = [(key[0].as_py(), n * parts + part, high - low, buckets, rest, exchange.narrow(counts[low:high])) for part, low, high, buckets, rest in exchange.pack(values, BITS, parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), schema, strict=True)], schema=schema)

    return send


def _answered(parts: int):
    """Adds the counts of all units' n-grams of one part; answers each unit with the sums, in the order it sent them."""
    schema = common.arrow_schema(ANSWERED)

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, hashes, counts = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                units.append(row["unit"])
                hashes.append(exchange.unpack(key[0].as_py() % parts, BITS, parts, row["buckets"], row["rest"]))
                counts.append(exchange.widen(row["counts"], row["grams"]))
        _, which = np.unique(np.concatenate(hashes), return_inverse=True)
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)[which]
        for unit, own in zip(units, np.split(total, ends), strict=True):
            row = [unit, key[0].as_py(), len(own), exchange.narrow(own)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return answer


def score_words(counts: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Each word's log score without the corpus size, and whether that is still to be taken off.

    counts has those of the n-grams in order, for n from 1; the last word of an n-gram is the one it scores.
    """
    log, alone = np.log(np.maximum(counts[0], 1)), np.ones(len(counts[0]), bool)
    for n in range(2, rule.order + 1):
        seen = counts[n - 1]
        known = seen >= rule.least_count
        log[n - 1 :] = np.where(known, np.log(np.maximum(seen, 1) / np.maximum(counts[n - 2][: len(seen)], 1)), log[n - 1 :] + np.log(rule.backoff))
        alone[n - 1 :] &= ~known
    return log, alone


def _scored(rule: Rule, parts: int):
    schema = common.arrow_schema(SCORED)

    def score(key: tuple, unit: pa.Table, answers: pa.Table) -> pa.Table:
        texts = list(_texts(unit))
        own = [places(text, rule.order) for *_, text in texts]
        got = {row["part"]: exchange.widen(row["counts"], row["grams"]) for row in answers.select(["part", "grams", "counts"]).to_pylist()}
        counts = []
        for n in range(rule.order):
            which = np.unique(np.concatenate([o[n] for o in own]), return_inverse=True)[1]
            per = np.concatenate([np.zeros(0, np.int64), *(got[p] for p in sorted(got) if p // parts == n)])
            counts.append(np.split(per[which], np.cumsum([len(o[n]) for o in own])[:-1]))
        out = []
        for i, (row, doc, skip, _) in enumerate(texts):
            log, alone = (x[skip:] for x in score_words([c[i] for c in counts], rule))
            out.append((row, doc, len(log), float(log.sum()), int(alone.sum())))
        return pa.table([pa.array(c, f.type) for c, f in zip(map(list, zip(*out, strict=True)), schema, strict=True)], schema=schema)

    return score


def score(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score (null without words)."""
    parts = exchange.parts_of(docs)
    dealt = packed(docs, rule.order).repartition(parts, "unit")
    sent = dealt.groupBy("unit").applyInArrow(_sent(rule.order, parts), SENT)
    answers = sent.groupBy("part").applyInArrow(_answered(parts), ANSWERED)
    pieces_ = dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_scored(rule, parts), SCORED)
    whole = pieces_.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "log", "alone")))
    scores = common.written(whole, "scores")
    words = scores.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    log_score = F.when(F.col("n_words") > 0, F.col("log") - F.col("alone") * F.log(F.lit(float(max(words, 1))))).otherwise(0.0)
    return scores.select("doc_id", "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"))
