"""Quality classifier: perplexity under interpolated modified Kneser-Ney trigram models of trusted text.

Documents are in two folds by the hash of their id. The trusted documents of either fold, all of them, train the model that
scores the other fold: every trusted document counts, and none is scored by a model that has seen it. Each language's limit is a
quantile of the perplexity of its trusted documents, over all of them; languages with fewer than Rule.least_trusted take the
quantile over all languages. Limits are a table that scores are joined with. Documents up to the limit are kept.

Counts, continuation counts and counts of counts are those of Chen and Goodman (1999). Texts are packed into units of bounded size.
A unit sends its distinct trigrams, as places in a vocabulary of their own, to the parts of their middle words, where all meet that
a probability needs but the words' own counts: trigrams, contexts (the first two words), pairs (the last two) and what follows the
middle word. A frequent word has several parts, dealt by the word before it. fit() counts that way: each part keeps its distinct
trigrams, packed, and tells the parts of their last words what it has of these; they sum, and tell it the words' counts and the
counts of frequent words' pairs. These two tables are the model. scored() brings a part of the model and the scored texts' trigrams
together; a part answers with one sum a text, since log p is a sum of what the n-gram's and the word's part know: a word's own share
is added where it is the middle word, for which a mark stands after a text's last word. No texts move; neither model nor answers are
ever whole in one place; parts follow the input's size. A fold is scored in ROUNDS; what a job shuffled is removed at its end and
a model after its fold, so that disk holds one model and one round's messages.

If Rule.train_documents is given, one model is fitted on a sample instead: of the first so many trusted documents by the hash of
their id, at most half of all, those that fit into Rule.train_words words together; limits come from all other trusted ones.

Words are those of hashing.words(); two marks stand before a text's first word. Only a unit's distinct words are hashed, to 48 bits.
A text longer than a unit is cut between words, each piece with the two words before it.

Defined cases: null or wordless text has no perplexity and is not kept; without trusted text there is no perplexity and
every document with words is kept; if only one fold has trusted text, its model scores both, and limits come from the other's
documents; a null lang is the language `und`; ties at a limit are kept; a trusted document longer than train_words isn't in a
sample; a null doc_id is kept as such and never trusted; repeated rows give repeated results; empty tables are fine; other columns
are ignored. Texts are scored whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count
from math import prod

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import backoff, common, exchange, hashing, idfilter

#: Bits of a word's hash.
BITS = 48
#: The marks before a text and after it, as hashes.
BEGIN, END = 0xB5297A4D3F84, 0x6A09E667F3BC
#: Documents of a fold are scored in so many rounds, one after the other, each of which sends the model again.
ROUNDS = 2
#: Parts of small inputs.
LEAST_PARTS = 12
#: Shares of a part, so many, above which a word is frequent and has several parts.
HOT = 4
#: Kinds of rows: n-grams of texts to learn from, to score, the texts; a part's n-grams, what it tells words' parts, what they tell it, counts of counts.
LEARN, ASK, DOCS, GRAMS, TOLD, FACT, SEEN = range(7)
SENT = "part long, kind int, unit long, data binary, rows array<long>, docs array<long>, langs array<string>, sizes array<long>"
COUNTED = "part long, kind int, data binary, unit long, seen array<long>"
ANSWERED = "unit long, sums binary, rows array<long>, docs array<long>, langs array<string>, sizes array<long>"
SCORED = "row long, doc_id long, lang string, n_words long, log double"


@dataclass(frozen=True)
class Rule:
    #: Documents of a sample to learn from, and its words; None: all trusted documents, whatever train_words.
    train_documents: int | None = None
    train_words: int = 2_000_000
    quantile: float = 0.95
    least_trusted: int = 50
    #: Share of the limit's perplexity added to it.
    slack: float = 0.0


@dataclass(frozen=True)
class Order:
    """Discounts of counts 1, 2 and 3 or more."""

    discounts: tuple[float, float, float]

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts])[np.minimum(n, 3)]

    def kept(self, n: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        return np.maximum(n - self.of(n), 0)


def discounts(seen: dict[int, int]) -> Order:
    """From the numbers of n-grams with counts 1 to 4; their usual approximations where those are too few."""
    n1, n2, n3, n4 = (seen.get(k, 0) for k in (1, 2, 3, 4))
    if min(n1, n2, n3, n4) == 0:
        return Order((0.5, 1.0, 1.5))
    y = n1 / (n1 + 2 * n2)
    return Order(tuple(min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))))


def _hashed(words: Iterable[bytes]) -> np.ndarray:
    """Hashes of words in lower case."""
    return (hashing.words(b" ".join(words)) >> np.uint64(64 - BITS)).astype(np.int64)


def _split(text: bytes | None) -> list[bytes]:
    """The words of a text: bytes know ASCII's white space and capitals only."""
    return (text or b"").lower().split()


@dataclass(frozen=True)
class Spread:
    """Where n-grams meet: in the part of their middle word; a word of many n-grams has several parts, dealt by the word before it."""

    parts: int
    words: np.ndarray
    shares: np.ndarray

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first part of each word, and how many it has."""
        shares = np.ones(len(words), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            shares[hit] = self.shares[at[hit]]
        return words % self.parts, shares

    def places(self) -> dict[int, np.ndarray]:
        """By part, the words with several parts that have this one."""
        word = np.repeat(self.words, self.shares)
        part = (word + np.arange(len(word)) - np.repeat(np.cumsum(self.shares) - self.shares, self.shares)) % self.parts
        return {int(p): word[part == p] for p in np.unique(part)}


def spread(docs: DataFrame) -> Spread:
    """Parts follow the size of docs. A word with more than a share of 1 / (HOT * parts) of all words has a part for each such share."""
    parts = max(min(common.partitions(docs.sparkSession), LEAST_PARTS), -(-common.input_bytes(docs) // exchange.PART_BYTES))
    least, schema = 1 / (2 * HOT * parts), common.arrow_schema("z long, n long")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.units(batches, "text", exchange.UNIT_BYTES, exchange.UNIT_ROWS):
            found = Counter()
            for text in common.raw(batch, "text"):
                found.update(_split(text))
            if every := found.total():
                many = {w: n for w, n in found.items() if n >= least * every}  # others are rarer
                yield pa.RecordBatch.from_arrays([pa.array([-1, *_hashed(many)], pa.int64()), pa.array([every, *many.values()], pa.int64())], schema=schema)

    common.bounded_batches(docs.sparkSession)
    found = common.written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "z long, n long").groupBy("z").agg(F.sum("n").alias("n")), "frequent")
    every = found.filter("z = -1").first()
    some = [] if every is None else found.filter((F.col("z") >= 0) & (F.col("n") > every["n"] / (HOT * parts))).orderBy("z").collect()  # at most HOT * parts rows
    shares = [min(parts, -(-r["n"] * HOT * parts // every["n"])) for r in some]
    return Spread(parts, np.array([r["z"] for r in some], np.int64), np.array(shares, np.int64))


def _packed(rising: Iterable[np.ndarray], plain: Iterable[np.ndarray]) -> bytes:
    """Columns of numbers from 0 to below 2 ** 56 by the planes of their bytes, compressed; of those that rise mostly, the differences."""
    head, planes = [], []
    for columns, differ in ((rising, 1), (plain, 0)):
        for column in columns:
            width = -(-int(column.max(initial=1)).bit_length() // 8)
            own = np.diff(column.astype("<i8"), prepend=0) if differ else column.astype("<i8")
            head += [len(own), width, differ]
            planes.append(np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(1).compress(np.array([len(planes), *head], "<i8").tobytes() + b"".join(planes))


def _unpacked(data: bytes) -> list[np.ndarray]:
    data, out = zstandard.ZstdDecompressor().decompress(data), []
    columns = int(np.frombuffer(data, "<i8", 1)[0])
    at = 8 + 24 * columns
    for n, width, differ in np.frombuffer(data, "<i8", 3 * columns, 8).reshape(-1, 3).tolist():
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        own = wide.view("<i8").reshape(-1)
        out.append(np.cumsum(own) & ((1 << 8 * width) - 1) if differ else own)
    return out


def _gathered(rows: Iterable[bytes], columns: int) -> list[np.ndarray]:
    """The columns of packed rows, each in one."""
    found = [_unpacked(r) for r in rows]
    return [np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(columns)]


def _distinct(columns: list[np.ndarray], sizes: list[int], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct combinations in order, and how often each is there, or the sum of its n. sizes: above the columns' numbers."""
    if fits := prod(sizes) < 1 << 63:
        key = columns[0].astype(np.int64)
        for column, size in zip(columns[1:], sizes[1:], strict=True):
            key *= size
            key += column
        if n is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        end, key, out = len(key), key[new], []
        for size in reversed(sizes[1:]):
            key, column = np.divmod(key, size)
            out.append(column)
        out = [key, *reversed(out)]
    if not fits:
        order = np.lexsort(columns[::-1])
        out, changed = [c[order] for c in columns], np.ones(len(order), bool)
        changed[1:] = np.any([c[1:] != c[:-1] for c in out], axis=0)
        new, end, n = np.flatnonzero(changed), len(order), None if n is None else n[order]
        out = [c[new] for c in out]
    return out, np.diff(np.append(new, end)) if n is None else np.add.reduceat(n, new) if len(new) else n


def _sent(where: Spread, asked: bool):
    """Units of texts as messages to parts: their n-grams and how often (LEARN); or how often in which text (ASK), and the texts (DOCS)."""
    schema = common.arrow_schema(SENT)

    def batch(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    def messages(held: list[tuple], seen: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
        first = held[0][0]
        if asked:
            yield batch(first % where.parts, DOCS, first, None, *([h[k] for h in held] for k in range(4)))
        found = [(row - first, own) for row, *_, own in held if len(own) > 2]
        if not found:
            return
        idx, vocab = np.concatenate([own for _, own in found]), np.concatenate([[BEGIN, END], _hashed(seen)])
        counts = np.bincount(idx, minlength=len(vocab))
        order = np.lexsort((vocab, -counts))  # frequent words have small numbers, equally frequent ones stand by hash
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        vocab, idx = vocab[order], rank[idx]
        lengths = np.array([len(own) for _, own in found])
        starts = np.cumsum(lengths) - lengths
        last = np.ones(len(idx), bool)
        last[starts] = last[starts + 1] = False
        at = np.flatnonzero(last)
        doc = np.repeat(np.array([d for d, _ in found], np.int32), lengths - 2)
        x, y, z = idx[at - 2], idx[at - 1], idx[at]

        home, shares = where.of(vocab)
        word, begin = np.repeat(np.arange(len(vocab)), shares), np.cumsum(shares) - shares
        part = (home[word] + np.arange(len(word)) - begin[word]) % where.parts
        order = np.argsort(part, kind="stable")
        word, part, place = word[order], part[order], np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))  # of a word and one of its parts, in the order of parts
        share = begin[y]
        split = np.flatnonzero(shares[y] > 1)
        share[split] += (hashing.mix(vocab[x[split]].astype(np.uint64)) % shares[y[split]].astype(np.uint64)).astype(np.int64)
        columns, sizes = [place[share], x, z], [len(word), len(vocab), len(vocab)]
        del idx, at, last, y, share, split
        columns, n = _distinct([*columns, doc], [*sizes, int(doc[-1]) + 1]) if asked else _distinct(columns, sizes)
        y, x, z, *doc = columns
        part, y = part[y], word[y]
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        place = np.empty(len(vocab), np.int64)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, used = slice(low, high), np.zeros(len(vocab), bool)
            used[y[own]] = used[x[own]] = used[z[own]] = True
            mine = np.flatnonzero(used)
            place[mine] = np.arange(len(mine))
            data = _packed([vocab[mine], place[y[own]], place[x[own]]], [place[z[own]], *(d[own] for d in doc), n[own]])
            yield batch(int(part[low]), ASK if asked else LEARN, first, data, None, None, None, None)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = -(-exchange.UNIT_BYTES // 2)
        row, held, size, seen = TaskContext.get().partitionId() << 32, [], 0, defaultdict(count(2).__next__)
        for unit in common.units(batches, "text"):
            for doc, lang, text in zip(common.strings(unit, "doc_id"), common.strings(unit, "lang"), common.raw(unit, "text"), strict=True):
                cut = backoff.pieces(text or b"", 3, most)
                following = next(cut)
                while following:
                    (skip, piece), following = following, next(cut, None)
                    if held and (size + len(piece) > most or row - held[0][0] >= exchange.UNIT_ROWS):
                        yield from messages(held, seen)
                        held, size, seen = [], 0, defaultdict(count(2).__next__)
                    words = np.fromiter(map(seen.__getitem__, _split(piece)), np.int32)
                    own = np.concatenate([np.zeros(2 - skip, np.int32), words, np.ones(int(asked and not following and len(words) > 0), np.int32)])
                    held.append((row, doc, lang, len(words) - skip, own))
                    size += len(piece)
                row += 1
        if held:
            yield from messages(held, seen)

    return send


def _few(counts: np.ndarray) -> list[int]:
    """How many of counts are 1 to 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _counted(where: Spread):
    """One part's n-grams (GRAMS); to words' parts, z and its pairs here, but of words y with several parts y, z and their n-grams (TOLD)."""
    schema = common.arrow_schema(COUNTED)

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        part, found = key[0].as_py(), [_unpacked(r) for r in rows["data"].to_pylist()]
        vocab = np.unique(np.concatenate([f[0] for f in found]))
        places = [np.searchsorted(vocab, f[0]) for f in found]
        columns = [np.concatenate([p[f[k]] for p, f in zip(places, found, strict=True)]) for k in (1, 2, 3)]
        (y, x, z), n = _distinct(columns, [len(vocab)] * 3, np.concatenate([f[4] for f in found]))
        del found, places, columns
        out = [(part, GRAMS, _packed([vocab, y, x], [z, n]), part, None)]
        (y, z), before = _distinct([y, z], [len(vocab)] * 2)
        several = where.of(vocab)[1][y] > 1
        out.append((part, SEEN, None, part, _few(n) + _few(before[~several]) + [0] * 6))
        words, pairs = np.unique(z[~several], return_counts=True)
        words, hot_y, hot_z, hot_n = vocab[words], vocab[y[several]], vocab[z[several]], before[several]
        to, hot_to = words % where.parts, hot_z % where.parts
        for q in np.union1d(to, hot_to).tolist():
            own, hot = to == q, hot_to == q
            out.append((q, TOLD, _packed([words[own], hot_y[hot]], [pairs[own], hot_z[hot], hot_n[hot]]), part, None))
        return _table(out, schema)

    return counted


def _told(where: Spread):
    """Words' counts from what parts told one part, and the answers (FACT) to parts: z, its count; pairs y, z of words with several
    parts, their counts, z's; the words that are the part's own, their counts."""
    schema = common.arrow_schema(COUNTED)

    def told(key: tuple, rows: pa.Table) -> pa.Table:
        part, places = key[0].as_py(), where.places()
        found = {r["unit"]: _unpacked(r["data"]) for r in rows.select(["unit", "data"]).to_pylist()}
        z, hot_y, n, hot_z, hot_n = (np.concatenate([f[k] for f in found.values()]) for k in range(5))
        (hot_z, hot_y), hot_n = _distinct([hot_z, hot_y], [1 << BITS] * 2, hot_n)
        words = np.unique(np.concatenate([z, hot_z]))
        total = np.bincount(np.searchsorted(words, z), n, len(words)).astype(np.int64) + np.bincount(np.searchsorted(words, hot_z), minlength=len(words))
        out = [(part, SEEN, None, part, [0] * 4 + _few(hot_n) + _few(total) + [len(words), int(total.sum())])]
        none = np.zeros(0, np.int64)
        for p in sorted({part, *found, *places}):
            its = places.get(p, none)
            asked, hot = found[p][0] if p in found else none, np.isin(hot_y, its)
            own = np.ones(len(words), bool) if p == part else np.isin(words, its)
            if len(asked) or hot.any() or own.any():
                count_of = lambda w: total[np.searchsorted(words, w)]
                out.append((p, FACT, _packed([asked, hot_z[hot], words[own]], [count_of(asked), hot_y[hot], hot_n[hot], count_of(hot_z[hot]), total[own]]), part, None))
        return _table(out, schema)

    return told


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


@dataclass(frozen=True)
class Model:
    """What fit() counts: where n-grams meet; of each part its n-grams (GRAMS) and what words' parts told it (FACT); discounts; the
    total of words' counts, p of an unknown word."""

    where: Spread
    rows: DataFrame
    orders: tuple[Order, Order, Order]
    total: int
    unknown: float


def _messages(docs: DataFrame, where: Spread, asked: bool) -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "lang", "text").mapInArrow(_sent(where, asked), SENT)


def _plain(texts: DataFrame) -> DataFrame:
    return texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def fit(texts: DataFrame, where: Spread | None = None) -> Model | None:
    """The model of texts; None if they have no words. where: the spread of what will be scored."""
    where = where or spread(texts)
    with common.scope() as own:
        counts = common.written(_messages(_plain(texts), where, False).groupBy("part").applyInArrow(_counted(where), COUNTED), "counts")
        facts = common.written(counts.filter(F.col("kind") == TOLD).groupBy("part").applyInArrow(_told(where), COUNTED), "facts")
        every = counts.union(facts)
        seen = {r["pos"]: r["n"] for r in every.filter(F.col("kind") == SEEN).select(F.posexplode("seen")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}  # 14 numbers
        if not seen:
            return None
        orders = tuple(discounts({k: seen[at + k - 1] for k in range(1, 5)}) for at in (0, 4, 8))
        types, total = seen[12], seen[13]
        d1, d2, d3 = orders[2].discounts
        left = seen[8] * d1 + seen[9] * d2 + (types - seen[8] - seen[9]) * d3
        own.keep(counts, facts)
        rows = every.filter(F.col("kind").isin(GRAMS, FACT)).select("part", "kind", "unit", "data", *(F.lit(None).cast(k).alias(n) for n, k in (f.split() for f in SENT.split(", ")[4:])))
        return Model(where, rows, orders, total, left / total / (types + 1))


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where sorted keys have wanted ones; -1 where they haven't, or for -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _answered(where: Spread, orders: tuple[Order, Order, Order], total: int, unknown: float):
    """Of every unit's texts the sum of what one part knows of their logarithms.

    Of n-gram x, y, z the part adds log p(y), so that of every word, since a text's last is before END; it adds the rest for z: if
    the model has no pair (y, z), the weights that x, y and y leave to shorter n-grams; if it has, log p(z | x, y) - log p(z)."""
    schema = common.arrow_schema(ANSWERED)
    p_of = lambda n: orders[2].kept(n) / total + unknown

    def answer(key: tuple, messages: pa.Table) -> pa.Table:
        kinds = np.array(messages["kind"].to_pylist(), np.int64)
        of = lambda kind: messages.filter(pa.array(kinds == kind))
        vocab, y, x, z, n = _gathered(of(GRAMS)["data"].to_pylist(), 5)  # one row at most
        fact_z, hot_z, own_z, fact_n, hot_y, hot_n, hot_m, own_n = _gathered(of(FACT)["data"].to_pylist(), 8)
        before = vocab
        vocab = np.union1d(before, np.concatenate([hot_y, hot_z]))
        y, x, z = (np.searchsorted(vocab, before)[c] for c in (y, x, z)) if len(before) else (y, x, z)
        size = max(len(vocab), 1)
        place = lambda words: _place(vocab, words)

        words = np.full(size, unknown)
        words[place(fact_z)] = p_of(fact_n)
        words[place(hot_z)] = p_of(hot_m)
        (pair_y, pair_z), before = _distinct([y, z], [size] * 2)
        single = where.of(vocab)[1][pair_y] == 1
        pairs, before = np.concatenate([(pair_y * size + pair_z)[single], place(hot_y) * size + place(hot_z)]), np.concatenate([before[single], hot_n])
        order = np.argsort(pairs)
        pairs, before = pairs[order], before[order]
        pair_y = pairs // size
        pair_total = np.bincount(pair_y, before, size)
        rest2 = np.ones(size + 1)  # the last: a word without pairs
        some = pair_total > 0
        rest2[:size][some] = np.minimum(np.bincount(pair_y, orders[1].of(before), size)[some] / pair_total[some], 1)
        known = words[pairs % size]
        p2 = orders[1].kept(before) / pair_total[pair_y] + rest2[pair_y] * known

        contexts = y * size + x
        first = np.flatnonzero(np.diff(contexts, prepend=-1))
        grams, which = contexts[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(contexts))))
        context_total = np.bincount(which, n, len(grams))
        rest3 = np.append(np.minimum(np.bincount(which, orders[0].of(n), len(grams)) / context_total, 1), 1.0)
        p = _place(pairs, y * size + z)
        trigrams, tri = which * size + z, np.log((orders[0].kept(n) / context_total[which] + rest3[which] * p2[p]) / known[p])
        del x, y, z, n, contexts, which, p, pair_y, pair_z, order

        order = np.argsort(own_z)
        own_z, own_p = own_z[order], np.log(np.append(p_of(own_n[order]), unknown))

        sums: dict[int, np.ndarray] = {}
        for row in of(ASK).select(["unit", "data"]).to_pylist():
            asked, y, x, z, doc, n = _unpacked(row["data"])
            log = own_p[_place(own_z, asked)]
            log[asked == BEGIN] = 0
            log, rest, at = log[y], np.flatnonzero(asked[z] != END), place(asked)
            y, x, z = at[y[rest]], at[x[rest]], at[z[rest]]
            c = _place(grams, np.where((y >= 0) & (x >= 0), y * size + x, -1))
            left, of_y = rest3[c], rest2[y]
            more = np.log(left * of_y)
            there = np.flatnonzero((c >= 0) & (z >= 0))
            t = _place(trigrams, c[there] * size + z[there])
            hit = t >= 0
            more[there[hit]] = tri[t[hit]]
            missed = (y >= 0) & (z >= 0)
            missed[there[hit]] = False
            missed = np.flatnonzero(missed)
            p = _place(pairs, y[missed] * size + z[missed])
            missed, p = missed[p >= 0], p[p >= 0]
            more[missed] = np.log(left[missed] * p2[p] / known[p])
            log[rest] += more
            new, old = np.bincount(doc, log * n), sums.get(row["unit"], np.zeros(0))
            sums[row["unit"]] = np.pad(new, (0, max(len(old) - len(new), 0))) + np.pad(old, (0, max(len(new) - len(old), 0)))
        out = [(unit, v.astype("<f8").tobytes(), None, None, None, None) for unit, v in sums.items()]
        out += [(r["unit"], None, r["rows"], r["docs"], r["langs"], r["sizes"]) for r in of(DOCS).to_pylist()]
        return _table(out, schema)

    return answer


def _summed():
    """The texts of a unit with the sums of all parts' answers; of the pieces of a text one has the sum."""
    schema = common.arrow_schema(SCORED)

    def whole(key: tuple, answers: pa.Table) -> pa.Table:
        unit = key[0].as_py()
        sums, out = np.zeros(0), []
        for data in answers["sums"].drop_null().to_pylist():
            new = np.frombuffer(data, "<f8")
            sums = np.pad(sums, (0, max(len(new) - len(sums), 0)))
            sums[: len(new)] += new
        taken = set()
        for row in answers.filter(answers["sums"].is_null()).to_pylist():
            for number, doc, lang, n in zip(row["rows"], row["docs"], row["langs"], row["sizes"], strict=True):
                out.append((number, doc, lang, n, float(sums[number - unit]) if number - unit < len(sums) and number not in taken else 0.0))
                taken.add(number)
        return _table(out, schema)

    return whole


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, n_words, perplexity."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    if model is None:

        def start():
            return lambda batch: [batch.column(0), batch.column(1), [len(hashing.words(t)) for t in common.raw(batch, "text")], [None] * batch.num_rows]

        return common.arrow_map(own, "doc_id long, lang string, n_words long, perplexity double", start)
    answers = _messages(own, model.where, True).union(model.rows).groupBy("part").applyInArrow(_answered(model.where, model.orders, model.total, model.unknown), ANSWERED)
    pieces = answers.groupBy("unit").applyInArrow(_summed(), SCORED)
    whole = pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.sum("n_words").alias("n_words"), F.round(F.sum("log"), 6).alias("log"))
    return whole.select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("log") / F.col("n_words"))).alias("perplexity"))


def sampled(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """The doc_id of the sample: of at most train_documents ids, in the order of their hash, those that fit together."""
    count = ids.count()
    first = common.written(ids.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(min(rule.train_documents, (count + 1) // 2)), "sample")

    def start():
        return lambda batch: [batch.column(0), [len(hashing.words(t)) for t in common.raw(batch, "text")]]

    texts = docs.join(F.broadcast(first), "doc_id", "left_semi").select("doc_id", "text")  # at most train_documents ids
    sizes = {r["doc_id"]: r["n"] for r in common.arrow_map(texts, "doc_id long, n long", start).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    held, chosen = 0, []
    for row in first.orderBy("place", "doc_id").collect():
        n = sizes.get(row["doc_id"], 0)
        if held + n <= rule.train_words:
            held += n
            chosen.append((row["doc_id"],))
    return docs.sparkSession.createDataFrame(chosen, "doc_id long")


def _trusted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of trusted documents, read where they are: a bitmap of the ids finds them, and a join takes out the few others that it has."""
    maybe, _ = idfilter.divided(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids, "doc_id")
    found, _ = idfilter.divided(docs.select(F.col("doc_id").cast("long").alias("doc_id")), ids, "doc_id")
    others = common.written(found.join(ids, "doc_id", "left_anti").distinct(), "others")
    return maybe.join(others, "doc_id", "left_anti")


def _folded(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of docs, each by the model of the other fold's trusted documents; and the trusted ids that limits come from."""
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    fold = F.pmod(hashed, F.lit(2))
    where = spread(docs)
    turn = F.pmod(F.shiftrightunsigned(hashed, 1), F.lit(ROUNDS))

    def scores(k: int, by: int) -> list[DataFrame] | None:
        """Scores of fold k by the model of the documents that aren't in fold by, which is removed after; None if they have no words."""
        with common.scope() as own:
            model = fit(_trusted(docs.filter(fold != by), ids.filter(fold != by)), where)
            return None if model is None else list(own.keep(*(common.written(scored(docs.filter((fold == k) & (turn == r)), model), "scores") for r in range(ROUNDS))))

    found = {k: scores(k, k) for k in (0, 1)}
    apart = [k for k in (0, 1) if found[k] is not None]
    rest = [s for k in (0, 1) if found[k] is None for s in (scores(k, 1 - k) if apart else [scored(docs.filter(fold == k), None)])]
    return reduce(DataFrame.union, [s for k in apart for s in found[k]] + rest), ids.filter(fold.isin(apart))


def judge(docs: DataFrame, trusted: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, lang, n_words, perplexity, most (the language's limit), kept. trusted: doc_id of trusted documents."""
    with common.unshuffled(docs.sparkSession):
        ids = common.written(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), "trusted_ids")
        with common.scope() as own:
            if rule.train_documents is None:
                scores, apart = _folded(docs, ids)
            else:
                texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                sample = sampled(texts, ids, rule)
                scores, apart = scored(docs, fit(texts.join(F.broadcast(sample), "doc_id", "left_semi"))), ids.join(F.broadcast(sample), "doc_id", "left_anti")
            (scores,) = own.keep(common.written(scores, "perplexity"))
        rest = scores.filter("perplexity is not null").join(apart, "doc_id", "left_semi")
        quantile = F.percentile_approx("perplexity", rule.quantile, 10000)
        every = rest.agg(quantile.alias("q")).first()["q"]
        limits = common.written(rest.groupBy("lang").agg(quantile.alias("q"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rule.least_trusted).select("lang", "q"), "limits")
    most = (1 + rule.slack) * F.coalesce("q", F.lit(every).cast("double"))
    limited = scores.join(limits, "lang", "left").withColumn("most", most)
    return limited.select("doc_id", "lang", "n_words", "perplexity", "most", ((F.col("n_words") > 0) & (F.col("perplexity").isNull() | F.col("most").isNull() | (F.col("perplexity") <= F.col("most")))).alias("kept"))
