"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton accepts every word sequence inside an item. Streaming a document's words through it gives, at each word, the
longest item sequence that ends there; where that reaches the window size, the window's words are hit. Items shorter than
a window count as one window of their own, found by the states on the suffix links. Documents never move: each task
streams its own texts.

Words: A-Z lower-cased, then maximal runs of anything but ASCII other than digits and letters.

The automata are bounded: items are dealt to as many as AUTOMATON_WORDS asks for, and documents stream through one after
another; benchmarks are small, and one automaton is the rule.

Defined cases: null text has no words (no hits, not contaminated, kept); null or wordless items match nothing; an item with
a null item_id marks words but is not listed; repeated items count once by item_id; a null doc_id is kept; repeated rows
give repeated results; empty tables are fine on either side; other columns are ignored by scan() and kept by clean().
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words in one automaton.
AUTOMATON_WORDS = 2_000_000
#: Lower-cases A-Z and makes every other ASCII character but digits and letters a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class Automaton:
    """A generalised suffix automaton over word ids, with the items of every window-long state."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.ids, self.names = window, {}, []
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[tuple[int, list[int]]] = []
        for name, text in items:
            if sequence := [self.ids.setdefault(w, len(self.ids)) for w in words(text)]:
                ends.append((len(self.names), sequence))
                self.names.append(name)
                self._insert(sequence)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, sequence in ends:
            state = 0
            for word in sequence:
                state = up = self.next[state][word]
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if len(sequence) < window:
                self.short[state].append((len(sequence), k))
        self.chain: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.chain[state] = (*self.short[state], *self.chain[self.link[state]])

    def _insert(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            if (there := self.next[last].get(word)) is not None and self.length[there] == self.length[last] + 1:
                last = there
                continue
            new = None
            if there is None:
                new = self._state({}, self.length[last] + 1)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
            else:
                old = self.next[at][word]
                if self.length[old] == self.length[at] + 1:
                    target = old
                else:
                    target = self._state(dict(self.next[old]), self.length[at] + 1)
                    self.link[target] = self.link[old]
                    self.link[old] = target
                    while at >= 0 and self.next[at].get(word) == old:
                        self.next[at][word] = target
                        at = self.link[at]
                if new is None:
                    new = target
                else:
                    self.link[new] = target
            last = new

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint hit ranges of word places, ordered, and the items whose windows occur."""
        window, following, link, length, chain = self.window, self.next, self.link, self.length, self.chain
        state = run = 0
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[int] = set()
        ids = self.ids
        for i, word in enumerate(map(ids.get, text)):
            if word is None:
                state = run = 0
                continue
            while state and word not in following[state]:
                state = link[state]
                run = length[state]
            state = following[state].get(word, 0)
            if not state:
                run = 0
                continue
            run += 1
            reach = 0
            if run >= window:
                reach = window
                states.add(state)
            if chain[state]:
                for n, k in chain[state]:
                    if n <= run:
                        found.add(k)
                        reach = max(reach, n)
            if reach:
                first = i - reach + 1
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        for state in states:
            while length[link[state]] >= window:
                state = link[state]
            found |= self.items[state]
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


_CACHE: dict[tuple, Automaton] = {}


@dataclass(frozen=True)
class Group:
    """Items of one automaton: a broadcast of bounded size, and a name by which a worker tells groups apart."""

    items: Broadcast
    name: str


def automaton(group: Group, window: int) -> Automaton:
    """Built once a worker process; only the latest is kept."""
    if (key := (group.name, window)) not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Automaton(group.items.value, window)
    return _CACHE[key]


def item_groups(benchmark: DataFrame, most_words: int = AUTOMATON_WORDS) -> list[Group]:
    """The benchmark's items in groups of about most_words words, by the hash of their text.

    The benchmark is scanned once, to the shared folder; the driver holds one group at a time, of bounded size.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    items = common.written(items, "items")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    groups = 1 + total // (5 * most_words)
    if groups > 1:
        dealt = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(groups))).repartition("part").sortWithinPartitions("part")
        items = common.written(dealt, "items")  # a group is found by its files' statistics
    out, context = [], benchmark.sparkSession.sparkContext
    for k in range(groups):
        rows = (items.filter(F.col("part") == k) if groups > 1 else items).select("item_id", "text").collect()
        own = sorted(((r["item_id"], r["text"].encode()) for r in rows), key=lambda x: (x[0] or "", x[1]))
        out.append(Group(context.broadcast(own), uuid.uuid4().hex))
    return out


def _merged_with(own: list[tuple[int, int]], old: list[int] | None) -> list[int]:
    """Hit ranges of this group and of those before it, flat."""
    return [x for span in merged(own + list(zip(old[::2], old[1::2], strict=True)) if old else own) for x in span]


def matched(docs: DataFrame, benchmark: DataFrame, window: int, schema: T.StructType, finish: Callable) -> DataFrame:
    """finish(batch, texts, spans, items) of all documents, in the pass that matches the last group of items.

    spans are the first and end words of a text's hit ranges (flat), items the ids of the items found. Groups before the
    last hand theirs on in two columns.
    """
    names = common.unused(docs, "_spans"), common.unused(docs, "_items")
    handed = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.LongType())), T.StructField(names[1], T.ArrayType(T.StringType()))])
    groups = item_groups(benchmark)
    place, out = docs.columns.index("text"), docs
    for k, group in enumerate(groups):

        def start(group=group, first=k == 0, last=k == len(groups) - 1):
            built = automaton(group, window)

            def step(batch):
                texts = batch.column(place).cast(pa.binary()).to_pylist()
                before = [[None] * batch.num_rows] * 2 if first else [c.to_pylist() for c in batch.columns[-2:]]
                spans, found = [], []
                for text, old, listed in zip(texts, *before, strict=True):
                    own, of = built.match(words(text))
                    spans.append(_merged_with(own, old))
                    found.append(sorted({built.names[k] for k in of if built.names[k] is not None} | set(listed or ())))
                kept = batch.columns if first else batch.columns[:-2]
                if last:
                    return finish(kept, texts, spans, found)
                return [*kept, pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]

            return step

        out = common.arrow_map(out, schema if k == len(groups) - 1 else handed, start)
    return out


def covered(spans: list[int]) -> int:
    return sum(spans[1::2]) - sum(spans[::2])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def finish(columns, texts, spans, items):
        hits = [covered(s) for s in spans]
        digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
        return [columns[0], [len(words(t)) for t in texts], hits, [len(i) for i in items], digests, [h > 0 for h in hits]]

    ddl = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return matched(common.id_and_text(docs), benchmark, window, T.StructType.fromDDL(ddl), finish)


def without(text: bytes, spans: list[int]) -> bytes:
    """text without the words in spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(TABLE))]
    parts, at = [], 0
    for first, end in zip(spans[::2], spans[1::2], strict=True):
        parts.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*parts, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_covered: float = 0.5) -> DataFrame:
    """docs without the hit words; documents with more than most_covered of their words hit go.

    All columns stay; n_chars, if there, follows a changed text.
    """
    names = docs.columns

    def finish(columns, texts, spans, items):
        columns, keep, changed, lengths = list(columns), [], [], []
        for text, hit in zip(texts, spans, strict=True):
            keep.append(not hit or covered(hit) <= most_covered * len(words(text)))
            new = (without(text, hit) if hit and keep[-1] else text or b"").decode("utf-8", "replace")
            changed.append(None if text is None else new)
            lengths.append(len(new) if hit else None)
        columns[names.index("text")] = pa.array(changed, columns[names.index("text")].type)
        if "n_chars" in names:
            old = columns[names.index("n_chars")]
            columns[names.index("n_chars")] = pa.compute.coalesce(pa.array(lengths, pa.int64()).cast(old.type), old)
        mask = pa.array(keep, pa.bool_())
        return [c.filter(mask) for c in columns]

    return matched(docs, benchmark, window, docs.schema, finish)
