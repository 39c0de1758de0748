"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram's vector binds its letters' vectors, permuted by their
place, by elementwise product; a text's vector bundles (adds) those of its trigrams, a language's those of its texts. A
text gets the language whose prototype has the largest cosine with it.

Text is lower-cased, everything but letters becomes one space, and a space goes before and after. A letter's vector comes from
its code point alone, so every letter of every script has one of its own, and nothing is kept of letters once seen.

Training bundles as it reads: a task keeps one vector a language, whatever its texts; those are summed, and only languages x
dimensions numbers reach the driver.

accept() needs to tell a text in no learned language. The cosine of a text in a language grows with its letters n about as
expected(n) = sqrt(n / (n + HALF)), the share of a profile that a sample of n trigrams shows; that of a text in none varies
by noise = 1 / sqrt(dimensions). calibrated() takes, over all training texts, a low quantile a language of
(cosine + NOISES * noise) / expected(letters), which compares texts of any length; a share of it is the language's limit. A text
is accepted if its own ratio reaches that of its language.

Defined cases: null text, or text without a letter, is `und` with score 0; documents without lang, or with such text,
don't train; without any training text everything is `und`; ties go to the first language in alphabetical order; a null
doc_id counts as the empty text for the split; repeated rows give repeated results; empty tables are fine; other columns
are ignored by predict() and kept by accept(). Texts are read whole. More than LANGUAGES languages are an error: they are a
column of something else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, hashing

UNKNOWN = "und"
#: Trigrams of a step that are turned into vectors at once.
BLOCK = 4096
#: Trigram codes up to which a table of all of them is cheaper than sorting.
TABLE = 1 << 24
#: Letters at which a text's expected cosine with its language is sqrt(1 / 2).
HALF = 200
#: How many times the noise of an unrelated text's cosine is added before texts of different lengths are compared.
NOISES = 3
#: Languages, at most.
LANGUAGES = 10_000


@dataclass(frozen=True)
class Space:
    dimensions: int = 1024
    seed: int = 20240101


    @property
    def noise(self) -> float:
        return float(1 / np.sqrt(self.dimensions))


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """Of every code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray, space: Space) -> np.ndarray:
    """A vector of +1 and -1 a code point (0: the space), from a hash of the point and the seed."""
    words = -(-space.dimensions // 64)
    own = hashing.mix(hashing.mix(points.astype(np.uint64)[:, None] * np.uint64(hashing.BASE) + np.uint64(space.seed)) + np.arange(words, dtype=np.uint64))
    bits = np.unpackbits(hashing.mix(own).astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1, bitorder="little")
    return bits[:, : space.dimensions].astype(np.int8) * 2 - 1


@dataclass(frozen=True)
class Trigrams:
    """The trigrams of some texts: codes over the texts' own alphabet (the space is its first), and the text of each."""

    alphabet: np.ndarray
    codes: np.ndarray
    of: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes, and the place of each trigram's among them."""
        most = len(self.alphabet) ** 3
        if most > TABLE:
            return np.unique(self.codes, return_inverse=True)
        seen = np.zeros(most, bool)
        seen[self.codes] = True
        place = np.cumsum(seen, dtype=np.int32)
        return np.flatnonzero(seen), place[self.codes] - 1


def trigrams(texts: list[str]) -> Trigrams:
    """All trigrams of the texts. Texts without letters have none."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    points = np.where(is_letter()[points], points, 0)
    same = np.concatenate([[False], of[1:] == of[:-1]])
    keep = (points > 0) | ~(same & np.concatenate([[False], points[:-1] == 0]))
    points, of = points[keep], of[keep]
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    ids, size = place[points], len(alphabet)
    inside = (of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, bool)
    codes = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    return Trigrams(alphabet, codes[inside], of[2:][inside])


def bundled(found: Trigrams, groups: np.ndarray, count: int, space: Space) -> np.ndarray:
    """The sum of the trigrams' vectors by group; groups has each text's."""
    out = np.zeros((count, space.dimensions))
    own, size = letter_vectors(found.alphabet, space), len(found.alphabet)
    first, second = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1)
    present, where = found.distinct()
    group = groups[found.of]
    for at in range(0, len(present), BLOCK):
        block = present[at : at + BLOCK]
        mine = (where >= at) & (where < at + len(block)) if len(present) > BLOCK else slice(None)
        counts = np.bincount(group[mine].astype(np.int64) * len(block) + (where[mine] - at), minlength=count * len(block)).astype(np.float32).reshape(count, len(block))
        bound = first[block // (size * size)] * second[block // size % size] * own[block % size]
        out += counts @ bound.astype(np.float32)
    return out


def profiles(texts: list[str], space: Space) -> np.ndarray:
    """A bundled vector a text."""
    return bundled(trigrams(texts), np.arange(len(texts)), len(texts), space)


def letters(text: str) -> int:
    return int(np.count_nonzero(is_letter()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]))


def expected(n: int) -> float:
    return float(np.sqrt(n / (n + HALF)))


@dataclass(frozen=True)
class Model:
    space: Space
    languages: tuple[str, ...]
    prototypes: tuple[tuple[float, ...], ...]
    #: The least ratio (see above), a language; none without calibrated().
    limits: tuple[float, ...] = ()

    def ratio(self, cosine: float, letters: int) -> float:
        return (cosine + NOISES * self.space.noise) / expected(letters)

    def least(self, label: str) -> float:
        return self.limits[self.languages.index(label)] if self.limits else float("-inf")

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages or not texts:
            return labels, scores
        unit = np.array(self.prototypes)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        own = profiles([t or "" for t in texts], self.space)
        norms = np.linalg.norm(own, axis=1)
        cosine = own @ unit.T / np.maximum(norms, 1e-12)[:, None]
        for i in np.flatnonzero(norms > 0):
            best = int(cosine[i].argmax())
            labels[i], scores[i] = self.languages[best], float(min(1.0, max(0.0, cosine[i, best])))
        return labels, scores


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, space: Space = Space()) -> Model:
    """Prototypes of the languages of docs (text, lang), over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for unit in common.units(batches, "text"):
            langs = common.strings(unit, "lang")
            names = sorted(set(langs))
            own = bundled(trigrams(common.strings(unit, "text")), np.array([names.index(x) for x in langs]), len(names), space)
            for name, vector in zip(names, own, strict=True):
                sums[name] = sums.get(name, 0) + vector.astype(np.int64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "bundle"])

    common.bounded_batches(docs.sparkSession)
    used = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    parts = used.mapInArrow(run, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("place", "n"))
    summed = common.written(parts.groupBy("lang", "place").agg(F.sum("n").alias("n")), "prototypes")
    if summed.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    prototypes: dict[str, list[float]] = {}
    for row in summed.collect():
        prototypes.setdefault(row["lang"], [0.0] * space.dimensions)[row["place"]] = float(row["n"])
    languages = sorted(name for name, vector in prototypes.items() if any(vector))
    return Model(space, tuple(languages), tuple(tuple(prototypes[name]) for name in languages))


def calibrated(docs: DataFrame, model: Model, quantile: float = 0.01, share: float = 0.5) -> Model:
    """model with limits from its training documents docs (text, lang), over all rows that it gives their language.

    A language without such a row has the limit 0.
    """

    def start():
        def step(batch):
            texts, langs = common.strings(batch, "text"), common.strings(batch, "lang")
            found = [(own, model.ratio(score, letters(text))) for text, own, label, score in zip(texts, langs, *model.predict(texts), strict=True) if own == label != UNKNOWN]
            return list(map(list, zip(*found, strict=True))) if found else None

        return step

    used = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    ratios = common.arrow_map(used, "lang string, ratio double", start)
    rows = ratios.groupBy("lang").agg(F.percentile_approx("ratio", quantile, 10000).alias("q")).collect()  # learned languages only
    low = {r["lang"]: share * r["q"] for r in rows}
    return replace(model, limits=tuple(low.get(name, 0.0) for name in model.languages))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Only text is an input of the prediction."""

    def start():
        def step(batch):
            labels, scores = model.predict(common.strings(batch, "text"))
            return [batch.column(0), batch.column(1), labels, scores]

        return step

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return common.arrow_map(own, "doc_id long, held_out boolean, lang_pred string, score double", start)


def accept(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of languages (None: any learned one) and reaches its limit."""

    def accepted(text: str, label: str, score: float) -> bool:
        if label == UNKNOWN or (languages is not None and label not in languages):
            return False
        return model.ratio(score, letters(text)) >= model.least(label)

    def start():
        def step(batch):
            texts = common.strings(batch, "text")
            mask = pa.array([accepted(*x) for x in zip(texts, *model.predict(texts), strict=True)], pa.bool_())
            return [c.filter(mask) for c in batch.columns]

        return step

    return common.arrow_map(docs, docs.schema, start)
