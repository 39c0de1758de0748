"""Quality rules under weak supervision.

Each rule votes good (1) or bad (-1) or abstains (0) on a document. A document is good or bad; a rule objects to a share of the
good and a share of the bad, which expectation-maximisation estimates from how the rules agree over the whole corpus (Dawid and
Skene, 1979), with the share of good documents. A document is kept by its posterior probability of being good, not by passing
every rule: an objection of a rule that objects to many good documents counts little, abstentions count nothing.

Measures that see the same fault (two of repetition, both ends of word length) are one rule, which objects if one of them does:
rules are taken to be independent given the class. The model is fitted on documents within the base limits, as those are what it
decides about. Estimates are smoothed by pseudo-documents, a share of the corpus's size: as many as there are documents (TRUST)
say that a rule objects to ALARM of good ones, few (DOUBT) that it objects to half of bad ones. So what only one rule sees is
taken for a kind of bad documents if there is much of it, and for stray objections if there is little. Nothing else bounds
the estimates.

There are 3 ** len(RULES) vote patterns at most, whatever the corpus; only their counts reach the driver, and only their
probabilities are broadcast.

Words are maximal runs of anything but space and U+0009 to U+000D; texts are processed whole. Variety is the share of distinct
words in windows of WINDOW words, averaged, so that it doesn't depend on a text's length; shorter texts have none.

Defined cases: a null or wordless text has no words, fails the base limits and is not kept; a null doc_id is kept; repeated
rows give repeated results; documents that are all alike are good unless most rules object; a posterior of exactly the threshold
is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_closed_lines", "n_windows", "n_window_words")
#: Words of a window of variety.
WINDOW = 50
#: Pseudo-documents of good and of bad, as a share of all; and the share of good documents that rules are expected to object to.
TRUST, DOUBT, ALARM = 1.0, 0.003, 0.01


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    ids: dict[bytes, int] = {}
    places = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key, n = places[: len(places) - window + 1], len(ids)
    for k in range(1, window):
        key = key * n + places[k : len(places) - window + 1 + k]
        if k + 1 < window and n > 2_000_000 // 2:  # the next product wouldn't fit in 64 bits
            key = np.unique(key, return_inverse=True)[1]
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of a text."""
    words = text.split()
    seen: set[bytes] = set()
    duplicate = lines = closed = 0
    for line in text.split(b"\n"):
        if stripped := line.strip():
            lines += 1
            closed += stripped[-1:] in b".!?\"':;"
            duplicate += line in seen
            seen.add(line)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), duplicate, repeated_words(words),
        lines, upper, lower, closed, len(words) // WINDOW, sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words) - WINDOW + 1, WINDOW)),
    )


def measures(docs: DataFrame) -> DataFrame:
    def start():
        def step(batch):
            rows = [(doc, *measure(text or b"")) for doc, text in zip(common.strings(batch, "doc_id"), common.raw(batch, "text"), strict=True)]
            return [list(column) for column in zip(*rows, strict=True)] if rows else None

        return step

    return common.arrow_map(common.id_and_text(docs), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES), start)


@dataclass(frozen=True)
class Measure:
    """good and bad are bounds of value; a measure with good > bad takes high values for good. Null abstains."""

    value: str
    good: float
    bad: float

    def vote(self) -> Column:
        value = F.expr(self.value)
        good, bad = (value >= self.good, value < self.bad) if self.good > self.bad else (value <= self.good, value > self.bad)
        return F.coalesce(F.when(good, 1).when(bad, -1), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """Votes as the least of its measures: objects if one does, else abstains if one does."""

    name: str
    measures: tuple[Measure, ...]

    def vote(self) -> Column:
        votes = [m.vote() for m in self.measures]
        return F.least(*votes) if len(votes) > 1 else votes[0]


_LENGTH = "word_chars / nullif(n_words, 0)"
RULES = (
    Rule("word_length", (Measure(_LENGTH, 3, 2.2), Measure(_LENGTH, 10, 15))),
    Rule("symbols", (Measure("n_symbols / nullif(n_words, 0)", 0.1, 0.25),)),
    Rule("duplicate_lines", (Measure("n_dup_lines / nullif(n_lines, 0)", 0.1, 0.3),)),
    Rule("repetition", (Measure("n_repeat_words / nullif(n_words, 0)", 0.2, 0.4), Measure("n_window_words / nullif(50 * n_windows, 0)", 0.5, 0.3))),
    Rule("capitals", (Measure("n_upper / nullif(n_upper + n_lower, 0)", 0.2, 0.4),)),
    Rule("closed_lines", (Measure("n_closed_lines / nullif(n_lines, 0)", 0.5, 0.1),)),
)


@dataclass(frozen=True)
class Model:
    """The share of good documents; how often each rule, when it votes, objects to good and to bad ones."""

    good: float
    false_alarms: tuple[float, ...]
    catches: tuple[float, ...]


def posterior(model: Model, votes: np.ndarray) -> np.ndarray:
    """The probability of good for each row of votes; an abstention tells nothing."""
    bad, good = votes < 0, votes > 0
    log = [math.log(share) + bad @ np.log(objects) + good @ np.log1p(-np.array(objects)) for share, objects in ((model.good, model.false_alarms), (1 - model.good, model.catches))]
    return 1 / (1 + np.exp(log[1] - log[0]))


def fit(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 1000, tolerance: float = 1e-10) -> Model:
    """Expectation-maximisation from counts of vote patterns. It starts from documents with an objection as bad, by 0.9."""
    n = sum(patterns.values())
    ordered = sorted(patterns)
    votes, counts = np.array(ordered, float).reshape(len(ordered), rules), np.array([patterns[p] for p in ordered], float)
    bad, cast = (votes < 0).astype(float), (votes != 0).astype(float)
    trust, doubt = TRUST * max(n, 1), DOUBT * max(n, 1)
    good = np.where(bad.any(axis=1), 0.1, 0.9)
    model = None
    for _ in range(rounds):
        well, ill = good * counts, (1 - good) * counts
        share = float((well.sum() + 0.9 * doubt) / (n + doubt)) if n else 0.9
        alarms = (well @ bad + ALARM * trust) / (well @ cast + trust)
        catches = (ill @ bad + 0.5 * doubt) / (ill @ cast + doubt)
        moved = math.inf if model is None else max(abs(share - model.good), np.abs(alarms - model.false_alarms).max(), np.abs(catches - model.catches).max())
        model = Model(share, tuple(map(float, alarms)), tuple(map(float, catches)))
        if moved < tolerance:
            break
        good = posterior(model, votes)
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good.

    Base limits: at least 50 words, at most half of them in repeated 3-word windows.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = common.written(measures(docs).withColumns({f"v{k}": rule.vote() for k, rule in enumerate(rules)}).withColumn("base_failed", failed), "quality")
    votes = [f"v{k}" for k in range(len(rules))]
    found = [(tuple(int(r[v]) for v in votes), r["base_failed"], r["n"]) for r in voted.groupBy(*votes, "base_failed").agg(F.count(F.lit(1)).alias("n")).collect()]
    model = fit({p: n for p, failed, n in found if not failed}, len(rules))
    patterns = sorted({p for p, _, _ in found})
    good = posterior(model, np.array(patterns, float).reshape(len(patterns), len(rules)))
    table = voted.sparkSession.createDataFrame([(*p, float(x)) for p, x in zip(patterns, good, strict=True)], ", ".join(f"{v} int" for v in votes) + ", p_good double")
    return voted.join(F.broadcast(table), votes).select("doc_id", *MEASURES[:5], "base_failed", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good")
