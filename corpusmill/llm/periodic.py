"""Periodic runs: stretches of words that repeat with a period, found by masking and Main-Lorentz.

A run is a stretch of consecutive words with smallest period q and length >= max(least, times * q) that no neighbouring word
extends keeping period q. Words are maximal runs of anything but space and U+0009 to U+000D, as they are written.

Masking: in a run of length L and period q, words i and i + q are equal for L - q places in a row, so each of its words lies in a
k-gram that stands in the document twice, k being the least L - q that any period allows (5 for least 6 and times 4). Words
outside such k-grams can't join a run. k-grams are compared by hash: a collision lets a word through, it hides none. Of the
stretches of words left, those in which a k-gram stands again soon enough for a period go through Main and Lorentz's divide and conquer: a run either
lies in one half or crosses the middle, and the common extensions from the middle, by Z values, give all that cross it.

Work is a document's own: no shuffle, and what a task holds is one unit of texts.

Defined cases: null, empty and wordless texts have no words and no runs; rows are documents of their own, whatever their
doc_id (null ones too), and repeated rows give repeated results; ties go to the smallest start, then the smallest period; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, collapsed string"


@dataclass(frozen=True)
class Rule:
    """A run has at least least words and times periods."""

    least: int = 6
    times: int = 4

    def length(self, period: int) -> int:
        return max(self.least, self.times * period)

    @property
    def gram(self) -> int:
        """The least number of places at which a run agrees with itself one period on."""
        return min(self.length(q) - q for q in range(1, self.least + 1))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-gram, in order."""
    total, each = np.zeros(max(len(ids) - k + 1, 0), np.uint64), ids.astype(np.uint64)
    for i in range(k):
        total = total * np.uint64(hashing.BASE) + each[i : i + len(total)]
    return total


def distances(own: np.ndarray) -> np.ndarray:
    """How far on each k-gram stands next; more than any distance if it doesn't."""
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    out = np.full(len(own), np.iinfo(np.int64).max)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def segments(following: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """The stretches (start, end) of words inside k-grams that stand twice, by the distances of k-grams."""
    k, first = rule.gram, np.flatnonzero(following < len(following))
    at = np.union1d(first, first + following[first])
    steps = np.zeros(len(following) + k, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    inside = np.concatenate([[0], np.cumsum(steps)[: len(following) + k - 1] > 0, [0]]).astype(np.int8)
    edges = np.diff(inside)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def z_values(s: list[int], most: int) -> list[int]:
    """For each of the first most places, how many words from there on equal those from the start."""
    z, n = [0] * most, len(s)
    left = right = 0
    for i in range(1, most):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(ids: list[int], low: int, mid: int, high: int, most: int, rule: Rule) -> np.ndarray:
    """start, end, period (columns) of the stretches around mid, long enough for runs, whose words agree one of up to most places on."""
    u, v = ids[low:mid][::-1], ids[mid:high]
    right, left = min(most, len(v)), min(most, len(u))
    ahead = np.array([*z_values(v, min(right + 1, len(v))), 0])[1 : right + 1]
    behind = np.array([*z_values(u, min(left + 1, len(u))), 0])[1 : left + 1]
    back = np.array(z_values([*u, -1, *ids[low : mid + right][::-1]], len(u) + 1 + right)[: len(u) : -1])
    forth = np.array(z_values([*v, -1, *ids[mid - left : high]], len(v) + 1 + left)[: len(v) : -1])
    p, q = np.arange(1, right + 1), np.arange(1, left + 1)
    found = np.concatenate([np.stack([mid - back, mid + ahead + p, p]), np.stack([mid - q - behind, mid + forth, q])], axis=1)  # agreeing at mid and mid + p, at mid - q and mid
    return found[:, found[1] - found[0] >= np.maximum(rule.least, rule.times * found[2])]


def _farthest(own: np.ndarray, mid: int, most: int, k: int) -> int:
    """The greatest distance, up to most, at which a k-gram that has the words before or at mid stands again; 0 if none does."""
    far = 0
    for c in range(max(mid - k + 1, 0), min(mid + 1, len(own))):
        first = max(c - most, 0)
        far = max(far, *np.abs(np.flatnonzero(own[first : c + most + 1] == own[c]) + first - c)[[0, -1]].tolist())
    return far


def runs(ids: np.ndarray, rule: Rule = Rule()) -> list[tuple[int, int, int]]:
    """start, length, period of every run of a sequence of numbers, by start, then period.

    Inside a run of period c, other runs are shorter than c and their own period together (two periods of a longer stretch
    would be one), so halves that a run covers are searched for periods below c / (times - 1) only, and near the middle.
    """
    n, best, k = len(ids), {}, rule.gram
    own = _grams(ids, k)
    following = distances(own)
    if not len(own) or following.min() > n:
        return []
    todo = [(s, e, n * rule.times) for s, e in segments(following, rule)]
    whole = ids.tolist()
    while todo:
        low, high, cover = todo.pop()
        mid, most = (low + high) // 2, min((high - low) // rule.times, (cover - 1) // (rule.times - 1))
        if high - low < rule.least or following[low : high - k + 1].min() > most:
            continue  # no period is short enough, nor is one in its halves
        most = _farthest(own, mid, most, k)
        halves = [(low, mid, cover), (mid, high, cover)]
        if most:
            for s, e, p in _crossing(whole, max(low, mid - 2 * cover), mid, min(high, mid + 2 * cover), most, rule).T.tolist():
                if (s == 0 or whole[s - 1] != whole[s - 1 + p]) and (e == n or whole[e] != whole[e - p]):
                    best[s, e] = min(p, best.get((s, e), p))  # multiples of its period give the same stretch
                halves = [(a, b, min(c, p) if s <= a and b <= e else c) for a, b, c in halves]
        todo += [half for half in halves if half[2] >= rule.times]
    return sorted((s, e - s, p) for (s, e), p in best.items())


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; of equals the first."""
    top = None
    for run in found:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Of n words, those that no run has after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for s, length, p in found:
        steps[s + p] += 1
        steps[s + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def words(doc_id: int | None, text: bytes) -> list[bytes]:
    return text.split()


def scan(docs: DataFrame, rule: Rule = Rule(), words_of: Callable[[int | None, bytes], list[bytes]] = words) -> DataFrame:
    """FOUND, a row a row of docs: every run, the strongest one, and the text with the repetitions of runs collapsed."""

    def start():
        def step(batch):
            out = [[], [], [], [], [], [], []]
            for doc, text in zip(common.strings(batch, "doc_id"), common.raw(batch, "text"), strict=True):
                own = words_of(doc, text or b"")
                found = runs(numbered(own), rule)
                stay = np.flatnonzero(kept(len(own), found)).tolist() if found else range(len(own))
                listed = [{"start": s, "length": n, "period": p} for s, n, p in found]
                for column, value in zip(out, (doc, len(own), listed, *(strongest(found) or (None, None, None)), b" ".join([own[i] for i in stay]).decode("utf-8", "replace")), strict=True):
                    column.append(value)
            return out

        return step

    return common.arrow_map(common.id_and_text(docs), FOUND, start)


def digested(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run with its exponent in thousandths, and digests of the runs and the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    exponent = F.expr("(1000 * length) div period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
