"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

Rules come first; the longest that fits decides. For the other urls one pass of the automaton counts vocabulary terms that
stand alone (no letter or digit of ASCII before or after): one strict term blocks, and so do two or more distinct soft terms
whose weights add up to the limit. The vocabulary is a table (term, weight; no weight: strict) of the user's or the default.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Terms are
looked for in the whole url, A-Z lower-cased.

Defined cases: a null url, or one without ://, has an empty host and path; a null url has no terms and is allowed. A null
page_id is kept; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: The default vocabulary.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "sexcam", "warez", "keygen")
SOFT = {"adult": 2, "sex": 2, "nude": 2, "escort": 2, "erotic": 2, "casino": 2, "poker": 1, "betting": 2, "viagra": 2, "cialis": 2, "torrent": 1, "crack": 1, "dating": 1, "loan": 1}
#: The weight of distinct soft terms that blocks, and the terms of a vocabulary table, at most.
LIMIT, TERMS = 3, 1_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


def parts(url: str | None) -> tuple[str, str]:
    found = PARTS.search(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def vocabulary(strict: tuple[str, ...], soft: dict[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in strict))
    found.make_automaton()
    return found


def listed(table: DataFrame) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict terms and weighted soft ones of a table (term, weight), A-Z lower-cased; a null weight makes a term strict."""
    rows = table.select(F.translate(F.col("term").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term"), F.col("weight").cast("int").alias("weight")).filter("term <> ''").limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError(f"more than {TERMS} terms")
    strict = {r["term"] for r in rows if r["weight"] is None}
    soft: dict[str, int] = {}
    for r in rows:
        if r["term"] not in strict:
            soft[r["term"]] = max(r["weight"], soft.get(r["term"], r["weight"]))
    return tuple(sorted(strict)), soft


def terms(url: str, found: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand alone in url (lower-cased)."""
    strict, soft = set(), set()
    for end, (term, is_strict) in found.iter(url):
        first = end - len(term) + 1
        if (first == 0 or url[first - 1] not in EDGE) and (end + 1 == len(url) or url[end + 1] not in EDGE):
            (strict if is_strict else soft).add(term)
    return strict, soft


def judge(pages: DataFrame, rules: list[Rule], strict: tuple[str, ...] = STRICT, soft: dict[str, int] = SOFT, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft (distinct terms)."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def start():
        automaton = vocabulary(strict, soft)

        def step(batch):
            out = [[] for _ in range(7)]
            for page, url in zip(common.strings(batch, "page_id"), common.strings(batch, "url"), strict=True):
                host, path = parts(url)
                rule = next((r for r in ordered if r.fits(host, path)), None)
                hard, mild = terms((url or "").translate(UPPER), automaton)
                verdict = rule.verdict if rule else "block" if hard or len(mild) > 1 and sum(soft[t] for t in mild) >= limit else "allow"
                for column, value in zip(out, (page, host, path, rule.name if rule else None, verdict, len(hard), len(mild)), strict=True):
                    column.append(value)
            return out

        return step

    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return common.arrow_map(urls, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long", start, "url")
