"""Secret scans: pattern rules, and random strings told by their low characters-per-token ratio.

Text that a BPE vocabulary was made for takes few tokens; random strings take many. Every maximal run of key-like
characters, less what the rules found in it, whose ratio of characters to tokens is low becomes a finding, unless it is a known
digest (hexadecimal of a digest's length) or identifier (UUID), or has no letter. The findings of the rules are never changed
by the ratio test.

Spans are in code points, end exclusive, written kind:start:end, ordered by start and then kind as in KINDS.

Defined cases: null text is the empty text (no findings); a null doc_id is kept; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored by scan() and kept by redact(). Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import bpe, common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: A text without any of these (in lower case) has no assignment.
WORDS = ("passw", "secret", "token", "api")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LETTER = re.compile(r"[A-Za-z]")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))


@dataclass(frozen=True)
class Ratio:
    """Runs of least characters with letters, at most ratio characters a token, are random strings."""

    path: str
    pattern: str
    least: int = 20
    ratio: float = 1.9


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the rules' findings, ordered."""
    found = []
    lower = text.lower()
    if any(word in lower for word in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_known(run: str) -> bool:
    return not LETTER.search(run) or bool(UUID.fullmatch(run)) or len(run) in DIGEST_LENGTHS and bool(DIGEST.fullmatch(run))


def random_spans(text: str, codec: tiktoken.Encoding, rule: Ratio, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The ratio test's findings. taken (by start) and the runs are walked together, once; a run's stretches outside taken count each."""
    found = []
    at = passed = 0  # the next of taken, and the furthest end of those before it
    for m in RUN.finditer(text):
        first, end = m.span()
        open_ = []
        while at < len(taken) and taken[at][0] < end:
            if taken[at][0] > max(first, passed):
                open_.append((max(first, passed), taken[at][0]))
            passed = max(passed, taken[at][2])
            at += 1
        if end > max(first, passed):
            open_.append((max(first, passed), end))
        for start, stop in open_:
            run = text[start:stop]
            if len(run) >= rule.least and not is_known(run) and len(run) <= rule.ratio * len(bpe.encode(run, codec, rule.pattern)):
                found.append((start, 3, stop))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, rule: Ratio) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""

    def start():
        codec = bpe.encoding(rule.path, rule.pattern)

        def step(batch):
            out = [[] for _ in range(7)]
            for doc, text in zip(common.strings(batch, "doc_id"), common.strings(batch, "text"), strict=True):
                base = rule_spans(text or "")
                more = random_spans(text or "", codec, rule, base)
                kinds = [kind for _, kind, _ in base]
                row = (doc, *(kinds.count(k) for k in range(3)), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return step

    return common.arrow_map(common.id_and_text(docs), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", start)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """text with each stretch that spans cover, once, replaced by mask."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, rule: Ratio, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs; findings in text are replaced by mask, and n_chars, if there, follows the new text."""
    names = docs.columns

    def start():
        codec = bpe.encoding(rule.path, rule.pattern)

        def step(batch):
            texts, lengths = [], []
            for text in common.strings(batch, "text"):
                if text:
                    base = rule_spans(text)
                    if spans := sorted(base + random_spans(text, codec, rule, base)):
                        text = masked(text, spans, mask)
                        lengths.append(len(text))
                    else:
                        lengths.append(None)
                else:
                    lengths.append(None)
                texts.append(text)
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, columns[names.index("text")].type)
            if "n_chars" in names:
                old = columns[names.index("n_chars")]
                columns[names.index("n_chars")] = pa.compute.coalesce(pa.array(lengths, pa.int64()).cast(old.type), old)
            return columns

        return step

    return common.arrow_map(docs, docs.schema, start)
