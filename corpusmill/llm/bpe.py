"""Byte-level BPE encoding and decoding with a local tiktoken rank file.

A text is encoded as the tiktoken library would encode it whole: each match of the pre-split pattern by itself, without
special tokens. Long texts are cut at safe boundaries first, so that no call gets an unbounded text. Decoding works on raw
bytes and doesn't need the ids to be valid UTF-8 together.

Defined cases: null text is the empty text (no ids); a null doc_id is kept; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import common

#: Characters after which a cut is looked for, and the longest piece that the library's own splitter gets.
CUT, WHOLE = 100_000, 400_000
#: A white-space character after a letter or digit starts a match of its own: no match contains both.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])[ \n]")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def safe_parts(text: str, cut: int = CUT) -> list[str]:
    """text cut before white space that follows a letter or digit, each part of about cut characters."""
    if len(text) <= cut:
        return [text]
    parts, at = [], 0
    while len(text) - at > cut and (found := SAFE.search(text, at + cut)):
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def encode(text: str, codec: tiktoken.Encoding, pattern: str, cut: int = CUT, whole: int = WHOLE) -> list[int]:
    ids: list[int] = []
    for part in safe_parts(text, cut):
        if len(part) <= whole:
            ids += codec.encode_ordinary(part)
        else:  # no boundary for very long: split by the pattern here, match by match
            for found in splitter(pattern).finditer(part):
                ids += codec._core_bpe.encode_single_piece(found[0].encode())
    return ids


def digest_ids(ids: list[int]) -> str:
    return hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact (the decoded bytes equal the text), and ids if keep_ids."""

    def start():
        codec = encoding(path, pattern)

        def step(batch):
            out = [[], [], [], [], [], []]
            for doc, text in zip(common.strings(batch, "doc_id"), common.raw(batch, "text"), strict=True):
                text = text or b""
                ids = encode(text.decode("utf-8", "replace"), codec, pattern)
                decoded = codec.decode_bytes(ids)
                for column, value in zip(out, (doc, len(ids), digest_ids(ids), hashlib.sha256(decoded).hexdigest(), decoded == text, ids if keep_ids else None), strict=True):
                    column.append(value)
            return out if keep_ids else out[:5]

        return step

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * keep_ids
    return common.arrow_map(common.id_and_text(docs), ddl, start)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, content (the raw bytes) of rows with doc_id and ids; null ids: no bytes."""

    def start():
        codec = encoding(path, pattern)
        return lambda batch: [common.strings(batch, "doc_id"), [codec.decode_bytes(ids or []) for ids in common.strings(batch, "ids")]]

    return common.arrow_map(encoded.select("doc_id", "ids"), "doc_id long, content binary", start, None)
