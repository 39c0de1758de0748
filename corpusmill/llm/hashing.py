"""64-bit hashes of words and word n-grams, vectorised over a text's bytes.

Words are maximal runs of anything but space and U+0009 to U+000D, A-Z lower-cased. Hashes depend on nothing but the text.
"""

from __future__ import annotations

import re

import numpy as np

PIECE = 1 << 20
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
SPACE = re.compile(rb"[\x20\x09-\x0d]")
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
APART = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
BASE = 0x9E3779B97F4A7C15
#: Multipliers of an n-gram's words, by place.
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F], np.uint64)
#: BASE to the powers 1 to 1024, and 1024 times as far apart from 0 on.
LOW_POWERS = np.multiply.accumulate(np.full(1024, BASE, np.uint64))
HIGH_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(4 * PIECE // 1024, LOW_POWERS[-1])]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(text: bytes) -> np.ndarray:
    bytes_ = np.frombuffer(text, np.uint8)
    apart = APART[bytes_]
    inside = ~apart
    begins = inside.copy()
    begins[1:] &= apart[:-1]
    letters = LOWER[bytes_[inside]].astype(np.uint64)
    starts = np.flatnonzero(begins[inside])
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(letters)))
    places = np.arange(len(letters)) - np.repeat(starts, lengths)
    letters += np.uint64(1)
    letters *= LOW_POWERS[places & 1023]
    if lengths.max() > 1024:
        letters *= HIGH_POWERS[places >> 10]
    return mix(np.add.reduceat(letters, starts) + lengths.astype(np.uint64))


def _long(word: bytes) -> np.ndarray:
    """The hash of one word that is longer than a piece should be, piece by piece."""
    total, step = 0, pow(BASE, PIECE, 1 << 64)
    for at in range(len(word) - 1 - (len(word) - 1) % PIECE, -1, -PIECE):  # from the end: what follows is a piece further away
        letters = LOWER[np.frombuffer(word[at : at + PIECE], np.uint8)].astype(np.uint64) + np.uint64(1)
        places = np.arange(len(letters))
        total = (total * step + int((letters * LOW_POWERS[places & 1023] * HIGH_POWERS[places >> 10]).sum(dtype=np.uint64))) % (1 << 64)
    return mix(np.array([(total + len(word)) % (1 << 64)], np.uint64))


def words(text: bytes | None) -> np.ndarray:
    """The hash of every word, in order. Long texts are hashed in pieces that end between words, very long words in pieces."""
    if not text:
        return np.zeros(0, np.uint64)
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            found = SPACE.search(text, at + PIECE)
            end = found.end() if found else end
        if end - at > 3 * PIECE:
            first = 1 + max(at - 1, *(text.rfind(c, at, at + PIECE) for c in SPACES))
            last = found.start() if found else end
            parts += [_piece(text[at:first]), _long(text[first:last])]
            at = end
            continue
        parts.append(_piece(text[at:end]))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n-gram of words, in order; none if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, n, np.uint64)
    for k in range(n):
        total += hashes[k : k + count] * PLACES[k]
    return mix(total)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The distinct n-grams, ordered by hash; of fewer words the whole sequence is the one shingle."""
    own = words(text)
    return np.unique(ngrams(own, min(n, len(own)))) if len(own) else own
