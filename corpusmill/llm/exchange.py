"""Packed hashes for exchanges in which every n-gram of a corpus meets its like.

A row a hash would cost more than the text that it comes from. So the texts of a unit of work send one row a part of the hash
space: sorted hashes, by bucket, of which only the bytes below the bucket are stored. Parts are ranges of hashes; their number
follows the input's size, so that what one part gathers is bounded, whatever the corpus. Hashes are even, so parts are.

A unit is numbered by its task and its place in it; the rows that carry this number come from one evaluation of the texts (one
shuffle), so a lost executor can't mix units.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import common

#: Input bytes a part, by which parts are counted, and text bytes of a unit (at most an Arrow batch of them).
PART_BYTES, UNIT_BYTES, UNIT_ROWS = 16 << 20, 8 << 20, 16_384
BUCKET_BITS = 16


def parts_of(docs: DataFrame) -> int:
    """Parts for the n-grams of docs: at least one a shuffle partition, more for larger inputs."""
    return max(common.partitions(docs.sparkSession), -(-common.input_bytes(docs) // PART_BYTES))


@lru_cache(maxsize=8)
def bases(bits: int, parts: int) -> np.ndarray:
    """The least hash of each part."""
    return np.array([-(-(p << bits) // parts) for p in range(parts)], np.uint64)


def pack(values: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Of sorted hashes of so many bits, by part: part, first and end place, entries a bucket, the bytes below the bucket."""
    first = bases(bits, parts)
    rest = bits - BUCKET_BITS
    edges = np.append(np.searchsorted(values, first), len(values))
    for part in np.flatnonzero(np.diff(edges)).tolist():
        low, high = int(edges[part]), int(edges[part + 1])
        own = values[low:high] - first[part]
        sizes = np.bincount((own >> np.uint64(rest)).astype(np.int64))
        kept = np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : rest // 8])
        yield part, low, high, sizes.astype("<u4").tobytes(), kept.tobytes()


def unpack(part: int, bits: int, parts: int, buckets: bytes, rest: bytes) -> np.ndarray:
    width = (bits - BUCKET_BITS) // 8
    wide = np.zeros((len(rest) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(rest, np.uint8).reshape(len(wide), width)
    sizes = np.frombuffer(buckets, "<u4")
    bucket = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    return (wide.view("<u8").reshape(-1) | (bucket << np.uint64(bits - BUCKET_BITS))) + bases(bits, parts)[part]


def narrow(counts: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, 255 for those that follow as 64-bit numbers."""
    wide = counts[counts >= 255].astype("<i8")
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + wide.tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts
