"""A filter of fixed size over ids: a bitmap that has every id, and few others while it isn't full.

It keeps rows of long texts from a shuffle that an exact join would not keep: rows that the bitmap lacks have no partner, the
others are joined exactly. However many ids there are, the bitmap's size, and so what is broadcast, stays the same; a full
one passes every row, and the join alone decides. Results are the same either way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

#: The bitmap has 2 ** BITS bits in CHUNKS parts, and PROBES of them are set for an id.
BITS, CHUNKS, PROBES = 26, 16, 2
CHUNK = (1 << BITS) // CHUNKS


def probes(ids: np.ndarray) -> np.ndarray:
    """The bits of each id, a row a probe."""
    own = hashing.mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([(own >> np.uint64(64 - BITS)), (own & np.uint64((1 << BITS) - 1))])[:PROBES].astype(np.int64)


def packed(places: np.ndarray) -> bytes:
    """Sorted places in a chunk, by their distances."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def bitmap(ids: DataFrame, name: str) -> np.ndarray:
    """The bitmap of a column of ids, packed. Tasks' bitmaps are merged in parts, in two steps."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.unique(probes(batch.column(0).to_numpy(zero_copy_only=False))) for batch in batches if batch.num_rows]
        if own:
            places = np.unique(np.concatenate(own))
            edges = np.searchsorted(places, np.arange(CHUNKS + 1) * CHUNK)
            parts = [(k, places[edges[k] : edges[k + 1]] - k * CHUNK) for k in range(CHUNKS) if edges[k + 1] > edges[k]]
            salt = int(places.sum() % 64)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([packed(p) for _, p in parts], pa.binary())], ["chunk", "salt", "bits"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(CHUNK, bool)
        for batch in batches:
            for part in batch.column(batch.schema.get_field_index("bits")):
                bits[unpacked(part.as_py())] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([packed(np.flatnonzero(bits))], pa.binary())], ["chunk", "salt", "bits"])

    common.bounded_batches(ids.sparkSession)
    ddl = "chunk int, salt int, bits binary"
    own = ids.select(F.col(name).cast("long").alias("id")).filter("id is not null")
    out = np.zeros((CHUNKS, CHUNK // 8), np.uint8)
    for row in own.mapInArrow(build, ddl).groupBy("chunk", "salt").applyInArrow(merge, ddl).groupBy("chunk").applyInArrow(merge, ddl).collect():  # CHUNKS rows
        bits = np.zeros(CHUNK, bool)
        bits[unpacked(bytes(row["bits"]))] = True
        out[row["chunk"]] = np.packbits(bits)
    return out.reshape(-1)


def divided(docs: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose key may be among ids, and those whose key isn't (null keys with them)."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ids, name))
    names = docs.columns

    def rows(wanted: bool):
        def start():
            bits = sent.value

            def step(batch):
                column = batch.column(names.index(key)).cast(pa.int64())
                at = probes(column.fill_null(0).to_numpy(zero_copy_only=False))
                inside = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0) & column.is_valid().to_numpy(zero_copy_only=False)
                mask = pa.array(inside == wanted)
                return [c.filter(mask) for c in batch.columns]

            return step

        return common.arrow_map(docs, docs.schema, start, None)

    return rows(True), rows(False)
