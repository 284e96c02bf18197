"""Filters of a fixed size, built on the executors, that tell tasks which keys can be skipped."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix

#: Bits of a filter: what it holds is passed always, and what it doesn't mostly not. Its size is the same for any corpus.
FILTER_BITS, FILTER_PARTS = 25, 256
_PART = 1 << FILTER_BITS >> FILTER_PARTS.bit_length() - 1


def key_of(*columns: np.ndarray) -> np.ndarray:
    """A hash of rows of 64-bit values, by which filters know them."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix(out + c.view(np.uint64))
    return out


def key_filter(rows: DataFrame, names: list[str]):
    """The keys (long columns) of rows as a broadcast filter of 2 ** FILTER_BITS bits (4 MB), whatever the number of rows. It is put together on
    the executors, a part of its bits in a task; only the bits come to the driver."""

    def places(batches):
        for batch in batches:
            key = key_of(*[c.to_numpy(zero_copy_only=False) for c in batch.columns]) >> np.uint64(64 - FILTER_BITS)
            value = np.unique(key).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value % FILTER_PARTS), pa.array(value // FILTER_PARTS)], names=["part", "place"])

    def bits(rows):
        own = np.zeros(_PART, bool)
        own[rows["place"].to_numpy()] = True
        return rows.iloc[:1][["part"]].assign(bits=[np.packbits(own).tobytes()])

    found = rows.select(*names).mapInArrow(places, "part long, place long").distinct().groupBy("part").applyInPandas(bits, "part long, bits binary")
    whole = np.zeros((_PART, FILTER_PARTS), bool)
    for row in found.toLocalIterator():  # FILTER_PARTS rows
        whole[:, row["part"]] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))
    return rows.sparkSession.sparkContext.broadcast(np.packbits(whole.ravel()))


def holds(bits: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    at = (key_of(*columns) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
