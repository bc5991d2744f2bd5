"""A one-hash Bloom filter, sized from the number of its values and built by Spark in segments. It only spares work:
what passes by chance is found out by an exact join later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits are a power of two, sixteen for each value or more, between these (the upper one is 128 MB, the bound of what is
#: broadcast; beyond some 10^8 values more and more passes, and the join that follows has more to do).
LEAST, MOST = 20, 30
_SEGMENT = 16


def bits_for(values: int) -> int:
    return min(MOST, max(LEAST, (16 * values - 1).bit_length()))


def build(rows: DataFrame, column: str, parts: int) -> np.ndarray:
    """Packed bits; the bit of a value from 0 to 2^63 - 1 is at its leading bits. ``rows`` is read twice."""
    bits = bits_for(rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False) >> (63 - bits)
            segment = at >> _SEGMENT
            for s in np.unique(segment):
                got.setdefault(int(s), np.zeros(1 << _SEGMENT, bool))[at[segment == s] & ((1 << _SEGMENT) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([np.packbits(x).tobytes() for x in got.values()], pa.binary())], ["segment", "bits"])

    keyed = rows.select(column).repartition(parts, F.shiftright(F.col(column), 63 - bits + _SEGMENT))
    out = np.zeros((1 << (bits - _SEGMENT), (1 << _SEGMENT) // 8), np.uint8)
    for r in keyed.mapInArrow(run, "segment long, bits binary").collect():
        out[r["segment"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def passes(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values >> (63 - (8 * len(packed) - 1).bit_length())
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
