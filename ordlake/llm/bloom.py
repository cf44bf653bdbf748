"""Bloom filters over 64-bit hashes that are built by all tasks, saturate at two, and are broadcast.

A filter has a bound: beyond it more keys are let through, and whatever uses it stays exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bits of the filter for each row, hash functions, and the bound of the filter that is broadcast. Beyond the bound
#: (about 33 million rows; a task that builds it holds 128 MB, one that asks it 64 MB) more rows are found possibly repeated and shuffled; results stay exact.
BITS_PER_ROW, HASHES, MAX_BITS = 16, 4, 1 << 29
#: Bytes of a segment; tasks send the segments they touched, compressed.
SEGMENT = 1 << 14


def _positions(h: np.ndarray, n_bits: int) -> np.ndarray:
    """HASHES bit positions of each 64-bit hash, by double hashing."""
    h = h.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) % np.uint64(n_bits)).astype(np.int64) for i in range(HASHES)], axis=1)


def _pack(once: np.ndarray, twice: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for s in range(0, len(once), SEGMENT):
        o, t = once[s : s + SEGMENT], twice[s : s + SEGMENT]
        if o.any():
            yield s // SEGMENT, zlib.compress(o.tobytes() + t.tobytes(), 1)


def _set(bits: np.ndarray, positions: np.ndarray) -> None:
    np.bitwise_or.at(bits, positions >> 3, np.left_shift(1, positions & 7).astype(np.uint8))


def _get(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bits[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1


def seen_filter(hashes: DataFrame, n_rows: int, times: int) -> bytes:
    """Bits of all positions that at least one or two (times) rows of the one-column table of hashes set."""
    n_bits = 1 << max(17, min(MAX_BITS, BITS_PER_ROW * max(1, n_rows) - 1).bit_length())
    n_bits = min(n_bits, MAX_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            at, n = np.unique(_positions(batch.column(0).to_numpy(), n_bits).ravel(), return_counts=True)
            _set(twice, at[(n > 1) | _get(once, at)])
            _set(once, at)
        for segment, data in _pack(once, twice):
            yield pa.RecordBatch.from_pydict({"segment": [segment], "data": [data]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, np.uint8)
        for data in group["data"]:
            raw = np.frombuffer(zlib.decompress(data), np.uint8)
            o, t = raw[:SEGMENT], raw[SEGMENT:]
            twice |= t | (once & o)
            once |= o
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "data": [zlib.compress(once.tobytes() + twice.tobytes(), 1)]})

    parts = hashes.mapInArrow(fill, "segment long, data binary").withColumn("part", F.spark_partition_id() % 64)
    merged = parts.groupBy("segment", "part").applyInPandas(merge, "segment long, data binary")
    merged = merged.groupBy("segment").applyInPandas(merge, "segment long, data binary")
    bits = np.zeros(max(n_bits // 8, SEGMENT), np.uint8)
    for row in merged.toLocalIterator():
        bits[row.segment * SEGMENT :][:SEGMENT] = np.frombuffer(zlib.decompress(row.data), np.uint8)[(times - 1) * SEGMENT : times * SEGMENT]
    return bits[: n_bits // 8].tobytes()


def possibly_in(spark, bits: bytes):
    """A function of a hash column: false only where the hash surely was not seen (so often)."""
    shared, n_bits = spark.sparkContext.broadcast(bits), len(bits) * 8

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(_get(np.frombuffer(shared.value, np.uint8), _positions(h.to_numpy(), n_bits)).all(axis=1))

    return test
