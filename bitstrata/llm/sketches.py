"""Bloom filters and count sketches of fixed size.

Both are built in two steps (per task, then per segment), so what reaches the
driver, and what is broadcast, has a size set by a parameter and never by the
data.  A full sketch only costs work later: a Bloom filter has no false
negatives and a count is never too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitstrata.llm import kernels as K

BLOOM_BITS = (1 << 20, 1 << 30)
COUNT_CELLS = (1 << 18, 1 << 24)
_SEGMENT = 1 << 16  # bytes of a bit map, or cells of a count table
_U = np.uint64


def bits_for(n: int) -> int:
    """At least ten bits an element, within BLOOM_BITS: 128 MB at the most."""
    return min(BLOOM_BITS[1], max(BLOOM_BITS[0], 1 << (10 * n).bit_length()))


def cells_for(n: int) -> int:
    """About four cells a value, within COUNT_CELLS: 64 MB at the most."""
    return min(COUNT_CELLS[1], max(COUNT_CELLS[0], 1 << (4 * n).bit_length()))


def _bits(ids: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    h = K.mix64(ids.astype(np.int64).view(np.uint64))
    step = K.mix64(h + _U(0x632BE59BD9B4E019)) | _U(1)
    for k in range(3):
        yield ((h + step * _U(k)) & _U(n_bits - 1)).astype(np.int64)


def might_hold(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for at in _bits(ids, len(bitmap) * 8):
        ok &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return ok


def bloom(df: DataFrame, column: str, n_bits: int) -> np.ndarray:
    """Bit map (n_bits / 8 bytes) of an integer column; nulls are left out."""

    def fill(batches):
        bitmap = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            for at in _bits(batch.column(0).drop_null().to_numpy(), n_bits):
                np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from _segments(bitmap, _SEGMENT)

    def merge(key, table):
        out = np.zeros(0, np.uint8)
        for raw in table.column("part"):
            part = np.frombuffer(raw.as_py(), np.uint8)
            out = part.copy() if not len(out) else out | part
        return pa.table({"segment": [key[0].as_py()], "part": [out.tobytes()]}, schema=_SCHEMA)

    return _gather(df.select(column), fill, merge, n_bits // 8, np.uint8)


def parted(docs: DataFrame, ids: Column, found: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of `found`'s ids, rows that have none): the first are to be joined, the
    second, and their texts, need no shuffle.  Null ids are among the second.  Only ids go to Python."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bloom(found, column, bits_for(found.count())))

    @F.arrow_udf("boolean")
    def may_be(x: pa.Array) -> pa.Array:
        return pa.array(might_hold(shared.value, x.fill_null(0).to_numpy(zero_copy_only=False)) & x.is_valid().to_numpy(zero_copy_only=False))

    flag = may_be(ids)
    return docs.filter(flag), docs.filter(~flag)


def _slots(hashes: np.ndarray, cells: int) -> np.ndarray:
    return ((hashes * _U(0x9E3779B97F4A7C15)) >> _U(64 - cells.bit_length() + 1)).astype(np.int64)


def levels(df: DataFrame, column: str, number: str, cells: int) -> np.ndarray:
    """Table of the binary logarithms (floors) of the keys' numbers, the largest of a cell's."""

    def fill(batches):
        table = np.zeros(cells, np.uint8)
        for batch in batches:
            keys, n = (batch.column(c).to_numpy() for c in (0, 1))
            np.maximum.at(table, _slots(keys.view(np.uint64), cells), (np.frexp(n.astype(np.float64))[1] - 1).astype(np.uint8))
        yield from _segments(table, _SEGMENT)

    def merge(key, table):
        out = np.zeros(0, np.uint8)
        for raw in table.column("part"):
            part = np.frombuffer(raw.as_py(), np.uint8)
            out = part.copy() if not len(out) else np.maximum(out, part)
        return pa.table({"segment": [key[0].as_py()], "part": [out.tobytes()]}, schema=_SCHEMA)

    return _gather(df.select(column, number), fill, merge, cells, np.uint8)


def level(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[_slots(keys.view(np.uint64), len(table))].astype(np.int64)


def estimate(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Upper estimates of how often each hash was counted."""
    return table[((hashes * _U(0x9E3779B97F4A7C15)) >> _U(64 - int(len(table)).bit_length() + 1)).astype(np.int64)]


def counts(df: DataFrame, column: str, values, cells: int) -> np.ndarray:
    """Count table of the 64-bit hashes that `values` makes of a column, array by array."""

    def fill(batches):
        table = np.zeros(cells, np.int32)
        shift = _U(64 - cells.bit_length() + 1)
        for batch in batches:
            for x in values(batch.column(0)):
                slots, n = np.unique(((x * _U(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), return_counts=True)
                table[slots] = np.minimum(table[slots] + n, 2**31 - 1)
        yield from _segments(table, _SEGMENT)

    def merge(key, table):
        total = np.zeros(0, np.int64)
        for raw in table.column("part"):
            part = np.frombuffer(raw.as_py(), np.int32).astype(np.int64)
            total = part if not len(total) else total + part
        return pa.table({"segment": [key[0].as_py()], "part": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]}, schema=_SCHEMA)

    return _gather(df.select(column), fill, merge, cells, np.int32)


_SCHEMA = pa.schema([("segment", pa.int32()), ("part", pa.binary())])


def _segments(values: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(values), step):
        if values[k : k + step].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([values[k : k + step].tobytes()], pa.binary())], schema=_SCHEMA)


def _gather(df: DataFrame, fill, merge, length: int, dtype) -> np.ndarray:
    out = np.zeros(length, dtype)
    parts = df.mapInArrow(K.trimming(fill), "segment int, part binary").groupBy("segment").applyInArrow(merge, "segment int, part binary")
    # each part that comes to the driver is a job: some megabytes, not a few segments or none
    parts = parts.coalesce(max(1, length * out.itemsize >> 22))
    for row in parts.toLocalIterator():
        out[row.segment * _SEGMENT : row.segment * _SEGMENT + len(row.part) // out.itemsize] = np.frombuffer(bytes(row.part), dtype)
    return out
