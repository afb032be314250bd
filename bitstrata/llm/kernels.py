"""Vectorised text kernels on Arrow string buffers.

Everything here works on whole batches of UTF-8 bytes with numpy; no kernel
loops over words in Python.  Words are maximal runs of bytes other than the
six ASCII white-space characters, compared with A-Z lower-cased.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call works on; a longer single text is taken whole.
SLICE_BYTES = 1 << 18

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Bytes whose powers are at hand; longer stretches are hashed piece by piece.
_SPAN = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


_SALT = 0x2545F4914F6CDD1D
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def trim() -> None:
    """Gives memory that is free back to the system, which a worker that stays alive else keeps."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def trimming(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, with free memory given back after every batch that it reads, and at its end."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                trim()

        yield from run(read())
        trim()

    return trimmed


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) < 5)


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(rows, max(at + 1, to))
        yield at, to
        at = to


def pieces(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices of a column."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words bounds[d]:bounds[d+1] are those of text d."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~is_space(data)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_tables: list[np.ndarray] = []


def _tables_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of each."""
    if not _tables or len(_tables[0]) < n:
        size = min(_SPAN, max(1 << 15, 1 << (n - 1).bit_length()))
        _tables[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _tables[0], _tables[1]


def _long_span(data: np.ndarray) -> int:
    """Sum over a span of more than _SPAN bytes."""
    up, _ = _tables_of(_SPAN)
    total, factor = 0, 1
    for lo in range(0, len(data), _SPAN):
        part = _BYTE[data[lo : lo + _SPAN]]
        total = (total + factor * int(np.add.reduce(part * up[: len(part)], dtype=np.uint64))) & (2**64 - 1)
        factor = factor * pow(_BASE, _SPAN, 1 << 64) & (2**64 - 1)
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, as they are (lower-case the bytes before).

    A span's sum of byte values times powers of a base is the difference of two running sums,
    divided by the power at its start: odd numbers have inverses modulo 2 ** 64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    if (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        out[order] = span_hashes(data, starts[order], ends[order])
        return out
    lens, reach = ends - starts, np.maximum.accumulate(ends)
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        if lens[k] > _SPAN:
            out[k] = _long_span(data[lo : int(ends[k])])
            k += 1
            continue
        to = max(k + 1, int(np.searchsorted(reach, lo + _SPAN, "right")))
        hi = int(ends[k:to].max())
        up, down = _tables_of(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        out[k:to] = (total[ends[k:to] - lo] - total[starts[k:to] - lo]) * down[starts[k:to] - lo]
        k = to
    return mix64(out + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def chain_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` words in a row, one for each place where such a run can start: sums of
    words times powers of a base, by doubling the run's length."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, runs, done, total = 1, words, 0, None
    while True:
        if size & have:  # this many words more, after those that are done
            part = runs[done : done + n] * _U(pow(_BASE, done, 1 << 64)) if done else runs[:n]
            total = part if total is None else total + part
            done += have
        if 2 * have > size:
            break
        runs = runs[:-have] + runs[have:] * _U(pow(_BASE, have, 1 << 64))
        have *= 2
    return mix64(total + _U(size * _SALT & (2**64 - 1)))


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's shingles with repeats.  A text with fewer
    than `size` words has its whole sequence as its one shingle, an empty one none."""
    count = np.diff(bounds)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    first = np.ones(len(words), bool)  # places where a run starts
    for k in range(1, size):
        first[(bounds[1:] - k)[count >= k]] = False
    first[bounds[:-1][(count > 0) & (count < size)]] = True
    chain, out = chain_hashes(words, size), np.empty(out_bounds[-1], np.uint64)
    chain = chain[first[: len(chain)]]
    out[: len(chain)] = chain  # what lies after are short texts
    for n in range(1, size):
        if (short := np.flatnonzero(count == n)).size:
            own = words[bounds[short][:, None] + np.arange(n)]
            out[out_bounds[short]] = mix64(np.add.reduce(own * _powers(_BASE, n), 1, dtype=np.uint64) + _U(n * _SALT & (2**64 - 1)))
    return out, out_bounds


def distinct_in_rows(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, laid end to end, and their bounds."""
    n = np.diff(bounds)
    if len(n) > 1 and len(values) >= 48 * len(n):  # long rows: each sorted in its place
        values, edge = values.copy(), bounds.tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            values[a:b].sort()
        fresh = np.ones(len(values), bool)
        fresh[1:] = values[1:] != values[:-1]
        fresh[bounds[:-1][n > 0]] = True
        return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]
    if 1 < len(n) <= 1 << 16 and len(values) < 1024 * len(n):  # many short rows: sorted together, then dealt to their rows
        row = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        order = np.argsort(values)
        order = order[np.argsort(row[order], kind="stable")]
        values, row = values[order], row[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        return values[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(n)))])
    parts = [np.unique(values[a:b]) if b > a else values[:0] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of word-shingle hashes: sorted, laid end to end, with bounds."""
    starts, ends, bounds = word_spans(data, offsets)
    return distinct_in_rows(*shingles(span_hashes(lower(data), starts, ends), bounds, size))


@functools.cache
def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minmax_signatures(sets: np.ndarray, bounds: np.ndarray, n_perm: int, seed: int) -> np.ndarray:
    """(rows, 2 * n_perm) signatures: minimum and maximum of each row's set under
    each permutation.  Rows must not be empty."""
    a, b = permutations(n_perm, seed)
    low = (sets >> _U(32)).astype(np.uint32)
    out, y = np.empty((2 * n_perm, len(bounds) - 1), np.uint32), np.empty_like(low)
    for k in range(n_perm):
        np.multiply(low, a[k], out=y)
        np.add(y, b[k], out=y)
        np.minimum.reduceat(y, bounds[:-1], out=out[2 * k])
        np.maximum.reduceat(y, bounds[:-1], out=out[2 * k + 1])
    return out.T


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit keys; the band's number is part of its key."""
    n, width = signature.shape
    bands = width // rows
    total = np.empty((n, bands), np.uint64)
    total[:] = np.arange(1, bands + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)
    shaped = signature[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    for k in range(rows):
        total = mix64(total + shaped[:, :, k] * _PLACE[8 + k])
    return total


def row_fingerprints(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each row's set: of its hashes and of their squares' mix.
    Rows must not be empty."""
    square = sets * sets
    square ^= square >> _U(32)
    square *= sets | _U(1)
    return np.add.reduceat(sets, bounds[:-1]), np.add.reduceat(square, bounds[:-1])
