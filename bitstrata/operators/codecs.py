"""Byte codecs by name, each lossless, and their comparison."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(raw: bytes, keep: int = 3) -> bytes:
    """The first `keep` bytes, then differences modulo 256."""
    x = np.frombuffer(raw, np.uint8)
    d = x.copy()
    d[keep:] = x[keep:] - x[keep - 1 : -1] if len(x) > keep else x[keep:]
    return d.tobytes()


def undelta(raw: bytes, keep: int = 3) -> bytes:
    x = np.frombuffer(raw, np.uint8).copy()
    if len(x) > keep:
        x[keep - 1 :] = np.cumsum(x[keep - 1 :], dtype=np.uint8)
    return x.tobytes()


def run_length(raw: bytes) -> bytes:
    """Runs of three and more, and every 255, as (255, byte, length); other bytes as they are."""
    x = np.frombuffer(raw, np.uint8)
    if not len(x):
        return b""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(np.concatenate([first, [len(x)]]))
    out, done = bytearray(), 0
    some = np.flatnonzero((size >= 3) | (x[first] == 255))
    for at, n in zip(first[some].tolist(), size[some].tolist(), strict=True):
        out += raw[done:at]
        done, b = at + n, raw[at]
        while n >= 3 or (n and b == 255):
            k = min(n, 255)
            out += bytes((255, b, k))
            n -= k
        out += bytes([b]) * n
    return bytes(out + raw[done:])


def un_run_length(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while (at := raw.find(255, i)) >= 0:
        out += raw[i:at]
        out += raw[at + 1 : at + 2] * raw[at + 2]
        i = at + 3
    return bytes(out + raw[i:])


WINDOW, SHORTEST, LONGEST, CHAIN = 32768, 3, 255, 8
#: Bytes whose matches are sought at once (some 150 bytes of intermediates each), and bytes of rows that are coded at once.
STRETCH, ROWS_BYTES = 1 << 18, 1 << 22


def _matches(x: np.ndarray, bounds: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of the longest match before each place, of the `chain` nearest places
    with the same three bytes, inside the same text and the window; the nearest wins ties."""
    n = len(x)
    best, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < SHORTEST:
        return best, far
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = np.minimum(bounds[1:][text] - np.arange(n), LONGEST)  # bytes that a match can have
    grown = np.concatenate([x, np.zeros(LONGEST + 8, np.uint8)]).astype(np.uint64)
    eight = grown[: n + LONGEST].copy()  # eight bytes from each place on
    for k in range(1, 8):
        eight |= grown[k : n + LONGEST + k] << np.uint64(8 * k)
    key = (text.astype(np.uint64) << np.uint64(24)) | (eight[:n] & np.uint64(0xFFFFFF))
    order = np.argsort(key, kind="stable")
    prev = np.full(n, -1)
    same = key[order[1:]] == key[order[:-1]]
    prev[order[1:][same]] = order[:-1][same]
    live = np.flatnonzero((prev >= 0) & (left >= SHORTEST))
    at = prev[live]
    for _ in range(chain):
        near = live - at < WINDOW
        live, at = live[near], at[near]
        if not len(live):
            break
        length, open_ = np.zeros(len(live), np.int64), np.arange(len(live))
        while len(open_):
            i, j, k = live[open_], at[open_], length[open_]
            differ = eight[i + k] ^ eight[j + k]
            # equal bytes from the lowest: those below the lowest bit that differs
            low = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
            length[open_] = k + equal
            open_ = open_[(equal == 8) & (k + 8 < left[i])]
        length = np.minimum(length, left[live])
        better = length > best[live]
        best[live[better]], far[live[better]] = length[better], (live - at)[better]
        more = (prev[at] >= 0) & (best[live] < left[live])
        live, at = live[more], prev[at[more]]
    return best, far


def _tokens(best: np.ndarray, far: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The tokens that start at the places `at`, and where each begins and the last ends."""
    copies = best[at] >= SHORTEST if len(at) else np.zeros(0, bool)
    end = np.concatenate([[0], np.cumsum(np.where(copies, 4, 2))]).astype(np.int64)
    out = np.zeros(int(end[-1]), np.uint8)
    lone, many = end[:-1][~copies], end[:-1][copies]
    out[lone + 1] = x[at[~copies]]
    out[many], out[many + 1], out[many + 2], out[many + 3] = 1, far[at[copies]] >> 8, far[at[copies]] & 255, best[at[copies]]
    return out.tobytes(), end


def _together(texts: list[bytes], chain: int) -> list[bytes]:
    """Texts of a stretch at most: matches of all of them are found together."""
    diffs = [delta(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in diffs])]).astype(np.int64)
    x = np.frombuffer(b"".join(diffs), np.uint8)
    best, far = _matches(x, bounds, chain)
    jump, places, starts = (np.arange(len(x)) + np.where(best >= SHORTEST, best, 1)).tolist(), [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        starts.append(len(places))
        while a < b:
            places.append(a)
            a = jump[a]
    raw, end = _tokens(best, far, x, np.array(places, np.int64))
    edge = end[np.array([*starts, len(places)], np.int64)].tolist()
    return [zlib.compress(raw[a:b], 6) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _stretched(text: bytes, chain: int) -> bytes:
    """A longer text, stretch by stretch; each sees the window before it and the longest match
    beyond it, so its matches are those of the whole."""
    x, out, packer, at = np.frombuffer(delta(text), np.uint8), [], zlib.compressobj(6), 0
    for lo in range(0, len(x), STRETCH):
        hi, a = min(len(x), lo + STRETCH), max(0, lo - WINDOW)
        part = x[a : hi + LONGEST]
        best, far = _matches(part, np.array([0, len(part)]), chain)
        step, places = np.where(best >= SHORTEST, best, 1).tolist(), []
        while at < hi:
            places.append(at - a)
            at += step[at - a]
        out.append(packer.compress(_tokens(best, far, part, np.array(places, np.int64))[0]))
    return b"".join([*out, packer.flush()])


def _groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of `limit` bytes at most, or of one row."""
    lo = total = 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > limit:
            yield lo, k
            lo, total = k, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def match_copy_many(texts: list[bytes], chain: int = CHAIN) -> list[bytes]:
    """Each text as a deflated stream of (0, byte) and (1, distance, length) tokens over its byte
    differences.  Memory is that of a stretch, however many or long the texts."""
    out: list[bytes] = []
    for a, b in _groups([len(t) for t in texts], STRETCH):
        out += [_stretched(texts[a], chain)] if b == a + 1 and len(texts[a]) > STRETCH else _together(texts[a:b], chain)
    return out


def match_copy(raw: bytes, chain: int = CHAIN) -> bytes:
    return match_copy_many([raw], chain)[0]


def un_match_copy(raw: bytes) -> bytes:
    tokens, out, i, size = zlib.decompress(raw), bytearray(), 0, 0
    while i < len(tokens):
        if tokens[i]:
            back, n = tokens[i + 1] << 8 | tokens[i + 2], tokens[i + 3]
            part = out[size - back : size - back + n]
            while len(part) < n:
                part += part[: n - len(part)]
            out += part
            size += n
            i += 4
        else:
            out.append(tokens[i + 1])
            size += 1
            i += 2
    return undelta(bytes(out))


def _zstd(level: int) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    made: list = []  # a worker's own pair, not sent along

    def both():
        if not made:
            import zstandard

            made[:] = [zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()]
        return made

    return lambda raw: both()[0].compress(raw), lambda raw: both()[1].decompress(raw)


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "lz77": (match_copy, un_match_copy),
    "deflate": (zlib.compress, zlib.decompress),
    "rle": (run_length, un_run_length),
    "zlib1": (lambda b: zlib.compress(b, 1), zlib.decompress),
    "xz": (lambda b: lzma.compress(b, preset=6), lzma.decompress),
    "zstd3": _zstd(3),
    "zstd9": _zstd(9),
}


def compare(rows: DataFrame, data: str, names: tuple[str, ...] = ("lz77", "deflate", "rle", "zstd9")) -> DataFrame:
    """(codec, original, compressed, verified, ratio, saving) over all rows of a binary column.

    Rows are coded by all codecs in one pass, a few megabytes at a time; every codec is read back."""

    def run(batches):
        for b in batches:
            column = b.column(0)
            for lo, hi in _groups(pc.fill_null(pc.binary_length(column), 0).to_pylist(), ROWS_BYTES):
                raw = [x or b"" for x in column.slice(lo, hi - lo).to_pylist()]
                for name in names:
                    pack, unpack = CODECS[name]
                    packed = match_copy_many(raw) if pack is match_copy else [pack(x) for x in raw]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(raw)), pa.array([len(x) for x in raw], pa.int64()), pa.array([len(x) for x in packed], pa.int64()), pa.array([unpack(y) == x for x, y in zip(raw, packed, strict=True)])], names=["codec", "original", "compressed", "ok"])

    rows, wide = rows.select(data), rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < wide:  # coding costs far more than the shuffle of an input this small
        rows = rows.repartition(wide)
    x = rows.mapInArrow(run, "codec string, original long, compressed long, ok boolean")
    s = x.groupBy("codec").agg(F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.every("ok").alias("verified"))
    return s.withColumn("ratio", F.round(F.col("original") / F.greatest("compressed", F.lit(1)), 2)).withColumn("saving", F.round((1 - F.col("compressed") / F.greatest("original", F.lit(1))) * 100, 1))
