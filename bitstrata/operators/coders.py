"""Lossless coding of exponent planes, one independent stream a tile.

A stream is inherently sequential; parallelism comes from tiles.  The model is a
table of integer frequencies per context, so encoder and decoder agree for any
batching, and its digest travels with the stream.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 15
CONTEXTS = 9
# Container tags and version.
MAGIC, HYBRID_MAGIC, VERSION = b"S4RC", b"S4HZ", 1


def write_container(header: dict, payload: bytes, magic: bytes = MAGIC) -> bytes:
    raw = json.dumps(header, sort_keys=True).encode()
    return magic + struct.pack("<II", VERSION, len(raw)) + raw + payload


def read_container(blob: bytes, magic: bytes = MAGIC) -> tuple[dict, bytes]:
    if blob[:4] != magic:
        raise ValueError(f"not a {magic.decode()} stream")
    version, size = struct.unpack_from("<II", blob, 4)
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    return json.loads(blob[12 : 12 + size]), blob[12 + size :]


def range_encode(lo: np.ndarray, width: np.ndarray) -> bytes:
    """Range coder over intervals out of 2 ** 15; bytes leave from the top, carries run back."""
    low, span, out = 0, 0xFFFFFFFF, bytearray()
    push = out.append
    for a, w in zip(lo.tolist(), width.tolist(), strict=True):
        unit = span >> BITS
        low += unit * a
        span = unit * w
        if low > 0xFFFFFFFF:
            low &= 0xFFFFFFFF
            i = len(out) - 1
            while out[i] == 255:
                out[i] = 0
                i -= 1
            out[i] += 1
        while span < 1 << 24:
            push(low >> 24)
            low = low << 8 & 0xFFFFFFFF
            span <<= 8
    # what is left of the interval holds a number that ends in three zero bytes, or needs one more
    end = low + span - 1
    for keep in (24, 16, 8, 0):
        code = end >> keep << keep
        if code >= low:
            break
    if code > 0xFFFFFFFF:
        code &= 0xFFFFFFFF
        i = len(out) - 1
        while out[i] == 255:
            out[i] = 0
            i -= 1
        out[i] += 1
    return bytes(out) + code.to_bytes(4, "big").rstrip(b"\0")


class RangeReader:
    """Reads what `range_encode` wrote; zeros follow the end."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.span = raw, 4, 0xFFFFFFFF
        self.code = int.from_bytes(raw[:4].ljust(4, b"\0"), "big")

    def next(self, find: list[int], lo: list[int], width: list[int]) -> int:
        unit = self.span >> BITS
        v = self.code // unit
        s = find[v if v < 1 << BITS else (1 << BITS) - 1]
        self.code -= unit * lo[s]
        self.span = unit * width[s]
        while self.span < 1 << 24:
            self.code = self.code << 8 | (self.raw[self.at] if self.at < len(self.raw) else 0)
            self.at += 1
            self.span <<= 8
        return s


def contexts(left: np.ndarray, up: np.ndarray) -> np.ndarray:
    d = left - up
    size = np.searchsorted([1, 2, 4, 9], np.abs(d), "right")
    return np.where(d < 0, 4 + size, size)


def plane_context(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prediction, context) of every cell of a tile; the tile's edge is the plane's edge."""
    e = plane.astype(np.int64)
    left, up, corner = np.zeros_like(e), np.zeros_like(e), np.zeros_like(e)
    left[1:], up[:, 1:], corner[1:, 1:] = e[:-1], e[:, :-1], e[:-1, :-1]
    pred = np.clip(left + up - corner, 0, 255)
    ctx = contexts(left, up)
    pred[0], pred[:, 0] = up[0], left[:, 0]
    ctx[0] = ctx[:, 0] = 0
    return pred, ctx


def table_digest(freq: np.ndarray) -> str:
    return hashlib.sha256(freq.astype("<i4").tobytes()).hexdigest()


def encode_plane(plane: np.ndarray, freq: np.ndarray) -> bytes:
    pred, ctx = plane_context(plane)
    sym = (plane.astype(np.int64) - pred) & 255
    lo = np.cumsum(freq, 1) - freq
    c, s = ctx.ravel(), sym.ravel()
    payload = range_encode(lo[c, s], freq[c, s])
    return write_container({"codec": "tile_range", "shape": list(plane.shape), "total_freq": 1 << BITS, "model_sha256": table_digest(freq)}, payload)


def decode_payload(payload: bytes, shape: tuple[int, int], freq: np.ndarray) -> np.ndarray:
    """A plane's cells in order, each in the context of those before."""
    h, w = shape
    lo = (np.cumsum(freq, 1) - freq).tolist()
    find = [np.repeat(np.arange(256), f).tolist() for f in freq]
    width = freq.tolist()
    reader, out = RangeReader(payload), np.zeros((h, w), np.int64)
    above = [0] * w
    for t in range(h):
        row: list[int] = []
        for s in range(w):
            left, up = above[s] if t else 0, row[s - 1] if s else 0
            if t and s:
                pred = min(255, max(0, left + up - above[s - 1]))
                d = left - up
                a = abs(d)
                ctx = (0 if a == 0 else 1 if a == 1 else 2 if a <= 3 else 3 if a <= 8 else 4) + (4 if d < 0 else 0)
            else:
                pred, ctx = left if t else up, 0
            row.append(pred + reader.next(find[ctx], lo[ctx], width[ctx]) & 255)
        out[t] = above = row
    return out


def decode_plane(blob: bytes, freq: np.ndarray) -> np.ndarray:
    header, payload = read_container(blob)
    if header["model_sha256"] != table_digest(freq):
        raise ValueError("the stream was made with another model")
    return decode_payload(payload, tuple(header["shape"]), freq)


def model_table(freq: DataFrame) -> np.ndarray:
    """(context, symbol, freq) rows as an array: contexts times symbols, whatever the data."""
    table = np.zeros((CONTEXTS, 256), np.int64)
    for r in freq.select("ctx", "symbol", "freq").collect():
        table[r.ctx, r.symbol] = r.freq
    table[table.sum(1) == 0] = (1 << BITS) // 256
    return table


def encode_tiles(exps: DataFrame, freq: np.ndarray, tile: tuple[int, int] = (64, 64)) -> DataFrame:
    """(p, t0, s0, n, blob): a stream for each tile of (p, t, s, e)."""
    shared = exps.sparkSession.sparkContext.broadcast(freq)
    h, w = tile

    def run(key, table):
        t, s, e = (table.column(c).to_numpy() for c in ("t", "s", "e"))
        t0, s0 = int(key[1].as_py()), int(key[2].as_py())
        plane = np.zeros((int(t.max()) - t0 + 1, int(s.max()) - s0 + 1), np.int64)
        if plane.size != len(e):
            raise ValueError("a tile has gaps")
        plane[t - t0, s - s0] = e
        return pa.table({"p": [key[0].as_py()], "t0": [t0], "s0": [s0], "n": [len(e)], "blob": [encode_plane(plane, shared.value)]}, schema=pa.schema([("p", pa.int32()), ("t0", pa.int32()), ("s0", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]))

    keyed = exps.select("p", "t", "s", "e", (F.col("t") - F.col("t") % h).alias("t0"), (F.col("s") - F.col("s") % w).alias("s0"))
    return keyed.groupBy("p", "t0", "s0").applyInArrow(run, "p int, t0 int, s0 int, n long, blob binary")


def decode_tiles(tiles: DataFrame, freq: np.ndarray) -> DataFrame:
    """(p, t, s, e) of every cell."""
    shared = tiles.sparkSession.sparkContext.broadcast(freq)

    def run(batches):
        for b in batches:
            for p, t0, s0, blob in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                e = decode_plane(blob, shared.value)
                t, s = np.indices(e.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(e.size, p), pa.int32()), pa.array((t + t0).ravel(), pa.int32()), pa.array((s + s0).ravel(), pa.int32()), pa.array(e.ravel(), pa.int32())], names=["p", "t", "s", "e"])

    return tiles.select("p", "t0", "s0", "blob").mapInArrow(run, "p int, t int, s int, e int")
