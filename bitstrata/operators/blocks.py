"""Whole-volume codecs of exponents, one stream a block of profiles.

Three orders of the same model (predicted residuals in nine contexts, `coders.plane_context`):

- wavefront (`diag`): all cells with one t + s, of all profiles of a block, are coded in one
  step, a profile's cells dealt over its lanes; what a cell needs lies on earlier wavefronts;
- raster: one range-coded stream a profile, cell by cell, over a rectangle of traces or all;
- hybrid: the rectangle by raster, all that lies outside of it as plain bytes by zstd.

A block is what one task holds: `per_block` profiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitstrata.operators import coders, lanes

#: Cells a lane codes on average; its last state costs four bytes.
LANE_CELLS = 2048


def ordered(traces: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(p, t, lengths, values) of trace rows with their values' list, in order of (p, t), the
    values end to end.  Any trace may be absent and of any length; a trace given twice is an error."""
    traces = traces.select(["p", "t", column]).combine_chunks().sort_by([("p", "ascending"), ("t", "ascending")])
    p, t = (traces.column(c).to_numpy().astype(np.int32) for c in ("p", "t"))
    if ((p[1:] == p[:-1]) & (t[1:] == t[:-1])).any():
        raise ValueError("a block has a trace twice")
    lists = traces.column(column).combine_chunks()
    return p, t, lists.value_lengths().fill_null(0).to_numpy().astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def planes_of(traces: pa.Table, column: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first profile, trace numbers, (p, t, s) array) of the boxes that trace rows make: profiles
    in a row with the same traces, all of one length, are one box.  Empty traces are in none."""
    p, t, n, flat = ordered(traces, column)
    ends = np.cumsum(n)
    at = np.flatnonzero(n)
    cut = np.flatnonzero((p[at][1:] != p[at][:-1]) | (n[at][1:] != n[at][:-1])) + 1
    out: list[tuple[int, np.ndarray, list[np.ndarray]]] = []
    for rows in np.split(at, cut) if len(at) else []:
        own, a, b = t[rows], rows[0], rows[-1]
        plane = flat[ends[a] - n[a] : ends[b]].reshape(len(rows), -1)
        if out and out[-1][0] + len(out[-1][2]) == p[a] and np.array_equal(out[-1][1], own) and out[-1][2][0].shape == plane.shape:
            out[-1][2].append(plane)
        else:
            out.append((int(p[a]), own, [plane]))
    return [(first, own, np.stack(planes)) for first, own, planes in out]


def _wavefronts(n_t: int, n_s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for d in range(n_t + n_s - 1):
        t = np.arange(max(0, d - n_s + 1), min(n_t, d + 1))
        out.append((t, d - t))
    return out


def _steps(n_p: int, n_t: int, n_s: int, width: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each wavefront its cells (t, s), `width` at a time: a step of every profile's lanes."""
    return [[(t[k : k + width], s[k : k + width]) for k in range(0, len(t), width)] for t, s in _wavefronts(n_t, n_s)]


def encode_diag(block: np.ndarray, freq: np.ndarray) -> bytes:
    """A (p, t, s) block of exponents as one wavefront stream."""
    n_p, n_t, n_s = block.shape
    width = max(1, min(min(n_t, n_s), n_t * n_s // LANE_CELLS))
    both = [coders.plane_context(plane) for plane in block]
    pred, ctx = np.stack([a for a, _ in both]), np.stack([b for _, b in both])
    symbol = (block.astype(np.int64) - pred) & 255
    _, lo, f = lanes.tables(freq)
    lo, f = lo[ctx, symbol], f[ctx, symbol]
    steps = [x for front in _steps(n_p, n_t, n_s, width) for x in front]
    big_lo, big_f = np.zeros((len(steps), n_p, width), np.uint64), np.ones((len(steps), n_p, width), np.uint64)
    live = np.zeros((len(steps), n_p, width), bool)
    for k, (t, s) in enumerate(steps):
        big_lo[k, :, : len(t)], big_f[k, :, : len(t)], live[k, :, : len(t)] = lo[:, t, s], f[:, t, s], True
    shape = (len(steps), n_p * width)
    words, state = lanes.encode(big_lo.reshape(shape), big_f.reshape(shape), live.reshape(shape))
    payload = state.astype("<u4").tobytes() + np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words)
    return coders.write_container({"codec": "global_diag", "shape": list(block.shape), "width": width, "total_freq": 1 << lanes.BITS, "model_sha256": coders.table_digest(freq)}, payload)


def decode_diag(blob: bytes, freq: np.ndarray) -> np.ndarray:
    header, payload = coders.read_container(blob)
    if header["codec"] != "global_diag" or header["model_sha256"] != coders.table_digest(freq):
        raise ValueError("the stream was made by another codec or with another model")
    n_p, n_t, n_s = header["shape"]
    width = header["width"]
    n = n_p * width
    state = np.frombuffer(payload, "<u4", n)
    sizes = np.frombuffer(payload, "<u4", n, 4 * n)
    ends = 8 * n + np.cumsum(sizes.astype(np.int64))
    reader = lanes.Reader([payload[e - z : e] for e, z in zip(ends.tolist(), sizes.tolist(), strict=True)], state)
    find, lo, f = lanes.tables(freq)
    out = np.zeros((n_p, n_t + 1, n_s + 1), np.int64)  # a row and a column of zeros before the first
    base = (np.arange(n_p) * width)[:, None]
    for front in _steps(n_p, n_t, n_s, width):
        for t, s in front:
            left, up, corner = out[:, t, s + 1], out[:, t + 1, s], out[:, t, s]
            edge = ((t == 0) | (s == 0))[None, :]
            pred = np.where(edge, left + up, np.clip(left + up - corner, 0, 255))  # at an edge one of them is zero
            ctx = np.where(edge, 0, coders.contexts(left, up))
            own = (base + np.arange(len(t))[None, :]).ravel()
            symbol = reader.next(own, ctx.ravel(), find, lo, f).reshape(pred.shape)
            out[:, t + 1, s + 1] = (pred + symbol) & 255
    return out[:, 1:, 1:]


def encode_raster(block: np.ndarray, freq: np.ndarray, rects: np.ndarray | None = None) -> bytes:
    """Profiles one after another, cells in order, inside [left, right) of each profile's traces.
    Contexts see nothing outside of the rectangle."""
    n_p, n_t, n_s = block.shape
    rects = np.array([[0, n_t]] * n_p) if rects is None else rects
    lo = np.cumsum(freq, 1) - freq
    streams = []
    for plane, (a, b) in zip(block, rects, strict=True):
        inside = plane[a:b]
        if not inside.size:
            streams.append(b"")
            continue
        pred, ctx = coders.plane_context(inside)
        c, x = ctx.ravel(), ((inside.astype(np.int64) - pred) & 255).ravel()
        streams.append(coders.range_encode(lo[c, x], freq[c, x]))
    header = {"codec": "raster", "shape": list(block.shape), "rects": np.asarray(rects).tolist(), "sizes": [len(x) for x in streams], "total_freq": 1 << coders.BITS, "model_sha256": coders.table_digest(freq)}
    return coders.write_container(header, b"".join(streams))


def decode_raster(blob: bytes, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, rectangles); cells outside of the rectangles are 0."""
    header, payload = coders.read_container(blob)
    if header["codec"] != "raster" or header["model_sha256"] != coders.table_digest(freq):
        raise ValueError("the stream was made by another codec or with another model")
    rects = np.array(header["rects"], np.int64)
    if rects.shape != (header["shape"][0], 2):
        raise ValueError("a rectangle a profile")
    out, at = np.zeros(header["shape"], np.int64), 0
    for k, ((a, b), size) in enumerate(zip(rects.tolist(), header["sizes"], strict=True)):
        if b > a:
            out[k, a:b] = coders.decode_payload(payload[at : at + size], (b - a, header["shape"][2]), freq)
        at += size
    return out, rects


def outside(block: np.ndarray, rects: np.ndarray) -> bytes:
    """All that lies left, then right, of each profile's rectangle."""
    return b"".join(plane[:a].astype(np.uint8).tobytes() + plane[b:].astype(np.uint8).tobytes() for plane, (a, b) in zip(block, rects.tolist(), strict=True))


def put_outside(block: np.ndarray, raw: bytes, rects: np.ndarray) -> None:
    x, at = np.frombuffer(raw, np.uint8), 0
    n_t, n_s = block.shape[1:]
    if len(x) != sum(n_t - b + a for a, b in rects.tolist()) * n_s:
        raise ValueError("bytes outside of the rectangles are missing or too many")
    for plane, (a, b) in zip(block, rects.tolist(), strict=True):
        for lo, hi in ((0, a), (b, n_t)):
            plane[lo:hi] = x[at : at + (hi - lo) * n_s].reshape(hi - lo, n_s)
            at += (hi - lo) * n_s


def encode_hybrid(block: np.ndarray, freq: np.ndarray, rects: np.ndarray, level: int = 9) -> bytes:
    import zstandard

    inside, raw = encode_raster(block, freq, rects), outside(block, rects)
    rest = zstandard.ZstdCompressor(level=level).compress(raw)
    header = {"codec": "roi_zstd_hybrid", "shape": list(block.shape), "roi_bytes": len(inside), "outside_raw_bytes": len(raw), "outside_zstd_bytes": len(rest), "zstd_level": level}
    return coders.write_container(header, inside + rest, coders.HYBRID_MAGIC)


def decode_hybrid(blob: bytes, freq: np.ndarray) -> np.ndarray:
    import zstandard

    header, payload = coders.read_container(blob, coders.HYBRID_MAGIC)
    block, rects = decode_raster(payload[: header["roi_bytes"]], freq)
    raw = zstandard.ZstdDecompressor().decompress(payload[header["roi_bytes"] :], max_output_size=max(1, header["outside_raw_bytes"]))
    put_outside(block, raw, rects)
    return block


_CODED = pa.schema([("block", pa.int32()), ("first_p", pa.int32()), ("traces", pa.list_(pa.int32())), ("n", pa.int64()), ("inside", pa.int64()), ("blob", pa.binary())])
CODED = "block int, first_p int, traces array<int>, n long, inside long, blob binary"


def encode_blocks(traces: DataFrame, freq: np.ndarray, codec: str = "diag", per_block: int = 16, rects: DataFrame | None = None) -> DataFrame:
    """(block, first_p, traces, n, inside, blob) of trace rows (p, t, e array): a stream for each
    `per_block` profiles, or for each box of them where profiles differ in their traces
    (`planes_of`); `traces` are a box's trace numbers, null if they count from 0.

    `rects` (p, left, right) bounds what the model codes with `raster` and `hybrid`; a
    profile without one is coded whole."""
    shared = traces.sparkSession.sparkContext.broadcast(freq)
    rows = traces.select("p", "t", "e")
    if rects is not None:
        rows = rows.join(rects.select("p", F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right")), "p", "left")
    else:
        rows = rows.withColumns({"left": F.lit(None).cast("int"), "right": F.lit(None).cast("int")})

    def run(key, table):
        bounds = {p: (a, max(a, b)) for p, a, b in zip(*(table.column(c).to_pylist() for c in ("p", "left", "right")), strict=True) if a is not None}
        out = []
        for first, t, block in planes_of(table, "e"):
            own = np.array([np.searchsorted(t, bounds[p]) if p in bounds else (0, len(t)) for p in range(first, first + len(block))])
            if codec == "diag":
                blob = encode_diag(block, shared.value)
            elif codec == "raster":
                blob = encode_raster(block, shared.value, own)
            else:
                blob = encode_hybrid(block, shared.value, own)
            inside = block.size if codec == "diag" else int((own[:, 1] - own[:, 0]).sum()) * block.shape[2]
            out.append({"block": key[0].as_py(), "first_p": first, "traces": None if t[-1] == len(t) - 1 else t.tolist(), "n": block.size, "inside": inside, "blob": blob})
        return pa.Table.from_pylist(out, schema=_CODED)

    return rows.withColumn("block", F.floor(F.col("p") / per_block).cast("int")).groupBy("block").applyInArrow(run, CODED)


def decode_blocks(coded: DataFrame, freq: np.ndarray, codec: str = "diag") -> DataFrame:
    """Trace rows (p, t, e array) of coded blocks."""
    shared = coded.sparkSession.sparkContext.broadcast(freq)

    def run(batches):
        for b in batches:
            for first, traces, blob in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                block = decode_diag(blob, shared.value) if codec == "diag" else decode_raster(blob, shared.value)[0] if codec == "raster" else decode_hybrid(blob, shared.value)
                n_p, n_t, n_s = block.shape
                off = pa.array(np.arange(n_p * n_t + 1, dtype=np.int32) * n_s)
                p, t = np.divmod(np.arange(n_p * n_t, dtype=np.int32), np.int32(n_t))
                t = t if traces is None else np.array(traces, np.int32)[t]
                yield pa.RecordBatch.from_arrays([pa.array(p + np.int32(first)), pa.array(t), pa.ListArray.from_arrays(off, pa.array(block.astype(np.int32).ravel()))], names=["p", "t", "e"])

    return coded.select("first_p", "traces", "blob").mapInArrow(run, "p int, t int, e array<int>")


def exponent_traces(traces: DataFrame) -> DataFrame:
    """Trace rows (p, t, samples) as (p, t, e array), without a shuffle."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            bits = lists.flatten().view(pa.int32()).to_numpy()
            off = lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(off - off[0]), pa.array((bits >> 23) & 255, pa.int32()))], names=["p", "t", "e"])

    return traces.select(F.col("p").cast("int").alias("p"), F.col("t").cast("int").alias("t"), F.col("samples").cast("array<float>").alias("samples")).mapInArrow(run, "p int, t int, e array<int>")
