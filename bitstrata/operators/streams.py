"""Byte streams of a volume's signs and mantissas, and what compressors make of them.

A block of profiles is one stream of float32 values in order; each of the streams below is
derived from it, compressed, read back and compared, and sizes are summed over blocks.  So a
frame is a block, not the volume: blocks are coded where they lie, and a lost task costs one.

Streams: `sign` bits packed lowest first; sign run lengths (one or two bytes each, by the
volume's longest run) and their differences (two bytes); `whole` mantissas of three bytes;
`mid` the middle 15 bits as two-byte integers, as a byte plane each, or as 15 bit planes laid
end to end; `side` the high and the low four bits as one byte, or as eight bit planes.
"""

from __future__ import annotations

import hashlib
import lzma
import time
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitstrata.operators.blocks import ordered

#: Levels of the general streams, of the run-length streams, and of xz.
ZSTD_LEVEL, RLE_LEVEL, XZ_PRESET = 9, 3, 6


def words_of(block: np.ndarray) -> np.ndarray:
    """The values' 32 bits in order."""
    return np.ascontiguousarray(block, np.float32).ravel().view(np.uint32)


def run_lengths(bits: np.ndarray) -> np.ndarray:
    if not len(bits):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], bits[1:] != bits[:-1]]))
    return np.diff(np.concatenate([first, [len(bits)]]))


def planes(values: np.ndarray, bits: int) -> bytes:
    """Bit planes from the lowest, each over all values, back to back, highest bit of a byte first."""
    return np.packbits(np.concatenate([(values >> k & 1).astype(np.uint8) for k in range(bits)])).tobytes()


def unplanes(raw: bytes, n: int, bits: int) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(raw, np.uint8))[: n * bits].reshape(bits, n).astype(np.uint32)
    return (x << np.arange(bits, dtype=np.uint32)[:, None]).sum(0, dtype=np.uint32)


def three_bytes(m: np.ndarray) -> bytes:
    return m.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def from_three_bytes(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.uint32)
    return x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16


def length_type(longest: int) -> str:
    return "<u1" if longest < 256 else "<u2" if longest < 65536 else "<u4"


def raw_streams(words: np.ndarray, longest: int | None = None) -> dict[str, bytes]:
    """All streams of a block before compression."""
    sign, m = (words >> 31).astype(np.uint8), words & 0x7FFFFF
    mid, side = m >> 4 & 0x7FFF, (m >> 19 << 4 | m & 15).astype(np.uint8)
    runs = run_lengths(sign)
    steps = np.diff(runs, prepend=runs[:1])
    return {
        "sign_bits": np.packbits(sign, bitorder="little").tobytes(),
        "sign_runs": runs.astype(length_type(int(runs.max(initial=0)) if longest is None else longest)).tobytes(),
        "sign_steps": steps.astype("<i2" if not len(steps) or np.abs(steps).max() < 1 << 15 else "<i4").tobytes(),
        "whole": three_bytes(m),
        "mid_words": mid.astype("<u2").tobytes(),
        "mid_low": (mid & 255).astype(np.uint8).tobytes(),
        "mid_high": (mid >> 8).astype(np.uint8).tobytes(),
        "mid_planes": planes(mid, 15),
        "side_bytes": side.tobytes(),
        "side_planes": planes(side, 8),
    }


def zstd_size(raw: bytes, level: int) -> tuple[int, bool]:
    import zstandard

    packed = zstandard.ZstdCompressor(level=level).compress(raw)
    return len(packed), zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, len(raw))) == raw


def xz_size(raw: bytes) -> tuple[int, bool]:
    packed = lzma.compress(raw, preset=XZ_PRESET)
    return len(packed), lzma.decompress(packed) == raw


#: part, method, its place among the part's candidates, the streams it takes, the compressor.
CANDIDATES: list[tuple[str, str, int, tuple[str, ...], Callable[[bytes], tuple[int, bool]]]] = [
    ("sign", "bitpack+zstd", 0, ("sign_bits",), lambda b: zstd_size(b, ZSTD_LEVEL)),
    ("sign", "bitpack+lzma", 1, ("sign_bits",), xz_size),
    ("sign", "rle_lengths+zstd", 2, ("sign_runs",), lambda b: zstd_size(b, RLE_LEVEL)),
    ("sign", "rle_lengths+lzma", 3, ("sign_runs",), xz_size),
    ("sign", "rle_deltas+zstd", 4, ("sign_steps",), lambda b: zstd_size(b, RLE_LEVEL)),
    ("sign", "rle_deltas+lzma", 5, ("sign_steps",), xz_size),
    ("mid", "mid15_raw_u16_zstd", 0, ("mid_words",), lambda b: zstd_size(b, ZSTD_LEVEL)),
    ("mid", "mid15_bytesplit_zstd", 1, ("mid_low", "mid_high"), lambda b: zstd_size(b, ZSTD_LEVEL)),
    ("mid", "mid15_bitshuffle_zstd", 2, ("mid_planes",), lambda b: zstd_size(b, ZSTD_LEVEL)),
    ("side", "hi4lo4_raw_zstd", 0, ("side_bytes",), lambda b: zstd_size(b, ZSTD_LEVEL)),
    ("side", "hi4lo4_bitshuffle_zstd", 1, ("side_planes",), lambda b: zstd_size(b, ZSTD_LEVEL)),
    ("whole", "mantissa23_packed+zstd", 0, ("whole",), lambda b: zstd_size(b, ZSTD_LEVEL)),
]
_SIZES = "block int, part string, method string, ord int, n long, raw long, bytes long, seconds double, ok boolean"
_SIZES_SCHEMA = pa.schema([("block", pa.int32()), ("part", pa.string()), ("method", pa.string()), ("ord", pa.int32()), ("n", pa.int64()), ("raw", pa.int64()), ("bytes", pa.int64()), ("seconds", pa.float64()), ("ok", pa.bool_())])


def _blocked(traces: DataFrame, per_block: int) -> DataFrame:
    return traces.select("p", "t", F.col("samples").cast("array<float>").alias("samples"), F.floor(F.col("p") / per_block).cast("int").alias("block"))


def sizes(traces: DataFrame, per_block: int = 16, longest: int | None = None) -> DataFrame:
    """(block, part, method, ord, n, raw, bytes, seconds, ok): every candidate of every block of
    trace rows (p, t, samples).  `longest` is the volume's longest sign run, where known, so that
    all blocks store lengths alike."""

    def run(key, table):
        words = words_of(ordered(table, "samples")[3])
        raw, out = raw_streams(words, longest), []
        for part, method, place, streams, pack in CANDIDATES:
            began = time.perf_counter()
            done = [pack(raw[s]) for s in streams]
            out.append({"block": key[0].as_py(), "part": part, "method": method, "ord": place, "n": len(words), "raw": sum(len(raw[s]) for s in streams), "bytes": sum(d[0] for d in done), "seconds": time.perf_counter() - began, "ok": all(d[1] for d in done)})
        return pa.Table.from_pylist(out, schema=_SIZES_SCHEMA)

    return _blocked(traces, per_block).groupBy("block").applyInArrow(run, _SIZES)


def digests(traces: DataFrame, per_block: int = 16) -> DataFrame:
    """(block, stream, n_bytes, sha256) of every stream before compression, after a check that the
    values' signs and mantissas come back from it."""

    def run(key, table):
        words = words_of(ordered(table, "samples")[3])
        raw, m, n = raw_streams(words), words & 0x7FFFFF, len(words)
        mid = m >> 4 & 0x7FFF
        same = [
            (unplanes(raw["mid_planes"], n, 15), mid),
            (unplanes(raw["side_planes"], n, 8), m >> 19 << 4 | m & 15),
            (from_three_bytes(raw["whole"]), m),
            (np.unpackbits(np.frombuffer(raw["sign_bits"], np.uint8), bitorder="little")[:n], words >> 31),
            (np.frombuffer(raw["mid_low"], np.uint8) | np.frombuffer(raw["mid_high"], np.uint8).astype(np.uint32) << 8, mid),
        ]
        if not all((a == b).all() for a, b in same):
            raise ValueError("a stream does not give its values back")
        rows = [{"block": key[0].as_py(), "stream": k, "n_bytes": len(v), "sha256": hashlib.sha256(v).hexdigest()} for k, v in raw.items()]
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("stream", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    return _blocked(traces, per_block).groupBy("block").applyInArrow(run, "block int, stream string, n_bytes long, sha256 string")


def totals(found: DataFrame) -> DataFrame:
    """Sizes over all blocks."""
    return found.groupBy("part", "method", "ord").agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"), F.every("ok").alias("ok"))


def best(found: DataFrame, by: str = "part", size: str = "bytes") -> DataFrame:
    """The smallest candidate of each `by`, the first listed at a tie."""
    return found.groupBy(by).agg(F.min(F.struct(size, "ord", "method")).alias("b"), F.max("n").alias("n")).select(by, "b.method", F.col(f"b.{size}").alias(size), "n")


def schemes(chosen: DataFrame, exponent_bytes: Column | float) -> DataFrame:
    """(scheme, n, sign_bytes, exponent_bytes, mantissa_bytes, total, ratio, saving, bits_per_value):
    signs and exponents with mantissas in two parts, or whole.  `chosen` is `best`'s result."""
    size = lambda part: F.max(F.when(F.col("part") == part, F.col("bytes")))
    x = chosen.agg(F.max("n").alias("n"), size("sign").alias("sign_bytes"), (size("mid") + size("side")).alias("split"), size("whole").alias("whole"))
    x = x.select("n", "sign_bytes", F.explode(F.array(F.struct(F.lit("split").alias("scheme"), F.col("split").alias("mantissa_bytes")), F.struct(F.lit("whole").alias("scheme"), F.col("whole").alias("mantissa_bytes")))).alias("z")).select("n", "sign_bytes", "z.*")
    e = exponent_bytes if isinstance(exponent_bytes, Column) else F.lit(exponent_bytes)
    total = F.col("sign_bytes") + e + F.col("mantissa_bytes")
    x = x.withColumn("exponent_bytes", e).withColumn("total", total)
    return x.select("scheme", "n", "sign_bytes", "exponent_bytes", "mantissa_bytes", "total", (F.col("n") * 4 / F.col("total")).alias("ratio"), (1 - F.col("total") / (F.col("n") * 4)).alias("saving"), (F.col("total") * 8 / F.col("n")).alias("bits_per_value"))


def estimated_exponent_bytes(n: int, nll_bits: float) -> float:
    """What exponents would take at a mean code length."""
    return n * nll_bits / 8


# ------------------------------------------------------------ whole values

_PACKED = pa.schema([("block", pa.int32()), ("traces", pa.binary()), ("sign", pa.binary()), ("mantissa", pa.binary())])


def pack_values(traces: DataFrame, per_block: int = 16, level: int = 1) -> DataFrame:
    """(block, traces, sign, mantissa): zlib streams of (p, t, length) of each trace, column by
    column, of sign bits (highest first) and of three-byte mantissas; exponents are coded beside
    them (`blocks.encode_blocks`)."""

    def run(key, table):
        p, t, n, flat = ordered(table, "samples")
        words = words_of(flat)
        streams = np.stack([p, t, n]).astype("<i4").tobytes(), np.packbits((words >> 31).astype(np.uint8)).tobytes(), three_bytes(words & 0x7FFFFF)
        return pa.table([[key[0].as_py()], *([zlib.compress(x, level)] for x in streams)], schema=_PACKED)

    return _blocked(traces, per_block).groupBy("block").applyInArrow(run, "block int, traces binary, sign binary, mantissa binary")


def unpack_values(packed: DataFrame, exponents: DataFrame) -> DataFrame:
    """Trace rows (p, t, samples) from `pack_values`' rows and decoded exponent traces (p, t, e)."""

    def run(batches):
        for b in batches:
            for traces, sign, mantissa in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                p, t, size = np.frombuffer(zlib.decompress(traces), "<i4").reshape(3, -1)
                off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                s = np.unpackbits(np.frombuffer(zlib.decompress(sign), np.uint8))[: off[-1]].astype(np.uint32)
                x = (s << 31 | from_three_bytes(zlib.decompress(mantissa))).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(t), pa.ListArray.from_arrays(pa.array(off), pa.array(x))], names=["p", "t", "rest"])

    def join(batches):
        for b in batches:
            e, rest = b.column(2), b.column(3)
            bits = rest.flatten().to_numpy() | e.flatten().to_numpy() << 23
            off = e.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(off - off[0]), pa.array(bits.astype(np.int32)).view(pa.float32()))], names=["p", "t", "samples"])

    rest = packed.select("traces", "sign", "mantissa").mapInArrow(run, "p int, t int, rest array<int>")
    both = exponents.select("p", "t", "e").join(rest, ["p", "t"])
    return both.select("p", "t", "e", "rest").mapInArrow(join, "p int, t int, samples array<float>")


def timing(found: DataFrame, wall_seconds: Column | float) -> DataFrame:
    """(n, seconds, per_value_us, overhead): time inside the coders, and what is left of the wall time."""
    wall = wall_seconds if isinstance(wall_seconds, Column) else F.lit(wall_seconds)
    x = found.agg(F.max("n").alias("n"), F.sum("seconds").alias("seconds"))
    return x.select("n", "seconds", (F.col("seconds") / F.greatest("n", F.lit(1)) * 1e6).alias("per_value_us"), F.greatest(wall - F.col("seconds"), F.lit(0.0)).alias("overhead"))


def longest_run(runs: DataFrame) -> int:
    """Longest of a table of runs (column n); 0 without any."""
    return int(runs.agg(F.max("n")).first()[0] or 0)


