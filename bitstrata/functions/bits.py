"""IEEE-754 and IBM float32 bit fields as column expressions.

Only the two casts between float and its 32 bits leave the JVM (Arrow, zero copy);
everything else is integer arithmetic inside whole-stage codegen.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import FloatType, IntegerType


@arrow_udf(IntegerType())
def bits_of(v: pa.Array) -> pa.Array:
    """The 32 bits of a float, as a signed int; null stays null."""
    return v.view(pa.int32())


@arrow_udf(FloatType())
def float_of(b: pa.Array) -> pa.Array:
    return b.view(pa.float32())


def sign(bits: Column) -> Column:
    return F.shiftright(bits, 31).bitwiseAND(F.lit(1))


def exponent(bits: Column) -> Column:
    return F.shiftright(bits, 23).bitwiseAND(F.lit(255))


def mantissa(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(0x7FFFFF))


def compose(sgn: Column, e: Column, m: Column) -> Column:
    return F.shiftleft(sgn, 31).bitwiseOR(F.shiftleft(e, 23)).bitwiseOR(m.bitwiseAND(F.lit(0x7FFFFF)))


def field(x: Column, shift: int, mask: int) -> Column:
    return F.shiftright(x, shift).bitwiseAND(F.lit(mask))


def mantissa_parts(m: Column) -> dict[str, Column]:
    """The middle 15 bits, the 8 side bits (high four, low four), and the four nibbles."""
    lo4, hi4, mid = field(m, 0, 15), field(m, 19, 15), field(m, 4, 0x7FFF)
    return {"mid15": mid, "lo4": lo4, "hi4": hi4, "side": F.shiftleft(hi4, 4).bitwiseOR(lo4), "mid_low": mid.bitwiseAND(F.lit(255)), "mid_high": F.shiftright(mid, 8), "nib19": field(m, 19, 15), "nib15": field(m, 15, 15), "nib4": field(m, 4, 15), "nib0": lo4}


def packed_bytes(m: Column) -> dict[str, Column]:
    """A mantissa as three little-endian bytes, the last of seven bits."""
    return {"b0": field(m, 0, 255), "b1": field(m, 8, 255), "b2": field(m, 16, 127)}


def binary_text(bits: Column) -> Column:
    """sign|exponent|mantissa in binary digits."""
    return F.concat_ws("|", sign(bits).cast("string"), F.lpad(F.bin(exponent(bits)), 8, "0"), F.lpad(F.bin(mantissa(bits)), 23, "0"))


def big_endian_hex(bits: Column) -> Column:
    """The four bytes, most significant first, as eight hex digits."""
    return F.right(F.lpad(F.hex(bits.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.lit(8))


def ibm_value(word: Column) -> Column:
    """IBM hexadecimal float32 word (unsigned, as long) to a float."""
    w = word.cast("long")
    frac = w.bitwiseAND(F.lit(0xFFFFFF)).cast("double") / F.lit(16777216.0)
    power = F.pow(F.lit(16.0), F.shiftright(w, 24).bitwiseAND(F.lit(127)) - 64)
    return (F.when(F.shiftright(w, 31).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0) * frac * power).cast("float")


def ibm_word(v: Column) -> Column:
    """A float as an IBM word (long), fraction truncated; 0, NaN and infinities give 0."""
    a = F.abs(v.cast("double"))
    base = F.floor(F.log2(a) / 4)
    exp = base + F.when(F.floor(a / F.pow(F.lit(16.0), base) * 16777216.0) >= 16777216, 1).otherwise(0)
    frac = F.floor(a / F.pow(F.lit(16.0), exp) * 16777216.0)
    word = F.when(v < 0, F.lit(1 << 31)).otherwise(F.lit(0)) + (exp.cast("long") + 64) * F.lit(1 << 24) + frac.cast("long")
    return F.when((a == 0) | F.isnan(a) | (a == F.lit(float("inf"))) | v.isNull(), F.lit(0)).otherwise(word).cast("long")


def bernoulli_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def residual(e: Column, pred: Column) -> Column:
    return (e - pred).bitwiseAND(F.lit(255))


def restore(symbol: Column, pred: Column, mode: str) -> Column:
    if mode not in ("raw", "residual"):
        raise ValueError(f"unknown target mode {mode!r}")
    return symbol if mode == "raw" else (pred + symbol).bitwiseAND(F.lit(255))


def file_size_text(b: Column) -> Column:
    """1024-based size with two decimals at most."""
    unit = F.least(F.floor(F.log2(F.greatest(b, F.lit(1))) / 10), F.lit(3)).cast("int")
    names = F.array(*[F.lit(x) for x in ("Bytes", "KB", "MB", "GB")])
    return F.when(b == 0, F.lit("0 Bytes")).otherwise(F.concat_ws(" ", F.round(b / F.pow(F.lit(1024.0), unit), 2).cast("string"), F.element_at(names, unit + 1)))
