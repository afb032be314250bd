"""Canonical length-limited Huffman codes, packed and read with numpy."""

from __future__ import annotations

import numpy as np

MAX_BITS = 18
#: A bit offset is kept for every so many ids; decoding runs over all of them at once.
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    is_leaf, level = [], leaves
    for _ in range(limit):
        merged = np.argsort(level if level is leaves else np.concatenate([leaves, level]), kind="stable")
        values = leaves if level is leaves else np.concatenate([leaves, level])
        is_leaf.append(merged < n)
        values = values[merged]
        level = values[0 : len(values) // 2 * 2 : 2] + values[1 : len(values) // 2 * 2 : 2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        leaf = int(np.count_nonzero(flags[:take]))
        lengths[:leaf] += 1
        take = 2 * (take - leaf)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol), each the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    for bits in np.unique(lengths[used]).tolist():
        code <<= bits - last
        group = used[lengths[used] == bits]
        codes[group] = code + np.arange(len(group), dtype=np.uint32)
        code, last = code + len(group), bits
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for every value of the next `limit` bits."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = 1 << (limit - lengths[used].astype(np.int64))
    symbol, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    filled = int(span.sum())
    symbol[:filled], bits[:filled] = np.repeat(used.astype(np.uint32), span), np.repeat(lengths[used], span)
    return symbol, bits


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits as big-endian 32-bit words, offsets of every STRIDE-th id)."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    bits = lengths[ids].astype(np.int64)
    if not bits.all():
        raise ValueError("an id has no code")
    end = np.cumsum(bits)
    at = end - bits
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - bits).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint32)
    joined = np.bitwise_or.reduceat(value, first)
    out[word[first]] |= (joined >> np.uint64(32)).astype(np.uint32)
    out[word[first] + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out[: (int(end[-1]) + 31) >> 5].astype(">u4").tobytes(), at[::STRIDE].astype(np.uint32)


def decode(payload: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = MAX_BITS, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block of `n`, or of its runs first:last of STRIDE ids each."""
    symbol, bits = table
    words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    at = offsets[first:last].astype(np.int64)
    lanes = len(at)
    out = np.zeros((STRIDE, lanes), np.uint32)
    short = n - (first + lanes - 1) * STRIDE  # ids in the last lane
    mask = np.uint64((1 << limit) - 1)
    for k in range(STRIDE if lanes > 1 else min(short, STRIDE)):
        m = lanes - (k >= short)
        pos = at[:m]
        w = pos >> 5
        window = (words[w] << np.uint64(32)) | words[w + 1]
        key = ((window >> (64 - limit - (pos & 31)).astype(np.uint64)) & mask).astype(np.int64)
        out[k, :m] = symbol[key]
        pos += bits[key]
    flat = out.T.ravel()
    return flat[: min(n - first * STRIDE, len(flat))]
