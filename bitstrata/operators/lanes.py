"""Interleaved entropy coding in numpy: many independent coder states step together.

A state is a 32-bit integer that gives and takes 16-bit words (range variant of asymmetric
numeral systems, frequencies out of 2 ** 15).  Lanes share nothing, so one step codes a
symbol of every lane; what is sequential is a lane's own symbols only.
"""

from __future__ import annotations

import numpy as np

BITS = 15
_LOW = np.uint64(1 << 16)
_WORD = np.uint64(0xFFFF)
_SIXTEEN = np.uint64(16)
_B = np.uint64(BITS)
_MASK = np.uint64((1 << BITS) - 1)


def encode(lo: np.ndarray, freq: np.ndarray, live: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(steps, lanes) intervals, and which of them are there -> each lane's words, its last state.
    Steps are coded from the last, so that they are read from the first."""
    steps, lanes = lo.shape
    lo, freq = lo.astype(np.uint64), freq.astype(np.uint64)
    state = np.full(lanes, _LOW)
    words = np.zeros((steps, lanes), np.uint16)
    sent = np.zeros((steps, lanes), bool)
    full = freq << np.uint64(17)
    for k in range(steps - 1, -1, -1):
        on = live[k]
        f = np.where(on, freq[k], np.uint64(1))
        out = on & (state >= full[k])
        words[k], sent[k] = (state & _WORD).astype(np.uint16), out
        x = np.where(out, state >> _SIXTEEN, state)
        q = x // f
        state = np.where(on, (q << _B) + lo[k] + (x - q * f), x)
    return [words[sent[:, i], i].astype("<u2").tobytes() for i in range(lanes)], state


class Reader:
    """Lanes of words with their states, read a step at a time."""

    def __init__(self, words: list[bytes], state: np.ndarray):
        self.state = state.astype(np.uint64)
        size = np.array([len(w) // 2 for w in words], np.int64)
        self.at = np.cumsum(size) - size
        self.words = np.concatenate([np.frombuffer(b"".join(words), "<u2").astype(np.uint64), np.zeros(1, np.uint64)])

    def next(self, lanes: np.ndarray, context: np.ndarray, find: np.ndarray, lo: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """The next symbol of each of the lanes, in its context.  `find` is (contexts, 2 ** 15)."""
        x = self.state[lanes]
        v = x & _MASK
        symbol = find[context, v.astype(np.int64)]
        x = freq[context, symbol] * (x >> _B) + v - lo[context, symbol]
        take = x < _LOW
        at = self.at[lanes]
        x = np.where(take, (x << _SIXTEEN) | self.words[np.where(take, at, -1)], x)
        self.at[lanes] = at + take
        self.state[lanes] = x
        return symbol


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(find, lo, freq) of a table of frequencies a context."""
    lo = (np.cumsum(freq, 1) - freq).astype(np.uint64)
    find = np.stack([np.repeat(np.arange(freq.shape[1], dtype=np.int64), f) for f in freq])
    return find, lo, freq.astype(np.uint64)
