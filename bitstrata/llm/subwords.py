"""Whole texts to token ids, or to token counts, a distinct word at a time.

White space always ends a token in these vocabularies, so a text's tokens are
those of its words in turn.  The words of a slice are found and hashed with
numpy; each distinct word goes through the tokenizer once, and a bounded memo
keeps results between slices.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from bitstrata.llm import kernels as K

#: Distinct words that a worker remembers before it starts afresh.
MEMO = 600_000
SLICE = 2 << 20
#: Bytes whose ids are made at once; spans, hashes and their order take some 40 times as much.
IDS_SLICE = 1 << 20


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it has a glyph in Latin-1, else the next letter from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_STAND_IN = byte_letters()
_TRANSLATE = dict(enumerate(_STAND_IN))


def stand_in(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TRANSLATE)


# Classes of bytes in words that need no regular expression: ASCII, and letters in two bytes from 0xC3.
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[ord("'")] = _ODD
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0xC3] = _LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, bounds, odd): runs of letters, single digits and
    runs of other marks, of every text in turn.  A word with a byte that could be read
    otherwise (an apostrophe, a control, a letter beyond U+00FF, the start of a special
    string) is one odd part, in its own case."""
    starts, ends, _ = K.word_spans(data, offsets)
    low = K.lower(data)
    kind = _CLASS[data]
    high = data >= 0x80
    if high.any():
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        tail = high & (data < 0xC0)
        kind[tail & after & (data != 0x97) & (data != 0xB7)] = _LETTER
        low[tail & after & (data < 0x9F) & (data != 0x97)] += 0x20
    opens = np.flatnonzero(data[:-1] == ord("<"))
    kind[opens[data[opens + 1] == ord("|")]] = _ODD
    seen = np.concatenate([[0], np.cumsum(kind == _ODD)])
    odd_word = seen[ends] > seen[starts]
    new = np.zeros(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new &= kind > 0
    new[starts] = True
    if odd_word.any():
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[odd_word]] += 1
        edge[ends[odd_word]] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        low[inside] = data[inside]
        new[inside] = False
        new[starts[odd_word]] = True
    begin = np.flatnonzero(new)
    word = np.searchsorted(starts, begin, "right") - 1
    stop = ends[word] if len(begin) else begin
    if len(begin):
        stop[:-1] = np.minimum(stop[:-1], begin[1:])
    return low, begin, stop, np.searchsorted(begin, offsets), odd_word[word] if len(begin) else new[:0]


class WordIds:
    """Ids as `tokenizers` gives them for a vocabulary whose normaliser is NFC and
    lower case and whose words end at white space."""

    #: Text on which NFC changes nothing and letters and digits are beyond dispute.
    _PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]*")
    _PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        said = json.loads(self.library.to_str())
        steps = [s["type"] for s in said["normalizer"]["normalizers"]]
        splits = [s for s in said["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        # words that this class may split by itself; any other vocabulary goes through the library whole
        self.known = steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["pattern"]["Regex"].replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == self._PART.pattern
        self._fresh()

    def _fresh(self) -> None:
        # hashes of the words that are known, in order, and their places: twelve bytes a word
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.parts: dict[str, list[int]] = {}
        self.starts, self.lens, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.words = self.used = 0

    def word(self, text: str) -> list[int]:
        if not self.known or not self._PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for part in self._PART.findall(text.lower()):
            got = self.parts.get(part)
            if got is None:
                got = self.parts[part] = self.part(part.encode())
            out += got
        return out

    def part(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(stand_in(raw))]

    def _learn(self, raw: bytes, whole: bool) -> None:
        ids = self.word(raw.decode()) if whole else self.part(raw)
        if self.words == len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * self.words), np.resize(self.lens, 2 * self.words)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.words], self.lens[self.words] = self.used, len(ids)
        self.used += len(ids)
        self.words += 1

    def _places(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Places of the words with these hashes, which are distinct and in order; new ones are learnt."""
        if self.words > MEMO:
            self._fresh()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != hashes
        if new.any():
            first = self.words
            for a, b, whole in zip(starts[new].tolist(), ends[new].tolist(), odd[new].tolist(), strict=True):
                self._learn(raw[a:b], whole)
            self.keys = np.insert(self.keys, at[new], hashes[new])
            self.place = np.insert(self.place, at[new], np.arange(first, self.words, dtype=np.int32))
            at += np.cumsum(new) - new
        return self.place[at]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, bounds) of consecutive slices of a text column."""
        for i, j, data, offsets in K.pieces(column, IDS_SLICE):
            if self.known:
                text, starts, ends, bounds, odd = parts(data, offsets)
            else:
                text, (starts, ends, bounds) = data, K.word_spans(data, offsets)
                odd = np.ones(len(starts), bool)
            hashes, where, back = np.unique(K.span_hashes(text, starts, ends), return_index=True, return_inverse=True)
            slot = self._places(hashes, text.tobytes(), starts[where], ends[where], odd[where])[back]
            lens = self.lens[slot]
            last = np.cumsum(lens)
            ids = self.flat[np.repeat(self.starts[slot] - last + lens, lens) + np.arange(int(last[-1]) if len(last) else 0)]
            yield i, j, ids, np.concatenate([[0], last])[bounds]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


# ---------------------------------------------------------------- counting


class PairMerges:
    """Counts byte-pair tokens without making ids: symbols are a linked list, the
    pairs a heap of (rank, place); count = bytes - merges."""

    _PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: White space beyond ASCII, as UTF-8: next to it a text is not cut into words.
    _WIDE = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if said["model"]["type"] != "BPE" or said["normalizer"] is not None or said["pre_tokenizer"]["type"] != "ByteLevel" or not said["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"{path} is not a byte-level BPE vocabulary")
        symbol = {c: b for b, c in enumerate(_STAND_IN)}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(said["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            new = symbol.setdefault(left + right, 256 + len(symbol))
            self.rank.setdefault(symbol[left] << 20 | symbol[right], r)
            self.made.append(new)
        special = [regex.escape(t["content"]) for t in said["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.memo: dict[int, int] = {}
        self.piece_memo: dict[str, int] = {}

    def merges(self, raw: bytes) -> int:
        """How many merges the bytes of one piece undergo."""
        n = len(raw)
        sym, after, before = list(raw), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(sym[i] << 20 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0 or rank.get(sym[i] << 20 | sym[j]) != top >> 32:
                continue  # one of the two has been merged since
            sym[i], sym[j] = self.made[top >> 32], -1
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (r := rank.get(sym[i] << 20 | sym[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank.get(sym[h] << 20 | sym[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return done

    def piece(self, text: str) -> int:
        got = self.piece_memo.get(text)
        if got is None:
            raw = text.encode()
            got = len(raw) - self.merges(raw) if len(raw) > 1 else len(raw)
            if len(raw) <= 256:
                self.piece_memo[text] = got
        return got

    def text(self, text: str) -> int:
        if self.special is None or not (found := self.special.findall(text)):
            return sum(map(self.piece, self._PIECE.findall(text)))
        return len(found) + sum(self.piece(p) for t in self.special.split(text) for p in self._PIECE.findall(t))

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text."""
        out = np.zeros(len(column), np.int64)
        for i, j, data, offsets in K.pieces(column, SLICE):
            starts, ends, bounds = K.word_spans(data, offsets)
            # a unit is a word with the white space before it; what follows the last word is one more
            row = np.repeat(np.arange(j - i), np.diff(bounds))
            prev = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            first = bounds[:-1][np.diff(bounds) > 0]
            prev[first] = offsets[:-1][np.diff(bounds) > 0]
            tail = offsets[:-1].copy()
            tail[np.diff(bounds) > 0] = ends[bounds[1:][np.diff(bounds) > 0] - 1]
            left = np.flatnonzero(tail < offsets[1:])
            begin, end, row = np.concatenate([prev, tail[left]]), np.concatenate([ends, offsets[1:][left]]), np.concatenate([row, left])
            wide = [m.start() for m in self._WIDE.finditer(data.tobytes())] if (data >= 0xC2).any() else []
            if wide:
                slow = np.unique(np.searchsorted(offsets, wide, "right") - 1)
                fast = ~np.isin(row, slow)
                begin, end, row = begin[fast], end[fast], row[fast]
                for d in slow.tolist():
                    out[i + d] = self.text(data[offsets[d] : offsets[d + 1]].tobytes().decode())
            hashes, where, back = np.unique(K.span_hashes(data, begin, end), return_index=True, return_inverse=True)
            if len(self.memo) > MEMO:
                self.memo.clear()
                self.piece_memo.clear()
            memo, got = self.memo, []
            for key, w in zip(hashes.tolist(), where.tolist(), strict=True):
                n = memo.get(key)
                if n is None:
                    n = memo[key] = self.text(data[begin[w] : end[w]].tobytes().decode())
                got.append(n)
            if got:
                out[i:j] += np.bincount(row, np.array(got, np.float64)[back], j - i).astype(np.int64)
        return out


@lru_cache(maxsize=2)
def pair_merges(path: str) -> PairMerges:
    return PairMerges(path)
