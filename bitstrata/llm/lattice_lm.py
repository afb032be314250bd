"""Subword lattice likelihood.

A word's probability is the sum, over all ways to spell it, of the products of the
arcs' probabilities; a document's is the product over its words and one end mark.
The sums run in log space by the forward recursion.  Arcs are the pieces of an existing
unigram vocabulary, among them every single byte, so no text has probability 0, and
from a word's start to its end the word itself where training has seen it.

The vocabulary's own scores give the pieces' first probabilities (a byte-pair
vocabulary scores pieces by rank, read as a Zipf law); expectation-maximisation over
the training word types then re-estimates them, with the same forward and a backward
pass.  A word seen c times in N training tokens of V types has (c - D) / N on its own
arc, and D * V / N is left for its spellings with pieces (absolute discounting), so
the whole sums to one and what the model knows grows with the corpus.

Word types are what is computed on, once each:

1. text -> chunks: each chunk (a task's texts, up to `CHUNK_BYTES`) keeps its documents
   as places in its list of distinct words, and deals those words, with their training
   counts, into `parts` by hash;
2. each part merges what the chunks sent: the corpus's words with their counts;
3. expectation-maximisation: one pass over the word table a round, a sum of one
   number a piece;
4. each part answers each chunk with count and lattice scores of its words, and each
   chunk adds up its documents.

A frequent word is one entry a chunk, whatever its number of occurrences.  Parts grow
in number with a quarter of the input's splits (a corpus's distinct words grow slower than
its text), so a part does not outgrow a task, and a chunk is as large as a task can hold,
so that what it sends to a part stays a message of many words.

The contract has the model learn from the corpus, which a vocabulary's own scores do not;
`plain_score` is the lattice by those scores alone.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitstrata.llm import kernels as K
from bitstrata.llm import scratch
from bitstrata.llm.names import col

#: Bytes of text that are cut into words at once, and that share a list of words.
SLICE_BYTES, CHUNK_BYTES = 4 << 20, 64 << 20
#: Parts of the word table at least.
PARTS = 16
#: First probability of the end mark.
FIRST_END = 1e-3
ROUNDS = 3
#: Pseudo-count of every piece, so that none has probability 0.
SMOOTH = 0.1
#: What each word type gives up of its training count.
DISCOUNT = 0.75
_U = np.uint64
_LONG = 48  # bytes; longer words go one at a time, for memory's sake
_BLOCK = 1 << 14  # bytes of a long word whose arcs are held at once


# ------------------------------------------------------------------ lattice


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a blank marks a word's start) and their first probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 1e-7 for b in range(256)}
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    log_scores = min(scores) > -100.0  # log probabilities, not ranks
    for i, score in enumerate(scores):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in raw[1:]:
            weight[raw] = weight.get(raw, 0.0) + (float(np.exp(score)) if log_scores else 1.0 / (100.0 - score))
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, p / p.sum()


class Lattice:
    """Forward and backward sums over many words at once."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = np.concatenate([log_p, [-np.inf]])
        self.none = len(pieces)
        self.longest = max(map(len, pieces))
        self.power = K._powers(K._BASE, self.longest)
        self.place = {x: i for i, x in enumerate(pieces)}
        lens = np.array([len(x) for x in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(lens)
        keys = np.array([self._spans(raw[e - n : e][None, :])[0, 0, n - 1] for e, n in zip(ends, lens, strict=True)], np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece_of = keys[order], order
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> _U(44)).astype(np.int64)] = True

    def _spans(self, words: np.ndarray) -> np.ndarray:
        """(words, starts, lengths) hashes of all substrings of equally long words."""
        n, size = words.shape
        top = min(size, self.longest)
        value = K._BYTE[words]
        out = np.zeros((n, size, top), np.uint64)
        for m in range(top):
            run = value[:, m:] * self.power[m]
            out[:, : size - m, m] = run if m == 0 else out[:, : size - m, m - 1] + run
        return K.mix64(out)

    def arcs(self, words: np.ndarray) -> np.ndarray:
        """(words, starts, lengths) piece numbers, `none` where a substring is no piece."""
        keys = self._spans(words)
        out = np.full(keys.shape, self.none, np.int32)
        flat = np.flatnonzero(self.maybe[(keys >> _U(44)).astype(np.int64)])
        some = keys.ravel()[flat]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[at] == some
        out.ravel()[flat[hit]] = self.piece_of[at[hit]]
        size = words.shape[1]
        for s in range(size):
            out[:, s, size - s :] = self.none
        return out

    def forward(self, arcs: np.ndarray, log_p: np.ndarray | None = None) -> np.ndarray:
        """log sums over all spellings of each word's first j bytes."""
        log_p = self.log_p if log_p is None else log_p
        n, size, top = arcs.shape
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(1, size + 1):
                terms = np.stack([alpha[j - m] + log_p[arcs[:, j - m, m - 1]] for m in range(1, min(j, top) + 1)])
                most = terms.max(0)
                alpha[j] = most + np.log(np.exp(terms - most).sum(0))
        return alpha

    def expected(self, arcs: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Adds each piece's expected number of uses to `total`; log probabilities of the words."""
        n, size, top = arcs.shape
        alpha = self.forward(arcs)
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(size - 1, -1, -1):
                terms = np.stack([beta[i + m] + self.log_p[arcs[:, i, m - 1]] for m in range(1, min(size - i, top) + 1)])
                most = terms.max(0)
                beta[i] = most + np.log(np.exp(terms - most).sum(0))
                use = np.exp(alpha[i] + terms - alpha[size]) * weight
                own = arcs[:, i, : len(terms)].T.ravel()
                total += np.bincount(own, np.nan_to_num(use).ravel(), self.none + 1)
        return alpha[size]

    def _spelt(self, word: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, numbers) of the pieces that start in one block of a word, by start."""
        hi = min(lo + _BLOCK, len(word))
        arcs = self.arcs(word[None, lo : hi + self.longest - 1])[0, : hi - lo]
        at, m = np.nonzero(arcs != self.none)
        return at + lo, at + lo + m + 1, arcs[at, m]

    def long_word(self, word: bytes, weight: float = 0.0, total: np.ndarray | None = None, log_p: np.ndarray | None = None) -> float:
        """Log probability of one word of any length, in blocks; adds its pieces' expected uses to `total`."""
        log_p = self.log_p if log_p is None else log_p
        raw = np.frombuffer(word, np.uint8)
        size, blocks = len(raw), range(0, len(raw), _BLOCK)

        def both(a: float, b: float) -> float:
            if a < b:
                a, b = b, a
            return a if b == -math.inf else a + math.log1p(math.exp(b - a))

        alpha, beta = array("d", [-math.inf]) * (size + 1), array("d", [-math.inf]) * (size + 1)
        alpha[0] = beta[size] = 0.0
        for lo in blocks:
            starts, ends, own = self._spelt(raw, lo)
            for i, j, p in zip(starts.tolist(), ends.tolist(), log_p[own].tolist(), strict=True):
                alpha[j] = both(alpha[j], alpha[i] + p)
        if total is not None and alpha[size] > -math.inf:
            for lo in reversed(blocks):
                starts, ends, own = self._spelt(raw, lo)
                cost = log_p[own]
                for i, j, p in zip(starts[::-1].tolist(), ends[::-1].tolist(), cost[::-1].tolist(), strict=True):
                    beta[i] = both(beta[i], beta[j] + p)
                use = np.exp(np.frombuffer(alpha)[starts] + cost + np.frombuffer(beta)[ends] - alpha[size]) * weight
                total += np.bincount(own, use, self.none + 1)
        return alpha[size]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray | None = None, plain: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, expected uses) of the byte spans, each with a blank before it.
        With `weight`, words of weight 0 are passed over.  With `plain`, other pieces' log
        probabilities, the words' by those stand in place of the uses."""
        out, total = np.zeros(len(starts)), np.zeros(self.none + 1)
        other = np.zeros(len(starts)) if plain is not None else None
        plain = np.concatenate([plain, [-np.inf]]) if plain is not None else None
        lens = ends - starts
        for size in np.unique(lens).tolist():
            own = np.flatnonzero((lens == size) & (weight > 0) if weight is not None else lens == size)
            if size > _LONG:
                for k in own.tolist():
                    word = b" " + data[starts[k] : ends[k]].tobytes()
                    out[k] = self.long_word(word) if weight is None else self.long_word(word, float(weight[k]), total)
                    if other is not None:
                        other[k] = self.long_word(word, log_p=plain)
                continue
            step = max(1, 400_000 // ((size + 1) * min(size + 1, self.longest)))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                words = np.full((len(part), size + 1), 32, np.uint8)
                words[:, 1:] = data[starts[part][:, None] + np.arange(size)]
                arcs = self.arcs(words)
                out[part] = self.forward(arcs)[-1] if weight is None else self.expected(arcs, weight[part], total)
                if other is not None:
                    other[part] = self.forward(arcs, plain)[-1]
        return out, total[:-1] if other is None else other


# ------------------------------------------------------------------ words


def _join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The spans, each followed by a blank."""
    lens = ends - starts
    to = np.cumsum(lens + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    skip = np.repeat(to - lens - 1, lens)
    within = np.arange(len(skip)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[skip + within] = data[np.repeat(starts, lens) + within]
    return out.tobytes()


def _spans_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes) of blank-separated words."""
    data = np.frombuffer(blob, np.uint8)
    starts, ends, _ = K.word_spans(data, np.array([0, len(data)]))
    return data, starts, ends, K.span_hashes(data, starts, ends)


_CHUNK = "chunk long, part int, words binary, counts binary, ids array<long>, held array<boolean>, bounds binary, places binary, n_words long"
_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("bounds", pa.binary()), ("places", pa.binary()), ("n_words", pa.int64())])


class _Chunk:
    """Texts that share one list of distinct words."""

    def __init__(self) -> None:
        self.size = 0
        self.slices: list[tuple[np.ndarray, np.ndarray, dict]] = []  # places in its own list, bounds, row
        self.lists: list[tuple[np.ndarray, bytes, np.ndarray]] = []  # hashes, words, counts

    def add(self, ids: list, held: list, learn: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        low = K.lower(data)
        starts, ends, bounds = K.word_spans(low, offsets)
        hashes, where, back = np.unique(K.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        counts = np.bincount(back[np.repeat(learn, np.diff(bounds))], minlength=len(hashes))
        self.lists.append((hashes, _join_words(low, starts[where], ends[where]), counts))
        self.slices.append((back.astype(np.uint32), bounds, {"ids": ids, "held": held}))
        self.size += len(data)

    def rows(self, chunk: int, parts: int) -> Iterator[dict]:
        every = np.concatenate([h for h, _, _ in self.lists])
        data = np.frombuffer(b"".join(w for _, w, _ in self.lists), np.uint8)
        starts, ends, _ = K.word_spans(data, np.array([0, len(data)]))
        hashes, where, back = np.unique(every, return_index=True, return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, _, c in self.lists]), len(hashes)).astype(np.int64)
        part = (hashes % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edge)).tolist():
            own = order[edge[p] : edge[p + 1]]
            w = where[own]
            yield {"chunk": chunk, "part": p, "words": _join_words(data, starts[w], ends[w]), "counts": counts[own].tobytes()}
        # a word's place: the parts in turn, in each the words as they were sent
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        at = 0
        for (places, bounds, row), (own, _, _) in zip(self.slices, self.lists, strict=True):
            yield row | {"chunk": chunk, "part": -1, "bounds": bounds.astype(np.int64).tobytes(), "places": rank[back[at : at + len(own)]][places].tobytes(), "n_words": len(order)}
            at += len(own)


def _chunks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, _Chunk()

        def out() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for row in held.rows(TaskContext.get().partitionId() << 32 | made, parts):
                rows.append(row)
                size += sum(len(v) for v in row.values() if isinstance(v, bytes))
                if len(rows) == 64 or size > SLICE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CHUNK_SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_CHUNK_SCHEMA)

        for batch in batches:
            for i, j, data, offsets in K.pieces(batch.column(3), SLICE_BYTES):
                ids, kept, learn = (batch.column(c).slice(i, j - i) for c in range(3))
                held.add(ids.to_pylist(), kept.to_pylist(), learn.to_numpy(zero_copy_only=False).astype(bool), data, offsets)
                if held.size >= CHUNK_BYTES:
                    yield from out()
                    made, held = made + 1, _Chunk()
        if held.slices:
            yield from out()

    return run


def _merge(key, table):
    """All that the chunks sent to one part: its distinct words and their counts."""
    words = b"".join(w.as_py() for w in table.column("words"))
    counts = np.frombuffer(b"".join(c.as_py() for c in table.column("counts")), np.int64)
    data, starts, ends, hashes = _spans_of(words)
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(back, counts, len(where)).astype(np.int64)
    return pa.table({"part": [key[0].as_py()], "words": [_join_words(data, starts[where], ends[where])], "counts": [total.tobytes()], "n": [int(total.sum())], "v": [int((total > 0).sum())]}, schema=_WORDS)


_WORDS = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        total = np.zeros(lattice.none)
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                data, starts, ends, _ = _spans_of(words.as_py())
                total += lattice.words(data, starts, ends, (np.frombuffer(counts.as_py(), np.int64) > 0).astype(np.float64))[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    return run


def with_own_arc(log_spelt: np.ndarray, counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """Log probabilities of words (or of the end) by all arcs."""
    if not n:
        return log_spelt
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(counts - DISCOUNT, 0.0) / n), np.log(DISCOUNT * v / n) + log_spelt)


def _answer(shared, plain: np.ndarray, n: int, v: int):
    made: list[Lattice] = []  # one a task, for all its parts

    def run(key, table, asked):
        if not table.num_rows:
            return _ANSWER.empty_table()
        data, starts, ends, hashes = _spans_of(table.column("words")[0].as_py())
        counts = np.frombuffer(table.column("counts")[0].as_py(), np.int64)
        if not made:
            made.append(Lattice(*shared.value))
        spelt, plainly = made[0].words(data, starts, ends, plain=plain)
        scores = with_own_arc(spelt, counts, n, v)
        order = np.argsort(hashes)
        hashes, counts, scores, plainly = hashes[order], counts[order], scores[order], plainly[order]
        out = []
        for chunk, words in zip(asked.column("chunk"), asked.column("words"), strict=True):
            at = np.searchsorted(hashes, _spans_of(words.as_py())[3])
            out.append({"chunk": chunk.as_py(), "part": key[0].as_py(), "counts": counts[at].tobytes(), "scores": scores[at].tobytes(), "plain": plainly[at].tobytes()})
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return run


_ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("scores", pa.binary()), ("plain", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("plain_score", pa.float64())])


def _add_up(n: int, v: int, ends_seen: int, log_end: float):
    def run(key, docs, answers):
        if not docs.num_rows:
            return _SCORED.empty_table()
        got = sorted(zip(answers.column("part").to_pylist(), answers.column("counts"), answers.column("scores"), answers.column("plain"), strict=True), key=lambda x: x[0])
        counts = np.frombuffer(b"".join(c.as_py() for _, c, _, _ in got), np.int64)
        scores = np.frombuffer(b"".join(s.as_py() for _, _, s, _ in got), np.float64)
        plain = np.frombuffer(b"".join(s.as_py() for _, _, _, s in got), np.float64)
        norm = np.log10(n + 0.5 * (v + 1))
        base = np.log10(counts + 0.5) - norm
        known = (counts > 0).astype(np.float64)
        out = []
        for row in range(docs.num_rows):
            ids, held, bounds, places, n_words = (docs.column(c)[row].as_py() for c in ("ids", "held", "bounds", "places", "n_words"))
            bounds, places = np.frombuffer(bounds, np.int64), np.frombuffer(places, np.uint32)
            if len(counts) != n_words:
                raise ValueError("a chunk lacks answers to its words")
            words = np.diff(bounds)
            full = np.flatnonzero(words)

            def sums(x: np.ndarray) -> np.ndarray:
                total = np.zeros(len(words))
                if full.size:
                    total[full] = np.add.reduceat(x[places], bounds[:-1][full])
                return total

            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "held_out": pa.array(held, pa.bool_()),
                        "n_tokens": words + 1,
                        "n_known": np.rint(sums(known)).astype(np.int64) + (ends_seen > 0),
                        "base_score": sums(base) + np.log10(ends_seen + 0.5) - norm,
                        "score": (sums(scores) + log_end) / np.log(10.0),
                        "plain_score": (sums(plain) + np.log(FIRST_END)) / np.log(10.0),
                    },
                    schema=_SCORED,
                )
            )
        return pa.concat_tables(out)

    return run


def lattice_scores(docs: DataFrame, vocabulary: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, plain_score) for every row.

    Learns from rows where `held_out` is false and the id is not null.  A null or empty
    text is its end mark alone.  Repeated ids are separate rows.  Without training rows
    every base probability is 1 and the pieces keep their first probabilities.  An empty table
    gives no rows.  Scores are log10 probabilities; `plain_score` is that of the lattice by the
    vocabulary's own scores, without any learning.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), held_out.alias("held"), (~held_out & col(id_col).isNotNull()).alias("learn"), col(text_col).cast("string").alias("text"))
    ends_seen = rows.filter("learn").select("doc_id").count()
    parts = max(PARTS, min(1 << 16, rows.rdd.getNumPartitions() // 4))
    chunks = scratch.keep(rows.mapInArrow(_chunks(parts), _CHUNK), "chunks", compression="zstd")
    sent = chunks.filter("part >= 0").select("part", "chunk", "words", "counts")
    words = scratch.keep(sent.groupBy("part").applyInArrow(_merge, "part int, words binary, counts binary, n long, v long"), "words", compression="zstd")
    seen = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(seen.n or 0) + ends_seen, int(seen.v or 0) + (ends_seen > 0)

    pieces, p = load_pieces(vocabulary)
    log_p, log_end = np.log(p), np.log(FIRST_END)
    plain = log_p + np.log1p(-FIRST_END)
    # a part's words are few bytes and much work: parts are dealt out by number, not merged by size
    spread = words.repartition(parts, "part")
    for _ in range(rounds if n else 0):
        uses = np.zeros(len(pieces))
        for r in spread.select("words", "counts").mapInArrow(_expect(spark.sparkContext.broadcast((pieces, log_p))), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r.piece] = r.uses
        whole = uses.sum() + SMOOTH * len(pieces) + 1.0  # the end mark is one type
        log_p, log_end = np.log((uses + SMOOTH) / whole), -float(np.log(whole))
    log_end = float(with_own_arc(np.array([log_end]), np.array([ends_seen]), n, v)[0])

    answers = spread.groupBy("part").cogroup(sent.drop("counts").repartition(parts, "part").groupBy("part")).applyInArrow(_answer(spark.sparkContext.broadcast((pieces, log_p)), plain, n, v), "chunk long, part int, counts binary, scores binary, plain binary")
    own = chunks.filter("part < 0").select("chunk", "ids", "held", "bounds", "places", "n_words")
    out = own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_add_up(n, v, ends_seen, log_end), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, plain_score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "plain_score")
