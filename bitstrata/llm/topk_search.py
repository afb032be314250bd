"""Exact top-k by inner product: Fagin's threshold algorithm.

Vectors become integers, floor(256 x).  Candidates are packed, task by task, into
blocks; each block has one list a dimension, sorted by that component.  A query
reads the lists from the end that its own component favours, all to the same
depth; every id met is scored in full (random access).  No id that is still
unseen can score more than the sum of the query's components times the values at
that depth, and the query stops as soon as its k-th score is above this bound (at
a tie it reads on, so a smaller id is never missed).  Depth doubles from round to
round, so a query that cannot stop early costs one full read.

Where a block's and a query's components are so large that a sum of products could
leave the integers that a double holds, the same search runs on Python's integers.

Query blocks meet candidate blocks by a sort-merge join on a block group: a copy of
all query blocks goes to each group, far more than the planner sees in their table,
so they are never broadcast.  The number of groups keeps these copies within twice the
candidates' bytes.  The k best of each block are then ranked once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitstrata.llm import scratch

BLOCK_ROWS, QUERY_ROWS, MAX_GROUPS = 8192, 512, 4096
#: Groups that there may be whatever the queries' share of the rows.
FREE_GROUPS = 64
#: Queries that search a block side by side.
SIDE_BY_SIDE = 128
#: Integers up to here are exact as doubles.
EXACT = 1 << 53
#: A score beyond a long is given as the nearest long.
LARGEST = (1 << 63) - 1


def _raw(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where all fit, else as doubles."""
    return x.astype(np.int16 if np.abs(x).max(initial=0.0) < 1 << 15 else np.float64).tobytes()


def _vectors(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * rows * dim else np.float64).reshape(rows, dim).astype(np.float64)


def _pack(rows: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        made = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            own = held.pop(dim)
            made += 1
            x = np.stack([v for _, v in own])
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | made]), pa.array([dim], pa.int32()), pa.array([np.array([i for i, _ in own], np.int64).tobytes()], pa.binary()), pa.array([_raw(x)], pa.binary())], names=["block", "dim", "ids", "vectors"]
            )

        for batch in batches:
            lists = batch.column(1)
            flat, off = lists.flatten(), lists.offsets.to_numpy()
            values = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            off = off - off[0]
            for k, i in enumerate(batch.column(0).to_pylist()):
                v = values[off[k] : off[k + 1]]
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= rows:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return run


def _integers(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers as Python's integers."""
    out = np.empty(x.size, object)
    out[:] = [int(v) for v in x.ravel()]
    return out.reshape(x.shape)


class Lists:
    """A block's per-dimension lists, best first for either sign of the query."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order], np.float64)
        up = np.argsort(self.x, axis=0, kind="stable").T.astype(np.int32)
        self.lists = np.stack([up, up[:, ::-1]])  # [0]: small first, [1]: large first
        self.values = np.take_along_axis(self.x.T[None], self.lists, 2)
        self.top = int(np.abs(self.x).max(initial=0.0))
        self.large: np.ndarray | None = None

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of each query's k best, ties to the smaller id."""
        small = self.top * np.abs(q).max(1) * q.shape[1] < EXACT
        if not small.all() and self.large is None:
            self.large = _integers(self.x)
        out: list = [self._large(int(own[j]), q[j], k) if not small[j] else None for j in range(len(q))]
        at = np.flatnonzero(small)
        for lo in range(0, len(at), SIDE_BY_SIDE):
            some = at[lo : lo + SIDE_BY_SIDE]
            for j, found in zip(some.tolist(), self._together(own[some], q[some], k), strict=True):
                out[j] = found
        return out

    def _together(self, own: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The search of several queries, round by round: ids that any of those still searching
        meets are scored for all of these in one product."""
        n = len(self.ids)
        known, score = np.zeros(n, bool), np.empty((len(q), n))
        runs = [self._rounds(int(i), v, k, lambda places, j=j: score[j, places].astype(np.int64), lambda last, side, dims, v=v: int(self.values[side, dims, last] @ v[dims])) for j, (i, v) in enumerate(zip(own, q, strict=True))]
        live, out = list(range(len(q))), [None] * len(q)
        while live:
            asked, still = np.zeros(n, bool), []
            for j in live:
                met = next(runs[j])
                if isinstance(met, tuple):
                    out[j] = met
                else:
                    asked |= met
                    still.append(j)
            live, new = still, np.flatnonzero(asked & ~known)
            if live and len(new):
                score[np.ix_(live, new)] = q[live] @ self.x[new].T
                known[new] = True
        return out

    def _large(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The search of one query on Python's integers."""
        whole = _integers(q)
        clip = lambda x: max(-LARGEST, min(LARGEST, x))
        run = self._rounds(own, q, k, lambda places: np.array([clip(sum(a * b for a, b in zip(row, whole, strict=True))) for row in self.large[places]], np.int64), lambda last, side, dims: clip(sum(int(a) * b for a, b in zip(self.values[side, dims, last], whole[dims], strict=True))))
        while not isinstance(found := next(run), tuple):
            pass
        return found

    def _rounds(self, own: int, q: np.ndarray, k: int, scores: Callable, bound: Callable) -> Iterator:
        """Yields which places a round meets, before it asks for their scores; at the end the result."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        side = (q[dims] > 0).astype(np.int64)
        fresh = self.ids != own
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(dims):
            best = np.flatnonzero(fresh)[:k]
            yield best, np.zeros(len(best), np.int64)
            return
        depth, step = 0, max(8, n // 64)
        while depth < n and fresh.any():
            to = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.lists[side, dims, depth:to]] = True
            met &= fresh
            fresh &= ~met
            yield met
            new = np.flatnonzero(met)
            best, score = np.concatenate([best, new]), np.concatenate([score, scores(new)])
            if len(best) > k:
                top = np.lexsort((best, -score))[:k] if len(best) <= 64 else self._top(best, score, k)
                best, score = best[top], score[top]
            if len(best) == k and int(score.min()) > bound(to - 1, side, dims):
                break
            depth, step = to, 2 * step
        yield best, score

    @staticmethod
    def _top(best: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((best[some], -score[some]))[:k]]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lists = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                block, dim, q_ids, q = (batch.column(c)[r].as_py() for c in (0, 1, 4, 5))
                if block != last:
                    ids = np.frombuffer(batch.column(2)[r].as_py(), np.int64)
                    last, lists = block, Lists(ids, _vectors(batch.column(3)[r].as_py(), len(ids), dim))
                queries = np.frombuffer(q_ids, np.int64)
                out = lists.search(queries, _vectors(q, len(queries), dim), k)
                n = [len(b) for b, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, n)), pa.array(lists.ids[np.concatenate([b for b, _ in out])]), pa.array(np.concatenate([s for _, s in out]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to the smaller id.

    Vectors that are null, empty, or hold a null or non-finite component take no part,
    nor do rows with a null id.  An id that repeats counts once, with the least of its
    vectors, and is a query if any of its rows is.  Vectors of different length are not
    compared.  A query is never its own candidate; with fewer than k candidates it has
    them all.  An empty table gives no rows.  Scores are exact for components of any
    size; one beyond a long counts as the nearest long, ties still to the smaller id.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).groupBy("id").agg(F.min("v").alias("v"), F.bool_or("q").alias("q"))
    rows = scratch.keep(rows, "vectors")
    kinds = "block long, dim int, ids binary, vectors binary"
    blocks = scratch.keep(rows.select("id", "v").mapInArrow(_pack(BLOCK_ROWS, scale), kinds), "blocks")
    queries = scratch.keep(rows.filter("q").select("id", "v").mapInArrow(_pack(QUERY_ROWS, scale), kinds), "queries")
    n, asking = rows.agg(F.count("*"), F.count_if("q")).first()
    groups = max(1, min(MAX_GROUPS, blocks.count(), max(FREE_GROUPS, 2 * n // max(1, asking))))
    asked = queries.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    pairs = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(asked.hint("merge"), ["g", "dim"])
    found = pairs.select("block", "dim", "ids", "vectors", "q_ids", "q").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
