"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are parted by the size of their shingle set.  An item's signature is, for
each of its class's `PROBES` permutations, the shingle that comes first; the share
of these that a document holds is an unbiased estimate of the share of the whole
item that it holds, however long the document.  An item of any size that is held
to 0.8 is missed with probability 0.2 ** PROBES < 1e-16 at most.  Documents that
hold any signature shingle are compared with the item's full set, exactly.

Texts are read once per block of items; a block's size is bounded
(`BLOCK_SHINGLES`), so what is broadcast is too, and a larger benchmark means
more blocks, not less work.  One block is alive at a time: with several, the hits of
each are written as a table before the next is gathered, and meet the documents by
id and text at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitstrata.llm import kernels as K
from bitstrata.llm import scratch
from bitstrata.llm.names import col, fresh, quoted, schema_of

PROBES, BLOCK_SHINGLES, SEED = 24, 1 << 20, 20250202


def _item_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.pieces(batch.column(1)):
                starts, ends, bounds = K.word_spans(data, offsets)
                sets, at = K.distinct_in_rows(*K.shingles(K.span_hashes(K.lower(data), starts, ends), bounds, size))
                raw = [sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.minimum(np.diff(bounds), size)), pa.array(np.diff(at)), pa.array(raw, pa.binary())], names=["item_id", "words", "n", "set"])

    return run


class Index:
    """A block of items, ready to be searched."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], size: int, threshold: float):
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, _, s in items]
        self.lengths = sorted({w for _, w, _ in items if w < size})
        self.size, self.threshold = size, threshold
        probe, owner = [], []
        for k, (_, _, s) in enumerate(items):
            a, b = K.permutations(PROBES * (1 + len(s).bit_length()), SEED)
            own = slice(PROBES * len(s).bit_length(), PROBES * (1 + len(s).bit_length()))  # its size class's permutations
            low = (s >> np.uint64(32)).astype(np.uint32)
            p = np.unique(s[(low[None, :] * a[own, None] + b[own, None]).argmin(1)])
            probe.append(p)
            owner.append(np.full(len(p), k))
        flat, own = (np.concatenate(probe), np.concatenate(owner)) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(flat, kind="stable")
        self.probes, self.owners = flat[order], own[order]
        self.bits = max(16, min(24, 6 + int(len(flat)).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.probes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item's place, shingles in common) for every item that a text holds."""
        starts, ends, bounds = K.word_spans(data, offsets)
        words = K.span_hashes(K.lower(data), starts, ends)
        runs = []  # of shingles and the text each is in
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        for n in (*self.lengths, self.size):
            h = K.chain_hashes(words, n)
            if len(h):
                whole = row[: len(h)] == row[n - 1 :]
                runs.append((h, row[: len(h)], whole))
        seen: dict[tuple[int, int], None] = {}
        for h, r, whole in runs:
            at = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)] & whole)
            lo, hi = np.searchsorted(self.probes, h[at], "left"), np.searchsorted(self.probes, h[at], "right")
            for k in np.flatnonzero(hi > lo):
                for item in self.owners[lo[k] : hi[k]].tolist():
                    seen[int(r[at[k]]), item] = None
        rows: dict[int, np.ndarray] = {}
        for d, item in seen:
            if d not in rows:
                rows[d] = np.unique(np.concatenate([h[(a := int(np.searchsorted(r, d, "left"))) : (b := int(np.searchsorted(r, d, "right")))][w[a:b]] for h, r, w in runs]))
            mine = rows[d]
            s = self.sets[item]
            at = np.minimum(np.searchsorted(mine, s), max(len(mine) - 1, 0))
            common = int(np.count_nonzero(mine[at] == s))
            if common >= self.threshold * len(s) - 1e-9:
                yield d, item, common


HITS = "array<struct<item_id:bigint,n_shingles:bigint,n_common:bigint>>"


def _flag(shared, at: int, name: str):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_common", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, _, data, offsets in K.pieces(batch.column(at)):
                for d, item, common in index.search(data, offsets):
                    hits[i + d].append({"item_id": index.ids[item], "n_shingles": len(index.sets[item]), "n_common": common})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], names=[*batch.schema.names, name])

    return run


def item_blocks(benchmark: DataFrame, size: int, threshold: float, item_col: str, text_col: str) -> tuple[int, Iterator[Index]]:
    """How many blocks there are, and the blocks; the items' sets are made once."""
    items = benchmark.select(col(item_col).cast("long").alias("item_id"), col(text_col).cast("string").alias("text")).filter("item_id is not null")
    sets = scratch.keep(items.mapInArrow(_item_sets(size), "item_id long, words long, n long, set binary").filter("n > 0"), "items")
    blocks = max(1, -(-int(sets.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES))

    def gathered() -> Iterator[Index]:
        for k in range(blocks):
            own = sets.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
            yield Index(sorted(((r.item_id, r.words, np.frombuffer(bytes(r.set), np.uint64)) for r in own.collect()), key=lambda x: x[0]), size, threshold)
        scratch.drop(sets)

    return blocks, gathered()


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id", hits_col: str = "hits") -> DataFrame:
    """`docs` with `hits_col`: the items of which it holds at least `threshold` of the shingles.

    An item shorter than `size` words is its whole word sequence and is held if that
    stands anywhere in the text.  Items with a null id, and items or texts that are
    null, empty or without words, match nothing; rows that repeat an item's id are
    items of their own.  Rows of `docs` may repeat, and ids may be null.  An empty
    benchmark leaves the hits empty; an empty table gives no rows.  A column of `docs`
    called `hits_col` is replaced; the others pass through, whatever their names.
    """
    spark, keep = docs.sparkSession, [c for c in docs.columns if c.lower() != hits_col.lower()]
    blocks, found = item_blocks(benchmark, size, threshold, item_col, item_text_col)
    own = docs.select(*[col(c) for c in keep])
    if text_col not in keep:
        raise ValueError(f"{text_col} is not a column of the documents beside {hits_col}")
    if blocks == 1:
        out = own.mapInArrow(K.trimming(_flag(spark.sparkContext.broadcast(next(found)), keep.index(text_col), hits_col)), schema_of(docs, keep, f"{quoted(hits_col)} {HITS}"))
        next(found, None)
        return out
    key = [F.xxhash64(col(id_col), col(text_col)), F.xxhash64(F.lit(1), col(text_col), col(id_col))]
    texts, tables = docs.select(*[k.alias(n) for k, n in zip(key, "ab", strict=True)], col(text_col).alias("text")), []
    for index in found:
        shared = spark.sparkContext.broadcast(index)
        hits = texts.mapInArrow(K.trimming(_flag(shared, 2, "hits")), f"a long, b long, text string, hits {HITS}").filter("size(hits) > 0").select("a", "b", "hits")
        tables.append(scratch.keep(hits, "hits"))
        shared.destroy()
    # a document has hits in few blocks; rows equal in id and text have the same
    every = reduce(DataFrame.unionByName, tables).dropDuplicates(["a", "b", "hits"]).groupBy("a", "b").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    a, b, h = fresh([*keep, hits_col], "a", "b", "h")
    joined = own.withColumn(a, key[0]).withColumn(b, key[1]).join(every.toDF(a + "_", b + "_", h), (col(a) == col(a + "_")) & (col(b) == col(b + "_")), "left")
    return joined.select(*[col(c) for c in keep], F.coalesce(col(h), F.array().cast(HITS)).alias(hits_col))
