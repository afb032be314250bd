"""Token ids of a corpus as a Huffman-coded file, and back.

A file is a folder of two Parquet tables, so that any store Spark can write
holds it and a lost task is simply run again:

- ``codes``: symbol, bits.  The canonical code follows from the lengths.
- ``blocks``: one row a block of whole documents in id order: ``part`` and
  ``block`` give its place, ``doc_ids`` and ``lens`` its documents, ``offsets``
  the bit offset of every 128th id (little-endian unsigned 32-bit), ``payload``
  the bits, most significant first, in big-endian 32-bit words.

Blocks decode independently, from any checkpoint, with one look-up an id.

Writing: one pass turns text into ids (a written table), global id counts give
the code (at most one row a vocabulary entry reaches the driver), a range
partition by id orders the documents, and each task packs its own blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitstrata.llm import huffman as H
from bitstrata.llm import kernels as K
from bitstrata.llm import scratch
from bitstrata.llm.subwords import word_ids

#: Ids after which a block ends with the document it is in.
BLOCK_IDS = 1 << 19
_BLOCK = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("offsets", pa.binary()), ("payload", pa.binary())])
_BLOCK_DDL = "part long, block long, n_docs long, n_ids long, doc_ids array<long>, lens array<long>, offsets binary, payload binary"


def _tokenise(path: str, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for i, j, ids, bounds in words.encode(batch.column(1)):
                ended = np.insert(ids, bounds[1:], end_id).astype(width)
                at = (bounds + np.arange(len(bounds))) * np.dtype(width).itemsize
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ended)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), raw], names=["doc_id", "ids"])

    return run


def _id_counts(size: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), width)
                if len(ids):
                    total[: int(ids.max()) + 1] += np.bincount(ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["symbol", "n"])

    return run


def _pack(shared, width: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        codes = H.canonical(lengths)
        part, block = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            payload, offsets = H.encode(np.concatenate(parts), codes, lengths)
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "n_docs": len(docs), "n_ids": held, "doc_ids": docs, "lens": [len(p) for p in parts], "offsets": offsets.astype("<u4").tobytes(), "payload": payload}], schema=_BLOCK)

        for batch in batches:
            for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer(), width)
                docs.append(doc.as_py())
                parts.append(ids)
                held += len(ids)
                if held >= block_ids:
                    yield row()
                    docs, parts, held, block = [], [], 0, block + 1
        if docs:
            yield row()

    return run


def _unpack(shared, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = H.decode_table(shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                part, block, n, docs, lens, offsets, payload = (batch.column(c)[r].as_py() for c in range(7))
                ids = H.decode(payload, np.frombuffer(offsets, "<u4"), n, table).astype("<u4")
                at = np.concatenate([[0], np.cumsum(lens)])
                raw = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                out = [pa.array([part] * len(docs)), pa.array([block] * len(docs)), pa.array(docs, pa.int64()), pa.array(np.arange(len(docs))), pa.array(at[:-1]), pa.array(lens, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["part", "block", "doc_id", "seq", "at", "n_tokens", "ids_crc32"]
                if texts:
                    out.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text of `docs` into a file at `path`, in ascending id order.

    A null or empty text has the end id alone.  Null ids come first; rows that repeat
    an id follow each other, in the order of their ids' hash.  An empty table makes a
    file without blocks.  Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = scratch.keep(rows.mapInArrow(K.trimming(_tokenise(vocabulary, end_id, width)), "doc_id long, ids binary"), "ids", compression="zstd")
    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(K.trimming(_id_counts(size, width)), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r.symbol] = r.n
    lengths = H.code_lengths(counts)
    spark.createDataFrame([(int(s), int(lengths[s]), int(counts[s])) for s in np.flatnonzero(lengths)], "symbol long, bits int, n long").coalesce(1).write.parquet(f"{path}/codes")
    ordered = ids.withColumn("h", F.xxhash64("ids")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
    ordered.mapInArrow(K.trimming(_pack(spark.sparkContext.broadcast(lengths), width, block_ids)), _BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop(ids)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, block[, ids]) of every document of a file.

    `start` counts the ids of all documents before it; `ids` are little-endian unsigned
    32-bit integers."""
    size = 0
    pairs = spark.read.parquet(f"{path}/codes").select("symbol", "bits").collect()
    size = max((r.symbol for r in pairs), default=0) + 1
    lengths = np.zeros(size, np.uint8)
    for r in pairs:
        lengths[r.symbol] = r.bits
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    kinds = "part long, block long, doc_id long, seq long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = blocks.select("part", "block", "n_ids", "doc_ids", "lens", "offsets", "payload").mapInArrow(K.trimming(_unpack(spark.sparkContext.broadcast(lengths), with_ids)), kinds)
    # ids before each part (a row a part), then before each block within its part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = blocks.select("part", "block", "n_ids").withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts.select("part", "before"), "part").select("part", "block", (F.col("own") + F.col("before")).alias("base"))
    out = docs.join(place, ["part", "block"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "block", *["ids"] * with_ids)


def read_span(spark: SparkSession, path: str, part: int, block: int, first: int, last: int) -> np.ndarray:
    """Ids first:last of one block, decoded from the nearest checkpoint before."""
    lengths = np.zeros(1, np.uint8)
    for r in spark.read.parquet(f"{path}/codes").select("symbol", "bits").collect():
        if r.symbol >= len(lengths):
            lengths = np.concatenate([lengths, np.zeros(r.symbol + 1 - len(lengths), np.uint8)])
        lengths[r.symbol] = r.bits
    b = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks").filter((F.col("part") == part) & (F.col("block") == block)).select("n_ids", "offsets", "payload").first()
    lo = first // H.STRIDE
    got = H.decode(bytes(b.payload), np.frombuffer(bytes(b.offsets), "<u4"), b.n_ids, H.decode_table(lengths), first=lo, last=-(-last // H.STRIDE))
    return got[first - lo * H.STRIDE : last - lo * H.STRIDE]
