"""Plain little-endian float32 files as a Spark data source, and blocks of them.

    spark.dataSource.register(RawSource)
    spark.read.format("float32").options(path=uri, samples=2001).load()

One row a trace of `samples` values: (file, trace, samples).  Options: `path` (a file, or a
folder of .dat files, on any store pyarrow knows), `offset` and `count` (bytes of one file),
`traces` a partition.  Partitions are byte ranges and come as Arrow batches.  Writing makes a
folder with one file a task, each named by the first trace it holds, so that files in the
order of their names are the traces in order; nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, trace bigint, samples array<float>"
#: Bytes that are copied at once.
CHUNK = 64 << 20
#: Traces a batch.
BATCH = 512


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, base: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last, self.base = path, first, last, base


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.samples = options["path"], int(options["samples"])
        self.step = int(options.get("traces", 65536))
        self.offset = int(options.get("offset", 0))
        self.count = int(options["count"]) if "count" in options else None

    def partitions(self):
        store, path = pafs.FileSystem.from_uri(self.uri)
        at = store.get_file_info(path)
        files = [at] if at.type == pafs.FileType.File else sorted((x for x in store.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".dat")), key=lambda x: x.path)
        out, before, each = [], 0, 4 * self.samples
        for f in files:
            size = f.size - self.offset if self.count is None else self.count
            if size < 0 or size % each or self.offset + size > f.size:
                raise ValueError(f"{f.path}: {f.size} bytes from {self.offset} are no whole traces of {self.samples} samples, or too few")
            n = size // each
            out += [_Range(f.path, before + a, before + min(a + self.step, n), self.offset - before * each) for a in range(0, n, self.step)]
            before += n
        return out or [InputPartition(None)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        if part.value is None:
            return
        store, _ = pafs.FileSystem.from_uri(self.uri)
        each = 4 * self.samples
        with store.open_input_file(part.path) as f:
            for a in range(part.first, part.last, BATCH):
                n = min(BATCH, part.last - a)
                values = np.frombuffer(f.read_at(n * each, part.base + a * each), "<f4")
                off = pa.array(np.arange(n + 1, dtype=np.int32) * self.samples)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(off, pa.array(values))], names=["file", "trace", "samples"])


@dataclass
class _Part(WriterCommitMessage):
    path: str
    final: str


class RawWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.uri = options["path"]

    def write(self, rows):
        from pyspark import TaskContext

        store, path = pafs.FileSystem.from_uri(self.uri)
        store.create_dir(path)
        part = f"{path}/.part-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        first = None
        with store.open_output_stream(part) as out:
            for r in rows:
                first = r.trace if first is None else first
                out.write(np.array(r.samples, "<f4").tobytes())
        if first is None:
            store.delete_file(part)
            return None
        return _Part(part, f"{path}/{first:015d}.dat")

    def commit(self, messages):
        store, _ = pafs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None:
                store.move(m.path, m.final)

    def abort(self, messages):
        store, _ = pafs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class RawSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "float32"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options)


def read_raw(spark: SparkSession, uri: str, samples: int, **options: int) -> DataFrame:
    spark.dataSource.register(RawSource)
    return spark.read.format("float32").options(path=uri, samples=str(samples), **{k: str(v) for k, v in options.items()}).load()


def write_raw(traces: DataFrame, uri: str, order: str = "trace") -> None:
    """Rows (order, samples) as a folder of raw files, in ascending order."""
    traces.sparkSession.dataSource.register(RawSource)
    ordered = traces.select(F.lit("").alias("file"), F.col(order).cast("long").alias("trace"), F.col("samples").cast("array<float>").alias("samples")).repartitionByRange("trace").sortWithinPartitions("trace")
    ordered.write.format("float32").option("path", uri).mode("append").save()


# ------------------------------------------------------------ manifests


def totals(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("trace_count"), F.lit(0)).alias("traces"), F.coalesce(F.sum("value_count"), F.lit(0)).alias("values"))


def write_manifest(blocks: DataFrame, path: str, head: dict, values: int | None = None) -> dict:
    """One JSON document a folder: `head`, totals and the blocks; refused where the blocks' values are
    not `values` (a file's bytes / 4) or not traces times samples."""
    t = totals(blocks).first()
    if values is not None and t["values"] != values or "samples_per_trace" in head and t["values"] != t["traces"] * head["samples_per_trace"]:
        raise ValueError(f"blocks hold {t['values']} values, the source {values}")
    doc = head | {"total_blocks": t["blocks"], "total_traces": t["traces"], "total_values": t["values"]}
    packed = blocks.agg(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in doc.items()], F.sort_array(F.collect_list(F.struct("trace_offset", *[c for c in blocks.columns if c != "trace_offset"]))).alias("blocks"))).alias("value"))
    packed.coalesce(1).write.mode("overwrite").text(path)
    return doc


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's blocks, one row each, in order of their ids."""
    found = spark.read.option("multiLine", True).json(path)
    return found.select(F.explode("blocks").alias("b")).select("b.*")


def block_by_id(blocks: DataFrame, ids: DataFrame, id_col: str = "block_id") -> DataFrame:
    """The blocks asked for; of an id that repeats the one furthest on."""
    last = blocks.groupBy(id_col).agg(F.max_by(F.struct(*[c for c in blocks.columns if c != id_col]), "trace_offset").alias("b")).select(id_col, "b.*")
    return last.join(ids.select(id_col).distinct(), id_col)


def unavailable(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(block_id, reason) of blocks (block_id, path, byte_offset, byte_count) whose file (path, size) is
    missing, or whose range ends beyond it."""
    f = files.select(F.col("path").alias("fp"), "size")
    x = blocks.join(f, F.col("path") == F.col("fp"), "left")
    reason = F.when(F.col("size").isNull(), "missing").when(F.col("byte_offset") + F.col("byte_count") > F.col("size"), "beyond the end")
    return x.select("block_id", reason.alias("reason")).filter("reason is not null")


def list_files(spark: SparkSession, uri: str) -> DataFrame:
    """(path, size) of a folder's files."""
    store, path = pafs.FileSystem.from_uri(uri)
    rows = [(x.path, x.size) for x in store.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File]
    return spark.createDataFrame(rows, "path string, size long")


def extract_blocks(blocks: DataFrame, source: str, target: str, overwrite: bool = False) -> DataFrame:
    """(block_id, path, bytes, copied): each block's byte range of one file as a file of its own.

    Blocks are copied by the tasks that hold their rows, a bounded piece at a time; one that is
    there with the right size is left alone unless `overwrite` says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, src = pafs.FileSystem.from_uri(source)
        out, dst = pafs.FileSystem.from_uri(target)
        out.create_dir(dst)
        for b in batches:
            rows = []
            for name, at, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                path = f"{dst}/{name}.dat"
                there = out.get_file_info(path)
                copy = overwrite or there.type != pafs.FileType.File or there.size != n
                if copy:
                    with store.open_input_file(src) as f, out.open_output_stream(f"{path}.part") as to:
                        done = 0
                        while done < n:
                            piece = f.read_at(min(CHUNK, n - done), at + done)
                            if not piece:
                                raise ValueError(f"{source} ends before block {name} does")
                            to.write(piece)
                            done += len(piece)
                    out.move(f"{path}.part", path)
                rows.append((name, path, n, copy))
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows, strict=True)], names=["block_id", "path", "bytes", "copied"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("block_id", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("copied", pa.bool_())]))

    return blocks.select("block_id", F.col("byte_offset").cast("long").alias("byte_offset"), F.col("byte_count").cast("long").alias("byte_count")).mapInArrow(run, "block_id string, path string, bytes long, copied boolean")


def read_blocks(blocks: DataFrame, source: str, samples: int) -> DataFrame:
    """(block_id, trace, samples) of the traces of blocks, each read by its own byte range: of its own
    file (column `path`) from the start, where it has one, else of `source` at its offset."""
    rows = blocks.select("block_id", F.col("trace_offset").cast("long").alias("trace_offset"), F.col("byte_offset").cast("long").alias("byte_offset"), F.col("byte_count").cast("long").alias("byte_count"), (F.col("path") if "path" in blocks.columns else F.lit(None).cast("string")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, src = pafs.FileSystem.from_uri(source)
        each = 4 * samples
        for b in batches:
            for name, first, at, n, own in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                with store.open_input_file(own or src) as f:
                    for a in range(0, n // each, BATCH):
                        k = min(BATCH, n // each - a)
                        values = np.frombuffer(f.read_at(k * each, (0 if own else at) + a * each), "<f4")
                        off = pa.array(np.arange(k + 1, dtype=np.int32) * samples)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(np.arange(first + a, first + a + k)), pa.ListArray.from_arrays(off, pa.array(values))], names=["block_id", "trace", "samples"])

    return rows.mapInArrow(run, "block_id string, trace long, samples array<float>")


# Counts with a known layout (profiles, traces, samples), and trace lengths that are tried in turn.
KNOWN = {14400: (2, 60, 120), 40000: (2, 100, 200), 60000: (3, 100, 200)}
LENGTHS = (2001, 1500, 1000, 500, 250)


def infer_shape(size: Column, sidecar: Column | None = None) -> Column:
    """(profiles, traces, samples) of a file of `size` bytes: a sidecar's text "p,t,s", a known count,
    the first trace length that divides the count, else traces of about an 1/200 of it."""
    n = F.floor(size / 4).cast("long")
    shape = lambda p, t, s: F.struct(*[x.cast("long").alias(k) for k, x in (("profiles", p), ("traces", t), ("samples", s))])
    t = F.greatest(F.round(n / 200), F.lit(1))
    rule = F.coalesce(*[F.when(n == k, shape(*(F.lit(x) for x in v))) for k, v in KNOWN.items()], *[F.when(n % x == 0, shape(F.lit(1), F.floor(n / x), F.lit(x))) for x in LENGTHS], shape(F.lit(1), t, F.floor(n / t)))
    if sidecar is None:
        return rule
    part = F.split(F.regexp_replace(sidecar, r"[^0-9,]", ""), ",")
    return F.when(sidecar.isNotNull() & (F.size(part) == 3), shape(part[0], part[1], part[2])).otherwise(rule)
