"""SEG-Y files as a Spark data source: one row a trace, read by trace ranges.

    spark.dataSource.register(SegySource)
    spark.read.format("segy").option("path", uri).load()

Options: `path` (file, or folder of .sgy/.segy files, on any store pyarrow knows), `map`
("standard" or "ragged": where header fields are), `strict` ("true" refuses extended
headers, formats other than IBM float and partial traces), `traces` a partition.
Writing puts the 3600 bytes of `head` (base64) before the traces in `trace_seq` order.
"""

from __future__ import annotations

import base64
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from bitstrata.functions import bits as B
from bitstrata.sources.raw import write_raw

HEAD, TRACE_HEAD = 3600, 240
#: Traces a batch.
BATCH = 256
# Sample widths by format code, and byte offsets of trace header fields.
WIDTH = {1: 4, 2: 4, 3: 2, 4: 4, 5: 4, 8: 1}
FIELDS = {"standard": {"inline": 188, "xline": 192, "src_x": 72, "src_y": 76, "cdp": 20}, "ragged": {"inline": 188, "xline": 184, "src_x": 72, "src_y": 76, "cdp": 20}}
FAMILY = {1: "float", 5: "float", 2: "integer", 3: "integer"}
SCHEMA = "file string, trace_seq bigint, format int, header binary, inline int, xline int, src_x int, src_y int, cdp int, samples array<float>"


def ibm_to_float(words: np.ndarray) -> np.ndarray:
    w = words.astype(np.uint32)
    frac = (w & 0xFFFFFF).astype(np.float64) / (1 << 24)
    return (np.where(w >> 31, -1.0, 1.0) * frac * np.power(16.0, (w >> 24 & 127).astype(np.int64) - 64)).astype(np.float32)


def float_to_ibm(v: np.ndarray) -> np.ndarray:
    """Truncated fractions; 0, NaN and infinities give 0."""
    a = np.abs(v.astype(np.float64))
    ok = np.isfinite(a) & (a > 0)
    a = np.where(ok, a, 1.0)
    k = np.floor(np.log2(a) / 4)
    k += np.floor(a / 16.0**k * (1 << 24)) >= 1 << 24
    word = (np.where(v < 0, 1 << 31, 0) + ((k.astype(np.int64) + 64) << 24) + np.floor(a / 16.0**k * (1 << 24)).astype(np.int64)).astype(np.uint32)
    return np.where(ok, word, 0).astype(np.uint32)


def decode_samples(raw: bytes, code: int) -> np.ndarray:
    """Samples of any format as float32, one by one in its own width and sign."""
    if code == 1:
        return ibm_to_float(np.frombuffer(raw, ">u4"))
    if code == 4:  # a 16-bit gain, then a 16-bit value
        x = np.frombuffer(raw, ">i2").reshape(-1, 2)
        return (x[:, 1] * np.exp2(x[:, 0].astype(np.float64))).astype(np.float32)
    kind = {2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}[code]
    return np.frombuffer(raw, kind).astype(np.float32)


def encode_samples(v: np.ndarray, code: int) -> bytes:
    if code == 1:
        return float_to_ibm(v).astype(">u4").tobytes()
    kind = {2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}[code]
    return v.astype(kind).tobytes()


@dataclass
class FileInfo:
    path: str
    samples: int
    code: int
    interval: int
    traces: int
    rest: int


def file_info(store: pafs.FileSystem, path: str, strict: bool = False) -> FileInfo:
    with store.open_input_file(path) as f:
        size = f.size()
        head = f.read_at(min(HEAD, size), 0)
    if len(head) < HEAD:
        raise ValueError(f"{path} is shorter than its headers")
    interval, samples, code = (struct.unpack_from(">H", head, 3200 + at)[0] for at in (16, 20, 24))
    if samples <= 0 or code not in WIDTH:
        raise ValueError(f"{path}: {samples} samples of format {code}")
    each = TRACE_HEAD + samples * WIDTH[code]
    traces, rest = divmod(size - HEAD, each)
    if strict and (struct.unpack_from(">h", head, 3200 + 304)[0] or code != 1 or rest):
        raise ValueError(f"{path}: extended headers, a format other than 1, or a partial trace")
    return FileInfo(path, samples, code, interval, traces, rest)


class _Range(InputPartition):
    def __init__(self, uri: str, info: FileInfo, first: int, last: int):
        super().__init__((uri, first, last))
        self.uri, self.info, self.first, self.last = uri, info, first, last


class SegyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.fields = FIELDS[options.get("map", "standard")]
        self.strict = options.get("strict", "false").lower() == "true"
        self.step = int(options.get("traces", 4096))

    def partitions(self):
        store, path = pafs.FileSystem.from_uri(self.uri)
        at = store.get_file_info(path)
        files = [path] if at.type == pafs.FileType.File else sorted(x.path for x in store.get_file_info(pafs.FileSelector(path)) if x.path.lower().endswith((".sgy", ".segy")))
        out = []
        for p in files:
            info = file_info(store, p, self.strict)
            out += [_Range(self.uri, info, a, min(a + self.step, info.traces)) for a in range(0, info.traces, self.step)]
        return out or [InputPartition(None)]

    def read(self, part):
        if part.value is None:
            return
        store, _ = pafs.FileSystem.from_uri(part.uri)
        info = part.info
        each = TRACE_HEAD + info.samples * WIDTH[info.code]
        with store.open_input_file(info.path) as f:
            for a in range(part.first, part.last, BATCH):
                n = min(BATCH, part.last - a)
                raw = np.frombuffer(f.read_at(n * each, HEAD + a * each), np.uint8).reshape(n, each)
                heads = np.ascontiguousarray(raw[:, :TRACE_HEAD])
                fields = [pa.array(heads[:, at : at + 4].copy().view(">i4").ravel().astype(np.int32)) for at in self.fields.values()]
                off = np.arange(n + 1, dtype=np.int32)
                header = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off * np.int32(TRACE_HEAD)), pa.py_buffer(heads)])
                values = decode_samples(np.ascontiguousarray(raw[:, TRACE_HEAD:]).tobytes(), info.code)
                samples = pa.ListArray.from_arrays(pa.array(off * np.int32(info.samples)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([info.path] * n), pa.array(np.arange(a, a + n)), pa.array(np.full(n, info.code, np.int32)), header, *fields, samples], names=["file", "trace_seq", "format", "header", *self.fields, "samples"])


@dataclass
class _Part(WriterCommitMessage):
    path: str
    first: int


class SegyWriter(DataSourceWriter):
    """Each task writes its traces, in order, beside the target.  By default the parts are put
    together by the driver into one file; with `parts` each is a file with the head before it, in a
    folder, named by its first trace, and nothing goes through the driver."""

    def __init__(self, options: dict):
        self.uri, self.head = options["path"], base64.b64decode(options["head"])
        self.parts = options.get("parts", "false").lower() == "true"

    def write(self, rows):
        from pyspark import TaskContext

        store, path = pafs.FileSystem.from_uri(self.uri)
        ctx = TaskContext.get()
        part = f"{path}.part-{ctx.partitionId()}-{ctx.taskAttemptId()}"
        first = None
        if self.parts:
            store.create_dir(path)
        with store.open_output_stream(part) as out:
            if self.parts:
                out.write(self.head)
            for r in rows:
                first = r.trace_seq if first is None else first
                out.write(bytes(r.header) + encode_samples(np.array(r.samples, np.float32), r.format))
        return _Part(part, -1 if first is None else first)

    def commit(self, messages):
        store, path = pafs.FileSystem.from_uri(self.uri)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        if self.parts:
            for m in parts:
                if m.first < 0:
                    store.delete_file(m.path)
                else:
                    store.move(m.path, f"{path}/{m.first:015d}.sgy")
            return
        with store.open_output_stream(path) as out:
            out.write(self.head)
            for m in parts:
                with store.open_input_stream(m.path) as f:
                    while block := f.read(8 << 20):
                        out.write(block)
        for m in parts:
            store.delete_file(m.path)

    def abort(self, messages):
        store, _ = pafs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class SegySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegyReader:
        return SegyReader(self.options)

    def writer(self, schema, overwrite: bool) -> SegyWriter:
        return SegyWriter(self.options)


def write_segy(traces: DataFrame, uri: str, head: bytes, parts: bool = False) -> None:
    """Traces of the source's schema to one file, or with `parts` to a folder of files."""
    if len(head) != HEAD:
        raise ValueError("the file head has 3600 bytes")
    traces.sparkSession.dataSource.register(SegySource)
    ordered = traces.repartitionByRange("trace_seq").sortWithinPartitions("trace_seq")
    ordered.write.format("segy").option("path", uri).option("head", base64.b64encode(head).decode()).option("parts", str(parts).lower()).mode("append").save()


def header_sidecar(traces: DataFrame, head: bytes) -> DataFrame:
    """Headers as base64 JSON lines: the file's own, and each trace's."""
    file_head = traces.sparkSession.createDataFrame([(base64.b64encode(head[:3200]).decode(), base64.b64encode(head[3200:]).decode())], "text_header string, binary_header string")
    each = traces.select("trace_seq", F.base64("header").alias("header"))
    return each.select(F.to_json(F.struct("trace_seq", "header")).alias("value")).unionByName(file_head.select(F.to_json(F.struct("text_header", "binary_header")).alias("value")))


def segy_volume(traces: DataFrame, traces_per_profile: int) -> DataFrame:
    """Trace rows (p, t, samples) in file order."""
    n = F.lit(traces_per_profile)
    return traces.select(F.floor(F.col("trace_seq") / n).cast("int").alias("p"), (F.col("trace_seq") % n).cast("int").alias("t"), "samples")


def summary(traces: DataFrame) -> DataFrame:
    """(file, traces, min and max of inline and xline, inferred_from) of each file."""
    x = traces.groupBy("file").agg(F.count("*").alias("traces"), *[f(c).alias(f"{n}_{c}") for c in ("inline", "xline") for n, f in (("min", F.min), ("max", F.max))], F.count_if(F.col("inline") != 0).alias("lines"), F.count_if(F.col("src_x") != 0).alias("sources"))
    return x.withColumn("inferred_from", F.when(F.col("lines") > 0, "inline_3d").when(F.col("sources") > 0, "source_coords").otherwise("none")).drop("lines", "sources")


def family(code: Column) -> Column:
    """Kind of number of a sample format."""
    return F.coalesce(*[F.when(code == k, v) for k, v in FAMILY.items()], F.lit("unknown"))


def checked_union(*files: DataFrame) -> DataFrame:
    """All files' traces; refused where traces differ in length."""
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    lengths = out.select(F.size("samples").alias("n")).distinct().limit(2).count()
    if lengths > 1:
        raise ValueError("the files' traces differ in length")
    return out


def segy_components(traces: DataFrame, traces_per_profile: int) -> DataFrame:
    """(p, t, s, sgn, e, m) of every sample."""
    v = segy_volume(traces, traces_per_profile).select("p", "t", F.posexplode("samples").alias("s", "v")).withColumn("b", B.bits_of("v"))
    b = F.col("b")
    return v.select("p", "t", "s", B.sign(b).alias("sgn"), B.exponent(b).alias("e"), B.mantissa(b).alias("m"))


def to_raw(traces: DataFrame, uri: str) -> None:
    """All traces' samples as raw float32 files, in the order of the source."""
    write_raw(traces.select(F.col("trace_seq").alias("trace"), "samples"), uri)
