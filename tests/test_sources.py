import struct

import numpy as np
import pytest

from bitstrata.operators import coders, codecs, roi
from bitstrata.sources import segy, volumes


def make_file(path, code, samples=50, traces=23):
    rng = np.random.default_rng(3)
    head = bytearray(3600)
    struct.pack_into(">HHH", head, 3216, 2000, 0, samples)
    struct.pack_into(">H", head, 3224, code)
    values = np.round(rng.normal(0, 20, (traces, samples))).astype(np.float32)
    body = b""
    for k in range(traces):
        h = bytearray(240)
        struct.pack_into(">i", h, 188, k // 5)
        struct.pack_into(">i", h, 192, k % 5)
        struct.pack_into(">i", h, 76, 100 * k)
        body += bytes(h) + segy.encode_samples(values[k], code)
    path.write_bytes(bytes(head) + body)
    return bytes(head), values


@pytest.mark.parametrize("code", [1, 2, 3, 5, 8])
def test_segy_round_trip(spark, tmp_path, code):
    head, values = make_file(tmp_path / "a.sgy", code)
    spark.dataSource.register(segy.SegySource)
    df = spark.read.format("segy").option("path", f"file://{tmp_path}/a.sgy").option("traces", "7").load()
    got = df.orderBy("trace_seq").collect()
    assert [r.inline for r in got] == [k // 5 for k in range(23)]
    assert np.allclose(np.array([r.samples for r in got]), values, rtol=1e-6)
    segy.write_segy(df, f"file://{tmp_path}/b.sgy", head)
    assert (tmp_path / "b.sgy").read_bytes() == (tmp_path / "a.sgy").read_bytes()
    assert segy.header_sidecar(df, head).count() == 24


def test_segy_strict(spark, tmp_path):
    make_file(tmp_path / "a.sgy", 5)
    from pyarrow import fs

    with pytest.raises(ValueError):
        segy.file_info(fs.LocalFileSystem(), str(tmp_path / "a.sgy"), strict=True)


def test_ibm_words():
    assert segy.ibm_to_float(np.array([0xC276A000], np.uint32))[0] == np.float32(-118.625)
    v = np.array([0.0, 1.0, -118.625, 1e-3, 12345.678, np.nan, np.inf], np.float32)
    again = segy.ibm_to_float(segy.float_to_ibm(v))
    assert np.allclose(again[:5], v[:5], rtol=1e-6) and not again[5:].any()


def test_raw_volume(spark, tmp_path):
    x = np.arange(2 * 3 * 8, dtype="<f4").reshape(2, 3, 8)
    (tmp_path / "v.dat").write_bytes(x.tobytes())
    rows = volumes.raw_volume(spark, f"file://{tmp_path}/v.dat", 3, 8).orderBy("p", "t").collect()
    assert np.array_equal(np.array([r.samples for r in rows], "f4").reshape(2, 3, 8), x)


@pytest.mark.parametrize("kind", sorted(volumes.SYNTHETIC))
def test_synthetic(spark, kind):
    df = volumes.synthetic_volume(spark, kind, (2, 5, 8))
    assert df.count() == 80 and df.filter("v is null").isEmpty()


def test_micro_loco(spark):
    from bitstrata.operators.neighbours import residuals

    plane = [[10, 12, 11], [13, 250, 0], [255, 1, 2]]
    df = spark.createDataFrame([(0, t, s, e) for t, r in enumerate(plane) for s, e in enumerate(r)], "p int, t int, s int, e int")
    got = {(r.t, r.s): (r.pred, r.r) for r in residuals(df).collect()}
    assert [[got[t, s][0] for s in range(3)] for t in range(3)] == [[0, 10, 12], [10, 15, 249], [13, 255, 0]]
    assert [[got[t, s][1] for s in range(3)] for t in range(3)] == [[10, 2, 255], [3, 235, 7], [242, 2, 2]]


def test_micro_rectangles(spark):
    rows = [(0, t, s, float(t in (1, 3))) for t in range(5) for s in range(2)]
    v = spark.createDataFrame(rows, "p int, t int, s int, v float")
    assert [tuple(r) for r in roi.rectangles(v, 0, 2).collect()] == [(0, 1, 4)]
    assert [tuple(r) for r in roi.rectangles(v, 0, 2, margin=1).collect()] == [(0, 0, 5)]


@pytest.mark.parametrize("seed", range(6))
def test_plane_round_trip(seed):
    rng = np.random.default_rng(seed)
    plane = rng.integers(0, 256, (int(rng.integers(1, 40)), int(rng.integers(1, 40)))) if seed % 2 else np.clip(np.cumsum(rng.integers(-2, 3, (30, 40)), 1) + 100, 0, 255)
    freq = np.full((9, 256), 128, np.int64)
    assert (coders.decode_plane(coders.encode_plane(plane, freq), freq) == plane).all()
    with pytest.raises(ValueError):
        coders.decode_plane(coders.encode_plane(plane, freq), np.roll(freq * 2, 1, 1)[:, ::-1])


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
@pytest.mark.parametrize("raw", [b"", b"a", b"\xff" * 600, b"abc" * 400, bytes(range(256)) * 3, b"\xff\xff\x00\x00\x00"])
def test_codecs(name, raw):
    pack, unpack = codecs.CODECS[name]
    assert unpack(pack(raw)) == raw


def test_stream(spark, tmp_path):
    from bitstrata.streaming.incremental import stream_exponents, stream_runs

    spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([1, 1, -1, -1, -1, 1])], "k long, i long, v double").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    src = spark.readStream.schema("k long, i long, v double").parquet(f"file://{tmp_path}/in")
    q = stream_exponents(src).writeStream.outputMode("complete").format("memory").queryName("ex").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.e, r.n) for r in spark.table("ex").collect()] == [(127, 6)]
    from pyspark.sql import functions as F

    q = stream_runs(src.withColumn("sgn", (F.col("v") < 0).cast("int")), "k", "i", "sgn").writeStream.outputMode("append").format("memory").queryName("rn").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.length, r.value) for r in spark.table("rn").collect()) == [(2, 0), (3, 1)]
