"""Coded streams, whole-volume codecs, raw blocks, manifests, patches and the network against plain restatements."""

import json
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitstrata.operators import blocks, coders, codecs, lanes, mantissa, neighbours, network, planning, streams
from bitstrata.sources import raw, segy
from test_sources import make_file


def frequencies(planes):
    n = np.ones((coders.CONTEXTS, 256), np.int64)
    for plane in planes:
        pred, ctx = coders.plane_context(plane)
        np.add.at(n, (ctx, (plane - pred) & 255), 40)
    f = np.maximum(1, n * ((1 << coders.BITS) - 256) // n.sum(1, keepdims=True))
    f[np.arange(len(f)), f.argmax(1)] += (1 << coders.BITS) - f.sum(1)
    return f


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 1, 9), (2, 7, 1), (3, 20, 31), (2, 90, 130)])
def test_block_codecs(shape):
    rng = np.random.default_rng(sum(shape))
    x = (120 + np.cumsum(rng.integers(-2, 3, shape), 2) // 2 + (rng.random(shape) < 0.02) * rng.integers(0, 255, shape)) & 255
    f = frequencies(x)
    assert (blocks.decode_diag(blocks.encode_diag(x, f), f) == x).all()
    rects = np.array([[k % shape[1], max(k % shape[1], shape[1] - k % 3)] for k in range(shape[0])])
    for own in (None, rects, rects * 0):
        got, _ = blocks.decode_raster(blocks.encode_raster(x, f, own), f)
        for k in range(shape[0]):
            a, b = (0, shape[1]) if own is None else own[k]
            assert (got[k, a:b] == x[k, a:b]).all() and not got[k, :a].any() and not got[k, b:].any()
    assert (blocks.decode_hybrid(blocks.encode_hybrid(x, f, rects), f) == x).all()
    other = frequencies(255 - x)
    if (other != f).any():
        with pytest.raises(ValueError):
            blocks.decode_diag(blocks.encode_diag(x, f), other)
    with pytest.raises(ValueError):
        coders.read_container(blocks.encode_hybrid(x, f, rects))


def test_size_of_a_stream_is_near_the_entropy():
    rng = np.random.default_rng(1)
    f = np.zeros((coders.CONTEXTS, 256), np.int64)
    f[:] = 1
    f[:, :8] = (np.array([0.5, 0.2, 0.1, 0.08, 0.05, 0.04, 0.02, 0.01]) * ((1 << 15) - 256)).astype(int)
    f[:, 0] += (1 << 15) - f.sum(1)
    symbols = rng.choice(256, 40_000, p=f[0] / f[0].sum())
    find, lo, freq = lanes.tables(f)
    s = symbols.reshape(1000, 40)
    words, state = lanes.encode(lo[0, s], freq[0, s], np.ones(s.shape, bool))
    bits = -np.log2(f[0, symbols] / f[0].sum()).sum()
    assert 8 * sum(map(len, words)) + 32 * 40 < 1.005 * bits + 32 * 40
    reader = lanes.Reader(words, state)
    own = np.arange(40)
    again = np.stack([reader.next(own, np.zeros(40, np.int64), find, lo, freq) for _ in range(1000)])
    assert (again == s).all()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1001])
def test_streams_of_a_block(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    got, m = streams.raw_streams(words), words & 0x7FFFFF
    signs = [int(w) >> 31 for w in words]
    assert got["sign_bits"] == bytes(sum(b << k for k, b in enumerate(signs[i : i + 8])) for i in range(0, n, 8))
    runs = []
    for k, b in enumerate(signs):
        if k and b == signs[k - 1]:
            runs[-1] += 1
        else:
            runs.append(1)
    assert list(got["sign_runs"]) == runs and np.frombuffer(got["sign_steps"], "<i2").tolist() == [0] * bool(runs) + [b - a for a, b in zip(runs, runs[1:])]
    assert got["whole"] == b"".join(int(x).to_bytes(3, "little") for x in m)
    assert got["mid_words"] == b"".join((int(x) >> 4 & 0x7FFF).to_bytes(2, "little") for x in m)
    assert list(got["side_bytes"]) == [(int(x) >> 19) << 4 | int(x) & 15 for x in m]
    bits = [int(x) >> (4 + k) & 1 for k in range(15) for x in m]
    bits += [0] * (-len(bits) % 8)
    assert got["mid_planes"] == bytes(sum(b << (7 - k) for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))
    assert (streams.unplanes(got["side_planes"], n, 8) == np.frombuffer(got["side_bytes"], np.uint8)).all()


def test_accounting(spark):
    """Known volumes: constant values cost nothing but exponents; sizes are those of the compressors."""
    rows = [(p, t, [3.14159] * 64) for p in range(4) for t in range(10)]
    df = spark.createDataFrame(rows, "p int, t int, samples array<float>")
    found = streams.totals(streams.sizes(df, 2)).collect()
    assert all(r.ok and r.n == 4 * 640 for r in found) and len(found) == len(streams.CANDIDATES)
    one = np.full(2 * 640, 3.14159, np.float32).view(np.uint32)
    by = {r.method: r for r in found}
    assert by["mantissa23_packed+zstd"].bytes == 2 * streams.zstd_size(streams.three_bytes(one & 0x7FFFFF), 9)[0]
    assert by["bitpack+lzma"].raw == 2 * 160 and by["mid15_bitshuffle_zstd"].raw == 2 * 1280 * 15 // 8
    best = {r.part: r for r in streams.best(streams.totals(streams.sizes(df, 2))).collect()}
    for part in ("sign", "mid", "side", "whole"):
        own = [r for r in found if r.part == part]
        least = min(own, key=lambda r: (r.bytes, r.ord))
        assert (best[part].method, best[part].bytes) == (least.method, least.bytes)
    chosen = streams.best(streams.totals(streams.sizes(df, 2)))
    s = {r.scheme: r for r in streams.schemes(chosen, 100.0).collect()}
    assert s["whole"].total == best["sign"].bytes + 100 + best["whole"].bytes
    assert s["split"].ratio == pytest.approx(4 * 2560 / (best["sign"].bytes + 100 + best["mid"].bytes + best["side"].bytes))
    assert s["whole"].bits_per_value == pytest.approx(8 * s["whole"].total / 2560) and streams.estimated_exponent_bytes(800, 1.25) == 125
    t = streams.timing(streams.totals(streams.sizes(df, 2)), 0.0).first()
    assert t.overhead == 0 and t.n == 2560


def test_values_from_streams(spark):
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2**32, (3, 9, 21), dtype=np.uint32)
    bits[(bits >> 23 & 255) == 255] &= ~np.uint32(1 << 30)  # no NaN, which is not equal to itself
    rows = [(p, t, [float(x) for x in bits[p, t].view(np.float32)]) for p in range(3) for t in range(9)]
    df = spark.createDataFrame(rows, "p int, t int, samples array<float>").repartition(4)
    f = frequencies((bits >> 23 & 255).astype(np.int64))
    e = blocks.decode_blocks(blocks.encode_blocks(blocks.exponent_traces(df), f, "diag", 2), f)
    got = {(r.p, r.t): np.array(r.samples, np.float32).view(np.uint32) for r in streams.unpack_values(streams.pack_values(df, 2), e).collect()}
    assert len(got) == 27 and all((got[p, t] == bits[p, t]).all() for p, t in got)
    packed = streams.pack_values(df, 4).first()
    assert zlib.decompress(packed.sign) == np.packbits((bits.ravel() >> 31).astype(np.uint8)).tobytes()


@pytest.mark.parametrize("data", [b"", b"a", b"\xff" * 700, b"abcabcabcx" * 300, bytes(range(256)) * 9, b"\0" * 40_000])
def test_matches(data):
    texts = [data, b"abc", data + data[:50], b""]
    for chain in (1, 8):
        assert [codecs.un_match_copy(x) for x in codecs.match_copy_many(texts, chain)] == texts
    assert codecs.un_run_length(codecs.run_length(data)) == data


def test_matches_take_bounded_memory(monkeypatch):
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(300)]
    text = lambda n: b" ".join(words[k] for k in rng.integers(0, 300, n))
    texts = [text(3000) for _ in range(150)] + [text(60_000)]  # 2.9 MB, the last longer than a stretch
    tracemalloc.start()
    got = codecs.match_copy_many(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20 and [codecs.un_match_copy(x) for x in got[-3:]] == texts[-3:]
    monkeypatch.setattr(codecs, "STRETCH", 1 << 30)
    assert [len(x) for x in got[-3:]] == [len(x) for x in codecs.match_copy_many(texts[-3:])]
    monkeypatch.setattr(codecs, "STRETCH", 40_000)
    assert [zlib.decompress(x) for x in codecs.match_copy_many(texts[-2:])] == [zlib.decompress(x) for x in got[-2:]]


# ------------------------------------------------------------ raw files and manifests


def test_raw_blocks(spark, tmp_path):
    x = np.arange(60 * 8, dtype="<f4").reshape(60, 8)
    (tmp_path / "v.dat").write_bytes(x.tobytes())
    uri = f"file://{tmp_path}/v.dat"
    got = raw.read_raw(spark, uri, 8, traces=7).orderBy("trace").collect()
    assert [r.trace for r in got] == list(range(60)) and np.array_equal(np.array([r.samples for r in got], "f4"), x)
    part = raw.read_raw(spark, uri, 8, offset=32 * 10, count=32 * 5).orderBy("trace").collect()
    assert np.array_equal(np.array([r.samples for r in part], "f4"), x[10:15])
    with pytest.raises(Exception):
        raw.read_raw(spark, uri, 7).collect()
    raw.write_raw(raw.read_raw(spark, uri, 8).repartition(5), f"file://{tmp_path}/parts")
    again = raw.read_raw(spark, f"file://{tmp_path}/parts", 8).orderBy("trace").collect()
    assert np.array_equal(np.array([r.samples for r in again], "f4"), x)
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("*.dat"))) == x.tobytes()

    plan = planning.regular_blocks(spark, 12, 5, 8, 5).withColumn("block_id", F.format_string("p%04d", "block"))
    doc = raw.write_manifest(plan, f"{tmp_path}/manifest", {"samples_per_trace": 8}, values=480)
    assert doc["total_traces"] == 60 and json.loads(next((tmp_path / "manifest").glob("part-*")).read_text())["total_values"] == 480
    with pytest.raises(ValueError):
        raw.write_manifest(plan, f"{tmp_path}/other", {"samples_per_trace": 8}, values=481)
    found = raw.read_manifest(spark, f"{tmp_path}/manifest")
    assert found.count() == 3 and raw.block_by_id(found, spark.createDataFrame([("p0001",), ("none",)], "block_id string")).count() == 1
    done = raw.extract_blocks(found, uri, f"file://{tmp_path}/blocks").collect()
    assert all(r.copied for r in done) and (tmp_path / "blocks" / "p0002.dat").read_bytes() == x[50:].tobytes()
    assert not any(r.copied for r in raw.extract_blocks(found, uri, f"file://{tmp_path}/blocks").collect())
    for rows in (found, found.join(spark.createDataFrame([(r.block_id, r.path) for r in done], "block_id string, path string"), "block_id")):
        read = raw.read_blocks(rows.filter("block_id <> 'p0000'"), uri, 8).orderBy("trace").collect()
        assert [r.trace for r in read] == list(range(25, 60)) and np.array_equal(np.array([r.samples for r in read], "f4"), x[25:])
    files = raw.list_files(spark, f"file://{tmp_path}/blocks")
    want = found.select("block_id", F.concat(F.lit(f"{tmp_path}/blocks/"), "block_id", F.lit(".dat")).alias("path"), F.lit(0).alias("byte_offset"), (F.col("byte_count") + F.when(F.col("block_id") == "p0001", 4).otherwise(0)).alias("byte_count"))
    want = want.unionByName(spark.createDataFrame([("p9", "/none", 0, 4)], "block_id string, path string, byte_offset int, byte_count long"))
    assert {tuple(r) for r in raw.unavailable(want, files).collect()} == {("p0001", "beyond the end"), ("p9", "missing")}


def test_shapes(spark):
    sizes = {4 * 14400: (2, 60, 120), 4 * 40000: (2, 100, 200), 4 * 2001 * 3: (1, 3, 2001), 4 * 1500: (1, 1, 1500), 4 * 777: (1, 4, 194)}
    df = spark.createDataFrame([(k, None) for k in sizes] + [(40, "2, 1, 5")], "size long, side string")
    got = {r.size: tuple(r.shape) for r in df.select("size", raw.infer_shape(F.col("size"), F.col("side")).alias("shape")).collect()}
    assert got == sizes | {40: (2, 1, 5)}


def test_segy_folder(spark, tmp_path):
    head, values = make_file(tmp_path / "a.sgy", 1)
    spark.dataSource.register(segy.SegySource)
    df = spark.read.format("segy").option("path", f"file://{tmp_path}/a.sgy").load()
    segy.write_segy(df.repartition(3), f"file://{tmp_path}/parts", head, parts=True)
    again = spark.read.format("segy").option("path", f"file://{tmp_path}/parts").load()
    assert again.count() == 23 and np.allclose(np.sort(np.array([r.samples for r in again.collect()]).ravel()), np.sort(values.ravel()), rtol=1e-6)
    s = segy.summary(df).first()
    assert (s.traces, s.min_inline, s.max_inline, s.max_xline, s.inferred_from) == (23, 0, 4, 4, "inline_3d")
    assert [r[0] for r in spark.createDataFrame([(1,), (3,), (9,)], "c int").select(segy.family(F.col("c"))).collect()] == ["float", "integer", "unknown"]
    assert segy.checked_union(df, again).count() == 46
    with pytest.raises(ValueError):
        segy.checked_union(df, df.withColumn("samples", F.slice("samples", 1, 3)))
    assert segy.segy_components(df, 5).count() == 23 * 50
    segy.to_raw(df, f"file://{tmp_path}/raw")
    got = raw.read_raw(spark, f"file://{tmp_path}/raw", 50).orderBy("trace").collect()
    assert np.allclose(np.array([r.samples for r in got]), values, rtol=1e-6)


# ------------------------------------------------------------ patches, scores, network


@pytest.mark.parametrize("mode", ["diagonal", "raster", "strict", "edge"])
def test_patch(mode):
    """Cell by cell, as the rule says it."""
    plane = np.random.default_rng(4).integers(0, 256, (6, 7))
    value, kind = neighbours.patch(plane, 0, 6, (5, 7), mode)
    for t in range(6):
        for s in range(7):
            for k in range(35):
                dt, ds = k // 7 - 2, k % 7 - 3
                tt, ss = t + dt, s + ds
                before = tt + ss < t + s if mode == "diagonal" else dt < 0 or (dt == 0 and ds < 0)
                inside = 0 <= tt < 6 and 0 <= ss < 7
                ct, cs = min(max(tt, 0), 5), min(max(ss, 0), 6)
                if mode == "edge":
                    want = (int(plane[ct, cs]), 1) if before else (0, 0)
                elif inside and before:
                    want = (int(plane[tt, ss]), 1)
                elif mode == "strict":
                    want = (0, 0)
                elif s > 0 and ct == t:
                    want = (int(plane[t, s - 1]), 2)
                elif t > 0 and (mode == "raster" or min(ct, t - 1) + cs < t + s):
                    want = (int(plane[min(ct, t - 1), cs]), 2)
                else:
                    want = (0, 0)
                assert (value[t, s, k], kind[t, s, k]) == want


def test_restored_from_residuals(spark):
    x = np.random.default_rng(5).integers(0, 256, (2, 8, 11))
    df = spark.createDataFrame([(p, t, x[p, t].tolist()) for p in range(2) for t in range(8)], "p int, t int, e array<int>")
    got = {(r.p, r.t): r.e for r in neighbours.restored_traces(neighbours.residual_traces(df)).collect()}
    assert all(got[p, t] == x[p, t].tolist() for p in range(2) for t in range(8))


def test_network(spark):
    assert network.parameters(6) == 23_216
    weights = network.random_weights(4, 3)
    x = np.random.default_rng(2).random((5, 4, 4, 6)).astype(np.float32)
    y = x
    for layer in network.LAYERS:
        w, b = weights[f"{layer}.weight"], weights[f"{layer}.bias"]
        out = np.zeros((5, len(w), 4, 6))
        for n, o, i, j in np.ndindex(out.shape):
            out[n, o, i, j] = b[o] + sum(w[o, c, a, d] * y[n, c, i + a - 1, j + d - 1] for c in range(y.shape[1]) for a in range(3) for d in range(3) if 0 <= i + a - 1 < 4 and 0 <= j + d - 1 < 6)
        y = np.maximum(out, 0)
    z = y.mean((2, 3)) @ weights["head.weight"].T + weights["head.bias"]
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(network.probabilities(x, weights), want, atol=1e-5)
    file = network.pack_weights(weights, feature_mode="diagonal")
    assert network.unpack_weights(file)[1] == {"feature_mode": "diagonal", "target_mode": "raw"}
    e = np.random.default_rng(3).integers(100, 140, (2, 6, 8))
    df = spark.createDataFrame([(p, t, e[p, t].tolist()) for p in range(2) for t in range(6)], "p int, t int, e array<int>")
    found = network.predict(neighbours.patches(df, (4, 6)), file, (4, 6))
    assert found.count() == 96
    labels = df.select("p", "t", F.posexplode("e").alias("s", "symbol"))
    s = network.scored(found, labels).first()
    value, kind = zip(*(neighbours.patch(e[p], 0, 6, (4, 6), "diagonal") for p in range(2)), strict=True)
    probs = network.probabilities(network.features(np.concatenate(value).reshape(-1, 4, 6), np.concatenate(kind).reshape(-1, 4, 6)), weights)
    own = e.ravel()
    assert s.n == 96 and s.bits == pytest.approx(-np.log2(probs[np.arange(96), own]).mean(), abs=1e-4)
    rank = (probs > probs[np.arange(96), own][:, None]).sum(1)
    assert s.top1 == pytest.approx((rank == 0).mean()) and s.top5 == pytest.approx((rank < 5).mean())
    h = found.select(network.entropy(F.col("probs")).alias("h")).first().h
    assert h == pytest.approx(-(probs[0] * np.log2(probs[0])).sum(), abs=1e-3) or 0 < h <= 8


def test_window_starts_inside(spark):
    df = spark.range(60).select(mantissa.window_start(F.col("id"), 16, 50).alias("w"), "id")
    assert all(r.w == max(0, min(r.id - 8, 34)) for r in df.collect())


def test_samples(spark):
    vol = spark.range(4 * 30 * 40).select(F.floor(F.col("id") / 1200).cast("int").alias("p"), (F.floor(F.col("id") / 40) % 30).cast("int").alias("t"), (F.col("id") % 40).cast("int").alias("s"))
    x = planning.margin_sample(vol, 50, 30, 40).collect()
    assert len({tuple(r) for r in x}) == 50 and all(10 <= r.t < 20 and 10 <= r.s < 30 for r in x)
    rects = spark.createDataFrame([(p, p, 20 + p) for p in range(3)], "p int, left int, right int")
    assert planning.sample_in_rectangles(vol, rects, None).count() == 3 * 20 * 40
    seg = spark.createDataFrame([("a", "train", 0, 1, 7), ("b", "test", 2, 2, 5000)], "segment_id string, split string, seg_start int, seg_end int, n int")
    found = planning.materialise(vol, seg).groupBy("segment_id").count().collect()
    assert {r.segment_id: r["count"] for r in found} == {"a": 7, "b": 1200}


def test_ranges():
    assert planning.parse_ranges("0-2,5") == [(0, 2), (5, 5)]
